"""Chat formatting as prefix trees: conversations that share their first turns share the tokens of those turns.

A node is a turn after given earlier turns. Its text is emitted once, where the depth-first order of all nodes puts it, with position ids that
go on from its parent's and the intervals of that order that it may attend to: its ancestors'. In the order a node's first child follows
it at once, so ancestors join into few intervals. Units are code points, or whatever `length_of` counts.

The depth-first order is the order of the conversations' paths (arrays of turn hashes), sorted over the whole cluster; a tree
that many conversations share is spread over many tasks, and only one path per task is compared across tasks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custlattice.llm.staging import staged

START, STOP = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"


def escape(text: str) -> str:
    """`<|`, and `<` with any backslashes before `|`, gets one more backslash, so that no control string is left."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    """As texts, and a role stays on its line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and where its text begins and ends."""
    head = f"{START}{escape_role(role)}\n"
    body = escape(text)
    return f"{head}{body}{STOP}\n", len(head), len(head) + len(body)


def parse_turn(formatted: str) -> tuple[str, str]:
    role, _, text = formatted[len(START) : -len(STOP) - 1].partition("\n")
    return unescape_role(role), unescape(text)


_TURN = "conv_id bigint, idx bigint, node bigint, parent bigint, formatted string, text_start bigint, text_end bigint, loss boolean, path array<bigint>, lengths array<bigint>"


def _node(before: bytes, formatted: str) -> bytes:
    return hashlib.blake2b(before + formatted.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def formatted_turns(turns: DataFrame) -> DataFrame:
    """One row per turn: conv_id, idx, node, parent and the formatted text; a conversation's last row also has its path of nodes and their lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("idx", pa.int64()), ("node", pa.int64()), ("parent", pa.int64()), ("formatted", pa.string()), ("text_start", pa.int64()), ("text_end", pa.int64()), ("loss", pa.bool_()), ("path", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))])
        out: list[list] = []
        now, idx, key, path, lengths = (), 0, b"", [], []
        held = 0

        def batch(rows: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

        for got in batches:
            for conv, role, text in zip(*(got.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if now != (conv,):
                    if out:
                        out[-1][8:] = [path, lengths]
                    now, idx, key, path, lengths = (conv,), 0, b"", [], []
                if held >= 1 << 22:
                    yield batch(out)
                    out, held = [], 0
                formatted, a, b = format_turn(role or "", text or "")
                parent = int.from_bytes(key[:8], "big", signed=True) if key else None
                key = _node(key, formatted)
                node = int.from_bytes(key[:8], "big", signed=True)
                path.append(node)
                lengths.append(len(formatted))
                out.append([conv, idx, node, parent, formatted, a, b, role == LOSS_ROLE, None, None])
                idx += 1
                held += len(formatted) + 100
        if out:
            out[-1][8:] = [path, lengths]
            yield batch(out)

    rows = turns.select(F.col("conv_id").cast("bigint"), F.col("turn"), F.col("role").cast("string"), F.col("text").cast("string"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, _TURN)


_LAID = "part int, kind int, node bigint, parent bigint, tree bigint, depth int, begin bigint, end bigint, position bigint, attends array<bigint>, path array<bigint>"
_LAID_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
_NODE, _FIRST, _LAST = range(3)


def _joined(intervals: list[int], begin: int, end: int) -> list[int]:
    """Flat, ascending intervals with one more behind them; touching ones become one."""
    if intervals and intervals[-1] == begin:
        return [*intervals[:-1], end]
    return [*intervals, begin, end]


def _laid_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted paths in, new nodes out, placed from 0 in this task. Its first and last path follow, for what lies before this task.

    The first path's row has its nodes' ends in attends, the last path's row its nodes' begins and ends.
    """
    part, cursor = TaskContext.get().partitionId(), 0
    names = [f.split()[0] for f in _LAID.split(", ")]
    stack: list[tuple] = []  # begin, end, position, attends of its children
    now: list[int] = []
    first = None
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _LAID_TYPES, strict=True)], names)
        out.clear()
        return made

    for got in batches:
        for path, lengths in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True):
            same = _common(path, now)
            del stack[same:]
            for depth in range(same, len(path)):
                above = stack[-1] if stack else (0, 0, 0, [])
                begin, end = cursor, cursor + lengths[depth]
                position = above[2] + above[1] - above[0]
                out.append((part, _NODE, path[depth], path[depth - 1] if depth else None, path[0], depth, begin, end, position, above[3], None))
                stack.append((begin, end, position, _joined(above[3], begin, end)))
                cursor = end
            now = path
            if first is None:
                first = (part, _FIRST, None, None, None, None, None, None, None, [s[1] for s in stack], path)
            if len(out) >= 10_000:
                yield batch()
    if first is not None:
        out.append(first)
        out.append((part, _LAST, None, None, None, None, None, cursor, None, [x for s in stack for x in s[:2]], now))
        yield batch()


def _common(a: list[int], b: list[int]) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _places(ends: list) -> dict[int, tuple[int, int, list[int], list[int]]]:
    """For each task: how far its places move, how much of its start repeats what tasks before it placed, and where that was placed.

    ends: the first and the last path of each task, in order; the work is two paths a task.
    """
    found, total = {}, 0
    last_path: list[int] = []
    last_at: list[tuple[int, int]] = []
    for first, last in zip(ends[::2], ends[1::2], strict=True):
        same = _common(first.path, last_path)
        cut = first.attends[same - 1] if same else 0
        old = last_at[:same]
        found[first.part] = (total - cut, cut, first.attends[:same], [x for p in old for x in p])
        move = total - cut
        pairs = zip(last.attends[::2], last.attends[1::2], strict=True)
        last_at = [old[i] if b <= cut else (a + move, b + move) for i, (a, b) in enumerate(pairs)]
        last_path = last.path
        total += last.end - cut
    return found


def _moved(place: tuple[int, int, list[int], list[int]], intervals: list[int]) -> list[int]:
    """A task's own intervals as places in the whole order."""
    move, cut, ends, old = place
    out: list[int] = []
    for a, b in zip(intervals[::2], intervals[1::2], strict=True):
        if a < cut:
            for i, end in enumerate(ends):
                if end <= b:
                    out = _joined(out, old[2 * i], old[2 * i + 1])
            a = cut
        if a < b:
            out = _joined(out, a + move, b + move)
    return out


def prefix_trees(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, uses). nodes: node, parent, tree (its root), depth, begin, end (its place in the depth-first order), position (of its first unit in a
    conversation), attends (flat intervals of its ancestors), formatted, text_start, text_end, loss. uses: conv_id, idx, node.

    turns: conv_id, turn, role, text; other columns are ignored. Null texts and roles count as empty; turns are ordered by turn (null first), then role
    and text, so repeated rows are turns of their own. Rows with a null conv_id are one conversation. No rows give empty tables.
    Loss is taken on the text of turns whose role is LOSS_ROLE.
    """
    rows = staged(formatted_turns(turns), "turns")
    paths = rows.where("path is not null").select(F.element_at("path", -1).alias("leaf"), "path", "lengths")
    paths = paths.dropDuplicates(["leaf"]).select("path", "lengths")
    laid = staged(paths.repartitionByRange("path").sortWithinPartitions("path").mapInArrow(_laid_out, _LAID), "laid-out")
    ends = laid.where(F.col("kind") != _NODE).select("part", "kind", "attends", "path", "end").orderBy("part", "kind").collect()
    places = turns.sparkSession.sparkContext.broadcast(_places(ends))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                place = places.value[x["part"]]
                if x["end"] > place[1]:
                    x["begin"] += place[0]
                    x["end"] += place[0]
                    x["attends"] = _moved(place, x["attends"])
                    del x["part"]
                    out.append(x)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    kinds = "node bigint, parent bigint, tree bigint, depth int, begin bigint, end bigint, position bigint, attends array<bigint>"
    schema = pa.schema([(f.split()[0], t) for f, t in zip(kinds.split(", "), _LAID_TYPES[2:10], strict=True)])
    placed = laid.where(F.col("kind") == _NODE).select("part", *schema.names).mapInArrow(run, kinds)
    texts = rows.select("node", "formatted", "text_start", "text_end", "loss").dropDuplicates(["node"])
    nodes = staged(placed.join(texts, "node"), "nodes")
    return nodes, rows.select("conv_id", "idx", "node")


_READ = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def read_back(nodes: DataFrame, uses: DataFrame) -> DataFrame:
    """Per conversation, from the formatted nodes alone: its turns' digest, and its loss text's length and digest, both unescaped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _READ.split(", ")]
        out: list[tuple] = []
        now = None

        def close() -> None:
            conv, n, turns, chars, loss, formatted = now
            out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted))

        for batch in batches:
            for conv, text, a, b, loss in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5)), strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        close()
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, said = parse_turn(text)
                now[1] += 1
                now[2].update(f"{role}\n{said}\n".encode())
                if loss:
                    said = unescape(text[a:b])
                    now[3] += len(said)
                    now[4].update(said.encode())
                now[5] += len(text)
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=schema)
                out = []
        if now is not None:
            close()
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=schema)

    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    rows = uses.join(nodes.select("node", "formatted", "text_start", "text_end", "loss"), "node")
    rows = rows.select("conv_id", "idx", "formatted", "text_start", "text_end", "loss")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "idx").mapInArrow(run, _READ)
