"""Merkle manifest of a dataset as a postorder append log.

Leaves of a tree are its rows in order; every FAN consecutive nodes have a parent until one node is left. A builder is one aligned subtree of FAN^HEIGHT
leaves: it takes them in order and appends each node when it is complete, so its part of the log is the subtree in postorder. The roots of
the builders are the leaves of the next round, which is that many times smaller. Where a node stands in the log follows from the sizes
of complete subtrees alone (`position`), so the siblings of a proof are addressed without a search. Trees are named by a
number; the roots of all trees are the leaves of one more tree, whose root stands for the dataset.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custlattice.llm.order import numbered
from custlattice.llm.staging import staged

FAN = 8
#: Levels above the leaves of a builder.
HEIGHT = 3
#: Leaves of a builder.
BLOCK = FAN**HEIGHT
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def encoded(column):
    """`-` for null, else the number of UTF-8 bytes, a colon, the value."""
    text = column.cast("string")
    return F.when(column.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(*columns):
    return F.unhex(F.sha2(F.concat(*map(encoded, columns)).cast("binary"), 256))


def joined(digests: list[bytes]) -> bytes:
    """Digest of the concatenated hex texts of digests."""
    return hashlib.sha256(b"".join(digests).hex().encode()).digest()


def height(n: int) -> int:
    """Levels above n leaves until one node is left."""
    out = 0
    while n > 1:
        n, out = -(-n // FAN), out + 1
    return out


def position(n: int, level: int, index: np.ndarray, top: int | None = None) -> np.ndarray:
    """Place in the postorder log of the nodes `index` of a level, for a tree of n leaves and `top` levels (by default until one node is left).

    In front of a node stand the subtrees of all earlier siblings on its path, which are complete, and its own subtree.
    """
    index = np.asarray(index, dtype=np.int64)
    own = np.minimum(FAN**level, n - index * FAN**level)
    place = sum(-(-own // FAN**i) for i in range(level + 1)) - 1
    for i in range(level, height(n) if top is None else top):
        place = place + index // FAN ** (i - level) % FAN * ((FAN ** (i + 1) - 1) // (FAN - 1))
    return place


def appended(leaves: list[bytes], levels: int) -> Iterator[tuple[int, int, bytes]]:
    """(level, index, digest) of an aligned subtree's nodes in the order in which they are complete."""
    waiting: list[list[bytes]] = [[] for _ in range(levels + 1)]
    index = [0] * (levels + 1)
    for i, digest in enumerate(leaves):
        level, last = 0, i == len(leaves) - 1
        while True:
            yield level, index[level], digest
            index[level] += 1
            waiting[level].append(digest)
            if level == levels or not (last or len(waiting[level]) == FAN):
                break
            digest, waiting[level] = joined(waiting[level]), []
            level += 1


def _levels(n: int) -> int:
    return HEIGHT if n > BLOCK else height(n)


_LOG = "tree bigint, block bigint, n bigint, pos bigint, level int, index bigint, digest binary"


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes sorted by tree and idx in; the builders' parts of the log out."""

    def nodes() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    for (tree, block, n), rows in groupby(nodes(), key=lambda r: r[:3]):  # at most BLOCK rows
        out = list(appended([r[3] for r in rows], _levels(n)))
        level, index, digest = zip(*out, strict=True)
        same = len(out)
        yield pa.RecordBatch.from_arrays(
            [pa.array([tree] * same), pa.array([block] * same), pa.array([n] * same), pa.array(range(same)), pa.array(level, pa.int32()), pa.array(index), pa.array(digest)],
            [c.split()[0] for c in _LOG.split(", ")],
        )


def build(nodes: DataFrame) -> tuple[list[tuple[DataFrame, DataFrame]], DataFrame]:
    """For leaves (tree, idx, n, digest) of any number of trees (n: leaves of the tree) the rounds (nodes, log) and the roots (tree, digest)."""
    rounds, roots = [], None
    while True:
        nodes = nodes.withColumn("block", F.floor(F.col("idx") / BLOCK))
        keys = ["tree", "block"]
        narrow = nodes.select("tree", "block", "n", "digest", "idx").repartition(*keys).sortWithinPartitions(*keys, "idx")
        log = staged(narrow.mapInArrow(_built, _LOG), "merkle-log")
        rounds.append((nodes, log))
        last = F.struct("pos", "digest")
        tops = staged(log.groupBy(*keys).agg(F.max("n").alias("n"), F.max(last).alias("last")).select(*keys, "n", F.col("last.digest").alias("digest")), "merkle-tops")
        done = tops.where(F.col("n") <= BLOCK).select("tree", "digest")
        roots = done if roots is None else roots.unionByName(done)
        tops = tops.where(F.col("n") > BLOCK)
        if tops.isEmpty():
            return rounds, roots
        nodes = tops.select("tree", F.col("block").alias("idx"), F.ceil(F.col("n") / BLOCK).alias("n"), "digest")


def log_rows(rounds: list[tuple[DataFrame, DataFrame]], sizes: DataFrame) -> DataFrame:
    """(tree, pos, level, index, digest): the whole log; pos is the place in the tree's postorder, closed-form. sizes: (tree, leaves)."""
    out = None
    for r, (_, log) in enumerate(rounds):
        rows = log if r == 0 else log.where("level > 0")  # leaves of a later round are written already
        up = F.col("level") + HEIGHT * r
        index = F.col("block") * F.lit(FAN).cast("bigint") ** (HEIGHT - F.col("level")) + F.col("index")
        rows = rows.select("tree", up.alias("level"), index.cast("bigint").alias("index"), "digest")
        out = rows if out is None else out.unionByName(rows)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves, level, index = (batch.column(i).to_numpy(zero_copy_only=False) for i in (4, 1, 2))
            pos = np.zeros(batch.num_rows, np.int64)
            for n in np.unique(leaves).tolist():
                for x in np.unique(level[leaves == n]).tolist():
                    at = (leaves == n) & (level == x)
                    pos[at] = position(n, x, index[at])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pos), *batch.columns[1:4]], ["tree", "pos", "level", "index", "digest"])

    kind = "tree bigint, pos bigint, level int, index bigint, digest binary"
    return out.join(sizes, "tree").select("tree", "level", "index", "digest", "leaves").mapInArrow(placed, kind)


def steps(path: bytes) -> list[tuple[int, list[bytes]]]:
    """A path's steps from below to the root: place among the siblings, and the other siblings. Encoded as one byte each for place and number, then digests."""
    out, i = [], 0
    while i < len(path):
        at, n = path[i], path[i + 1]
        out.append((at, [path[i + 2 + 32 * j : i + 34 + 32 * j] for j in range(n)]))
        i += 2 + 32 * n
    return out


def fold(digest: bytes, path: list[tuple[int, list[bytes]]]) -> bytes:
    """The root that a leaf and the siblings of its path give."""
    for at, others in path:
        digest = joined([*others[:at], digest, *others[at:]])
    return digest


def _own_steps(log: list[bytes], index: list[int], n: int, levels: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Steps of the leaves `index` inside one builder's subtree of n leaves, read from its part of the log."""
    runs: list[list[list[bytes]]] = []
    for level in range(levels):
        nodes = position(n, level, np.arange(-(-n // FAN**level)), levels).tolist()
        digests = [log[p] for p in nodes]
        runs.append([digests[i : i + FAN] for i in range(0, len(digests), FAN)])
    for i in index:
        out = []
        for level in range(levels):
            i, at = divmod(i, FAN)
            run = runs[level][i]
            out.append((at, run[:at] + run[at + 1 :]))
        yield out


def _with_paths(nodes: DataFrame, log: DataFrame, above: DataFrame, rest: list[str], out, kind: str) -> DataFrame:
    """Cogroups nodes (tree, block, idx, n, columns `rest`) with their builder's log and the path above it (tree, block, path); `out` makes the rows."""
    known = log.select("tree", "block", "pos", "digest").unionByName(above.select("tree", "block", F.lit(-1).cast("bigint").alias("pos"), F.col("path").alias("digest")))

    def run(node: pa.Table, logged: pa.Table) -> pa.Table:
        if not node.num_rows:
            return pa.table([pa.array([], f.type) for f in empty], schema=empty)
        logged = logged.sort_by("pos")
        path, *digests = logged.column("digest").to_pylist()
        node = node.sort_by("idx")
        size, first = node.column("n")[0].as_py(), node.column("block")[0].as_py() * BLOCK
        index = [i - first for i in node.column("idx").to_pylist()]
        own = _own_steps(digests, index, min(BLOCK, size - first), _levels(size))
        return out(node, own, path)

    columns = ["tree", "block", "idx", "n", *rest]
    keys = ["tree", "block"]
    empty = _arrow(kind)
    return nodes.select(*columns).groupBy(*keys).cogroup(known.groupBy(*keys)).applyInArrow(run, kind)


def _arrow(kind: str) -> pa.Schema:
    types = {"bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}
    return pa.schema([(c.split()[0], types[c.split()[1]]) for c in kind.split(", ")])


def _encode(path: list[tuple[int, list[bytes]]]) -> bytes:
    return b"".join(bytes((at, len(others))) + b"".join(others) for at, others in path)


_PATH = "tree bigint, idx bigint, path binary"


def _paths(node: pa.Table, own, above: bytes) -> pa.Table:
    return pa.table([node.column("tree"), node.column("idx"), pa.array([_encode(o) + above for o in own], pa.binary())], schema=_arrow(_PATH))


def above_builders(rounds: list[tuple[DataFrame, DataFrame]], roots: DataFrame) -> DataFrame:
    """(tree, block, path): from each builder of the first round to the dataset's root. roots: (tree, path) above the trees' roots."""
    lower = None
    for r in range(len(rounds) - 1, -1, -1):
        single = rounds[r][0].where((F.col("n") <= BLOCK) & (F.col("idx") == 0)).select("tree", F.lit(0).cast("bigint").alias("block"))
        here = single.join(roots, "tree").select("tree", "block", "path")
        here = here if lower is None else here.unionByName(lower)
        if r == 0:
            return here
        found = staged(_with_paths(*rounds[r], here, [], _paths, _PATH), "merkle-paths")
        lower = found.select("tree", F.col("idx").alias("block"), "path")


_PROOF = "doc_id bigint, tree bigint, leaf binary, proof_sha256 binary, folded_root binary"


def _proofs(node: pa.Table, own, above: bytes) -> pa.Table:
    upper = steps(above)
    tail = b"".join(b"".join(others) for _, others in upper).hex().encode()
    proofs, folded = [], []
    for steps_, leaf in zip(own, node.column("found").to_pylist(), strict=True):
        head = b"".join(b"".join(others) for _, others in steps_).hex().encode()
        proofs.append(hashlib.sha256(head + tail).digest())
        folded.append(fold(leaf, [*steps_, *upper]))
    columns = [node.column("doc_id"), node.column("tree"), node.column("digest"), pa.array(proofs, pa.binary()), pa.array(folded, pa.binary())]
    return pa.table([c.cast(f.type) for c, f in zip(columns, _arrow(_PROOF), strict=True)], schema=_arrow(_PROOF))


def manifest(docs: DataFrame, found=None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): one row per row of docs, digests as lower-case hex.

    A leaf is the digest of the columns FIELDS, null and empty told apart; one tree per lang (null is one of them, the first), leaves by doc_id
    (null first, then by digest, so repeated rows are neighbours), roots by lang. proof_sha256: digest of all siblings on the way from leaf to root.
    found: the text as it is found later, a column over docs (by default the text itself); folded_root is what the proof gives for it and
    verified says whether that is the root. Other columns are ignored; an empty table has no rows.
    """
    own = [F.col(c) for c in FIELDS]
    leaf = leaf_hash(*own)
    later = leaf if found is None else F.when(found.eqNullSafe(F.col("text")), leaf).otherwise(leaf_hash(*own[:-1], found))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), leaf.alias("digest"), later.alias("found"))
    rows = numbered(staged(rows, "leaves"), ["lang", "doc_id", "digest", "found"], "leaves-in-order")
    trees = rows.groupBy("lang").agg(F.min("place").alias("tree"), F.count("*").alias("n"))
    trees = staged(numbered(trees, ["tree"], "trees").withColumnRenamed("place", "idx"), "trees")
    of = trees.select(F.col("lang").alias("_lang"), "tree", "n")
    nodes = rows.join(of, rows["lang"].eqNullSafe(of["_lang"])).select("doc_id", "tree", (F.col("place") - F.col("tree")).alias("idx"), "n", "digest", "found")
    nodes = staged(nodes, "merkle-leaves")
    rounds, roots = build(nodes)
    subroots = trees.join(roots, "tree").select("tree", "idx", "digest")
    langs = trees.count()
    top_nodes = staged(subroots.select(F.lit(0).cast("bigint").alias("tree"), "idx", F.lit(langs).cast("bigint").alias("n"), "digest", F.col("tree").alias("of")), "subroots")
    top_rounds, top = build(top_nodes)
    root = top.first()
    root = bytes(root["digest"]) if root else b""
    spark = docs.sparkSession
    highest = above_builders(top_rounds, spark.createDataFrame([(0, b"")], "tree bigint, path binary"))
    found_paths = _with_paths(*top_rounds[0], highest, [], _paths, _PATH).select("idx", "path")
    paths = staged(trees.join(found_paths, "idx").select("tree", "path"), "tree-paths")
    proofs = _with_paths(*rounds[0], above_builders(rounds, paths), ["doc_id", "digest", "found"], _proofs, _PROOF)
    known = top_nodes.select(F.col("of").alias("tree"), F.col("digest").alias("subroot"))
    text = lambda c: F.lower(F.hex(c))
    return proofs.join(known, "tree").select(
        "doc_id", text("leaf").alias("leaf"), text("subroot").alias("subroot"), text(F.lit(root)).alias("root"),
        text("proof_sha256").alias("proof_sha256"), text("folded_root").alias("folded_root"), (F.col("folded_root") == F.lit(root)).alias("verified"),
    )
