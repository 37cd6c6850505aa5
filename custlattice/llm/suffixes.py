"""Repeated passages by a sparse suffix array.

Retained suffixes start at minimisers: the smallest hash of 11 consecutive words in each window of 40 such positions, so every passage of
50 words belongs to one that depends on its own words alone. Equal texts are taken once. Suffixes whose first 11 words occur once are
dropped; each of the others is one row with the words to its right and left that its passages have. The rows are sorted by minimiser and the
words to the right, neighbours are compared and their match is extended in both directions, which tells all passages that the two share.

Three or more suffixes can agree to the right and differ to the left, so that two that share a passage are no neighbours. Such passages, and those of a
minimiser with very many suffixes, are sorted once more, by minimiser and a hash of the whole passage; then equal ones are neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custlattice.llm.order import led
from custlattice.llm.staging import staged
from custlattice.llm.tokens import Words, grams, signed, slices, text_bytes, words

#: Words of the shortest passage that counts as repeated.
PASSAGE = 50
#: Words of a minimiser's own hash.
SEED = 11
WINDOW = PASSAGE - SEED + 1
#: Bits of the broadcast maps of minimisers, as a power of two: 8 MB each, whatever the input. Beyond it more suffixes
#: are sorted than need be (at most all: one for about 20 words), with the same result.
MAP_BITS = 26
#: Suffixes of one minimiser compared as neighbours; with more, all its passages are sorted by their hash.
HOT = 512
#: Rows handled at once.
ROWS = 1 << 14
#: Stands for a null doc_id, which is the last in the order of documents.
NO_ID = 2**63 - 1

_ID = ["doc_id", "copy"]


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, copy, text: copy tells rows of one doc_id with different texts apart."""
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("copy"),
        F.col("text").cast("string").alias("text"),
    )


def distinct_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of each text the row with the smallest doc_id (null is last), with `copied`, whether it has others; and the others: (doc_id, copy, of).

    Groups are found on digests. Only texts that may have copies, by a map of hashes, are shuffled to learn their part.
    """
    rows = _keyed(docs)
    digest = F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    ids = rows.select("doc_id", "copy", digest.alias("digest")).distinct()
    found = led(staged(ids, "text-ids"), "digest", "doc_id", [F.col("doc_id").asc_nulls_last(), "copy"], "text-leaders")
    others = staged(found.where(~F.col("leads")).select("doc_id", "copy", "of"), "text-copies")
    parts = others.select("doc_id", "copy", F.lit(False).alias("first")).unionByName(others.select(F.col("of").alias("doc_id"), "copy", F.lit(True).alias("first")).distinct())
    sent = docs.sparkSession.sparkContext.broadcast(_maps(others.select(F.xxhash64("copy").alias("key")))[0])

    @F.arrow_udf("boolean")
    def copied(key: pa.Array) -> pa.Array:
        return pa.array(_marked(sent.value, key.to_numpy(zero_copy_only=False).view(np.uint64)))

    rows = rows.withColumn("_maybe", copied(F.xxhash64("copy")))
    known = parts.select(F.col("doc_id").alias("_doc_id"), F.col("copy").alias("_copy"), "first").hint("shuffle_hash")
    joined = rows.where("_maybe").join(known, (F.col("copy") == F.col("_copy")) & F.col("doc_id").eqNullSafe(F.col("_doc_id")), "left")
    some = joined.where(F.coalesce("first", F.lit(True))).select("doc_id", "copy", "text", F.col("first").isNotNull().alias("copied"))
    alone = rows.where(~F.col("_maybe")).select("doc_id", "copy", "text", F.lit(False).alias("copied"))
    return alone.unionByName(staged(some, "copied-texts")), others


def minimisers(hashes: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of passages of PASSAGE words within one row, the position of each one's minimiser, and the hashes of all seeds."""
    h = grams(hashes, SEED)
    n = len(h) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), h
    least, width = np.arange(len(h)), 1  # the leftmost smallest hash of `width` positions from each one
    while width < WINDOW:
        step = min(width, WINDOW - width)
        a, b = least[: len(least) - step], least[step:]
        least = np.where(h[b] < h[a], b, a)
        width += step
    start = np.flatnonzero(w.left_in_row[:n] >= PASSAGE)
    return start, least[start], h


def _keys(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, raw, off in slices(batch, "text"):
                w = words(raw, off)
                _, at, seeds = minimisers(w.hashes, w)
                yield pa.RecordBatch.from_arrays([pa.array(signed(seeds[np.unique(at)]))], ["key"])

    return docs.select("text").mapInArrow(run, "key bigint")


def _maps(keys: DataFrame, least: int = 1, hot: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """A bit for each group of keys that holds one that occurs `least` times or more, and for each that holds one that occurs more than `hot` times."""
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - MAP_BITS}) & 63 as int))")
    rows = (
        keys.groupBy("key").count().where(F.col("count") >= least)
        .select(F.shiftrightunsigned("key", 64 - MAP_BITS + 6).cast("int").alias("at"), bit.alias("bit"), F.when(F.col("count") > hot, bit).otherwise(F.lit(0)).alias("hot"))
        .groupBy("at").agg(F.bit_or("bit").alias("bits"), F.bit_or("hot").alias("hot"))
    ).toArrow()
    out = np.zeros((2, 1 << (MAP_BITS - 6)), dtype=np.int64)
    out[0, rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    out[1, rows.column("at").to_numpy()] = rows.column("hot").to_numpy()
    return out[0].view(np.uint64), out[1].view(np.uint64)


def _marked(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    return (bits[key >> np.uint64(64 - MAP_BITS + 6)] >> ((key >> np.uint64(64 - MAP_BITS)) & np.uint64(63)) & np.uint64(1)) == 1


_SUFFIX = "key bigint, passage bigint, right binary, left binary, doc_id bigint, copy bigint, pos bigint"


def _binary(data: bytes, offsets: np.ndarray) -> pa.Array:
    array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
    return array.cast(pa.binary())


def _slices(values: np.ndarray, start: np.ndarray, n: np.ndarray, step: int) -> pa.Array:
    """values[start], values[start + step], ... n of them per row, as bytes that sort like the numbers."""
    ends = np.cumsum(n)
    at = np.repeat(start, n) + step * (np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n))
    return _binary(values[at].astype(">u4").tobytes(), 4 * np.concatenate([[0], ends]))


def suffixes(texts: DataFrame, hot: int = HOT) -> DataFrame:
    """The retained suffixes of distinct texts (see `distinct_texts`): key, right, left, doc_id, copy, pos (in words, of the minimiser).

    right, left: hashes of the words after and before pos, outwards, as far as passages with this minimiser reach. Of keys with very many suffixes
    each passage has a row instead: key, passage (hash), doc_id, copy, pos (its first word). A text that has copies and PASSAGE words or
    more has one row without key and passage; its pos is the number of words.
    """
    sent = texts.sparkSession.sparkContext.broadcast(_maps(_keys(texts), 2, hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated, frequent = sent.value

        def rows_of(part, row, key, passage, right, left, pos):
            at, n = pa.array(row), len(row)
            none = pa.nulls(n, pa.int64())
            columns = [none if key is None else pa.array(signed(key)), none if passage is None else pa.array(signed(passage))]
            columns += [pa.nulls(n, pa.binary()) if x is None else x for x in (right, left)]
            return pa.RecordBatch.from_arrays([*columns, part.column(0).take(at), part.column(1).take(at), pa.array(pos)], [c.split()[0] for c in _SUFFIX.split(", ")])

        for batch in batches:
            for part, raw, off in slices(batch, "text"):
                w = words(raw, off)
                hashes = w.hashes
                size = np.diff(w.rows)
                row = np.flatnonzero(part.column(3).to_numpy(zero_copy_only=False) & (size >= PASSAGE))
                if len(row):
                    yield rows_of(part, row, None, None, None, None, size[row])
                start, at, seeds = minimisers(hashes, w)
                hit = _marked(repeated, seeds[at])
                start, at = start[hit], at[hit]
                if not len(start):
                    continue
                row = np.searchsorted(w.rows, start, "right") - 1
                many = _marked(frequent, seeds[at])
                if many.any():
                    yield rows_of(part, row[many], seeds[at[many]], grams(hashes, PASSAGE)[start[many]], None, None, (start - w.rows[row])[many])
                start, at, row = start[~many], at[~many], row[~many]
                if not len(start):
                    continue
                # passages of one minimiser begin at consecutive words
                first = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (row[1:] != row[:-1])))
                low, high = start[first], start[np.append(first[1:], len(start)) - 1]
                at, row = at[first], row[first]
                short = (hashes >> np.uint64(32)).astype(np.uint32)
                right = _slices(short, at, high + PASSAGE - at, 1)
                left = _slices(short, at - 1, at - low, -1)
                yield rows_of(part, row, seeds[at], None, right, left, at - w.rows[row])

    return texts.select("doc_id", "copy", "text", "copied").mapInArrow(run, _SUFFIX)


def common_words(a: bytes, b: bytes) -> int:
    """Equal 32-bit words at the start of both."""
    n = min(len(a), len(b)) & ~3
    if a[:n] == b[:n]:
        return n >> 2
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return (8 * n - x.bit_length()) >> 5


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= ROWS:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


def _columns(block: pa.Table, *names: str) -> list[np.ndarray]:
    return [block.column(n).combine_chunks().fill_null(NO_ID).to_numpy(zero_copy_only=False) for n in names]


_COMPARED = "key bigint, passage bigint, doc_id bigint, copy bigint, pos bigint, last bigint, is_first boolean, first_doc bigint"


def _neighbours(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Whole keys of suffixes, sorted by key, right, doc_id, copy and pos, in; see `compared`."""
    key, doc, copy, pos = _columns(rows, "key", "doc_id", "copy", "pos")
    right, left = rows.column("right").to_pylist(), rows.column("left").to_pylist()
    n = len(key)
    same = key[1:] == key[:-1]
    r, x = np.zeros(n, np.int64), np.zeros(n, np.int64)  # words that a row shares with the next one to the right and left
    for i in np.flatnonzero(same).tolist():
        r[i] = common_words(right[i], right[i + 1])
        x[i] = common_words(left[i], left[i + 1])
    reach = np.array([len(b) // 4 for b in left])
    least = PASSAGE - np.array([len(b) // 4 for b in right])
    # cells: by words to the left of the minimiser, then rows
    l = np.arange(WINDOW)[:, None]  # noqa: E741
    have = (l >= least) & (l <= reach)
    alike = r >= PASSAGE - l  # the words to the right, with the next row
    match = alike & (x >= l)
    apart = (alike & ~match).ravel()
    start = np.ones((WINDOW, n), dtype=bool)
    start[:, 1:] = ~match[:, :-1]
    begin = np.flatnonzero(start.ravel())
    run = np.cumsum(start.ravel()) - 1
    end = np.append(begin[1:], WINDOW * n) - 1
    before = (begin % n > 0) & apart[begin - 1]
    after = apart[end]
    # three runs or more with the same words to the right: the first and the third may be equal
    unsure = (before & after) | (before & np.append(False, before[:-1])) | (after & np.append(after[1:], False))
    order = np.lexsort((pos, copy, doc))
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    leader = np.minimum.reduceat(np.tile(rank, WINDOW), begin)
    sure = ((end > begin) & ~unsure)[run].reshape(WINDOW, n) & have
    # ranges of passages of a row that have the same first occurrence
    leader = leader[run].reshape(WINDOW, n)
    cells = sure.T.ravel()
    at = np.flatnonzero(cells)
    if len(at):
        row, words_left, first = at // WINDOW, at % WINDOW, leader.T.ravel()[at]
        new = np.append(True, (row[1:] != row[:-1]) | (words_left[1:] != words_left[:-1] + 1) | (first[1:] != first[:-1]))
        a = np.flatnonzero(new)
        b = np.append(a[1:], len(at)) - 1
        yield _pieces(rows, row[a], pos[row[a]] - words_left[b], pos[row[a]] - words_left[a], rank[row[a]] == first[a], doc[order[first[a]]])
    words_left, row = np.nonzero(unsure[run].reshape(WINDOW, n) & have)
    if len(row):
        digest = xxhash.xxh64_intdigest
        passage = [digest(left[i][: 4 * k] + b"|" + right[i][: 4 * (PASSAGE - k)]) for i, k in zip(row.tolist(), words_left.tolist(), strict=True)]
        yield _pieces(rows, row, pos[row] - words_left, None, None, None, np.array(passage, dtype=np.uint64).view(np.int64))


def _pieces(rows: pa.Table, row, start, last, is_first, first_doc, passage=None) -> pa.RecordBatch:
    at, n = pa.array(row), len(row)
    key, doc, copy = (rows.column(c).combine_chunks().take(at) for c in ("key", "doc_id", "copy"))
    none = pa.nulls(n, pa.int64())
    columns = [key, none if passage is None else pa.array(passage), doc, copy, pa.array(start)]
    columns += [none, pa.nulls(n, pa.bool_()), none] if last is None else [pa.array(last), pa.array(is_first), pa.array(first_doc)]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _COMPARED.split(", ")])


def compared(retained: DataFrame) -> DataFrame:
    """Neighbours of the suffix array extended to both sides.

    Passages that begin at the words pos to last of a text and occur in several places, all neighbours: is_first and first_doc as in `matches`. Passages whose equals need
    not be neighbours: key, passage (hash), doc_id, copy, pos. A key's suffixes are few (`HOT`), so they are compared by one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for block in _blocks(batches):
            rows = block if held is None else pa.concat_tables([held, block])
            key = _columns(rows, "key")[0]
            cut_at = int(np.searchsorted(key, key[-1], "left"))  # the last key may go on
            if cut_at:
                yield from _neighbours(_once(rows.slice(0, cut_at)))
            held = rows.slice(cut_at)
        if held is not None:
            yield from _neighbours(_once(held))

    order = ["key", "right", F.col("doc_id").asc_nulls_last(), "copy", "pos"]
    rows = retained.select("key", "right", "left", "doc_id", "copy", "pos").repartition("key").sortWithinPartitions(*order)
    return rows.mapInArrow(run, _COMPARED)


def _once(rows: pa.Table) -> pa.Table:
    """Without repeated rows of a document, which are neighbours."""
    values = _columns(rows, "key", "doc_id", "copy", "pos")
    values.append(rows.column("doc_id").combine_chunks().is_null().to_numpy(zero_copy_only=False))
    keep = np.logical_or.reduce([np.append(True, v[1:] != v[:-1]) for v in values])
    return rows if keep.all() else rows.filter(pa.array(keep))


_MATCH = "part int, head boolean, edge int, alone boolean, key bigint, passage bigint, doc_id bigint, copy bigint, pos bigint, is_first boolean, first_doc bigint"
_PLACE = ["key", "passage", "doc_id", "copy", "pos"]


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted passages in, those that occur at two places or more out, each with its first one's document.

    head: equals of the partition's first passage. edge 1 and 2: the first of the equals of the partition's first and last passage, to be
    compared across partitions; alone: it has no equal in the partition.
    """
    part = TaskContext.get().partitionId()
    held: pa.Table | None = None  # the row before, whose next one is not known yet
    held_new, lead, groups, sizes = True, None, 0, [0, 0]  # sizes: rows of the first and last group
    first: pa.Table | None = None

    def marked(rows: pa.Table, head, edge: int, alone, is_first, first_doc) -> list[pa.RecordBatch]:
        n = rows.num_rows
        columns = [np.full(n, part, np.int32), head, np.full(n, edge, np.int32), np.full(n, alone), *(rows.column(c) for c in _PLACE), is_first, first_doc]
        return pa.table([c if isinstance(c, pa.ChunkedArray) else pa.array(c) for c in columns], names=[c.split()[0] for c in _MATCH.split(", ")]).to_batches()

    for block in _blocks(batches):
        block = block.select(_PLACE)
        rows = block if held is None else pa.concat_tables([held, block])
        values = [*_columns(rows, *_PLACE), rows.column("doc_id").combine_chunks().is_null().to_numpy(zero_copy_only=False)]
        change = [np.append(True, c[1:] != c[:-1]) for c in values]
        keep = np.logical_or.reduce(change)  # repeated rows of a document are one
        new = (change[0] | change[1])[keep]
        new[0] = held_new
        rows, doc = rows.filter(pa.array(keep)), values[2][keep]
        starts = np.flatnonzero(new)
        number = groups + np.cumsum(new)
        leaders = np.concatenate([[NO_ID if lead is None else _columns(lead, "doc_id")[0][0]], doc[starts]])[np.cumsum(new)]
        out = np.append(~new[:-1] | ~new[1:], False)  # of the last row when the next one is known
        if out.any():
            yield from marked(rows.filter(pa.array(out)), number[out] == 1, 0, False, new[out], leaders[out])
        if first is None:
            first = rows.slice(0, 1)
        if len(starts):
            lead = rows.slice(int(starts[-1]), 1)
        sizes[0] += int((number[:-1] == 1).sum())
        sizes[1] = (sizes[1] if number[0] == number[-1] else 0) + int((number[:-1] == number[-1]).sum())
        held, held_new, groups = rows.slice(rows.num_rows - 1, 1), bool(new[-1]), int(number[-1]) - int(new[-1])
    if held is None:
        return
    number = groups + int(held_new)
    if not held_new:
        yield from marked(held, np.array([number == 1]), 0, False, np.array([False]), _columns(lead, "doc_id")[0])
    alone = [sizes[0] + (number == 1) == 1, sizes[1] == 0]
    for edge, row in ((1, first), (2, lead)):
        yield from marked(row, np.array([False]), edge, alone[edge - 1], np.array([False]), _columns(row, "doc_id")[0])


def matches(retained: DataFrame) -> DataFrame:
    """(doc_id, copy, pos, is_first, first_doc): passages of PASSAGE words from pos that occur at two places or more.

    first_doc: the document of the first of its equals, in the order of doc_id (null, here NO_ID, is last), copy and pos.
    """
    order = ["key", "passage", F.col("doc_id").asc_nulls_last(), "copy", "pos"]
    found = staged(retained.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_matched, _MATCH), "runs")
    ends = sorted(found.where("edge > 0").collect(), key=lambda x: (x.part, x.edge))  # two rows a partition
    added: list[tuple] = []
    into: dict[int, int] = {}
    open_, alone = None, False  # the first of the equals that the last partition ended with
    for a, b in zip(ends[::2], ends[1::2], strict=True):
        if open_ is not None and (open_.key, open_.passage) == (a.key, a.passage):
            into[a.part] = open_.first_doc
            added += [(x.doc_id, x.copy, x.pos, x is open_, open_.first_doc) for x, single in ((open_, alone), (a, a.alone)) if single]
            alone = False
            if (b.key, b.passage) == (a.key, a.passage):
                continue
        open_, alone = b, b.alone
    inner = found.where("edge = 0").select("part", "head", *_ID, "pos", "is_first", "first_doc")
    spark = retained.sparkSession
    if into:
        renamed = spark.createDataFrame(pa.table({"part": pa.array(list(into), pa.int32()), "into": list(into.values())}))
        inner = inner.join(F.broadcast(renamed), "part", "left")
        moved = F.col("head") & F.col("into").isNotNull()
        inner = inner.withColumns({"is_first": F.col("is_first") & ~moved, "first_doc": F.when(moved, F.col("into")).otherwise(F.col("first_doc"))})
    inner = inner.select(*_ID, "pos", "is_first", "first_doc")
    if added:
        kinds = [pa.int64()] * 3 + [pa.bool_(), pa.int64()]
        more = pa.table({n: pa.array(c, t) for n, c, t in zip(inner.columns, zip(*added, strict=True), kinds, strict=True)})
        inner = inner.unionByName(spark.createDataFrame(more))
    return inner


_SPAN = "doc_id bigint, copy bigint, start_word bigint, end_word bigint, is_first boolean, first_doc_id bigint"


def _islands(start: np.ndarray, first_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and smallest first_doc of the unions of passages that begin at `start` (sorted)."""
    if not len(start):
        return start, start, first_doc
    begin = np.flatnonzero(np.append(True, np.diff(start) > PASSAGE))
    return start[begin], start[np.append(begin[1:], len(start)) - 1] + PASSAGE, np.minimum.reduceat(first_doc, begin)


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of passages sorted by document and position in; the spans of repeated_spans out.

    A row with `words` says that the text has copies, so all its passages occur again; it also gives one span of all words without is_first.
    """

    def passages(rows: pa.Table, new: np.ndarray) -> tuple[pa.Table, np.ndarray, Iterator[pa.RecordBatch]]:
        """One row per passage, and the spans of all words."""
        low, high, first_doc, doc, size = _columns(rows, "pos", "last", "first_doc", "doc_id", "words")
        is_first = rows.column("is_first").combine_chunks().fill_null(False).to_numpy(zero_copy_only=False)
        of = np.cumsum(new) - 1
        whole = np.flatnonzero(size != NO_ID)
        n = np.where(size == NO_ID, high - low + 1, size - PASSAGE + 1)
        row = np.repeat(np.arange(len(n)), n)
        pos = np.repeat(np.where(size == NO_ID, low, 0), n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        added = size[row] != NO_ID
        order = np.lexsort((added, pos, of[row]))  # what was found comes before what copies alone tell
        row, pos, added = row[order], pos[order], added[order]
        again = np.append(False, (of[row][1:] == of[row][:-1]) & (pos[1:] == pos[:-1]))
        row, pos, added = row[~again], pos[~again], added[~again]
        first = np.where(added, doc[row], first_doc[row])
        starts = np.append(True, of[row][1:] != of[row][:-1])
        made = pa.table([*(rows.column(c).combine_chunks().take(pa.array(row)) for c in _ID), pos, is_first[row] | added, first], names=[*_ID, "pos", "is_first", "first_doc"])
        least = np.full(int(of[-1]) + 1, NO_ID)
        np.minimum.at(least, of[row], first)
        named, end = least[of[whole]], size[whole]
        at = pa.array(whole)
        all_words = [pa.array(np.zeros(len(whole), np.int64)), pa.array(end), pa.nulls(len(whole), pa.bool_()), pa.array(named, mask=named == NO_ID)]
        return made, starts, pa.RecordBatch.from_arrays([*(rows.column(c).combine_chunks().take(at) for c in _ID), *all_words], [c.split()[0] for c in _SPAN.split(", ")])

    def inside(point: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return np.searchsorted(start, point, "right") > np.searchsorted(end, point, "right")

    def spans(rows: pa.Table, new: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows, new, all_words = passages(rows, new)
        yield all_words
        pos, is_first, first_doc = (rows.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("pos", "is_first", "first_doc"))
        begin = np.flatnonzero(new)
        size = pos[np.append(begin[1:], len(pos)) - 1] + 2 * PASSAGE  # documents one after the other on one scale, never touching
        base = np.cumsum(size) - size
        at = pos + base[np.cumsum(new) - 1]
        own, doc = _islands(at[is_first], first_doc[is_first]), first_doc[~is_first]
        other = at[~is_first]
        again = _islands(other, doc)
        # a passage whose words all belong to first occurrences of others is cut all the same
        where = np.searchsorted(own[0], other, "right") - 1
        within = other[(where >= 0) & (np.append(own[1], 0)[where] >= other + PASSAGE)]
        within = _islands(within, within)
        point = np.unique(np.concatenate([*again[:2], *own[:2], *within[:2]]))
        gone = inside(point, *again[:2]) & (~inside(point, *own[:2]) | inside(point, *within[:2]))
        edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
        start, end = point[edge[::2]], point[edge[1::2]]
        named = again[2][np.searchsorted(again[0], start, "right") - 1] if len(start) else start
        for a, b, d, kind in ((*own, True), (start, end, named, False)):
            row = np.searchsorted(base, a, "right") - 1
            of = pa.array(begin[row])
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(c).combine_chunks().take(of) for c in _ID), pa.array(a - base[row]), pa.array(b - base[row]), pa.array(np.full(len(a), kind)), pa.array(d, mask=d == NO_ID)],
                [c.split()[0] for c in _SPAN.split(", ")],
            )

    held: pa.Table | None = None
    for block in _blocks(batches):
        rows = block if held is None else pa.concat_tables([held, block])
        doc, copy = _columns(rows, *_ID)
        absent = rows.column("doc_id").combine_chunks().is_null().to_numpy(zero_copy_only=False)
        new = np.append(True, (doc[1:] != doc[:-1]) | (copy[1:] != copy[:-1]) | (absent[1:] != absent[:-1]))
        cut_at = int(np.flatnonzero(new)[-1])  # the last document may go on
        if cut_at:
            yield from spans(rows.slice(0, cut_at), new[:cut_at])
        held = rows.slice(cut_at)
    if held is not None and held.num_rows:
        yield from spans(held, np.arange(held.num_rows) == 0)


def repeated_spans(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """One row per repeated passage of a document: doc_id, copy, start_word, end_word, is_first, first_doc_id.

    is_first: the passage occurs here first, in the order of doc_id, copy and position; first_doc_id has that occurrence. It is decided for
    each PASSAGE words, so a span that is not first has only words that an earlier occurrence holds, and leaves out those that belong to the first
    occurrence of another passage, unless a repeated passage would stay whole. Rows equal in doc_id and text are one document. Of equal texts only
    the one with the smallest doc_id is searched; the others are one span each. Texts that are null, empty or shorter than PASSAGE words have no row, and no table is too small.
    """
    texts, others = distinct_texts(docs)
    retained = staged(suffixes(texts, hot), "suffixes")
    near = staged(compared(retained.where("right is not null")), "compared")
    passages = ["key", "passage", *_ID, "pos"]
    found = matches(retained.where("passage is not null").select(*passages).unionByName(near.where("passage is not null").select(*passages)))
    none = F.lit(None).cast("bigint")
    ranges = near.where("passage is null").select(*_ID, "pos", "last", "is_first", "first_doc", none.alias("words"))
    ranges = ranges.unionByName(found.select(*_ID, "pos", F.col("pos").alias("last"), "is_first", "first_doc", none.alias("words")))
    sizes = retained.where("key is null").select(*_ID, F.lit(0).cast("bigint").alias("pos"), F.lit(-1).cast("bigint").alias("last"), F.lit(False).alias("is_first"), none.alias("first_doc"), F.col("pos").alias("words"))
    spans = ranges.unionByName(sizes.distinct()).repartition(*_ID).sortWithinPartitions(*_ID, "pos").mapInArrow(_spans, _SPAN)
    spans = staged(spans, "spans")
    whole = spans.where("is_first is null").select(F.col("doc_id").alias("_of"), F.col("copy").alias("_copy"), "start_word", "end_word", F.lit(False).alias("is_first"), "first_doc_id")
    copies = others.join(whole, (F.col("copy") == F.col("_copy")) & F.col("of").eqNullSafe(F.col("_of"))).select(*spans.columns)
    return spans.where("is_first is not null").unionByName(copies)


def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """Texts without the words of their spans and the white space after them; null where either is null."""

    def one(text: str, gone: list[dict]) -> str:
        raw, off = text_bytes(pa.array([text]))
        w = words(raw, off)
        data, keep, at = text.encode(), [], 0
        for a, b in sorted((g["start_word"], g["end_word"]) for g in gone):
            keep.append(data[at : max(at, int(w.start[a]))])
            at = max(at, int(w.start[b]) if b < len(w.start) else len(data))
        return (b"".join(keep) + data[at:]).decode()

    pairs = zip(texts, spans, strict=True)
    return pa.array([one(t.as_py(), s.as_py()) if t.is_valid and s.is_valid else None for t, s in pairs], pa.string())


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with every repeated passage cut but its first occurrence; a text with nothing left goes, and n_chars is the new length."""
    gone = (
        repeated_spans(docs).where("not is_first").groupBy(*_ID)
        .agg(F.collect_list(F.struct("start_word", "end_word")).alias("spans"))
    )
    gone = staged(gone, "cuts").select(F.col("doc_id").alias("_id"), F.col("copy").alias("_copy"), "spans")
    on = docs["doc_id"].cast("bigint").eqNullSafe(gone["_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == gone["_copy"])
    joined = docs.join(gone, on, "left")
    # other texts don't go to Python, and the filter below doesn't make it run twice
    hit = F.when(F.col("spans").isNotNull(), F.col("text"))
    changed = F.arrow_udf(cut, "string").asNondeterministic()(hit, F.col("spans"))
    changed = F.when(F.col("spans").isNotNull(), changed).otherwise(F.col("text"))
    joined = joined.withColumn("text", changed).where(F.col("spans").isNull() | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        joined = joined.withColumn("n_chars", F.when(F.col("spans").isNotNull(), length).otherwise(F.col("n_chars")))
    return joined.select(*docs.columns)
