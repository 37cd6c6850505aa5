"""Ranked lexical search with bag deduplication.

Only words of the items matter, so a document is reduced to its counts of these words and its length class m; a document's score depends on nothing
else. Documents with the same counts and m are one class: they are brought together by a hash, compared byte for byte, scored once, and
stand for all their members. No item needs more than its k best classes, nor more than the k smallest doc_ids of a class.

Scores are integers: w * ((10^9 * tf) div (1000 * tf + 8 * m)) summed over an item's words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from custlattice.llm.staging import staged
from custlattice.llm.tokens import HashTable, slices, words

K = 10
#: Items and bytes of their text sent to the tasks at a time; more of them take more passes.
ITEMS = 8_192
BYTES = 8_000_000
#: Scores held at once.
CELLS = 1 << 18

#: ASCII digits and letters, and all bytes of other characters.
TERM = np.zeros(256, dtype=bool)
TERM[48:58] = TERM[65:91] = TERM[97:123] = TERM[128:] = True


@dataclass
class Items:
    """Distinct items of one block: ids, the table of their words, and the items of each word (items[first[t]:first[t + 1]])."""

    ids: list
    table: HashTable
    items: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, ids: list, texts: list[bytes]) -> Items:
        raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
        off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        w = words(raw, off, TERM)
        pairs = np.unique(np.stack([w.hashes, w.row_of.astype(np.uint64)], axis=1), axis=0)
        terms, first = np.unique(pairs[:, 0], return_index=True)
        return cls(ids, HashTable(terms), pairs[:, 1].astype(np.int64), np.append(first, len(pairs)))


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in base 128, lowest part first, all bytes but a number's last with the high bit; and where each one begins, with the end."""
    values = values.astype(np.uint64)
    size = np.maximum(1, sum((values >> np.uint64(7 * i) > 0).astype(np.int64) for i in range(10)))
    start = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(start[-1], dtype=np.uint8)
    for i in range(int(size.max(initial=0))):
        at = np.flatnonzero(size > i)
        more = np.where(size[at] > i + 1, 128, 0)
        out[start[at] + i] = (values[at] >> np.uint64(7 * i) & np.uint64(127)).astype(np.uint8) | more.astype(np.uint8)
    return out, start


def unpacked(raw: np.ndarray) -> np.ndarray:
    if not len(raw):
        return np.zeros(0, dtype=np.int64)
    start = np.concatenate([[0], np.flatnonzero(raw < 128)[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(start, np.diff(np.append(start, len(raw))))
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), start)


def _counted(block: Items, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Words per row, and the row's bag: for each item word it holds, in their order, the step from the last one and the count."""
    w = words(raw, off, TERM)
    at, term = block.table.find(w.hashes)
    size = max(1, len(block.table.keys))
    key, tf = np.unique(w.row_of[at] * size + term, return_counts=True)
    row, term = key // size, key % size
    begin = np.append(True, row[1:] != row[:-1])[: len(row)]
    step = np.where(begin, term, np.diff(term, prepend=0))
    data, start = packed(np.stack([step, tf], axis=1).ravel())
    ends = np.searchsorted(row, np.arange(len(off)))  # of row r the pairs ends[r] to ends[r + 1]
    offsets = start[2 * ends].astype(np.int64)
    bags = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return np.diff(w.rows), bags.cast(pa.binary())


def _bags(docs: DataFrame, block) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, off in slices(batch, "text"):
                n, bags = _counted(block.value, raw, off)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), bags], ["doc_id", "n", "bag"])

    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return text.mapInArrow(run, "doc_id bigint, n bigint, bag binary")


def _entries(bags: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, word and count of all entries of a batch of bags."""
    bags = bags.cast(pa.large_binary())
    _, offsets, data = bags.buffers()
    off = np.frombuffer(offsets, dtype=np.int64, count=len(bags) + 1 + bags.offset)[bags.offset :]
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    numbers = unpacked(raw)
    ends = np.concatenate([[0], np.cumsum(raw < 128)])[off - off[0]] // 2
    row = np.repeat(np.arange(len(bags)), np.diff(ends))
    total = np.cumsum(numbers[::2])
    before = np.concatenate([[0], total])[ends[:-1]]
    return row, total - before[row], numbers[1::2]


def _frequencies(bags: DataFrame, terms: int) -> np.ndarray:
    """In how many documents each word occurs: one partial sum per task and word that it saw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(terms, dtype=np.int64)
        for batch in batches:
            df += np.bincount(_entries(batch.column(0))[1], minlength=terms)[:terms]
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["term", "df"])

    rows = bags.select("bag").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(terms, dtype=np.int64)
    out[rows.column("term").to_numpy()] = rows.column("df").to_numpy()  # as many as a block's words
    return out


def weights(df: np.ndarray, n: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)


def classes(bags: DataFrame, n: int, total: int, k: int, bits: int = 64) -> DataFrame:
    """(bag, m, ids): one row per class of equal bag and m, with its k smallest doc_ids (null is last). bits: of the hash that brings rows together."""
    length = F.expr(f"cast((90 * cast(n as decimal(20, 0)) * {n}) div {total} as bigint)") + F.lit(100 - 90).cast("bigint")
    rows = bags.where(F.length("bag") > 0).select("doc_id", "bag", length.alias("m"))
    rows = rows.withColumn("h", F.shiftrightunsigned(F.xxhash64("bag", "m"), 64 - bits))
    # the rank is cut in every task before the shuffle, so a class may have any number of members; bag and m verify the hash
    rank = F.row_number().over(Window.partitionBy("h", "bag", "m").orderBy(F.col("doc_id").asc_nulls_last()))
    few = rows.withColumn("_rank", rank).where(F.col("_rank") <= k)
    members = F.transform(F.array_sort(F.collect_list(F.struct("_rank", "doc_id"))), lambda x: x["doc_id"])
    return few.groupBy("h", "bag", "m").agg(members.alias("ids")).select("bag", "m", "ids")


class _Best:
    """Per item the k best classes seen, by score and then by smallest doc_id."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.least = np.ones(items, dtype=np.int64)  # a score must be above 0
        self.rows: tuple[np.ndarray, ...] = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.ids: list = []

    def add(self, scores: np.ndarray, first: np.ndarray, ids: pa.Array) -> None:
        """scores: classes x items; first: the smallest doc_id of each class."""
        if len(scores) > self.k:
            self.least = np.maximum(self.least, np.partition(scores, len(scores) - self.k, axis=0)[len(scores) - self.k])
        row, item = np.nonzero(scores >= self.least)
        if not len(row):
            return
        score = np.concatenate([self.rows[1], scores[row, item]])
        smallest = np.concatenate([self.rows[2], first[row]])
        item = np.concatenate([self.rows[0], item])
        order = np.lexsort((smallest, -score, item))
        begin = np.searchsorted(item[order], item[order])
        order = order[np.arange(len(order)) - begin < self.k]
        old = len(self.ids)
        taken = ids.take(pa.array(row[order[order >= old] - old])).to_pylist()
        fresh = iter(taken)
        self.ids = [self.ids[i] if i < old else next(fresh) for i in order.tolist()]
        self.rows = item[order], score[order], smallest[order]
        full = np.flatnonzero(np.bincount(self.rows[0], minlength=len(self.least)) >= self.k)
        last = np.searchsorted(self.rows[0], full, "right") - 1
        self.least[full] = np.maximum(self.least[full], self.rows[1][last])


def _scores(block: Items, weight: np.ndarray, bags: pa.Array, m: np.ndarray) -> np.ndarray:
    """Classes x items."""
    row, term, tf = _entries(bags)
    part = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[row]))
    n = block.first[term + 1] - block.first[term]
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(block.first[term], n)
    out = np.zeros(len(bags) * len(block.ids), dtype=np.int64)
    np.add.at(out, np.repeat(row * len(block.ids), n) + block.items[at], np.repeat(part, n))
    return out.reshape(len(bags), len(block.ids))


def _best_classes(found: DataFrame, block, weight, k: int) -> DataFrame:
    """(item, score, ids): from each task the k best of its classes for every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = block.value
        best = _Best(len(items.ids), k)
        step = max(1, CELLS // max(1, len(items.ids)))
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                bags, m, ids = (c.slice(i, step) for c in batch.columns)
                m = m.to_numpy(zero_copy_only=False)
                first = pa.compute.list_element(ids, 0).fill_null(2**63 - 1).to_numpy(zero_copy_only=False)
                best.add(_scores(items, weight.value, bags, m), first, ids)
        yield pa.RecordBatch.from_arrays(
            [pa.array(best.rows[0]), pa.array(best.rows[1]), pa.array(best.ids, pa.list_(pa.int64()))], ["item", "score", "ids"]
        )

    return found.select("bag", "m", "ids").mapInArrow(run, "item bigint, score bigint, ids array<bigint>")


def _blocks(items: DataFrame) -> Iterator[Items]:
    """Distinct items in blocks of about ITEMS and, but for a single larger item, BYTES of text."""
    rows = items.select(F.col("item_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")).distinct()
    size = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    parts = max(1, -(-size[0] // ITEMS), -(-size[1] // BYTES))
    for part in range(parts):
        got = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id", "text").collect()
        if got:
            yield Items.of([r[0] for r in got], [bytes(r[1]) for r in got])


def ranked(docs: DataFrame, items: DataFrame, k: int = K, bits: int = 64) -> DataFrame:
    """(item_id, rank, doc_id, score): for each distinct row (item_id, text) of items its k highest-scoring rows of docs.

    Words are the longest runs of ASCII letters and digits and of all other characters, A-Z lower-cased. Only scores above 0 count; equal ones
    come by ascending doc_id, null last, and repeated rows each count. Null texts have no words. Other columns are ignored; empty tables give no rows.
    """
    spark = docs.sparkSession
    parts = []
    for made in _blocks(items):
        block = spark.sparkContext.broadcast(made)
        bags = staged(_bags(docs, block), "bags")
        n, total = bags.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n:
            continue
        weight = spark.sparkContext.broadcast(weights(_frequencies(bags, len(made.table.keys)), n))
        found = staged(classes(bags, n, total, k, bits), "classes")
        best = _best_classes(found, block, weight, k)
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
        best = best.select("item", "score", F.explode("ids").alias("doc_id")).withColumn("rank", rank).where(F.col("rank") <= k)
        names = spark.createDataFrame(pa.table({"item": pa.array(range(len(made.ids)), pa.int64()), "item_id": pa.array(made.ids, pa.int64())}))
        parts.append(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))  # at most ITEMS rows or so
    if not parts:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
