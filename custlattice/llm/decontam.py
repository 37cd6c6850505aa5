"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming look-up, exact weighted-shingle check.

An item of n words is compared with windows of n words, or with the whole text where that has fewer. Weights are the counts of 5-word shingles; similarity is the weighted Jaccard
measure, the sum of smaller counts over the sum of larger ones. A window with fewer than 0.8 of an item's shingles cannot reach 0.8, so
fingerprints are computed for the other windows only; no window that could match is left out. A window's fingerprint is looked up in BLOCKS
tables, one for each block of its bits, that hold every item under all block values within RADIUS // BLOCKS bits: by the pigeonhole principle this finds
every item within RADIUS. Candidates are then verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custlattice.llm.tokens import HashTable, Words, grams, mix, slices, word_slices, words

SHINGLE = 5
SIMILARITY = 0.8
#: Bits; at similarity 0.8 about 10 of 64 differ, with a deviation of 3.
RADIUS = 23
BLOCKS = 8
#: Benchmark items and bytes of text sent to the tasks at a time; a larger benchmark takes more passes over the documents.
ITEMS = 20_000
BYTES = 16_000_000

_OUT = "doc_id bigint, item_id bigint, start_word bigint, words bigint, hamming int, similarity double, windows bigint"


def shingle_counts(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a word sequence and their counts; fewer than SHINGLE words make one shingle."""
    if not len(hashes):
        return hashes, np.zeros(0, np.int64)
    return np.unique(grams(hashes, min(SHINGLE, len(hashes))), return_counts=True)


def simhash(shingles: np.ndarray, weights: np.ndarray) -> np.uint64:
    bits = np.unpackbits(mix(shingles).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = weights @ (2 * bits.astype(np.int64) - 1)
    return np.packbits(sums > 0, bitorder="little").view(np.uint64)[0]


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / (int(a[1].sum()) + int(b[1].sum()) - both)


class HammingIndex:
    """Fingerprints by the values of BLOCKS bit blocks; search returns all within RADIUS."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        self.width = 64 // BLOCKS
        reach = [0]
        for k in range(1, RADIUS // BLOCKS + 1):
            reach += [sum(1 << b for b in c) for c in combinations(range(self.width), k)]
        self.tables: list[dict[int, list[int]]] = []
        for block in range(BLOCKS):
            table: dict[int, list[int]] = {}
            for i, p in enumerate(prints.tolist()):
                value = p >> (block * self.width) & ((1 << self.width) - 1)
                for r in reach:
                    table.setdefault(value ^ r, []).append(i)
            self.tables.append(table)

    def search(self, fingerprint: int) -> dict[int, int]:
        found: dict[int, int] = {}
        for block, table in enumerate(self.tables):
            for i in table.get(fingerprint >> (block * self.width) & ((1 << self.width) - 1), ()):
                if i not in found:
                    found[i] = (fingerprint ^ int(self.prints[i])).bit_count()
        return {i: d for i, d in found.items() if d <= RADIUS}


class Benchmark:
    """Items of one block: shingles, fingerprints, an index by item length, and the shingles' items."""

    def __init__(self, ids: list[int], texts: list[bytes]):
        self.ids, self.length, self.shingles = [], [], []
        raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
        off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        w = words(raw, off)
        hashes = w.hashes
        for i, item in enumerate(ids):
            own = hashes[w.rows[i] : w.rows[i + 1]]
            if len(own):
                self.ids.append(item)
                self.length.append(len(own))
                self.shingles.append(shingle_counts(own))
        self.need = np.array([int(np.ceil(SIMILARITY * s[1].sum() - 1e-9)) for s in self.shingles], dtype=np.int64)
        pairs = [(s, i) for i, (own, _) in enumerate(self.shingles) for s in own.tolist()]
        keys = np.array([s for s, _ in pairs], dtype=np.uint64)
        order = np.argsort(keys, kind="stable")
        self.items = np.array([i for _, i in pairs], dtype=np.int64)[order]
        distinct, self.first = np.unique(keys[order], return_index=True)
        self.first = np.append(self.first, len(keys))
        self.table = HashTable(distinct)
        self.by_length: dict[int, tuple[HammingIndex, np.ndarray]] = {}
        for n in set(self.length):
            own = np.array([i for i, x in enumerate(self.length) if x == n])
            prints = np.array([simhash(*self.shingles[i]) for i in own], dtype=np.uint64)
            self.by_length[n] = (HammingIndex(prints), own)
        self.short = sorted({n for n in self.length if n < SHINGLE})

    def hits(self, w: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, item and position in words, for every shingle of a row that an item of the same shingle size has."""
        left = w.left_in_row
        row_of = w.row_of
        found = []
        for k in [*self.short, SHINGLE]:
            at, which = self.table.find(grams(hashes, k))
            inside = left[at] >= k
            at, which = at[inside], which[inside]
            n = self.first[which + 1] - self.first[which]
            index = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[which], n)
            at, item = np.repeat(at, n), self.items[index]
            fits = np.minimum(np.array(self.length)[item], SHINGLE) == k if len(item) else np.zeros(0, bool)
            found.append((at[fits], item[fits]))
        at = np.concatenate([a for a, _ in found])
        item = np.concatenate([i for _, i in found])
        return row_of[at], item, at

    def rows(self, w: Words) -> Iterator[tuple[int, dict[int, tuple]]]:
        """Rows with hits, and what `search` finds in each."""
        hashes = w.hashes
        row, item, at = self.hits(w, hashes)
        order = np.argsort(row, kind="stable")
        row, item, at = row[order], item[order], at[order]
        start = np.flatnonzero(np.diff(row, prepend=-1))
        for a, b in zip(start.tolist(), [*start[1:].tolist(), len(row)], strict=False):
            r = int(row[a])
            yield r, self.search(hashes[w.rows[r] : w.rows[r + 1]], item[a:b], at[a:b] - w.rows[r])

    def search(self, hashes: np.ndarray, items: np.ndarray, at: np.ndarray) -> dict[int, tuple]:
        """Best window per item of one row's words. items, at: the row's hits."""
        n, best, windows, seen = len(hashes), {}, {}, set()
        for item in np.unique(items).tolist():
            size, need = min(self.length[item], n), int(self.need[item])
            k = min(SHINGLE, size)
            own = np.sort(at[items == item])
            if len(own) < need:
                continue
            first = own[: len(own) - need + 1]
            last = own[need - 1 :]
            near = last - first <= size - k  # so many hits fit into one window
            starts = set()
            for a, b in zip(first[near].tolist(), last[near].tolist(), strict=True):
                starts.update(range(max(0, b + k - size), min(a, n - size) + 1))
            length = self.length[item]
            index, members = self.by_length[length]
            for start in sorted(starts):
                if (start, length) in seen:
                    continue
                seen.add((start, length))
                window = shingle_counts(hashes[start : start + size])
                for j, distance in index.search(int(simhash(*window))).items():
                    i = int(members[j])
                    s = similarity(window, self.shingles[i])
                    if s >= SIMILARITY:
                        windows[i] = windows.get(i, 0) + 1
                        if i not in best or s > best[i][3]:
                            best[i] = (start, size, distance, s)
        return {self.ids[i]: (*b, windows[i]) for i, b in best.items()}


def _blocks(benchmark: DataFrame) -> Iterator[Benchmark]:
    """The benchmark in blocks of at most ITEMS items and, but for a single larger item, BYTES bytes of text."""
    rows = benchmark.select(F.col("item_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    size = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    parts = max(1, -(-size[0] // (ITEMS // 2)), -(-size[1] // (BYTES // 2)))
    for part in range(parts):
        got = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id", "text").collect()
        yield Benchmark([r[0] for r in got], [bytes(r[1]) for r in got])


def _search(docs: DataFrame, block: Benchmark) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = sent.value
        for batch in batches:
            for part, raw, off in slices(batch, "text"):
                out = []
                for r, found in bench.rows(words(raw, off)):
                    out += [(part.column(0)[r].as_py(), i, *x) for i, x in found.items()]
                if out:
                    types = [pa.int64()] * 4 + [pa.int32(), pa.float64(), pa.int64()]
                    names = ["doc_id", "item_id", "start_word", "words", "hamming", "similarity", "windows"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return docs.mapInArrow(run, _OUT)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start_word, words, hamming, similarity, windows): per document row and item its most similar window.

    windows: how many windows reach SIMILARITY; ties go to the leftmost. A text shorter than an
    item is one window as a whole. Null and empty texts and items match nothing; items below 5 words are one shingle and match exactly. Repeated rows and items each count; empty tables give no rows.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = [_search(rows, block) for block in _blocks(benchmark)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _holder(docs: DataFrame, block: Benchmark):
    sent = docs.sparkSession.sparkContext.broadcast(block)

    @F.arrow_udf("boolean")
    def holds(text: pa.Array) -> pa.Array:
        out = [np.zeros(0, dtype=bool)]
        for rows, w in word_slices(text):
            hit = np.zeros(rows, dtype=bool)
            hit[[r for r, found in sent.value.rows(w) if found]] = True
            out.append(hit)
        return pa.array(np.concatenate(out))

    return holds


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold a benchmark item; one pass, nothing is shuffled."""
    for block in _blocks(benchmark):
        docs = docs.where(~_holder(docs, block)(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return docs
