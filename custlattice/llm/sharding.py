"""Shards of near equal size by a minimax contiguous partition.

Documents of equal text are one group that is never cut; groups are in the order of their text's digest. The capacity of a shard is the smallest
with which a greedy pass (each shard takes all it can, and a group larger than the capacity is a shard alone) needs no more shards than asked for.
It is found by binary search. A pass needs only the last group start within reach of a point on the scale of summed sizes, so the driver holds
group starts in a bounded number of places: first one coarse grid, then finer ones where the cuts may still fall. Between known starts
every look-up has a lower and an upper bound, the greedy pass is monotone in both, and the search ends when the bounds meet.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custlattice.llm.order import numbered
from custlattice.llm.staging import staged

SHARDS = 24
#: Bytes of a document besides its text.
OVERHEAD = 8
#: Cells of a grid; each sends its first and last group start to the driver.
CELLS = 1 << 15


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, group, size, text_crc32): group is the MD5 of the text. A null text has no bytes and belongs to the empty texts."""
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.unhex(F.md5(raw)).alias("group"),
        (F.octet_length(raw) + F.lit(OVERHEAD).cast("bigint")).alias("size"),
        F.crc32(raw).alias("text_crc32"),
    )


@dataclass
class Starts:
    """Known group starts (the first is 0, the last the end of the scale), and after which of them unknown ones may follow before the next."""

    at: np.ndarray
    open: np.ndarray

    def floor(self, x: int, low: bool) -> int:
        """A bound (lower, else upper) of the last start at or before x."""
        if x >= self.at[-1]:
            return int(self.at[-1])
        i = int(np.searchsorted(self.at, x, "right")) - 1
        return int(self.at[i]) if low or not self.open[i] else x

    def after(self, x: int, low: bool) -> int:
        """A bound of the first start after x."""
        if x >= self.at[-1]:
            return int(self.at[-1])
        i = int(np.searchsorted(self.at, x, "right")) - 1
        return x + 1 if low and self.open[i] else int(self.at[i + 1])

    def ceil(self, x: int, low: bool) -> int:
        """A bound of the first start at or after x."""
        return self.after(x - 1, low) if x > 0 else 0

    def last_before(self, x: int, low: bool) -> int:
        """A bound of the last start before x."""
        return self.floor(x - 1, low) if x > 0 else 0

    def reach(self, start: int, capacity: int, low: bool) -> int:
        """Where a shard from `start` ends that takes all it can."""
        return max(self.floor(start + capacity, low), self.after(start, low))

    def forward(self, capacity: int, shards: int, low: bool) -> list[int]:
        out = [0]
        for _ in range(shards):
            out.append(self.reach(out[-1], capacity, low))
        return out

    def backward(self, capacity: int, shards: int, low: bool) -> list[int]:
        """The first start from which the last shards still suffice, for each number of them."""
        out = [int(self.at[-1])]
        for _ in range(shards):
            out.append(min(self.ceil(out[-1] - capacity, low), self.last_before(out[-1], low)))
        return out[::-1]

    def last(self, shards: int, low: bool) -> list[int]:
        """The starts of the last groups, as many as shards, and the end."""
        out = [int(self.at[-1])]
        for _ in range(shards):
            out.append(self.last_before(out[-1], low))
        return out[::-1]

    def capacity(self, shards: int, low: bool) -> int:
        """The smallest capacity with which a greedy pass reaches the end."""
        a, b = 0, int(self.at[-1])
        while a < b:
            middle = (a + b) // 2
            a, b = (a, middle) if self.forward(middle, shards, low)[-1] >= self.at[-1] else (middle + 1, b)
        return a

    def cuts(self, capacity: int, shards: int, low: bool) -> list[int]:
        """Starts of the shards, and the end: each takes an even part of what is left, as far as the capacity allows here and for the rest, and leaves
        each later shard a group."""
        end, need, leave = int(self.at[-1]), self.backward(capacity, shards, low), self.last(shards, low)
        out = [0]
        for k in range(1, shards + 1):
            p = out[-1]
            even = self.floor(p + -(-(end - p) // (shards - k + 1)), low)
            after = self.after(p, low)
            out.append(min(max(even, need[k], after), self.reach(p, capacity, low), max(leave[k], after)))
        return out

    def refine(self, spans: list[tuple[int, int]], ask) -> Starts:
        """With the starts that `ask(ranges, width)` finds inside the open gaps that touch a span: (range, first, last, count) per cell of `width`."""
        gaps = np.flatnonzero(self.open)
        hit = np.zeros(len(self.open), dtype=bool)
        for a, b in spans:  # from the first to the last open gap that the span touches
            i, j = np.searchsorted(self.at, a, "right") - 1, np.searchsorted(self.at, b, "right")
            own = gaps[np.searchsorted(gaps, max(i, 0)) : np.searchsorted(gaps, j)]
            if len(own):
                hit[own[0] : own[-1] + 1] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]])))
        ranges = [(int(self.at[a]), int(self.at[b])) for a, b in zip(edge[::2], edge[1::2], strict=True)]
        width = max(1, -(-sum(b - a for a, b in ranges) // CELLS))
        of, first, last, count = ask(ranges, width)
        at = np.unique(np.concatenate([self.at, first, last]))
        left, right = at[:-1], at[1:]
        inside = np.searchsorted(self.at, left, "right") - 1
        open_ = self.open[inside] & ~hit[inside]  # gaps that were not looked into stay as they are
        known = np.searchsorted(at, last, "right") - np.searchsorted(at, first, "left")
        for r, (a, b) in enumerate(ranges):
            # within a cell of which not all starts are known, gaps between its first and last one stay open
            own = (of == r) & (count > known)
            order = np.argsort(first[own])
            f, x = first[own][order], last[own][order]
            here = np.flatnonzero((left >= a) & (right <= b))
            if len(f) and len(here):
                cell = np.searchsorted(f, left[here], "right") - 1
                open_[here] = self.open[inside[here]] & (cell >= 0) & (right[here] <= x[np.maximum(cell, 0)])
        return Starts(at, open_)


def minimax(total: int, shards: int, ask) -> list[int]:
    """Cut points (shards + 1, from 0 to total) over group starts known through `ask` alone (see `Starts.refine`)."""
    starts = Starts(np.array([0, total]), np.array([True]))
    while True:
        starts = starts.refine([(0, total)] if len(starts.at) == 2 else spans, ask)
        least, most = starts.capacity(shards, False), starts.capacity(shards, True)
        if least < most:
            low, high = starts.forward(least, shards, True), starts.forward(most, shards, False)
        else:
            low, high = starts.cuts(most, shards, True), starts.cuts(most, shards, False)
            if low == high:
                return low
            low, high = ([*p, *starts.backward(most, shards, x), *starts.last(shards, x)] for p, x in ((low, True), (high, False)))
        spans = [(a, b) for a, b in zip(low, high, strict=True) if a < b]


def _asker(groups: DataFrame):
    def ask(ranges: list[tuple[int, int]], width: int) -> tuple[np.ndarray, ...]:
        where = [(F.col("at") > a) & (F.col("at") < b) for a, b in ranges]  # no more than spans
        while len(where) > 1:
            where = [a | b for a, b in zip(where[::2], where[1::2], strict=False)] + where[len(where) // 2 * 2 :]
        # a cell that two ranges share counts for each of them
        of = F.size(F.filter(F.array(*(F.lit(a) for a, _ in ranges)), lambda x: x < F.col("at"))) - 1
        cells = groups.where(where[0]).groupBy(of.alias("of"), F.floor(F.col("at") / width).alias("cell"))
        got = cells.agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n")).toArrow()
        return tuple(got.column(c).to_numpy() for c in ("of", "first", "last", "n"))

    return ask


@dataclass
class Plan:
    """rows: doc_id, group, size, text_crc32, place (number in the whole order). first: place and group of each shard's first row; None if empty."""

    rows: DataFrame
    first: list[tuple[int, bytes] | None]


def plan(docs: DataFrame, shards: int = SHARDS) -> Plan:
    if shards < 1:
        raise ValueError("at least one shard")
    rows = staged(sized(docs).withColumn("_row", F.monotonically_increasing_id()), "sizes")
    order = ["group", F.col("doc_id").asc_nulls_last(), "_row"]  # the last one cuts up rows that are equal in all
    rows = numbered(rows, order, "in-order", "size").drop("_row")
    groups = staged(rows.groupBy("group").agg(F.min("before").alias("at"), F.min("place").alias("place")).sort("at"), "groups")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    cuts = minimax(total, shards, _asker(groups)) if total else [0] * (shards + 1)
    found = {r.at: (r.place, bytes(r.group)) for r in groups.where(F.col("at").isin(cuts)).collect()}
    return Plan(rows, [found[a] if a < b else None for a, b in zip(cuts[:-1], cuts[1:], strict=True)])


def _number_of(column, firsts: list):
    """How many of the sorted values after the first one are at or below the column."""
    return F.size(F.filter(F.array(*map(F.lit, firsts)), lambda x: x <= column)) - 1


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): one row per row of docs, other columns ignored.

    Equal texts share a shard, null counting as empty. size: UTF-8 bytes of the text plus OVERHEAD. No shard of several groups is larger than the
    smallest capacity that makes such a partition possible; a larger group is a shard alone. slot numbers a shard's rows from 0 in
    the order of text digest and doc_id (null last); repeated rows each get one. With fewer groups than shards the last shards
    stay empty, and an empty table has no rows.
    """
    made = plan(docs, shards)
    used = [(shard, first[0]) for shard, first in enumerate(made.first) if first is not None]
    if not used:
        return made.rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("slot"))
    at = _number_of(F.col("place"), [p for _, p in used])
    rows = made.rows.withColumn("_at", at)
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("_at") + 1)
    slot = F.col("place") - pick([p for _, p in used]).cast("bigint")
    return rows.select("doc_id", "size", "text_crc32", pick([s for s, _ in used]).alias("shard"), slot.alias("slot"))


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS) -> None:
    """The whole rows of docs below `folder`, one directory shard=n per shard, files and rows in the order of slots.

    A shard's first digest says where it begins, so a row's shard follows from its own text and no join is needed.
    """
    made = plan(docs, shards)
    used = [(shard, first[1]) for shard, first in enumerate(made.first) if first is not None]
    group = F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))
    at = F.element_at(F.array(*(F.lit(s) for s, _ in used or [(0, b"")])), _number_of(F.col("_group"), [g for _, g in used or [(0, b"")]]) + 1)
    rows = docs.withColumn("_group", group).withColumn("shard", at)
    order = ["shard", "_group", F.col("doc_id").asc_nulls_last()]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_group").write.partitionBy("shard").parquet(folder)
