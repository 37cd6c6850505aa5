"""Places of rows in a total order over the whole cluster."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custlattice.llm.staging import staged


def numbered(rows: DataFrame, order: list, name: str, weight: str | None = None) -> DataFrame:
    """rows with `place`, their number (from 0) in `order`, and, if a weight is named, `before`, its sum over all rows in front.

    Rows are cut into ranges of the order, so a range that many rows share is cut too as long as `order` tells them apart. Each task numbers its
    own range; only one count and sum per range meet in the driver. Rows that are equal in all of `order` come in any order.
    """
    spark = rows.sparkSession
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", _part int, place bigint, before bigint"
    at = rows.columns.index(weight) if weight else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, held = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n = batch.num_rows
            sizes = np.zeros(n, np.int64) if at is None else batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = held + np.cumsum(sizes)
            more = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seen, seen + n)), pa.array(ends - sizes)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "_part", "place", "before"])
            seen, held = seen + n, int(ends[-1]) if n else held

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = staged(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, kind), name)
    total = F.sum(weight) if weight else F.lit(0).cast("bigint")
    ends = sorted(found.groupBy("_part").agg(F.count("*"), total).collect())
    places, sums = (np.cumsum([0, *(e[i] for e in ends[:-1])], dtype=np.int64) for i in (1, 2))
    n = len(ends)  # at most one row a partition
    base = pa.table({"_part": pa.array([e[0] for e in ends], pa.int32()), "_place": places[:n], "_before": sums[:n]})
    joined = found.join(F.broadcast(spark.createDataFrame(base)), "_part").withColumn("place", F.col("place") + F.col("_place"))
    if weight:
        return joined.withColumn("before", F.col("before") + F.col("_before")).select(*rows.columns, "place", "before")
    return joined.select(*rows.columns, "place")


def led(rows: DataFrame, group: str, lead: str, order: list, name: str) -> DataFrame:
    """rows with `of`, the value of `lead` (bigint) in the first row of their group, and `leads`, whether they are that row.

    order: of the rows of a group. Rows are sorted over the whole cluster by group and order, so a group of any size is many tasks' work; a
    group that goes on in the next range is carried over by two values per range, which meet in the driver.
    """
    spark = rows.sparkSession
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", _part int, _head boolean, of bigint, leads boolean"
    at, own = rows.columns.index(group), rows.columns.index(lead)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, last, of = TaskContext.get().partitionId(), None, None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            names = batch.column(at)
            begin = np.append(True, pa.compute.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False))
            begin[0] = names[0].as_py() != last
            start = np.flatnonzero(begin)
            if first is None:
                first = names[0].as_py()
            # place 0 stands for the leader of the group that goes on
            leaders = pa.concat_arrays([pa.array([of], pa.int64()), batch.column(own).take(pa.array(start))])
            mine = leaders.take(pa.array(np.cumsum(begin)))
            head = pa.compute.equal(names, pa.scalar(first, names.type))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, part, np.int32)), head, mine, pa.array(begin)], [*batch.schema.names, "_part", "_head", "of", "leads"]
            )
            last, of = names[n - 1].as_py(), mine[n - 1].as_py()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = staged(rows.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order).mapInArrow(run, kind), name)
    ends = found.groupBy("_part").agg(F.min(group).alias("first"), F.max(group).alias("last"), F.max_by("of", group).alias("of"))
    into, open_ = {}, None  # the last group so far and its leader
    for e in sorted(ends.collect()):  # one row a partition
        goes_on = open_ is not None and open_[0] == e.first
        if goes_on:
            into[e._part] = open_[1]
        open_ = (e.last, open_[1] if goes_on and e.last == e.first else e.of)
    named = pa.table({"_part": pa.array(list(into), pa.int32()), "_of": pa.array(list(into.values()), pa.int64()), "_on": [True] * len(into)})
    joined = found.join(F.broadcast(spark.createDataFrame(named, "_part int, _of bigint, _on boolean")), "_part", "left")
    moved = F.col("_head") & F.col("_on").isNotNull()
    of = F.when(moved, F.col("_of")).otherwise(F.col("of"))
    return joined.select(*rows.columns, of.alias("of"), (F.col("leads") & ~moved).alias("leads"))
