"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custlattice.llm.staging import staged


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every node u that has an edge and is not the smallest of its component.

    edges: columns u, v of one comparable type; loops, repeats, both directions and no rows at all are fine. Each round
    is written to the shared folder, so lineage does not grow; the number of rounds is logarithmic in the nodes.
    """
    now = staged(
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "edges",
    )
    seen = _digest(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = staged(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = staged(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        digest = _digest(after)
        now = after
        if digest == seen:
            break
        seen = digest
    return now.select("u", F.col("v").alias("root"))
