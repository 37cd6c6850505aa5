"""Per-customer arrays and per-customer top-k that stay bounded when one customer owns a huge
share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_key(df: DataFrame, key: str, k: int, *order: Column, rank: str | None = None) -> DataFrame:
    """First ``k`` rows per key. Spark prunes to ``k`` per key and task before the shuffle
    (window group limit), so a hot key never sends more than ``k`` rows per map task."""
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    out = ranked.filter(F.col(name) <= k)
    return out if rank else out.drop(name)


PAGE_BUCKETS = 2  # hexadecimal digits: 256 buckets per key


def _exchanged(few: DataFrame, key: str) -> DataFrame:
    """``few`` without the partitioning by ``key`` that the operators below it leave, so that a join has an exchange of its own on this side too."""
    return few.repartition(F.xxhash64(key))


def join_hot(many: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """Inner join where one key may own a large share of ``many``; ``few`` has a small fixed number of rows per key.

    Adaptive execution splits an oversized partition of a join only where both inputs are exchanges, with nothing in between. ``many`` must
    not come partitioned by ``key``; ``few``, usually the result of an aggregation or another join by ``key``, is shuffled once more for it.
    A part of a hot key meets that key's rows of ``few``; all other rows are sent once.
    """
    return many.join(_exchanged(few, key), key)


def anti_hot(many: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """Rows of ``many`` whose key ``few`` lacks, with the inputs of ``join_hot``; NULL keys stay."""
    return many.join(_exchanged(few.select(key), key), key, "left_anti")


def stretches(rows: DataFrame, key: str, bucket: Column) -> DataFrame:
    """How many rows (``_n``) a key has in each stretch of its order."""
    return rows.withColumn("_bucket", bucket).groupBy(key, "_bucket").agg(F.count("*").alias("_n"))


def positions(
    rows: DataFrame, key: str, bucket: Column, *order: Column, first_bucket: Column, null_key: bool = True
) -> DataFrame:
    """``rows`` with ``_at``: the row's number within its key, from 0, without gaps.

    Without ``null_key`` rows with a NULL key drop out, and a filter on the key reaches both readings.

    ``bucket`` cuts a key's order into consecutive stretches; ``first_bucket`` orders them. A stretch
    is numbered on its own and starts after the rows of the earlier ones, so a key with very many
    rows is many tasks' work. The counts per stretch come from a second, narrow reading.
    """
    named = rows.withColumn("_bucket", bucket)
    counts = stretches(rows, key, bucket)
    earlier = Window.partitionBy(key).orderBy(first_bucket).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    own = F.row_number().over(Window.partitionBy(key, "_bucket").orderBy(*order))
    numbered = named.withColumn("_own", own)
    starts = counts.select(F.col(key).alias("_key"), F.col("_bucket").alias("_in"), "_before")
    same = numbered[key].eqNullSafe(starts["_key"]) if null_key else numbered[key] == starts["_key"]
    same &= numbered["_bucket"].eqNullSafe(starts["_in"])
    joined = numbered.join(starts, same)
    return joined.withColumn("_at", F.col("_before") + F.col("_own") - 1).drop("_key", "_in", "_before", "_own", "_bucket")


def paged_arrays(
    items: DataFrame, key: str, item_id: str, fields: dict[str, Column], page_size: int,
    header: DataFrame | None = None,
) -> DataFrame:
    """Collect ``fields`` into arrays per (key, page): page n holds the items at positions
    n * ``page_size`` to (n + 1) * ``page_size`` - 1 of the key, in the order of md5(item id).

    The rule is the same for every size. No task holds more than a page, no item is dropped, page
    numbers have no gaps, and they do not depend on the cluster. NULL items of a field are left out of its
    array. ``header`` has one row per key; its columns are repeated on every page, and its keys without
    items get an empty page 0.
    """
    digest = F.md5(F.coalesce(F.col(item_id).cast("string"), F.lit("")).cast("binary"))
    slim = items.select(F.col(key), F.col(item_id).alias("_id"), digest.alias("_digest"), *[c.alias(n) for n, c in fields.items()])
    bucket = F.substring("_digest", 1, PAGE_BUCKETS)
    numbered = positions(slim, key, bucket, F.col("_digest"), F.col("_id"), first_bucket=F.col("_bucket"), null_key=False)
    page = F.floor(F.col("_at") / page_size).cast("int")
    spread = numbered.select(key, page.alias("page"), *fields)
    head = [c for c in header.columns if c != key] if header is not None else []
    if header is not None:
        # the same counts as those of `positions`, so their exchange is used twice
        pages = stretches(slim, key, bucket).groupBy(key).agg(F.ceil(F.sum("_n") / page_size).cast("int").alias("pages"))
        every_page = F.explode(F.sequence(F.lit(0), F.coalesce("pages", F.lit(1)) - 1))
        titles = header.join(pages, key, "left").select(key, every_page.alias("page"), *head)
        spread = spread.unionByName(titles, allowMissingColumns=True)
    # explicit exchange on (key, page): a partitioning by key alone would put a whole hot key into one task
    return (
        spread.repartition(key, "page")
        .groupBy(key, "page")
        .agg(
            *[F.first(c, ignorenulls=True).alias(c) for c in head],
            *[F.array_sort(F.collect_list(n)).alias(n) for n in fields],
        )
    )
