"""Health kept up to date by signed changes: sums per customer stand for the detail rows.

The batch formula of ``health`` needs few numbers of a customer. Counts and sums are kept as integers that a change adds to or takes
from; what needs a newest or a next date (last contact, renewals ahead) is kept as counts per day, so a row can be taken back there too and
the scores can be asked for at any date. A customer has one row of sums and one per day with a contact or renewal, whatever the number of detail rows.

The stored form (``add``) is log-structured. A segment holds the net changes of some batches, in one folder per bucket of customers; segments are
added up in tiers of ``TIER``. A look-up for some customers reads their buckets alone, of each segment; the number of buckets follows a segment's rows.
"""

from __future__ import annotations

import uuid
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from custlattice import vocab
from custlattice.functions.values import count_where, date_lit, days_after, days_between, fixed_units
from custlattice.operators import health
from custlattice.operators.moments import RENEWAL_DAYS
from custlattice.sources import snapshots
from custlattice.sources.tables import scratch_dir

#: Signed integers. ``known`` comes from the customer table; ``contacts`` and ``renewals`` belong to the row's day.
MEASURES = (
    "known", "sentiment_micro", "sentiment_rows", "competitor_rows", "cancel_rows", "claims", "open_claims", "denied_claims",
    "resolution_days", "resolved_claims", "payments", "failed_payments", "contacts", "renewals",
)
SCHEMA = "customer_id string, day date, " + ", ".join(f"{m} bigint" for m in MEASURES)
TIER = 4
BUCKETS = 8192  # at most; a segment takes a power of two of them
BUCKET_ROWS = 100_000


def _one_if(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def _measured(rows: DataFrame, day: Column | None = None, **measures: Column) -> DataFrame:
    """A detail row's part in its customer's numbers, times its ``sign`` (1 where there is no such column)."""
    sign = F.col("sign") if "sign" in rows.columns else F.lit(1)
    parts = [(sign * F.coalesce(measures.get(m, F.lit(0)), F.lit(0))).cast("bigint").alias(m) for m in MEASURES]
    return rows.filter(F.col("customer_id").isNotNull()).select("customer_id", (F.lit(None) if day is None else day).cast("date").alias("day"), *parts)


def _of_customer(rows: DataFrame) -> DataFrame:
    return _measured(rows, known=F.lit(1))


def _of_policy(rows: DataFrame) -> DataFrame:
    return _measured(rows.filter(F.col("status") == "Active"), F.col("end_date"), renewals=F.lit(1))


def _of_claim(rows: DataFrame) -> DataFrame:
    status, days = F.col("status"), F.col("resolution_days")
    return _measured(
        rows, claims=F.lit(1), open_claims=_one_if(status.isin(*vocab.UNRESOLVED_CLAIM)), denied_claims=_one_if(status == "Denied"),
        resolution_days=fixed_units(days, 0), resolved_claims=_one_if(days.isNotNull()),
    )


def _of_payment(rows: DataFrame) -> DataFrame:
    return _measured(rows, payments=F.lit(1), failed_payments=_one_if(F.col("status") == "Failed"))


def _of_interaction(rows: DataFrame) -> DataFrame:
    return _measured(rows, F.col("interaction_date"), contacts=F.lit(1))


def _of_signals(rows: DataFrame) -> DataFrame:
    """One row per document with all its signals (``enrich.wide_from_text``)."""
    leaves = (F.col("sentiment_score") < -0.3) & F.col("intents.cancellation_intent")
    return _measured(
        rows, sentiment_micro=fixed_units(F.col("sentiment_sum"), 6), sentiment_rows=F.col("sentiment_rows"),
        competitor_rows=_one_if(F.array_size("entities.competitors") > 0), cancel_rows=_one_if(leaves),
    )


def _of_sentiment(rows: DataFrame) -> DataFrame:
    """Enrichment rows of which only the sentiment counts."""
    score = F.col("sentiment_score")
    return _measured(rows, sentiment_micro=fixed_units(score, 6), sentiment_rows=_one_if(score.isNotNull()))


SOURCES = {
    "customer": _of_customer, "policy": _of_policy, "claim": _of_claim, "payment": _of_payment, "interaction": _of_interaction,
    "signals": _of_signals, "sentiment": _of_sentiment,
}


def facts(tables: dict[str, DataFrame]) -> DataFrame:
    """The numbers of whichever of ``SOURCES`` are given, added up per customer and day.

    A table may have a column ``sign``: 1 for a row that is there or comes, -1 for one that goes; a changed row goes and comes. Sums
    combine before the shuffle, so a customer with very many rows is few rows in it. Rows without a customer count for nobody.
    """
    return added(reduce(DataFrame.unionByName, [SOURCES[name](rows) for name, rows in tables.items()]))


def added(rows: DataFrame) -> DataFrame:
    """Numbers of the same customer and day added up; what comes to nothing is left out."""
    sums = rows.groupBy("customer_id", "day").agg(*[F.sum(m).alias(m) for m in MEASURES])
    return sums.filter(reduce(Column.__or__, [F.col(m) != 0 for m in MEASURES]))


def health_from_facts(rows: DataFrame, as_of: datetime) -> DataFrame:
    """Health rows of all customers that the customer table knows, equal to those of the batch formula. One aggregation, no join."""
    days = ("contacts", "renewals")
    ahead = F.col("day").between(days_after(as_of, 1), days_after(as_of, RENEWAL_DAYS))
    per_day = rows.groupBy("customer_id", "day").agg(*[F.sum(m).alias(m) for m in MEASURES])
    per = per_day.groupBy("customer_id").agg(
        *[F.sum(m).alias(m) for m in MEASURES if m not in days],
        F.max(F.when(F.col("contacts") > 0, F.col("day"))).alias("last_day"),
        count_where((F.col("renewals") > 0) & ahead).alias("renewal_days_ahead"),
    )
    c = F.col
    churn = ((c("competitor_rows") > 0) & (c("renewal_days_ahead") > 0)) | (c("cancel_rows") > 0)
    has_claims = c("claims") > 0
    scored = per.filter(c("known") > 0).select(
        "customer_id",
        F.round(c("sentiment_micro").cast("double") / 1_000_000.0 / F.nullif("sentiment_rows", F.lit(0)), 12).alias("avg_sentiment"),
        F.when(has_claims, c("open_claims")).alias("open_claims"),
        F.when(has_claims, c("denied_claims")).alias("denied_claims"),
        (c("resolution_days").cast("double") / F.nullif("resolved_claims", F.lit(0))).alias("avg_resolution"),
        (c("failed_payments").cast("double") / F.nullif("payments", F.lit(0))).alias("failure_rate"),
        days_between(c("last_day"), date_lit(as_of)).alias("days_since_last"),
        _one_if(churn).alias("churn_moments"),
    )
    return health.scored(scored, as_of)


def _bucket(n: int) -> Column:
    return F.pmod(F.xxhash64("customer_id"), F.lit(n)).cast("int")


def _segment(rows: DataFrame, root: str, level: int) -> dict:
    """Writes added-up numbers as a segment. They are stored first, which tells how many buckets they need; buckets are even, and a task may write several."""
    spark = rows.sparkSession
    path = scratch_dir(spark)
    rows.write.parquet(path)
    stored = spark.read.schema(SCHEMA).parquet(path)
    n = stored.count()
    buckets = min(BUCKETS, 1 << (n // BUCKET_ROWS).bit_length())
    entry = {"id": uuid.uuid4().hex, "level": level, "rows": n, "buckets": buckets}
    even = spark.sql("SELECT /*+ REBALANCE(bucket) */ * FROM {rows}", rows=stored.withColumn("bucket", _bucket(buckets)))
    even.sortWithinPartitions("bucket", "customer_id").write.partitionBy("bucket").parquet(f"{root}/segment={entry['id']}")
    return entry


def _read(spark: SparkSession, root: str, segments: list[dict], wanted: list[int] | None = None) -> DataFrame:
    """Rows of segments, or of those buckets in them that hold some of the ``wanted`` of all ``BUCKETS``."""
    parts = []
    for n in sorted({s["buckets"] for s in segments}):
        paths = [f"{root}/segment={s['id']}" for s in segments if s["buckets"] == n]
        rows = spark.read.schema(SCHEMA + ", bucket int").option("basePath", root).parquet(*paths)
        if wanted is not None:
            rows = rows.filter(F.col("bucket").isin(sorted({b % n for b in wanted})))
        parts.append(rows.select("customer_id", "day", *MEASURES))
    return reduce(DataFrame.unionByName, parts)


def add(spark: SparkSession, root: str, change: DataFrame, batch: int) -> snapshots.Commit:
    """Add a batch's numbers (as of ``facts``) to the state at ``root``; batches are numbered upwards.

    A batch that the state holds already changes nothing, so one that runs again after a crash counts once. Two writers cannot both add to one state.
    """
    state = snapshots.newest(spark, root)
    if state and batch <= state.value["batch"]:
        return state
    segments = [*(state.value["segments"] if state else []), _segment(change.select("customer_id", "day", *MEASURES), root, 0)]
    while len(segments) >= TIER and len({s["level"] for s in segments[-TIER:]}) == 1:
        whole = added(_read(spark, root, segments[-TIER:]))
        segments = [*segments[:-TIER], _segment(whole, root, segments[-1]["level"] + 1)]
    return snapshots.publish(spark, root, {"batch": batch, "segments": segments}, state)


def read(spark: SparkSession, root: str, customers: DataFrame | None = None) -> DataFrame | None:
    """The state's numbers, several rows for a customer and day to be added up, or None before the first batch.

    With ``customers`` (a column customer_id) only theirs: their buckets, at most ``BUCKETS`` numbers, prune the folders that are read.
    """
    state = snapshots.newest(spark, root)
    if state is None:
        return None
    segments = state.value["segments"]
    if customers is None:
        return _read(spark, root, segments)
    wanted = customers.select("customer_id").distinct()
    buckets = [r.bucket for r in wanted.select(_bucket(BUCKETS).alias("bucket")).distinct().collect()]
    return _read(spark, root, segments, buckets).join(wanted, "customer_id", "left_semi")
