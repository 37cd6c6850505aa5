"""Verification reports over the source and derived tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custlattice import vocab
from custlattice.functions.values import count_where, mean_exact, round_exact
from custlattice.plans.pipeline import count_rows
from custlattice.sources.schemas import KEYS

# Target row counts of the demonstration data set
TARGETS = {
    "customer": 10_000, "policy": 25_000, "claim": 15_000, "payment": 60_000, "interaction": 50_000,
    "transcript": 8_000, "email": 10_000, "note": 12_000, "survey": 5_000,
}


def check_volumes(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [
        count_rows(tables[t], t.upper()).withColumn("target", F.lit(n).cast("bigint")) for t, n in TARGETS.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def _named(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.lit(name).alias("check_name"), *df.columns)


def check_enrichment(enrichment: DataFrame) -> DataFrame:
    filled = {
        "with_sentiment": "sentiment_score", "with_entities": "entities", "with_intents": "intents",
        "with_classification": "classification", "with_summary": "summary",
    }
    report = enrichment.agg(
        F.count("*").alias("total_enrichments"),
        *[count_where(F.col(c).isNotNull()).alias(n) for n, c in filled.items()],
    )
    return _named(report, "AI_ENRICHMENT")


def check_events(events: DataFrame) -> DataFrame:
    report = events.agg(
        F.count("*").alias("total_events"),
        F.count_distinct("customer_id").alias("unique_customers"),
        F.count_distinct("event_type").alias("unique_event_types"),
        F.count_distinct("source_table").alias("source_tables"),
    )
    return _named(report, "CUSTOMER_EVENTS")


def check_moments(moments: DataFrame) -> DataFrame:
    kind = F.col("moment_type")
    report = moments.agg(
        F.count("*").alias("total_moments"),
        F.count_distinct("customer_id").alias("affected_customers"),
        count_where(kind == "CHURN").alias("churn_moments"),
        count_where(kind == "CLAIM_FRICTION").alias("friction_moments"),
        count_where(kind == "PRICE_SENSITIVITY").alias("price_moments"),
    )
    return _named(report, "CUSTOMER_MOMENTS")


def check_health(health: DataFrame) -> DataFrame:
    report = health.agg(
        F.count("*").alias("scored_customers"),
        round_exact(mean_exact(F.col("health_score"), 2), 2).alias("avg_health"),
        round_exact(mean_exact(F.col("churn_risk"), 4), 4).alias("avg_churn_risk"),
        *[count_where(F.col("risk_level") == r).alias(r.lower()) for r in vocab.RISK_LEVELS],
    )
    return _named(report, "CUSTOMER_HEALTH")


def check_nba(actions: DataFrame) -> DataFrame:
    names = dict(zip(("retention", "claims_esc", "competitor_ret", "cross_sell", "payment_assist"), vocab.ACTION_TYPES))
    report = actions.agg(
        F.count("*").alias("total_actions"),
        *[count_where(F.col("action_type") == t).alias(n) for n, t in names.items()],
        count_where(F.col("suppressed")).alias("suppressed"),
    )
    return _named(report, "NBA_RECOMMENDATIONS")


def check_customer(
    tables: dict[str, DataFrame], health: DataFrame, moments: DataFrame, actions: DataFrame,
    customer_id: str | None = None,
) -> DataFrame:
    """One line per customer (or one customer) with five related counts.

    The five tables are reduced to marker rows, united, and counted in one shuffle.
    """
    sources = {
        "policies": tables["policy"], "claims": tables["claim"], "interactions": tables["interaction"],
        "moments": moments, "nbas": actions.filter(~F.col("suppressed")),
    }
    marks = reduce(
        DataFrame.unionByName,
        [df.select("customer_id", F.lit(n).alias("what")) for n, df in sources.items()],
    )
    if customer_id is not None:
        marks = marks.filter(F.col("customer_id") == F.lit(customer_id))
    counts = marks.groupBy("customer_id").agg(*[F.count_if(F.col("what") == n).alias(n) for n in sources])
    base = tables["customer"]
    if customer_id is not None:
        base = base.filter(F.col("customer_id") == F.lit(customer_id))
    scores = health.select("customer_id", "health_score", "churn_risk", "risk_level")
    return (
        base.select("customer_id", F.concat("first_name", F.lit(" "), "last_name").alias("name"), "segment")
        .join(scores, "customer_id", "left")
        .join(counts, "customer_id", "left")
        .na.fill(0, list(sources))
    )


def check_evidence(corpus: DataFrame) -> DataFrame:
    report = corpus.agg(
        F.count("*").alias("total_documents"),
        F.count_distinct("customer_id").alias("unique_customers"),
        F.count_distinct("source_type").alias("source_types"),
    )
    return _named(report, "EVIDENCE_SOURCE")


def check_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """Per table: repeated primary keys, and rows whose customer does not exist.

    Every table is read once. A row gives two marks, its key and its customer, each within its table; a row of the customer table also makes its customer known
    to every other table. One aggregation counts equal marks, in two numbers whatever the tables, and a second adds up the problems. Customer
    marks of one table combine before the shuffle, so a hot customer is one row of it per task. A row without a customer counts as one whose customer
    does not exist.
    """
    names = [name.upper() for name in tables]

    def mark(of: int, value: Column, row: bool, known: bool) -> Column:
        return F.struct(F.lit(of).alias("of"), value.alias("value"), F.lit(row).alias("row"), F.lit(known).alias("known"))

    def marks_of(at: int, table: str, df: DataFrame) -> DataFrame:
        customer, is_customer = F.col("customer_id").cast("string"), names[at] == "CUSTOMER"
        others = [mark(len(names) + i, customer, False, True) for i in range(len(names)) if is_customer and i != at]
        key = F.col(KEYS[table]).cast("string")
        return df.select(F.explode(F.array(mark(at, key, True, False), mark(len(names) + at, customer, True, is_customer), *others)).alias("mark")).select("mark.*")

    marks = reduce(DataFrame.unionByName, [marks_of(i, table, df) for i, (table, df) in enumerate(tables.items())])
    counted = marks.groupBy("of", "value").agg(F.count_if("row").alias("rows"), F.count_if("known").alias("known"))
    unknown = F.col("value").isNull() | (F.col("known") == 0)
    totals = counted.agg(
        *[F.count_if((F.col("of") == i) & (F.col("rows") > 1)).alias(f"repeated_{n}") for i, n in enumerate(names)],
        *[F.coalesce(F.sum(F.when((F.col("of") == len(names) + i) & unknown, F.col("rows"))), F.lit(0)).alias(f"unknown_{n}") for i, n in enumerate(names)],
    )
    problems = [(n, p, c) for n in names for p, c in (("duplicate_keys", f"repeated_{n}"), ("unknown_customers", f"unknown_{n}"))]
    lines = F.array(*[F.struct(F.lit(n).alias("table_name"), F.lit(p).alias("problem"), F.col(c).alias("value")) for n, p, c in problems])
    return totals.select(F.inline(lines))
