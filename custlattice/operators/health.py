"""Customer health: five per-customer aggregates, joined once on the customer, then scored."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custlattice import vocab
from custlattice.functions import scores
from custlattice.functions.values import count_where, date_lit, days_between, mean_exact, ratio, round_exact, ts_lit
from custlattice.operators.enrich import mean_sentiment

HEALTH = (
    "customer_id", "health_score", "churn_risk", "sentiment_score", "claims_score",
    "payment_score", "engagement_score", "risk_level", "scored_at",
)


def agg_sentiment(enrichment: DataFrame) -> DataFrame:
    return mean_sentiment(enrichment)


def agg_claims(claim: DataFrame) -> DataFrame:
    status = F.col("status")
    return claim.groupBy("customer_id").agg(
        F.count("*").alias("total_claims"),
        count_where(status.isin(*vocab.UNRESOLVED_CLAIM)).alias("open_claims"),
        count_where(status == "Denied").alias("denied_claims"),
        mean_exact(F.col("resolution_days"), 0).alias("avg_resolution"),
    )


def agg_payments(payment: DataFrame) -> DataFrame:
    failed = count_where(F.col("status") == "Failed")
    return payment.groupBy("customer_id").agg(
        F.count("*").alias("total_payments"),
        failed.alias("failed_payments"),
        ratio(failed, F.count("*")).alias("failure_rate"),
    )


def agg_engagement(interaction: DataFrame, as_of: datetime) -> DataFrame:
    last = F.max("interaction_date")
    return interaction.groupBy("customer_id").agg(
        F.count("*").alias("interaction_count"),
        last.alias("last_interaction"),
        days_between(last, date_lit(as_of)).alias("days_since_last"),
    )


def agg_moments(moments: DataFrame) -> DataFrame:
    return moments.groupBy("customer_id").agg(
        count_where(F.col("moment_type") == "CHURN").alias("churn_moments"),
        F.count("*").alias("total_moments"),
    )


def with_scores(facts: DataFrame) -> DataFrame:
    """Component scores and churn risk, unrounded, from the joined aggregates."""
    c = F.col
    return facts.withColumns(
        {
            "raw_sentiment": scores.score_sentiment(c("avg_sentiment")),
            "raw_claims": scores.score_claims(c("open_claims"), c("denied_claims"), c("avg_resolution")),
            "raw_payment": scores.score_payment(c("failure_rate")),
            "raw_engagement": scores.score_engagement(c("days_since_last")),
            "raw_churn": scores.churn_risk(
                c("churn_moments"), c("avg_sentiment"), c("failure_rate"), c("open_claims"), c("days_since_last")
            ),
        }
    )


def customer_health(
    customer: DataFrame, sentiment: DataFrame, claims: DataFrame, payments: DataFrame,
    engagement: DataFrame, moments: DataFrame, as_of: datetime,
) -> DataFrame:
    """One row per customer. All inputs but ``customer`` are the aggregates above, already one row
    per customer and hash-partitioned by it, so the left joins add no shuffle of detail rows."""
    facts = (
        customer.select("customer_id")
        .join(sentiment.select("customer_id", "avg_sentiment"), "customer_id", "left")
        .join(claims.select("customer_id", "open_claims", "denied_claims", "avg_resolution"), "customer_id", "left")
        .join(payments.select("customer_id", "failure_rate"), "customer_id", "left")
        .join(engagement.select("customer_id", "days_since_last"), "customer_id", "left")
        .join(moments.select("customer_id", "churn_moments"), "customer_id", "left")
    )
    return scored(facts, as_of)


def scored(facts: DataFrame, as_of: datetime) -> DataFrame:
    """Health rows from the joined aggregates, one row per customer."""
    c = F.col
    return with_scores(facts).select(
        "customer_id",
        scores.health_score(
            c("raw_sentiment"), c("raw_claims"), c("raw_payment"), c("raw_engagement"), c("raw_churn")
        ).alias("health_score"),
        c("raw_churn").cast("double").alias("churn_risk"),
        round_exact(c("raw_sentiment"), 2).alias("sentiment_score"),
        round_exact(c("raw_claims"), 2).alias("claims_score"),
        round_exact(c("raw_payment"), 2).alias("payment_score"),
        round_exact(c("raw_engagement"), 2).alias("engagement_score"),
        scores.risk_level(c("raw_churn")).alias("risk_level"),
        ts_lit(as_of).alias("scored_at"),
    )


def health_apply_delta(health: DataFrame, sentiment: DataFrame, touched: DataFrame, as_of: datetime) -> DataFrame:
    """Quick worsening step for customers with a new interaction; everybody else is unchanged.

    Sentiment is re-read from the average with factor 25, churn grows by 0.15, health drops by 10.
    ``touched`` needs a customer_id column; ``sentiment`` is ``agg_sentiment`` output. Customers
    without a health row are not added.
    """
    hit = touched.select("customer_id").distinct().withColumn("_hit", F.lit(True))
    joined = health.join(hit, "customer_id", "left").join(
        sentiment.select("customer_id", "avg_sentiment"), "customer_id", "left"
    )
    mood = F.coalesce(F.col("avg_sentiment"), F.lit(0.0)) * 25 + 50
    churn = round_exact(F.least(F.lit(1.0), F.col("churn_risk") + 0.15), 4)
    # NULL scores stay NULL, as with a NULL-propagating least/greatest
    churn = F.when(F.col("churn_risk").isNotNull(), churn)
    health_left = F.when(
        F.col("health_score").isNotNull(), round_exact(F.greatest(F.lit(0.0), F.col("health_score") - 10), 2)
    )
    changes = {
        "sentiment_score": round_exact(F.greatest(F.lit(0.0), F.least(F.lit(100.0), mood)), 6),
        "churn_risk": churn,
        "health_score": health_left,
        "risk_level": scores.risk_level(churn),
        "scored_at": ts_lit(as_of),
    }
    return joined.select(
        *[
            F.when(F.col("_hit"), changes[n]).otherwise(F.col(n)).alias(n) if n in changes else F.col(n)
            for n in HEALTH
        ]
    )


def health_rescore(health: DataFrame, fresh: DataFrame, touched: DataFrame) -> DataFrame:
    """Replace the rows of touched customers with freshly computed ones (the batch formula)."""
    hit = touched.select("customer_id").distinct()
    kept = health.select(*HEALTH).join(hit, "customer_id", "left_anti")
    return kept.unionByName(fresh.select(*HEALTH).join(hit, "customer_id", "left_semi"))


def health_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """What changed between two snapshots, per customer present in both."""
    b = before.select(
        "customer_id", F.col("health_score").alias("health_before"), F.col("churn_risk").alias("churn_before"),
        F.col("risk_level").alias("risk_before"),
    )
    a = after.select(
        "customer_id", F.col("health_score").alias("health_after"), F.col("churn_risk").alias("churn_after"),
        F.col("risk_level").alias("risk_after"),
    )
    return b.join(a, "customer_id").withColumns(
        {
            "health_delta": round_exact(F.col("health_after") - F.col("health_before"), 1),
            "churn_delta_pct": round_exact((F.col("churn_after") - F.col("churn_before")) * 100, 1),
        }
    )

