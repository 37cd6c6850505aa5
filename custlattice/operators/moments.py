"""Rule-based customer moments.

In the default ``mode="one"`` each rule yields one moment per customer (claim friction: per claim)
from data already reduced to one row per customer, so no rule joins a customer's texts with all of
that customer's policies. ``mode="all"`` keeps one moment per qualifying source row.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custlattice import vocab
from custlattice.functions.values import date_lit, days_after, days_between, stamp, ts_lit, ts_plus_days
from custlattice.operators.grouping import anti_hot, join_hot

CHURN, FRICTION, PRICE = "CHURN", "CLAIM_FRICTION", "PRICE_SENSITIVITY"
RENEWAL_DAYS = 45  # renewal window of the competitor rule
STALE_CLAIM_DAYS = 14

# Reason and source texts kept in a moment's context.
COMPETITOR_REASON = "Competitor mentioned with renewal approaching"
COMPETITOR_SOURCE = "AI enrichment + policy data"
CANCEL_REASON = "Negative sentiment with cancellation intent detected"
CANCEL_SOURCE = "Sentiment + intent analysis"
FRICTION_REASON = "Open claim exceeding 14 days with negative customer sentiment"
PRICE_REASON = "Customer expressed price sensitivity or cost concerns"
PRICE_SOURCE = "Intent analysis"


def _moment(
    df: DataFrame, as_of: datetime, moment_id: Column, kind: str, confidence: float, keep_days: int,
    source_event: Column, **context: Column,
) -> DataFrame:
    return df.select(
        moment_id.alias("moment_id"),
        "customer_id",
        F.lit(kind).alias("moment_type"),
        ts_lit(as_of).alias("detected_at"),
        F.lit(confidence).alias("confidence"),
        F.to_json(F.struct(*[v.alias(k) for k, v in context.items()])).alias("context"),
        source_event.alias("source_event_id"),
        ts_plus_days(as_of, keep_days).alias("expires_at"),
    )


def _stamped(prefix: str, as_of: datetime) -> Column:
    return F.concat(F.lit(prefix), F.col("customer_id"), F.lit("-" + stamp(as_of)))


def renewing(policy: DataFrame, as_of: datetime, days: int) -> DataFrame:
    """Active policies renewing in 1..``days`` days; plain date bounds, so they reach the scan."""
    return policy.filter(
        (F.col("status") == "Active")
        & F.col("end_date").between(days_after(as_of, 1), days_after(as_of, days))
    ).select("customer_id", days_between(date_lit(as_of), F.col("end_date")).alias("renewal_days"))


def next_renewal(policy: DataFrame, as_of: datetime, days: int) -> DataFrame:
    """Soonest renewal in the window, one row per customer."""
    return renewing(policy, as_of, days).groupBy("customer_id").agg(F.min("renewal_days").alias("renewal_days"))


def competitor_rows(wide: DataFrame) -> DataFrame:
    return wide.filter(F.array_size("entities.competitors") > 0).select(
        "customer_id", F.col("entities_row").alias("row_id"), F.col("entities.competitors").alias("names")
    )


def moments_churn_competitor(
    signals: DataFrame, policy: DataFrame, as_of: datetime, mode: str = "one", wide: DataFrame | None = None
) -> DataFrame:
    """Competitor named and a renewal within 45 days: soonest renewal, first naming row."""
    if mode == "all":
        # distinct renewal days: at most 45 per customer, whatever the number of policies
        hits = join_hot(competitor_rows(wide), renewing(policy, as_of, RENEWAL_DAYS).distinct(), "customer_id")
    else:
        named = signals.filter(F.col("competitor").isNotNull()).select(
            "customer_id", F.col("competitor.row_id").alias("row_id")
        )
        hits = named.join(next_renewal(policy, as_of, RENEWAL_DAYS), "customer_id")
    return _moment(
        hits, as_of, _stamped("MOM-CHR-", as_of), CHURN, 0.85, 30, F.col("row_id"),
        reason=F.lit(COMPETITOR_REASON), renewal_days=F.col("renewal_days"), source=F.lit(COMPETITOR_SOURCE),
    )


def moments_churn_intent(
    signals: DataFrame, churn_moments: DataFrame, as_of: datetime, mode: str = "one",
    wide: DataFrame | None = None, enrichment: DataFrame | None = None,
) -> DataFrame:
    """Very negative text that also asks to cancel, for customers without a churn moment yet.

    ``one`` and ``all`` look for both signals on one document (the most negative one, or every
    one). ``row`` looks for them on one sparse enrichment row: no enricher fills both.
    """
    if mode == "one":
        hits = signals.filter(F.col("cancel").isNotNull()).select(
            "customer_id", F.col("cancel.score").alias("score"), F.col("cancel.row_id").alias("row_id")
        )
    else:
        rows = wide if mode == "all" else enrichment
        row_id = F.col("intents_row" if mode == "all" else "enrichment_id")
        hits = rows.filter(
            (F.col("sentiment_score") < -0.3) & F.col("intents.cancellation_intent")
        ).select("customer_id", F.col("sentiment_score").alias("score"), row_id.alias("row_id"))
    held = churn_moments.filter(
        (F.col("moment_type") == CHURN) & F.col("customer_id").isNotNull()
    ).select("customer_id").distinct()
    return _moment(
        anti_hot(hits, held, "customer_id"), as_of, _stamped("MOM-CHR2-", as_of), CHURN, 0.90, 14,
        F.col("row_id"),
        reason=F.lit(CANCEL_REASON), sentiment_score=F.col("score"), source=F.lit(CANCEL_SOURCE),
    )


def stale_claims(claim: DataFrame, as_of: datetime) -> DataFrame:
    """Unresolved claims filed more than 14 days ago; a plain date bound, so it reaches the scan."""
    return claim.filter(
        F.col("status").isin(*vocab.UNRESOLVED_CLAIM)
        & (F.col("filed_date") < days_after(as_of, -STALE_CLAIM_DAYS))
    ).withColumn("days_open", days_between(F.col("filed_date"), date_lit(as_of)))


def moments_claim_friction(claim: DataFrame, sentiment: DataFrame, as_of: datetime) -> DataFrame:
    """Stale claim of a customer whose average sentiment is below -0.2; one moment per claim."""
    unhappy = sentiment.filter(F.col("avg_sentiment") < -0.2).select("customer_id", "avg_sentiment")
    hits = stale_claims(claim, as_of).select("customer_id", "claim_id", "days_open").join(unhappy, "customer_id")
    return _moment(
        hits, as_of, F.concat(F.lit("MOM-CF-"), "customer_id", F.lit("-"), "claim_id"), FRICTION, 0.80, 7,
        F.concat(F.lit("EVT-CLM-"), "claim_id"),
        reason=F.lit(FRICTION_REASON), claim_id=F.col("claim_id"), days_open=F.col("days_open"),
        avg_sentiment=F.col("avg_sentiment"),
    )


def moments_price_sensitivity(
    signals: DataFrame, as_of: datetime, mode: str = "one", wide: DataFrame | None = None
) -> DataFrame:
    """Price concern in the intents: the first row per customer, or every row."""
    if mode == "all":
        hits = wide.filter(F.col("intents.price_sensitivity")).select("customer_id", F.col("intents_row").alias("row_id"))
    else:
        hits = signals.filter(F.col("price_row").isNotNull()).select("customer_id", F.col("price_row").alias("row_id"))
    return _moment(
        hits, as_of, _stamped("MOM-PS-", as_of), PRICE, 0.75, 30, F.col("row_id"),
        reason=F.lit(PRICE_REASON), source=F.lit(PRICE_SOURCE),
    )


def detect_moments(
    signals: DataFrame, policy: DataFrame, claim: DataFrame, as_of: datetime, mode: str = "one",
    wide: DataFrame | None = None,
) -> DataFrame:
    """All rules in order; the second rule sees what the first one found."""
    competitor = moments_churn_competitor(signals, policy, as_of, mode, wide)
    parts = [
        competitor,
        moments_churn_intent(signals, competitor, as_of, mode, wide),
        moments_claim_friction(claim, signals, as_of),
        moments_price_sensitivity(signals, as_of, mode, wide),
    ]
    return reduce(DataFrame.unionByName, parts)


def active_moments(moments: DataFrame, as_of: datetime, customer_id: str | None = None) -> DataFrame:
    """Unexpired moments; of one customer newest first, or of all of them without order."""
    live = moments.filter(F.col("expires_at").isNull() | (F.col("expires_at") > ts_lit(as_of)))
    if customer_id is not None:
        live = live.filter(F.col("customer_id") == F.lit(customer_id)).orderBy(F.col("detected_at").desc(), "moment_id")
    return live.select("customer_id", "moment_id", "moment_type", "confidence", "detected_at", "context")
