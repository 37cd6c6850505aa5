"""Portfolio, queue and effectiveness reports, and the copilot's sample questions as queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custlattice.functions.values import count_where, date_lit, mean_exact, ratio, round_exact
from custlattice.operators.moments import stale_claims

RISK_ORDER = (("CRITICAL", 1), ("AT_RISK", 2), ("MONITOR", 3))


def _full_name() -> Column:
    return F.concat("first_name", F.lit(" "), "last_name")


def _level(name: str) -> Column:
    return count_where(F.col("risk_level") == name)


def portfolio_kpis(health: DataFrame) -> DataFrame:
    return health.agg(
        F.count("*").alias("total_customers"),
        round_exact(mean_exact(F.col("health_score"), 2), 1).alias("avg_health"),
        round_exact(mean_exact(F.col("churn_risk"), 4) * 100, 1).alias("avg_churn_pct"),
        _level("CRITICAL").alias("critical_count"),
        _level("AT_RISK").alias("at_risk_count"),
    )


def risk_distribution(health: DataFrame) -> DataFrame:
    rank = F.when(F.lit(False), 0)
    for name, position in RISK_ORDER:
        rank = rank.when(F.col("risk_level") == name, position)
    return health.groupBy("risk_level").agg(F.count("*").alias("customers")).orderBy(rank.otherwise(4), "risk_level")


def health_by_segment(customer: DataFrame, health: DataFrame) -> DataFrame:
    joined = customer.select("customer_id", "segment").join(health.select("customer_id", "health_score"), "customer_id")
    return joined.groupBy("segment").agg(
        round_exact(mean_exact(F.col("health_score"), 2), 1).alias("avg_health"),
        F.count("*").alias("customer_count"),
    ).orderBy("avg_health", "segment")


def critical_customers(customer: DataFrame, health: DataFrame, k: int | None = 20) -> DataFrame:
    """Most endangered critical customers first; ``k=None`` lists all of them."""
    names = customer.select("customer_id", _full_name().alias("name"), "segment")
    critical = health.filter(F.col("risk_level") == "CRITICAL").select(
        "customer_id", "health_score", "churn_risk", "risk_level", "sentiment_score"
    )
    out = critical.join(names, "customer_id").orderBy(F.col("churn_risk").desc(), "customer_id")
    return out if k is None else out.limit(k)


def portfolio_context(health: DataFrame) -> DataFrame:
    """The totals as one line of text."""
    stats = health.agg(
        F.count("*").alias("n"),
        _level("CRITICAL").alias("critical"),
        _level("AT_RISK").alias("at_risk"),
        F.round(mean_exact(F.col("health_score"), 2).cast("decimal(18,8)"), 1).cast("decimal(18,1)").alias("health"),
        F.round(mean_exact(F.col("churn_risk"), 4).cast("decimal(18,8)"), 3).cast("decimal(18,3)").alias("churn"),
    )
    text = F.concat(
        F.lit("Portfolio: "), F.col("n").cast("string"), F.lit(" customers, "),
        F.col("critical").cast("string"), F.lit(" critical, "), F.col("at_risk").cast("string"),
        F.lit(" at-risk, avg health "), F.col("health").cast("string"), F.lit(", avg churn "),
        F.col("churn").cast("string"),
    )
    return stats.select(text.alias("context"))


def nba_status_summary(actions: DataFrame) -> DataFrame:
    status = F.col("status")
    return actions.agg(
        F.count("*").alias("total"),
        count_where(status == "PENDING").alias("pending"),
        count_where(status == "APPROVED").alias("approved"),
        count_where(status == "REJECTED").alias("rejected"),
        count_where(F.col("suppressed")).alias("suppressed"),
    )


def nba_queue(actions: DataFrame, customer: DataFrame, action_type: str | None = None, k: int | None = 50) -> DataFrame:
    """Pending actions, most urgent first, optionally of one type; ``k=None`` lists the whole queue."""
    queue = actions.filter((F.col("status") == "PENDING") & ~F.col("suppressed"))
    if action_type is not None:
        queue = queue.filter(F.col("action_type") == F.lit(action_type))
    names = customer.select("customer_id", _full_name().alias("customer_name"))
    out = (
        queue.join(names, "customer_id")
        .select(
            "action_id", "customer_id", "customer_name", "action_type", "confidence", "rationale", "priority",
            "status", "created_at",
        )
        .orderBy("priority", F.col("confidence").desc(), "action_id")
    )
    return out if k is None else out.limit(k)


def nba_effectiveness(log: DataFrame) -> DataFrame:
    return log.groupBy("action_type").agg(
        F.count("*").alias("total"),
        count_where(F.col("decision") == "APPROVED").alias("approved"),
        count_where(F.col("outcome") == "SUCCESSFUL").alias("successful"),
    )


def retention_metrics(customer: DataFrame, policy: DataFrame, health: DataFrame) -> DataFrame:
    """Active and cancelled policy shares and the elevated-churn share, by segment and region.

    Policies are counted per customer first, so the customer join carries one row per customer.
    """
    counts = policy.groupBy("customer_id").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("status") == "Active").alias("active"),
        F.count_if(F.col("status") == "Cancelled").alias("cancelled"),
    )
    joined = (
        customer.select("customer_id", "segment", "region")
        .join(health.select("customer_id", "churn_risk"), "customer_id", "left")
        .join(counts, "customer_id", "left")
    )
    return joined.groupBy("segment", "region").agg(
        F.count("*").alias("customers"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("policies"),
        round_exact(ratio(F.sum("active"), F.sum("n")), 4).alias("active_share"),
        round_exact(ratio(F.sum("cancelled"), F.sum("n")), 4).alias("cancelled_share"),
        round_exact(ratio(F.count_if(F.col("churn_risk") >= 0.4), F.count("churn_risk")), 4).alias("elevated_churn_share"),
    )


# --- sample questions ------------------------------------------------------------------------


def q_critical_now(customer: DataFrame, health: DataFrame) -> DataFrame:
    return critical_customers(customer, health, None)


def q_competitor_mentions(wide: DataFrame, transcript: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """Customers whose transcripts of the last ``days`` days name a competitor, with the names."""
    recent = transcript.filter(F.col("created_at").cast("date") >= F.date_sub(date_lit(as_of), days)).select(
        F.col("transcript_id").alias("source_id")
    )
    named = wide.filter((F.col("source_table") == "TRANSCRIPT") & (F.array_size("entities.competitors") > 0))
    each = named.join(recent, "source_id", "left_semi").select(
        "customer_id", F.explode("entities.competitors").alias("competitor")
    )
    return each.groupBy("customer_id", "competitor").agg(F.count("*").alias("mentions"))


def q_pending_retention(actions: DataFrame, customer: DataFrame) -> DataFrame:
    return nba_queue(actions, customer, "RETENTION_OFFER", None)


def q_stale_claims_negative(claim: DataFrame, sentiment: DataFrame, as_of: datetime) -> DataFrame:
    unhappy = sentiment.filter(F.col("avg_sentiment") < -0.2).select("customer_id", "avg_sentiment")
    return stale_claims(claim, as_of).select(
        "customer_id", "claim_id", "claim_type", "claim_amount", "status", "days_open"
    ).join(unhappy, "customer_id")


def q_friction_this_week(moments: DataFrame, as_of: datetime) -> DataFrame:
    """Claim-friction moments since Monday."""
    monday = F.date_trunc("week", date_lit(as_of)).cast("date")
    return moments.filter(
        (F.col("moment_type") == "CLAIM_FRICTION") & (F.col("detected_at").cast("date") >= monday)
    ).select("moment_id", "customer_id", "source_event_id", "confidence")


def q_resolution_by_type(claim: DataFrame) -> DataFrame:
    return claim.groupBy("claim_type").agg(
        round_exact(mean_exact(F.col("resolution_days"), 0), 2).alias("avg_resolution_days"),
        F.count("resolution_days").alias("resolved_claims"),
    )


def q_top_contact_reasons(interaction: DataFrame, k: int | None = None) -> DataFrame:
    """Topics by number of contacts, or the ``k`` most frequent ones."""
    counts = interaction.groupBy("topic").agg(F.count("*").alias("contacts"))
    ordered = counts.orderBy(F.col("contacts").desc(), "topic")
    return ordered if k is None else ordered.limit(k)


def q_payment_assistance(actions: DataFrame, customer: DataFrame) -> DataFrame:
    return nba_queue(actions, customer, "PAYMENT_ASSISTANCE", None).select(
        "customer_id", "customer_name", "action_id", "confidence", "rationale"
    )
