"""Next-best-action rules.

Every rule skips customers that already hold a pending or approved action of its type. Rules that
need a renewal or a competitor use data reduced to one row per customer first, so no rule joins a
customer's texts with that customer's policies.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custlattice import vocab
from custlattice.functions.values import (
    clamp, count_where, date_lit, one_decimal, ratio, round_exact, stamp, ts_lit, ts_plus_days,
)
from custlattice.operators.grouping import join_hot
from custlattice.operators.moments import competitor_rows, next_renewal, renewing, stale_claims
from custlattice.sources.tables import delete_where

RETENTION, ESCALATION, CAMPAIGN, CROSS_SELL, ASSISTANCE = vocab.ACTION_TYPES

# Rationale texts; {} marks where a value of the row goes.
RETENTION_TEXT = (
    "High churn risk ({}%) with negative sentiment ({}) and policy renewal within 60 days. "
    "Recommend proactive retention outreach with discount offer."
)
ESCALATION_TEXT = (
    "Open claim ({}) pending for {} days with negative customer sentiment. "
    "Escalate to claims manager for expedited resolution."
)
CAMPAIGN_TEXT = (
    "Customer mentioned competitor(s) in recent interaction with policy renewal within 45 days. "
    "Initiate targeted retention campaign with competitive comparison and loyalty benefits."
)
CROSS_SELL_TEXT = (
    "Premium segment customer with positive sentiment and good engagement. "
    "Eligible for cross-sell of additional coverage products."
)
ASSISTANCE_TEXT = (
    "Customer has {} failed payments in recent period. "
    "Proactive outreach to resolve payment method issues and prevent policy lapse."
)
# Suppression reasons
SUPPRESSED_MOOD = "Suppressed: negative sentiment detected"
SUPPRESSED_CHURN = "Suppressed: customer at churn risk"


def _filled(template: str, *values: Column) -> Column:
    pieces = template.split("{}")
    parts = [F.lit(pieces[0])]
    for value, piece in zip(values, pieces[1:]):
        parts += [value.cast("string"), F.lit(piece)]
    return F.concat(*parts)


def _stamped(prefix: str, as_of: datetime) -> Column:
    return F.concat(F.lit(prefix), F.col("customer_id"), F.lit("-" + stamp(as_of)))


def _action(
    df: DataFrame, as_of: datetime, action_id: Column, kind: str, confidence: Column, rationale: Column,
    priority: int, keep_days: int, suppression: Column | None = None, **evidence: Column,
) -> DataFrame:
    reason = suppression if suppression is not None else F.lit(None).cast("string")
    return df.select(
        action_id.alias("action_id"),
        "customer_id",
        F.lit(kind).alias("action_type"),
        round_exact(confidence, 6).alias("confidence"),
        rationale.alias("rationale"),
        F.lit(priority).alias("priority"),
        F.when(reason.isNotNull(), "SUPPRESSED").otherwise("PENDING").alias("status"),
        reason.isNotNull().alias("suppressed"),
        reason.alias("suppression_reason"),
        F.to_json(F.struct(*[v.alias(k) for k, v in evidence.items()])).alias("evidence"),
        ts_lit(as_of).alias("created_at"),
        ts_plus_days(as_of, keep_days).alias("expires_at"),
    )


def _free(df: DataFrame, existing: DataFrame, kind: str) -> DataFrame:
    """Rows of customers without a blocking action of this kind; for few rows per customer."""
    holders = existing.filter(
        (F.col("action_type") == kind)
        & F.col("status").isin(*vocab.BLOCKING_STATUSES)
        & F.col("customer_id").isNotNull()
    ).select("customer_id").distinct()
    return df.join(holders, "customer_id", "left_anti")


def clear_pending(actions: DataFrame, mode: str = "fresh") -> DataFrame:
    """Drop what the next run regenerates. ``accumulate`` leaves earlier suppressed rows in place."""
    gone = ("PENDING",) if mode == "accumulate" else ("PENDING", "SUPPRESSED")
    return delete_where(actions, F.col("status").isin(*gone))


def nba_retention(
    health: DataFrame, policy: DataFrame, existing: DataFrame, as_of: datetime, mode: str = "one"
) -> DataFrame:
    """Churn >= 0.4, sentiment below 50, a renewal within 60 days (the soonest, or every one)."""
    renewals = (renewing if mode == "all" else next_renewal)(policy, as_of, 60)
    at_risk = health.filter((F.col("churn_risk") >= 0.4) & (F.col("sentiment_score") < 50)).select(
        "customer_id", "churn_risk", "sentiment_score"
    )
    hits = _free(at_risk, existing, RETENTION).join(renewals, "customer_id")
    churn, mood = F.col("churn_risk"), F.col("sentiment_score")
    return _action(
        hits, as_of, _stamped("NBA-RET-", as_of), RETENTION, clamp(churn * 0.5 + 0.5, 0.0, 0.95),
        _filled(RETENTION_TEXT, one_decimal(churn * 100), one_decimal(mood)), 1, 14,
        churn_risk=churn, sentiment=mood, renewal_days=F.col("renewal_days"),
    )


def nba_claims(claim: DataFrame, health: DataFrame, existing: DataFrame, as_of: datetime) -> DataFrame:
    """One escalation per stale claim of a customer with sentiment below 50.

    An escalation that was decided earlier and fires again gets this run's stamp, so that ids stay unique.
    """
    unhappy = health.filter(F.col("sentiment_score") < 50).select("customer_id", "sentiment_score")
    stale = stale_claims(claim, as_of).select("customer_id", "claim_id", "claim_amount", "days_open")
    hits = join_hot(stale, _free(unhappy, existing, ESCALATION), "customer_id")
    taken = existing.filter(F.col("action_type") == ESCALATION).select(F.col("action_id").alias("_id")).distinct()
    plain = F.concat(F.lit("NBA-CLM-"), "customer_id", F.lit("-"), "claim_id")
    hits = hits.withColumn("_id", plain).join(taken.withColumn("_taken", F.lit(True)), "_id", "left")
    days = F.col("days_open")
    return _action(
        hits, as_of, F.when(F.col("_taken"), F.concat("_id", F.lit("-" + stamp(as_of)))).otherwise(F.col("_id")), ESCALATION,
        clamp((days - 14) * 0.01 + 0.6, 0.0, 0.90), _filled(ESCALATION_TEXT, F.col("claim_id"), days), 2, 7,
        claim_id=F.col("claim_id"), days_open=days, claim_amount=F.col("claim_amount"),
        sentiment=F.col("sentiment_score"),
    )


def nba_competitor(
    signals: DataFrame, policy: DataFrame, existing: DataFrame, as_of: datetime, mode: str = "one",
    wide: DataFrame | None = None,
) -> DataFrame:
    """Competitor named and a renewal within 45 days: soonest renewal and first naming row, or
    (``all``) every naming row with every distinct renewal day."""
    if mode == "all":  # at most 45 renewal days per naming row
        hits = join_hot(competitor_rows(wide), _free(renewing(policy, as_of, 45).distinct(), existing, CAMPAIGN), "customer_id")
    else:
        named = signals.filter(F.col("competitor").isNotNull()).select(
            "customer_id", F.col("competitor.names").alias("names")
        )
        hits = _free(named, existing, CAMPAIGN).join(next_renewal(policy, as_of, 45), "customer_id")
    return _action(
        hits, as_of, _stamped("NBA-CRC-", as_of), CAMPAIGN, F.lit(0.80),
        F.lit(CAMPAIGN_TEXT), 2, 10,
        competitors_mentioned=F.col("names"), renewal_days=F.col("renewal_days"),
    )


def suppression_reason(sentiment: Column, risk: Column) -> Column:
    """Why a cross-sell must not go out now; mood is checked before churn. NULL means it may."""
    return F.when(sentiment < 40, SUPPRESSED_MOOD).when(risk.isin("CRITICAL", "AT_RISK"), SUPPRESSED_CHURN)


def nba_cross_sell(customer: DataFrame, health: DataFrame, existing: DataFrame, as_of: datetime) -> DataFrame:
    """Premium and enterprise customers with health of at least 60; suppressed where unfitting."""
    valued = customer.filter(F.col("segment").isin("Premium", "Enterprise")).select("customer_id", "segment")
    well = health.filter(F.col("health_score") >= 60).select(
        "customer_id", "health_score", "sentiment_score", "risk_level"
    )
    hits = _free(valued, existing, CROSS_SELL).join(well, "customer_id")
    return _action(
        hits, as_of, _stamped("NBA-XSL-", as_of), CROSS_SELL, F.lit(0.70), F.lit(CROSS_SELL_TEXT), 3, 30,
        suppression_reason(F.col("sentiment_score"), F.col("risk_level")),
        segment=F.col("segment"), sentiment=F.col("sentiment_score"), health_score=F.col("health_score"),
    )


def nba_payment(payment: DataFrame, existing: DataFrame, as_of: datetime) -> DataFrame:
    """Two or more failed payments dated within the last three months (no upper date bound)."""
    since = F.add_months(date_lit(as_of), -3)
    recent = (
        payment.filter(F.col("payment_date") >= since)
        .groupBy("customer_id")
        .agg(count_where(F.col("status") == "Failed").alias("failed"), F.count("*").alias("total"))
        .filter(F.col("failed") >= 2)
    )
    failed, total = F.col("failed"), F.col("total")
    return _action(
        _free(recent, existing, ASSISTANCE), as_of, _stamped("NBA-PAY-", as_of), ASSISTANCE,
        clamp(failed * 0.15 + 0.5, 0.0, 0.90), _filled(ASSISTANCE_TEXT, failed), 2, 7,
        failed_payments=failed, total_payments=total, failure_rate=round_exact(ratio(failed, total), 3),
    )


def generate_nba(
    tables: dict[str, DataFrame], signals: DataFrame, health: DataFrame, existing: DataFrame,
    as_of: datetime, mode: str = "fresh",
) -> DataFrame:
    """The next version of the action table: what was decided before, plus the five rules' actions.

    Pending rows are cleared first, so only approved ones block.
    """
    kept = clear_pending(existing, mode)
    parts = [
        kept,
        nba_retention(health, tables["policy"], kept, as_of),
        nba_claims(tables["claim"], health, kept, as_of),
        nba_competitor(signals, tables["policy"], kept, as_of),
        nba_cross_sell(tables["customer"], health, kept, as_of),
        nba_payment(tables["payment"], kept, as_of),
    ]
    return reduce(DataFrame.unionByName, parts)


def customer_nba(actions: DataFrame, as_of: datetime, customer_id: str | None = None) -> DataFrame:
    """Unsuppressed, unexpired actions in any status; of one customer most urgent first, or of all without order."""
    live = actions.filter(
        ~F.col("suppressed") & (F.col("expires_at").isNull() | (F.col("expires_at") > ts_lit(as_of)))
    )
    if customer_id is not None:
        live = live.filter(F.col("customer_id") == F.lit(customer_id))
        live = live.orderBy("priority", F.col("confidence").desc(), "action_id")
    return live.select(
        "customer_id", "action_id", "action_type", "confidence", "rationale", "priority", "status", "created_at"
    )
