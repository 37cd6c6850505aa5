"""Unified customer events: five projections of the source tables and their union."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custlattice.functions.values import ts_lit

# Status -> event type, per source; the last entry is the fallback.
POLICY_EVENTS = {"Active": "POLICY_ACTIVE", "Cancelled": "POLICY_CANCELLED", "Expired": "POLICY_EXPIRED"}
CLAIM_EVENTS = {
    "Open": "CLAIM_FILED", "Under Review": "CLAIM_REVIEW", "Approved": "CLAIM_APPROVED",
    "Denied": "CLAIM_DENIED", "Settled": "CLAIM_SETTLED",
}
PAYMENT_EVENTS = {"Completed": "PAYMENT_SUCCESS", "Failed": "PAYMENT_FAILED", "Refunded": "PAYMENT_REFUNDED"}


def _mapped(status: Column, names: dict[str, str], fallback: str) -> Column:
    out = F.when(F.lit(False), "")
    for value, name in names.items():
        out = out.when(status == value, name)
    return out.otherwise(fallback)


def _event(df: DataFrame, table: str, tag: str, key: str, kind: Column, at: Column, **payload: str) -> DataFrame:
    """``payload`` maps JSON member to column; NULL members are left out of the JSON."""
    return df.select(
        F.concat(F.lit(f"EVT-{tag}-"), F.col(key)).alias("event_id"),
        "customer_id",
        kind.alias("event_type"),
        at.alias("event_timestamp"),
        F.lit(table).alias("source_table"),
        F.col(key).alias("source_id"),
        F.to_json(F.struct(*[F.col(c).alias(name) for name, c in payload.items()])).alias("event_payload"),
    )


def events_policy(policy: DataFrame) -> DataFrame:
    return _event(
        policy, "POLICY", "POL", "policy_id",
        _mapped(F.col("status"), POLICY_EVENTS, "POLICY_CREATED"), F.col("created_at"),
        policy_type="policy_type", premium="premium_amount", status="status",
    )


def events_claim(claim: DataFrame, as_of: datetime) -> DataFrame:
    return _event(
        claim, "CLAIM", "CLM", "claim_id",
        _mapped(F.col("status"), CLAIM_EVENTS, "CLAIM_CLOSED"),
        F.coalesce(F.col("created_at"), ts_lit(as_of)),
        claim_type="claim_type", amount="claim_amount", status="status", resolution_days="resolution_days",
    )


def events_payment(payment: DataFrame, as_of: datetime) -> DataFrame:
    return _event(
        payment, "PAYMENT", "PAY", "payment_id",
        _mapped(F.col("status"), PAYMENT_EVENTS, "PAYMENT_PENDING"),
        F.coalesce(F.col("created_at"), ts_lit(as_of)),
        amount="amount", status="status", method="payment_method", failure_reason="failure_reason",
    )


def events_interaction(interaction: DataFrame) -> DataFrame:
    return _event(
        interaction, "INTERACTION", "INT", "interaction_id",
        F.concat(F.lit("INTERACTION_"), F.upper("channel")), F.col("interaction_date"),
        channel="channel", direction="direction", topic="topic", disposition="disposition",
    )


def events_survey(survey: DataFrame) -> DataFrame:
    return _event(
        survey, "SURVEY", "SRV", "survey_id", F.lit("SURVEY_SUBMITTED"), F.col("submitted_at"),
        survey_type="survey_type", nps_score="nps_score", csat_score="csat_score",
    )


def customer_events(tables: dict[str, DataFrame], as_of: datetime) -> DataFrame:
    parts = [
        events_policy(tables["policy"]),
        events_claim(tables["claim"], as_of),
        events_payment(tables["payment"], as_of),
        events_interaction(tables["interaction"]),
        events_survey(tables["survey"]),
    ]
    return reduce(DataFrame.unionByName, parts)
