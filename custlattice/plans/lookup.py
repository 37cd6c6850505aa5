"""Customer look-ups. Each takes an optional customer id; without one it covers all customers.

The order belongs to the one-customer view; a listing of all customers has none and shuffles nothing.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custlattice.functions.values import date_lit, ts_lit
from custlattice.operators.grouping import paged_arrays, top_per_key

HEALTH_FIELDS = (
    "health_score", "churn_risk", "risk_level", "sentiment_score", "claims_score", "payment_score",
    "engagement_score",
)
PAGE = 10_000  # items per nested record


def _of(df: DataFrame, customer_id: str | None) -> DataFrame:
    return df if customer_id is None else df.filter(F.col("customer_id") == F.lit(customer_id))


def _ordered(df: DataFrame, customer_id: str | None, *order) -> DataFrame:
    return df if customer_id is None else df.orderBy(*order)


def customer_profile(customer: DataFrame, health: DataFrame, customer_id: str | None = None) -> DataFrame:
    scores = _of(health, customer_id).select("customer_id", *HEALTH_FIELDS)
    return _of(customer, customer_id).join(scores, "customer_id", "left")


def customer_policies(policy: DataFrame, customer_id: str | None = None) -> DataFrame:
    listed = _of(policy, customer_id).select(
        "customer_id", "policy_id", "policy_type", "premium_amount", "status", "start_date", "end_date"
    )
    return _ordered(listed, customer_id, F.col("start_date").desc(), "policy_id")


def customer_claims(claim: DataFrame, customer_id: str | None = None) -> DataFrame:
    listed = _of(claim, customer_id).select(
        "customer_id", "claim_id", "claim_type", "claim_amount", "status", "filed_date", "resolution_days"
    )
    return _ordered(listed, customer_id, F.col("filed_date").desc(), "claim_id")


def customer_payments(payment: DataFrame, customer_id: str | None = None) -> DataFrame:
    listed = _of(payment, customer_id).select(
        "customer_id", "payment_id", "amount", "payment_date", "status", "payment_method", "failure_reason"
    )
    return _ordered(listed, customer_id, F.col("payment_date").desc(), "payment_id")


def customer_interactions(interaction: DataFrame, customer_id: str | None = None) -> DataFrame:
    listed = _of(interaction, customer_id).select(
        "customer_id", "interaction_id", "channel", "direction", "interaction_date", "topic", "disposition"
    )
    return _ordered(listed, customer_id, F.col("interaction_date").desc(), "interaction_id")


def customer_timeline(events: DataFrame, customer_id: str | None = None, k: int = 50) -> DataFrame:
    """Latest ``k`` events of one customer, or of each customer."""
    newest = (F.col("event_timestamp").desc_nulls_last(), F.col("event_id"))
    slim = _of(events, customer_id).select(
        "customer_id", "event_id", "event_type", "event_timestamp", "source_table", "source_id"
    )
    if customer_id is not None:
        return slim.orderBy(*newest).limit(k)
    return top_per_key(slim, "customer_id", k, *newest)


def customer_actions(actions: DataFrame, customer_id: str | None = None) -> DataFrame:
    """Unsuppressed actions, expired ones included, most urgent first."""
    listed = _of(actions, customer_id).filter(~F.col("suppressed")).select(
        "customer_id", "action_id", "action_type", "confidence", "rationale", "priority", "status"
    )
    return _ordered(listed, customer_id, "priority", F.col("confidence").desc(), "action_id")


def customer_health_state(health: DataFrame, customer_id: str | None = None) -> DataFrame:
    return _of(health, customer_id).select(
        "customer_id", "health_score", "churn_risk", "risk_level", "sentiment_score", "engagement_score"
    )


def _live(df: DataFrame, as_of: datetime) -> DataFrame:
    return df.filter(F.col("expires_at").isNull() | (F.col("expires_at") > ts_lit(as_of)))


MOMENT = "struct<moment_type:string,confidence:double,detected_at:timestamp_ntz,context:string>"
POLICY = "struct<policy_id:string,policy_type:string,premium:double,status:string,end_date:date>"
CLAIM = "struct<claim_id:string,claim_type:string,amount:double,status:string,filed_date:date>"


def customer_360(
    tables: dict[str, DataFrame], health: DataFrame, moments: DataFrame, as_of: datetime,
    customer_id: str | None = None, page_size: int = PAGE,
) -> DataFrame:
    """Nested record per customer: master data, health, live moments, policies, claims filed in
    the last six months.

    Record n of a customer holds ``page_size`` of its items (see ``paged_arrays``), so that no array grows
    without bound; totals are sums over a customer's records.
    """

    def item(df, key, moment=None, policy=None, claim=None):
        return df.select(
            "customer_id",
            F.col(key).alias("item_id"),
            (moment if moment is not None else F.lit(None)).cast(MOMENT).alias("moment"),
            (policy if policy is not None else F.lit(None)).cast(POLICY).alias("policy"),
            (claim if claim is not None else F.lit(None)).cast(CLAIM).alias("claim"),
        )

    recent = tables["claim"].filter(F.col("filed_date") >= F.add_months(date_lit(as_of), -6))
    items = (
        item(
            _live(_of(moments, customer_id), as_of), "moment_id",
            moment=F.struct("moment_type", "confidence", "detected_at", "context"),
        )
        .unionByName(
            item(
                _of(tables["policy"], customer_id), "policy_id",
                policy=F.struct("policy_id", "policy_type", F.col("premium_amount").alias("premium"), "status", "end_date"),
            )
        )
        .unionByName(
            item(
                _of(recent, customer_id), "claim_id",
                claim=F.struct("claim_id", "claim_type", F.col("claim_amount").alias("amount"), "status", "filed_date"),
            )
        )
    )
    lists = {"active_moments": F.col("moment"), "policies": F.col("policy"), "recent_claims": F.col("claim")}
    master = _of(tables["customer"], customer_id).select(
        "customer_id",
        F.struct(
            "customer_id", F.concat("first_name", F.lit(" "), "last_name").alias("name"), "email", "segment",
            "region", "state", "tenure_months", "lifetime_value",
        ).alias("customer"),
    )
    scores = _of(health, customer_id).select("customer_id", F.struct(*HEALTH_FIELDS).alias("health"))
    header = master.join(scores, "customer_id", "left")
    return paged_arrays(items, "customer_id", "item_id", lists, page_size, header)


def nba_recommendations(
    actions: DataFrame, as_of: datetime, customer_id: str | None = None, page_size: int = PAGE
) -> DataFrame:
    """Pending, unsuppressed, unexpired actions as an array per customer (paged like above)."""
    open_ = _live(_of(actions, customer_id), as_of).filter(~F.col("suppressed") & (F.col("status") == "PENDING"))
    record = F.struct("priority", "action_id", "action_type", "confidence", "rationale", "status", "evidence")
    return paged_arrays(open_, "customer_id", "action_id", {"actions": record}, page_size)
