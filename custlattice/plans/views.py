"""SQL access: the tables as temporary views, and parameterised look-ups as table functions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from custlattice.operators.actions import customer_nba
from custlattice.plans import lookup


def register_views(spark: SparkSession, frames: dict[str, DataFrame]) -> None:
    """One temporary view per table, so that reports can be written in plain SQL."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)


def register_functions(spark: SparkSession, frames: dict[str, DataFrame], as_of: datetime) -> None:
    """``get_customer_nba(id)``, ``get_nba_recommendation(id)`` and ``customer_360_lookup(id)``.

    The last two return one JSON record per page of a customer (see ``paged_arrays``). All three
    filter the set-based look-ups; the filter on the customer is pushed down to the scans.
    """
    register_views(
        spark,
        {
            "customer_nba_rows": customer_nba(frames["next_best_action"], as_of),
            "nba_recommendation_pages": lookup.nba_recommendations(frames["next_best_action"], as_of),
            "customer_360_pages": lookup.customer_360(
                frames, frames["customer_health"], frames["customer_moment"], as_of
            ),
        },
    )
    define = "CREATE OR REPLACE TEMPORARY FUNCTION"
    spark.sql(
        f"""
        {define} get_customer_nba(id STRING)
        RETURNS TABLE (action_id STRING, action_type STRING, confidence DOUBLE, rationale STRING,
                       priority INT, status STRING, created_at TIMESTAMP_NTZ)
        RETURN SELECT action_id, action_type, confidence, rationale, priority, status, created_at
               FROM customer_nba_rows WHERE customer_id = get_customer_nba.id
        """
    )
    spark.sql(
        f"""
        {define} get_nba_recommendation(id STRING) RETURNS TABLE (page INT, actions STRING)
        RETURN SELECT page, to_json(actions) FROM nba_recommendation_pages
               WHERE customer_id = get_nba_recommendation.id
        """
    )
    spark.sql(
        f"""
        {define} customer_360_lookup(id STRING) RETURNS TABLE (page INT, record STRING)
        RETURN SELECT page, to_json(struct(customer, health, active_moments, policies, recent_claims))
               FROM customer_360_pages WHERE customer_id = customer_360_lookup.id
        """
    )
