"""Approval and outcome tracking for whole batches: decisions and outcomes arrive as DataFrames."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custlattice import vocab
from custlattice.functions.values import stamp, ts_lit

LOG = (
    "log_id", "action_id", "customer_id", "action_type", "decision", "decided_by", "decided_at",
    "outcome", "outcome_date", "notes", "created_at",
)


def valid_decisions(decisions: DataFrame) -> DataFrame:
    return decisions.filter(F.col("decision").isin(*vocab.DECISIONS))


def _first_decision(decisions: DataFrame) -> DataFrame:
    """The decision that counts when a batch decides an action twice: lowest ``seq`` if given."""
    seq = F.col("seq") if "seq" in decisions.columns else F.lit(0)
    first = F.min(F.struct(seq.alias("seq"), F.col("decided_by"), F.col("decision")))
    return (
        valid_decisions(decisions)
        .groupBy("action_id")
        .agg(first.alias("d"))
        .select("action_id", F.col("d.decision").alias("decision"), F.col("d.decided_by").alias("decided_by"))
    )


def decide(actions: DataFrame, decisions: DataFrame) -> DataFrame:
    """The updated actions: a pending one takes its decision, everything else stays."""
    chosen = _first_decision(decisions).select("action_id", "decision")
    moved = F.col("decision").isNotNull() & (F.col("status") == "PENDING")
    return (
        actions.join(chosen, "action_id", "left")
        .withColumn("status", F.when(moved, F.col("decision")).otherwise(F.col("status")))
        .select(*actions.columns)
    )


def decision_log(actions: DataFrame, decisions: DataFrame, as_of: datetime, mode: str = "transitions") -> DataFrame:
    """Log rows for ``decide``. ``transitions``: one per action that really moved. ``always``: one
    per valid decision on a known action, moved or not."""
    if mode == "always":
        logged = actions.join(valid_decisions(decisions), "action_id")
    else:
        logged = actions.filter(F.col("status") == "PENDING").join(_first_decision(decisions), "action_id")
    return logged.select(
        F.concat(F.lit("LOG-"), "action_id", F.lit("-" + stamp(as_of))).alias("log_id"),
        "action_id", "customer_id", "action_type", "decision", "decided_by",
        ts_lit(as_of).alias("decided_at"),
        F.lit(None).cast("string").alias("outcome"),
        F.lit(None).cast("timestamp_ntz").alias("outcome_date"),
        F.lit(None).cast("string").alias("notes"),
        ts_lit(as_of).alias("created_at"),
    )


def _first_outcome(outcomes: DataFrame) -> DataFrame:
    first = F.min(F.struct(F.col("outcome").alias("o"), F.col("notes").alias("n")))
    return outcomes.groupBy("action_id").agg(first.alias("f")).select(
        "action_id", F.col("f.o").alias("new_outcome"), F.col("f.n").alias("new_notes"), F.lit(True).alias("reported")
    )


def record_outcome_log(log: DataFrame, outcomes: DataFrame, as_of: datetime, mode: str = "approved") -> DataFrame:
    """The updated log: rows without an outcome take the reported one; earlier outcomes stay.

    ``approved`` applies outcomes to approved actions only, ``always`` whatever the decision was.
    """
    open_row = F.col("reported") & F.col("outcome").isNull()
    if mode != "always":
        open_row = open_row & (F.col("decision") == "APPROVED")
    fires = F.coalesce(open_row, F.lit(False))
    joined = log.join(_first_outcome(outcomes), "action_id", "left").withColumn("_fires", fires)
    new = {"outcome": F.col("new_outcome"), "outcome_date": ts_lit(as_of), "notes": F.col("new_notes")}
    return joined.select(
        *[F.when(F.col("_fires"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in log.columns]
    )


def record_outcome_actions(actions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The updated actions: an approved action with a reported outcome is completed."""
    reported = outcomes.select("action_id").distinct().withColumn("_reported", F.lit(True))
    done = F.coalesce(F.col("_reported"), F.lit(False)) & (F.col("status") == "APPROVED")
    return (
        actions.join(reported, "action_id", "left")
        .withColumn("status", F.when(done, "COMPLETED").otherwise(F.col("status")))
        .select(*actions.columns)
    )
