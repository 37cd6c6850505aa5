"""The batch pipeline, lazily (``Workspace``) and as stored tables (``run_pipeline``)."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custlattice.functions.text import Lexicon
from custlattice.operators import actions as nba
from custlattice.operators import enrich, events, evidence, health, health_state, moments, search_log, workflow
from custlattice.sources import tables as store


def score_health(
    tables: dict[str, DataFrame], signals: DataFrame, found: DataFrame, as_of: datetime
) -> DataFrame:
    """Health from the source tables, the text signals and the detected moments."""
    return health.customer_health(
        tables["customer"],
        signals,
        health.agg_claims(tables["claim"]),
        health.agg_payments(tables["payment"]),
        health.agg_engagement(tables["interaction"], as_of),
        health.agg_moments(found),
        as_of,
    )


def run_scoring(
    tables: dict[str, DataFrame], signals: DataFrame, as_of: datetime
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events, moments and health, in this order."""
    found = moments.detect_moments(signals, tables["policy"], tables["claim"], as_of)
    return events.customer_events(tables, as_of), found, score_health(tables, signals, found, as_of)


@dataclass
class Workspace:
    """All derived tables over the nine source tables, each built when first asked for.

    Four small tables that many rules read are written below the session's checkpoint folder and
    read back: the text signals and the health rows (one narrow row per customer), the moments and
    the actions. That ends their lineage: a lost executor repeats at most one stage, and the plans
    on top stay small. Detail rows and texts are never copied.
    """

    tables: dict[str, DataFrame]
    as_of: datetime
    lexicon: Lexicon
    prior_actions: DataFrame | None = None

    @cached_property
    def _root(self) -> str:
        return store.scratch_dir(self.tables["customer"].sparkSession)

    def _stage(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self._root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    @cached_property
    def wide(self) -> DataFrame:
        return enrich.wide_from_text(self.tables["transcript"], self.tables["email"], self.lexicon)

    @cached_property
    def signals(self) -> DataFrame:
        return self._stage(enrich.customer_signals(self.wide), "signals")

    @cached_property
    def enrichment(self) -> DataFrame:
        return enrich.tall_from_wide(self.wide, self.as_of)

    @cached_property
    def enrichment_with_summaries(self) -> DataFrame:
        summaries = enrich.customer_summary(
            self.tables["customer"], self.tables["transcript"], self.tables["email"], self.tables["note"],
            self.signals, self.as_of,
        )
        return self.enrichment.unionByName(summaries)

    @cached_property
    def events(self) -> DataFrame:
        return events.customer_events(self.tables, self.as_of)

    @cached_property
    def moments(self) -> DataFrame:
        found = moments.detect_moments(self.signals, self.tables["policy"], self.tables["claim"], self.as_of)
        return self._stage(found, "moments")

    @cached_property
    def health(self) -> DataFrame:
        return self._stage(score_health(self.tables, self.signals, self.moments, self.as_of), "health")

    @cached_property
    def health_facts(self) -> DataFrame:
        """What the health formula needs of all tables, as numbers that changes can be added to and taken from."""
        named = ("customer", "policy", "claim", "payment", "interaction")
        return health_state.facts({t: self.tables[t] for t in named} | {"signals": self.wide})

    @cached_property
    def actions(self) -> DataFrame:
        prior = self.prior_actions
        if prior is None:
            spark = self.tables["customer"].sparkSession
            prior = spark.createDataFrame([], store.SCHEMAS["next_best_action"])
        return self._stage(nba.generate_nba(self.tables, self.signals, self.health, prior, self.as_of), "actions")

    @cached_property
    def corpus(self) -> DataFrame:
        return evidence.evidence_from_text(self.tables, self.lexicon)

    def log(self, decisions: DataFrame, outcomes_of=None) -> DataFrame:
        """Decision log of the generated actions; ``outcomes_of(log)`` may report outcomes."""
        written = workflow.decision_log(self.actions, decisions, self.as_of)
        if outcomes_of is None:
            return written
        return workflow.record_outcome_log(written, outcomes_of(written), self.as_of)


def run_pipeline(
    spark: SparkSession, tables: dict[str, DataFrame], lexicon: Lexicon, root: str, as_of: datetime,
    prior_actions: DataFrame | None = None, done: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Write every derived table of one run below ``root`` and read each back before the next
    stage uses it, so a lost executor never repeats more than one stage.

    ``done`` is the enrichment table of earlier runs: only documents and customers it lacks are
    enriched, and the new version holds its rows and the new ones.
    """
    version = as_of.strftime("v%Y%m%d%H%M%S")

    def publish(df: DataFrame, table: str, *cluster_by: str) -> DataFrame:
        return store.new_version(df, root, table, as_of, version, cluster_by)

    wide_path = f"{root}/text_signals/{version}"
    if done is None:
        wide = enrich.wide_from_text(tables["transcript"], tables["email"], lexicon)
    else:
        fresh_path = f"{root}/new_enrichment/{version}"
        enrich.new_rows(tables, lexicon, as_of, done).write.mode("overwrite").parquet(fresh_path)
        known = done.unionByName(spark.read.schema(store.SCHEMAS["customer_ai_enrichment"]).parquet(fresh_path))
        wide = enrich.enrichment_wide(known)
    wide.write.mode("overwrite").parquet(wide_path)
    wide = spark.read.parquet(wide_path)
    signals_path = f"{root}/customer_signals/{version}"
    enrich.customer_signals(wide).write.mode("overwrite").parquet(signals_path)
    signals = spark.read.parquet(signals_path)
    summaries = enrich.customer_summary(
        tables["customer"], tables["transcript"], tables["email"], tables["note"], signals, as_of, done
    )
    texts = enrich.tall_from_wide(wide, as_of) if done is None else known
    out = {
        "customer_ai_enrichment": publish(texts.unionByName(summaries), "customer_ai_enrichment"),
        "customer_event": publish(
            events.customer_events(tables, as_of), "customer_event", "customer_id", "event_timestamp"
        ),
        "customer_moment": publish(
            moments.detect_moments(signals, tables["policy"], tables["claim"], as_of), "customer_moment"
        ),
    }
    out["customer_health"] = publish(
        score_health(tables, signals, out["customer_moment"], as_of), "customer_health"
    )
    if prior_actions is None:
        prior_actions = spark.createDataFrame([], store.SCHEMAS["next_best_action"])
    out["next_best_action"] = publish(
        nba.generate_nba(tables, signals, out["customer_health"], prior_actions, as_of), "next_best_action"
    )
    # labels scored in place: joining them from the enrichment table would shuffle every text
    corpus = evidence.evidence_from_text(tables, lexicon)
    search_log.refresh(spark, f"{root}/evidence_index", corpus)
    return out


def count_rows(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
