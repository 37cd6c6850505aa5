"""Every query by name: ``name -> f(spark, directory of sample tables) -> DataFrame``.

Each query starts from the sample tables, runs over all of their rows, and flattens nested and
date columns so that results compare as plain values.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custlattice import vocab
from custlattice.functions import scores
from custlattice.functions.values import round_exact
from custlattice.operators import actions as nba
from custlattice.operators import enrich, events, evidence, health, health_state, moments, search_log, workflow
from custlattice.plans import checks, lookup, portfolio, semantic
from custlattice.plans.pipeline import Workspace, count_rows
from custlattice.sources import tables as store
from custlattice.sources.layout import open_bucketed, write_bucketed
from custlattice.sources.sample import AS_OF, LEXICON, SampleTables
from custlattice.sources.tables import scratch_dir
from custlattice.streaming import feeds

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SEARCH = "stupid worthless license onwh"
ONE_CUSTOMER = "CUST-000001"


def plain(df: DataFrame) -> DataFrame:
    """Dates and timestamps as text, so every client reads the same value."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, T.TimestampNTZType):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        out.append(c.alias(f.name))
    return df.select(out)


def query(f: Callable[[Workspace], DataFrame]) -> Callable[[Workspace], DataFrame]:
    """Register ``f`` under its name; it gets a workspace over the given directory."""

    def run(spark: SparkSession, directory: str) -> DataFrame:
        return plain(f(open_workspace(spark, directory)))

    QUERIES[f.__name__] = run
    return f


def open_workspace(spark: SparkSession, directory: str) -> Workspace:
    tables = SampleTables(spark, directory)
    return Workspace(tables, AS_OF, LEXICON, tables.prior_actions)


def _json(column: str, **members: str) -> list[Column]:
    return [F.get_json_object(column, f"$.{m}").cast(t).alias(f"{column}_{m}") for m, t in members.items()]


def _joined(c: str) -> Column:
    return F.array_join(c, ",").alias(c.split(".")[-1])


# --- text enrichment -------------------------------------------------------------------------

_ROW = ("enrichment_id", "customer_id", "source_table", "source_id")


@query
def enrich_transcript_sentiment(w):
    rows = enrich.enrich_sentiment(w.tables["transcript"], enrich.TRANSCRIPT, w.lexicon, w.as_of)
    return rows.select(*_ROW, "sentiment_score", "sentiment_label")


@query
def enrich_email_sentiment(w):
    rows = enrich.enrich_sentiment(w.tables["email"], enrich.EMAIL, w.lexicon, w.as_of)
    return rows.select(*_ROW, "sentiment_score", "sentiment_label")


@query
def enrich_entities(w):
    rows = enrich.enrich_entities(w.tables["transcript"], w.lexicon, w.as_of)
    return rows.select(*_ROW, *[_joined(f"entities.{k}") for k in vocab.ENTITY_KINDS])


@query
def enrich_transcript_intents(w):
    rows = enrich.enrich_intents(w.tables["transcript"], enrich.TRANSCRIPT, w.lexicon, w.as_of)
    return rows.select(*_ROW, "intents.*")


@query
def enrich_email_intents(w):
    rows = enrich.enrich_intents(w.tables["email"], enrich.EMAIL, w.lexicon, w.as_of)
    return rows.select(*_ROW, "intents.*")


@query
def enrich_classification(w):
    return enrich.enrich_classification(w.tables["transcript"], w.lexicon, w.as_of).select(*_ROW, "classification")


@query
def customer_text_digest(w):
    t = w.tables
    return enrich.customer_digest(t["transcript"], t["email"], t["note"]).select(
        "customer_id", "part", "n_lines", "oldest", "newest", "digest"
    )


@query
def enrich_customer_summary(w):
    t = w.tables
    return enrich.customer_summary(t["customer"], t["transcript"], t["email"], t["note"], w.signals, w.as_of).select(
        *_ROW, "summary"
    )


@query
def unprocessed_batch(w):
    """Transcripts that still lack a sentiment when those naming a competitor have one."""
    named = F.array_size("entities.competitors") > 0
    done = enrich.tall_from_wide(w.wide.filter(named), w.as_of)
    return enrich.unprocessed(
        w.tables["transcript"], "transcript_id", done, "TRANSCRIPT", "sentiment_score"
    ).select("transcript_id", "customer_id")


@query
def run_all_enrichment(w):
    return enrich.run_enrichment(w.tables, w.lexicon, w.as_of).select(
        *_ROW, "sentiment_score", "sentiment_label", _joined("entities.competitors"),
        F.col("intents.cancellation_intent").alias("cancellation_intent"), "classification", "summary",
    )


@query
def run_all_enrichment_again(w):
    """A second run over tables of which the first one has enriched a half, chosen by hash of the row's id."""
    first = enrich.run_enrichment(w.tables, w.lexicon, w.as_of)
    done = first.filter(F.substring(F.md5(F.col("enrichment_id").cast("binary")), 1, 1) < "8")
    return enrich.run_enrichment(w.tables, w.lexicon, w.as_of, done).select(
        *_ROW, "sentiment_score", "sentiment_label", _joined("entities.competitors"),
        F.col("intents.cancellation_intent").alias("cancellation_intent"), "classification", "summary",
    )


@query
def enrichment_wide(w):
    return enrich.enrichment_wide(w.enrichment).select(
        "source_table", "source_id", "customer_id", "sentiment_score", "sentiment_label",
        _joined("entities.competitors"), F.col("intents.cancellation_intent").alias("cancellation_intent"),
        "classification",
    )


# --- events ----------------------------------------------------------------------------------

_EVENT = ("event_id", "customer_id", "event_type", "event_timestamp", "source_table", "source_id")


@query
def events_policy(w):
    return events.events_policy(w.tables["policy"]).select(
        *_EVENT, *_json("event_payload", policy_type="string", premium="double", status="string")
    )


@query
def events_claim(w):
    return events.events_claim(w.tables["claim"], w.as_of).select(
        *_EVENT, *_json("event_payload", claim_type="string", amount="double", status="string", resolution_days="string")
    )


@query
def events_payment(w):
    return events.events_payment(w.tables["payment"], w.as_of).select(
        *_EVENT, *_json("event_payload", amount="double", status="string", method="string", failure_reason="string")
    )


@query
def events_interaction(w):
    return events.events_interaction(w.tables["interaction"]).select(
        *_EVENT, *_json("event_payload", channel="string", direction="string", topic="string", disposition="string")
    )


@query
def events_survey(w):
    return events.events_survey(w.tables["survey"]).select(
        *_EVENT, *_json("event_payload", survey_type="string", nps_score="int", csat_score="int")
    )


@query
def customer_events(w):
    return w.events.select(*_EVENT)


# --- moments ---------------------------------------------------------------------------------

_MOMENT = ("moment_id", "customer_id", "moment_type", "confidence", "source_event_id", "expires_at")


@query
def moment_churn_competitor(w):
    return moments.moments_churn_competitor(w.signals, w.tables["policy"], w.as_of).select(
        *_MOMENT, *_json("context", renewal_days="int")
    )


@query
def moment_churn_intent(w):
    first = moments.moments_churn_competitor(w.signals, w.tables["policy"], w.as_of)
    return moments.moments_churn_intent(w.signals, first, w.as_of).select(
        *_MOMENT, *_json("context", sentiment_score="double")
    )


@query
def moment_claim_friction(w):
    return moments.moments_claim_friction(w.tables["claim"], w.signals, w.as_of).select(
        *_MOMENT, *_json("context", claim_id="string", days_open="int")
    )


@query
def moment_price_sensitivity(w):
    return moments.moments_price_sensitivity(w.signals, w.as_of).select(*_MOMENT)


@query
def moments_every_row(w):
    """The rules with one moment per qualifying source row."""
    return moments.detect_moments(
        w.signals, w.tables["policy"], w.tables["claim"], w.as_of, "all", w.wide
    ).select(*_MOMENT, *_json("context", renewal_days="int"))


@query
def customer_moments(w):
    return w.moments.select(*_MOMENT)


@query
def active_moments(w):
    return moments.active_moments(w.moments, w.as_of).select(
        "customer_id", "moment_id", "moment_type", "confidence", "detected_at"
    )


# --- health ----------------------------------------------------------------------------------


@query
def agg_sentiment(w):
    return health.agg_sentiment(w.enrichment)


@query
def agg_claims(w):
    return health.agg_claims(w.tables["claim"]).withColumn("avg_resolution", round_exact(F.col("avg_resolution"), 6))


@query
def agg_payments(w):
    return health.agg_payments(w.tables["payment"]).withColumn("failure_rate", round_exact(F.col("failure_rate"), 6))


@query
def agg_engagement(w):
    return health.agg_engagement(w.tables["interaction"], w.as_of)


@query
def agg_moments(w):
    return health.agg_moments(w.moments)


def _score(w: Workspace, name: str) -> DataFrame:
    return w.health.select("customer_id", name)


@query
def score_sentiment(w):
    out = scores.score_sentiment(F.col("avg_sentiment"))
    return w.tables["customer"].select("customer_id").join(w.signals, "customer_id", "left").select(
        "customer_id", round_exact(out, 4).alias("score")
    )


@query
def score_claims(w):
    out = scores.score_claims(F.col("open_claims"), F.col("denied_claims"), F.col("avg_resolution"))
    facts = health.agg_claims(w.tables["claim"])
    return w.tables["customer"].select("customer_id").join(facts, "customer_id", "left").select(
        "customer_id", round_exact(out, 4).alias("score")
    )


@query
def score_payment(w):
    facts = health.agg_payments(w.tables["payment"])
    return w.tables["customer"].select("customer_id").join(facts, "customer_id", "left").select(
        "customer_id", round_exact(scores.score_payment(F.col("failure_rate")), 4).alias("score")
    )


@query
def score_engagement(w):
    facts = health.agg_engagement(w.tables["interaction"], w.as_of)
    return w.tables["customer"].select("customer_id").join(facts, "customer_id", "left").select(
        "customer_id", scores.score_engagement(F.col("days_since_last")).alias("score")
    )


@query
def churn_risk(w):
    return _score(w, "churn_risk")


@query
def risk_level(w):
    return w.health.select("customer_id", scores.risk_level(F.col("churn_risk")).alias("risk_level"))


@query
def customer_health(w):
    return w.health


@query
def run_events_moments_health(w):
    """Row counts of the three tables the scoring run produces."""
    parts = {"customer_event": w.events, "customer_moment": w.moments, "customer_health": w.health}
    return reduce(DataFrame.unionByName, [count_rows(df, n) for n, df in parts.items()])


def _touched(w: Workspace) -> DataFrame:
    """Customers with a complaint among their interactions."""
    return w.tables["interaction"].filter(F.col("topic") == "Complaint").select("customer_id")


@query
def health_apply_delta(w):
    return health.health_apply_delta(w.health, w.signals, _touched(w), w.as_of)


@query
def health_maintained(w):
    """Health after changes that only touch the stored numbers: late claims are settled, failed payments go through, complaints are withdrawn, some renewals move."""
    spark, state = w.tables.spark, f"{scratch_dir(w.tables.spark)}/health_state"
    health_state.add(spark, state, w.health_facts, 0)

    def replaced(table, where, **columns):
        goes = w.tables[table].filter(where).withColumn("sign", F.lit(-1))
        return goes.unionByName(goes.withColumns(columns | {"sign": F.lit(1)}))

    settled = replaced("claim", F.col("status") == "Open", status=F.lit("Settled"), resolution_days=F.lit(20))
    paid = replaced("payment", F.col("status") == "Failed", status=F.lit("Completed"))
    withdrawn = w.tables["interaction"].filter(F.col("topic") == "Complaint").withColumn("sign", F.lit(-1))
    lapsed = replaced("policy", F.col("policy_type") == "Auto", status=F.lit("Lapsed"))
    changes = ({"claim": settled}, {"payment": paid}, {"interaction": withdrawn}, {"policy": lapsed})
    for batch, change in enumerate(changes, 1):
        health_state.add(spark, state, health_state.facts(change), batch)
    return health_state.health_from_facts(health_state.read(spark, state), w.as_of)


@query
def health_change(w):
    """From two stored versions, the newest one and the one before it."""
    spark, root = w.tables.spark, scratch_dir(w.tables.spark)
    before = store.new_version(w.health, root, "customer_health", w.as_of, "scored")
    store.new_version(health.health_apply_delta(before, w.signals, _touched(w), w.as_of), root, "customer_health", w.as_of, "worsened")
    return health.health_change(store.load(spark, root, "customer_health", "scored"), store.load(spark, root, "customer_health"))


# --- actions ---------------------------------------------------------------------------------

_ACTION = (
    "action_id", "customer_id", "action_type", "confidence", "rationale", "priority", "status", "suppressed",
    "suppression_reason", "expires_at",
)


def _kept(w: Workspace) -> DataFrame:
    return nba.clear_pending(w.prior_actions)


@query
def nba_clear_pending(w):
    return _kept(w).select(*_ACTION)


@query
def nba_retention_offer(w):
    return nba.nba_retention(w.health, w.tables["policy"], _kept(w), w.as_of).select(
        *_ACTION, *_json("evidence", churn_risk="double", sentiment="double", renewal_days="int")
    )


@query
def nba_claims_escalation(w):
    return nba.nba_claims(w.tables["claim"], w.health, _kept(w), w.as_of).select(
        *_ACTION, *_json("evidence", claim_id="string", days_open="int", claim_amount="double", sentiment="double")
    )


@query
def nba_competitor_campaign(w):
    competitors = F.from_json(F.get_json_object("evidence", "$.competitors_mentioned"), "array<string>")
    return nba.nba_competitor(w.signals, w.tables["policy"], _kept(w), w.as_of).select(
        *_ACTION, *_json("evidence", renewal_days="int"), F.array_join(competitors, ",").alias("competitors")
    )


@query
def nba_cross_sell(w):
    return nba.nba_cross_sell(w.tables["customer"], w.health, _kept(w), w.as_of).select(
        *_ACTION, *_json("evidence", segment="string", sentiment="double", health_score="double")
    )


@query
def nba_suppression(w):
    rows = nba.nba_cross_sell(w.tables["customer"], w.health, _kept(w), w.as_of)
    return rows.groupBy("status", "suppression_reason").agg(F.count("*").alias("actions"))


@query
def nba_payment_assistance(w):
    return nba.nba_payment(w.tables["payment"], _kept(w), w.as_of).select(
        *_ACTION, *_json("evidence", failed_payments="int", total_payments="int", failure_rate="double")
    )


@query
def nba_generate(w):
    return w.actions.select(*_ACTION, "created_at")


# --- workflow --------------------------------------------------------------------------------


def _decisions(w: Workspace) -> DataFrame:
    return w.tables.decisions(w.actions)


def _log(w: Workspace) -> DataFrame:
    return w.log(_decisions(w), w.tables.outcomes)


@query
def nba_decide(w):
    return workflow.decide(w.actions, _decisions(w)).select("action_id", "customer_id", "action_type", "status")


@query
def nba_decision_log(w):
    return w.log(_decisions(w)).select(
        "log_id", "action_id", "customer_id", "action_type", "decision", "decided_by", "decided_at"
    )


@query
def nba_record_outcome(w):
    """Log and action side by side after decisions and outcomes."""
    decided = workflow.decide(w.actions, _decisions(w))
    outcomes = w.tables.outcomes(w.log(_decisions(w)))
    done = workflow.record_outcome_actions(decided, outcomes).select("action_id", "status")
    return _log(w).join(done, "action_id").select(
        "log_id", "action_id", "decision", "outcome", "outcome_date", "notes", "status"
    )


@query
def customer_nba(w):
    return nba.customer_nba(w.actions, w.as_of)


# --- evidence and search ---------------------------------------------------------------------


@query
def evidence_source(w):
    return w.corpus


@query
def evidence_source_joined(w):
    """The same corpus with labels taken from the enrichment table."""
    return evidence.evidence_source(w.tables, enrich.enrichment_wide(w.enrichment)).select(
        "doc_id", "customer_id", "source_type", "sentiment", "moment_type", "event_date"
    )


@query
def evidence_source_colocated(w):
    """The same from tables in buckets by document id: laid out once, every later join of texts and labels shuffles neither."""
    spark = w.tables["customer"].sparkSession
    root = scratch_dir(spark)
    laid = {t: open_bucketed(spark, write_bucketed(w.tables[t], root, t, f"{t}_id")) for t in ("transcript", "email")}
    labels = open_bucketed(spark, write_bucketed(enrich.enrichment_wide(w.enrichment), root, "labels", "source_id"))
    return evidence.evidence_source(laid | {t: w.tables[t] for t in ("note", "survey")}, labels).select(
        "doc_id", "customer_id", "source_type", "sentiment", "moment_type", "event_date"
    )


@query
def evidence_index(w):
    return evidence.postings(w.corpus).select("term", "doc_id", "tf", "customer_id", "source_type", "sentiment", "moment_type")


_HIT = ("doc_id", "score", "customer_id", "source_type", "sentiment", "moment_type", "event_date")


def _index(w: Workspace) -> search_log.SearchLog:
    """The corpus, written as an index and opened: questions read this and not the corpus."""
    spark = w.tables.spark
    path = scratch_dir(spark)
    search_log.refresh(spark, path, w.corpus)
    return search_log.open_log(spark, path)


@query
def evidence_search(w):
    index = _index(w)
    return index.with_content(index.search(SEARCH, 5)[0]).select(*_HIT, "content")


@query
def evidence_search_index(w):
    """The postings in one reading, without the index's layout."""
    return evidence.search_index(evidence.build_index(w.corpus), SEARCH, 5).select(*_HIT)


@query
def evidence_search_filtered(w):
    wanted = evidence.Filters(
        sentiment="NEGATIVE", source_type="TRANSCRIPT", since=datetime(2023, 10, 1), until=datetime(2024, 1, 15)
    )
    return _index(w).search(SEARCH, 5, wanted)[0].select(*_HIT)


@query
def evidence_search_corpus(w):
    """A corpus that is asked once, ranked without an index."""
    hits = evidence.search_corpus(w.corpus, SEARCH, 5)
    return evidence.with_content(hits, w.corpus).select(*_HIT, "content")


@query
def evidence_postings_read(w):
    """How much of the question's postings block bounds let the search skip; the ranking is that of all of them."""
    index = _index(w)
    hits, share = index.search(SEARCH, 5)
    return hits.select("doc_id", "score", F.lit(share < 0.5).alias("below_half"))


@query
def customer_evidence(w):
    return evidence.customer_evidence(w.corpus)


@query
def action_evidence(w):
    return evidence.action_evidence(w.actions.filter(F.col("status") == "PENDING"), w.corpus)


@query
def copilot_context(w):
    index = _index(w)
    return evidence.context_lines(index.with_content(index.search(SEARCH, 5)[0]))


# --- look-ups --------------------------------------------------------------------------------


def _sum_of(array: str, member: str, digits: int = 2) -> Column:
    cents = F.transform(array, lambda x: F.round(x[member].cast("decimal(18,4)") * 10**digits, 0).cast("bigint"))
    return F.aggregate(cents, F.lit(0).cast("bigint"), lambda a, x: a + x)


@query
def customer_360(w):
    nested = lookup.customer_360(w.tables, w.health, w.moments, w.as_of)
    return nested.select(
        "customer_id", "page", "customer.name", "customer.segment", "customer.region", "customer.tenure_months",
        "health.health_score", "health.risk_level",
        F.size("active_moments").alias("n_moments"), F.size("policies").alias("n_policies"),
        F.size("recent_claims").alias("n_claims"), _sum_of("recent_claims", "amount").alias("claim_cents"),
    )


@query
def customer_360_small_pages(w):
    """The same records with three items each, so that most customers have several."""
    nested = lookup.customer_360(w.tables, w.health, w.moments, w.as_of, page_size=3)
    ids = F.array_sort(F.concat(F.transform("policies", lambda x: x["policy_id"]), F.transform("recent_claims", lambda x: x["claim_id"])))
    return nested.select("customer_id", "page", F.size("active_moments").alias("n_moments"), F.array_join(ids, ",").alias("item_ids"))


@query
def customer_text_digest_small_parts(w):
    t = w.tables
    return enrich.customer_digest(t["transcript"], t["email"], t["note"], max_lines=2).select(
        "customer_id", "part", "n_lines", "oldest", "newest", "digest"
    )


@query
def nba_recommendation(w):
    arrays = lookup.nba_recommendations(w.actions, w.as_of)
    ids = F.transform("actions", lambda a: a["action_id"])
    return arrays.select(
        "customer_id", "page", F.size("actions").alias("n_actions"),
        F.array_join(F.array_sort(ids), ",").alias("action_ids"),
    )


@query
def customer_profile(w):
    return lookup.customer_profile(w.tables["customer"], w.health).select(
        "customer_id", "first_name", "last_name", "gender", "segment", "region", "state", "tenure_months",
        "lifetime_value", *lookup.HEALTH_FIELDS,
    )


@query
def customer_policies(w):
    return lookup.customer_policies(w.tables["policy"])


@query
def customer_claims(w):
    return lookup.customer_claims(w.tables["claim"])


@query
def customer_timeline(w):
    return lookup.customer_timeline(w.events)


@query
def customer_payments(w):
    return lookup.customer_payments(w.tables["payment"])


@query
def customer_interactions(w):
    return lookup.customer_interactions(w.tables["interaction"])


@query
def customer_actions(w):
    return lookup.customer_actions(w.actions)


@query
def customer_health_state(w):
    return lookup.customer_health_state(w.health)


# --- metrics ---------------------------------------------------------------------------------


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: round_exact(F.col(n), digits) for n in names})


@query
def sem_health_file(w):
    """``sem_health`` by a model file, held against the tables first."""
    frames = {"customer_health": w.health, "customer": w.tables["customer"]}
    model = semantic.checked(semantic.SemanticModel.from_yaml(os.path.join(os.path.dirname(__file__), "models", "health.yaml")), frames)
    means = ["average health", "avg_churn_risk", "churn_rate", "avg_sentiment", "avg_payment_score", "avg_engagement_score"]
    out = semantic.metrics(model, frames, ["customer_count", "critical_customers", *means], by=["risk category", "region"])
    return _rounded(out, "avg_health_score", *means[1:])


@query
def sem_health(w):
    out = semantic.metrics(
        semantic.MODEL, {"customer_health": w.health, "customer": w.tables["customer"]},
        [
            "customer_health.customer_count", "avg_health_score", "customer_health.avg_churn_risk", "churn_rate",
            "critical_customers", "avg_sentiment", "avg_payment_score", "avg_engagement_score",
        ],
        by=["risk_level", "region"],
    )
    return _rounded(
        out, "avg_health_score", "avg_churn_risk", "churn_rate", "avg_sentiment", "avg_payment_score",
        "avg_engagement_score",
    )


@query
def sem_customer(w):
    out = semantic.metrics(
        semantic.MODEL, {"customer": w.tables["customer"]},
        ["total_customers", "avg_tenure_months", "avg_lifetime_value", "total_lifetime_value"],
        by=["segment", "region", "gender"],
    )
    return _rounded(_rounded(out, "avg_tenure_months", "avg_lifetime_value"), "total_lifetime_value", digits=4)


@query
def sem_policy(w):
    out = semantic.metrics(
        semantic.MODEL, {"policy": w.tables["policy"]},
        ["policy_count", "avg_premium", "total_premium", "active_policies"], by=["policy_type", "status"],
    )
    return _rounded(_rounded(out, "avg_premium"), "total_premium", digits=4)


@query
def sem_policy_by_day(w):
    """A time dimension, a filter, an order and a limit: the 25 start days with most active premium."""
    out = semantic.metrics(
        semantic.MODEL, {"policy": w.tables["policy"]}, ["policy_count", "total_premium"], by=["start_date"],
        where=F.col("dim.status") == "Active", order=[F.col("total_premium").desc(), F.col("start_date")], limit=25,
    )
    return _rounded(out, "total_premium", digits=4)


@query
def sem_nba_log(w):
    out = semantic.metrics(
        semantic.MODEL, {"next_best_action_log": _log(w)},
        ["next_best_action_log.action_count", "approval_rate", "rejection_rate", "effectiveness"],
        by=["action_type", "decided_by"],
    )
    return _rounded(out, "approval_rate", "rejection_rate", "effectiveness")


def _view_frames(w: Workspace) -> dict[str, DataFrame]:
    return {"customer_health": w.health, "customers": w.tables["customer"], "nba": w.actions}


@query
def sem_view(w):
    """Metrics of two facts by shared dimensions, asked for by synonym."""
    out = semantic.metrics(
        semantic.VIEW, _view_frames(w),
        ["total customers", "average health", "avg_churn_risk", "critical alerts", "recommendation count"],
        by=["tier", "geographic region"],
    )
    return _rounded(out, "avg_health", "avg_churn_risk")


@query
def sem_claims_by_holder(w):
    """Claims meet the customer's segment over two hops, claim to policy to customer; policies over one."""
    frames = {t: w.tables[t] for t in ("claim", "policy", "customer")}
    names = ["claim_count", "claimed_amount", "avg_claim", "largest_claim", "open_share", "policies"]
    out = semantic.metrics(semantic.CLAIMS, frames, names, by=["segment", "policy_type"])
    return _rounded(out, "claimed_amount", "avg_claim", "open_share")


@query
def sem_view_actions(w):
    return semantic.metrics(semantic.VIEW, _view_frames(w), ["action_count"], by=["action_type", "nba_status", "segment"])


# --- portfolio, queue, effectiveness -----------------------------------------------------------


@query
def portfolio_kpis(w):
    return portfolio.portfolio_kpis(w.health)


@query
def risk_distribution(w):
    return portfolio.risk_distribution(w.health)


@query
def health_by_segment(w):
    return portfolio.health_by_segment(w.tables["customer"], w.health)


@query
def critical_customers(w):
    return portfolio.critical_customers(w.tables["customer"], w.health)


@query
def portfolio_context(w):
    return portfolio.portfolio_context(w.health)


@query
def nba_status_summary(w):
    return portfolio.nba_status_summary(workflow.decide(w.actions, _decisions(w)))


@query
def nba_queue(w):
    return portfolio.nba_queue(w.actions, w.tables["customer"])


@query
def nba_effectiveness(w):
    return portfolio.nba_effectiveness(_log(w))


@query
def retention_metrics(w):
    return portfolio.retention_metrics(w.tables["customer"], w.tables["policy"], w.health)


# --- sample questions ------------------------------------------------------------------------


@query
def q_critical_now(w):
    return portfolio.q_critical_now(w.tables["customer"], w.health)


@query
def q_competitor_mentions(w):
    return portfolio.q_competitor_mentions(w.wide, w.tables["transcript"], w.as_of)


@query
def q_pending_retention(w):
    return portfolio.q_pending_retention(w.actions, w.tables["customer"])


@query
def q_stale_claims_negative(w):
    return portfolio.q_stale_claims_negative(w.tables["claim"], w.signals, w.as_of)


@query
def q_friction_this_week(w):
    return portfolio.q_friction_this_week(w.moments, w.as_of)


@query
def q_resolution_by_type(w):
    return portfolio.q_resolution_by_type(w.tables["claim"])


@query
def q_customer_360(w):
    """The one question that names a customer."""
    nested = lookup.customer_360(w.tables, w.health, w.moments, w.as_of, ONE_CUSTOMER)
    lists = {"n_policies": "policies", "n_claims": "recent_claims", "n_moments": "active_moments"}
    return nested.groupBy("customer_id", "customer.name", "health.health_score", "health.risk_level").agg(
        *[F.sum(F.size(c)).cast("int").alias(n) for n, c in lists.items()]
    )


@query
def q_top_contact_reasons(w):
    return portfolio.q_top_contact_reasons(w.tables["interaction"])


@query
def q_payment_assistance(w):
    return portfolio.q_payment_assistance(w.actions, w.tables["customer"])


@query
def q_critical_count(w):
    return semantic.metrics(semantic.VIEW, _view_frames(w), ["critical_count"])


@query
def q_health_by_segment(w):
    return _rounded(semantic.metrics(semantic.VIEW, _view_frames(w), ["avg_health"], by=["segment"]), "avg_health")


@query
def q_churn_by_region(w):
    out = semantic.metrics(
        semantic.MODEL, {"customer_health": w.health, "customer": w.tables["customer"]}, ["churn_rate"], by=["region"]
    )
    return _rounded(out, "churn_rate")


# --- checks ----------------------------------------------------------------------------------


@query
def check_volumes(w):
    return checks.check_volumes(w.tables)


@query
def check_enrichment(w):
    return checks.check_enrichment(w.enrichment_with_summaries)


@query
def check_events(w):
    return checks.check_events(w.events)


@query
def check_moments(w):
    return checks.check_moments(w.moments)


@query
def check_health(w):
    return checks.check_health(w.health)


@query
def check_nba(w):
    return checks.check_nba(w.actions)


@query
def check_customer(w):
    return checks.check_customer(w.tables, w.health, w.moments, w.actions)


@query
def check_evidence(w):
    return checks.check_evidence(w.corpus)


@query
def check_keys(w):
    derived = {"customer_event": w.events, "customer_moment": w.moments, "next_best_action": w.actions}
    return checks.check_keys({**dict(w.tables.items()), **derived})


# --- streaming: the given tables as file streams, drained once --------------------------------

ONCE = {"availableNow": True}


@query
def stream_customer_events(w):
    spark, path = w.tables.spark, scratch_dir(w.tables.spark)
    live = SampleTables(spark, w.tables.path, streaming=True)
    feed = feeds.event_feed({t: live[t] for t in ("policy", "claim", "payment", "interaction", "survey")}, w.as_of)
    feeds.stream_customer_events(feed, f"{path}/events", f"{path}/checkpoint", ONCE).awaitTermination()
    return spark.read.schema(feed.schema).parquet(f"{path}/events").select(*_EVENT)


@query
def stream_enrichment(w):
    spark, path = w.tables.spark, scratch_dir(w.tables.spark)
    live = SampleTables(spark, w.tables.path, streaming=True)
    feeds.stream_enrichment(
        live["transcript"], enrich.TRANSCRIPT, w.lexicon, path, f"{path}/checkpoint", ONCE, w.as_of
    ).awaitTermination()
    return feeds.read_sink(spark, path, "customer_ai_enrichment").select(
        *_ROW, "sentiment_score", "sentiment_label", "classification"
    )


@query
def stream_evidence_refresh(w):
    spark, path = w.tables.spark, scratch_dir(w.tables.spark)
    live = SampleTables(spark, w.tables.path, streaming=True)
    corpus = evidence.evidence_from_text(live, w.lexicon)
    feeds.stream_evidence_refresh(corpus, path, f"{path}/checkpoint", ONCE).awaitTermination()
    return search_log.open_log(spark, path).documents.select(
        "doc_id", "customer_id", "source_type", "sentiment", "moment_type", F.col("dl").cast("bigint").alias("dl")
    )


@query
def stream_evidence_changes(w):
    """Notes arrive, then every note again with another text and surveys for the first time; the index holds the later state alone."""
    spark, path = w.tables.spark, scratch_dir(w.tables.spark)
    kept = w.corpus.filter(F.col("source_type").isin("NOTE", "SURVEY"))
    changed = kept.withColumn("content", F.when(F.col("source_type") == "NOTE", F.concat(F.lit("license changed "), F.coalesce("content", F.lit("")))).otherwise(F.col("content")))
    for rows in (kept.filter("source_type = 'NOTE'"), changed):
        rows.write.mode("append").parquet(f"{path}/in")
        live = feeds.stream_reader(spark, f"{path}/in", kept.schema)
        feeds.stream_evidence_refresh(live, f"{path}/index", f"{path}/checkpoint", ONCE).awaitTermination()
    return search_log.open_log(spark, f"{path}/index").postings(["license", "changed", "stupid"]).select("term", "doc_id", F.col("tf").cast("bigint").alias("tf"))


def _complaints(note: DataFrame) -> DataFrame:
    return note.select(
        "customer_id", F.col("note_id").alias("arrival_id"), F.lit("Phone").alias("channel"),
        F.lit("Complaint").alias("topic"), F.col("note_text").alias("text"), F.lit(-0.5).alias("sentiment"),
    )


@query
def ingest_interaction(w):
    """Every note arrives as a phone complaint; the touched customers' health worsens."""
    spark, path = w.tables.spark, scratch_dir(w.tables.spark)
    live = SampleTables(spark, w.tables.path, streaming=True)
    feeds.ingest_interaction(
        _complaints(live["note"]), w.health, w.enrichment, path, f"{path}/checkpoint", ONCE, w.as_of
    ).awaitTermination()
    return feeds.newest_health(spark, path).select(
        "customer_id", "health_score", "churn_risk", "sentiment_score", "risk_level"
    )


@query
def ingest_interaction_scored(w):
    """The same arrivals; the touched customers are scored by the batch formula, from their kept numbers."""
    spark, path = w.tables.spark, scratch_dir(w.tables.spark)
    live = SampleTables(spark, w.tables.path, streaming=True)
    feeds.ingest_interaction(
        _complaints(live["note"]), w.health, w.enrichment, path, f"{path}/checkpoint", ONCE, w.as_of, w.health_facts
    ).awaitTermination()
    return feeds.newest_health(spark, path)

