"""Health from kept sums equals the batch formula, whatever comes, goes or is delivered again."""

import glob
import re
from datetime import date, datetime

import pytest
from conftest import DATA
from pyspark.sql import functions as F
from test_streaming import ARRIVAL, ONCE, drained

from custlattice.operators import enrich, health, health_state
from custlattice.plans.registry import open_workspace
from custlattice.sources import snapshots
from custlattice.streaming import feeds


def by_id(df):
    return {r["customer_id"]: tuple(r[c] for c in health.HEALTH) for r in df.collect()}


def batch_health(t, enrichment, moments, as_of):
    return health.customer_health(
        t["customer"], health.agg_sentiment(enrichment), health.agg_claims(t["claim"]), health.agg_payments(t["payment"]),
        health.agg_engagement(t["interaction"], as_of), health.agg_moments(moments), as_of,
    )


@pytest.fixture
def small(make):
    at = datetime(2024, 1, 20, 9)
    return {
        "customer": make("customer", *[dict(customer_id=c) for c in "ABC"]),
        "claim": make(
            "claim", *[dict(claim_id=str(i), customer_id="A", status="Open") for i in range(3)],
            dict(claim_id="9", customer_id="B", status="Denied", resolution_days=10), dict(claim_id="8", customer_id="unknown", status="Open"),
        ),
        "payment": make("payment", dict(payment_id="1", customer_id="A", status="Failed"), dict(payment_id="2", customer_id="A", status="Completed")),
        "interaction": make(
            "interaction", dict(interaction_id="1", customer_id="A", interaction_date=at), dict(interaction_id="2", customer_id="A", interaction_date=at),
            dict(interaction_id="3", customer_id="A", interaction_date=datetime(2023, 6, 1)), dict(interaction_id="4", customer_id="B"),
            dict(interaction_id="5", customer_id="unknown", interaction_date=at),
        ),
    }


def test_all_tables_give_the_batch_rows(spark):
    w = open_workspace(spark, DATA)
    assert by_id(health_state.health_from_facts(w.health_facts, w.as_of)) == by_id(w.health)


def test_rows_come_and_go(spark, make, small, as_of, tmp_path):
    root = str(tmp_path)
    none = make("customer_moment")
    mood = make("customer_ai_enrichment", dict(enrichment_id="1", customer_id="A", sentiment_score=-0.7), dict(enrichment_id="2", customer_id="B"))
    empty = spark.createDataFrame([], health_state.SCHEMA)
    assert health_state.read(spark, root) is None
    health_state.add(spark, root, health_state.facts(small | {"sentiment": mood}), 0)
    now = dict(small)

    def check():
        kept = health_state.read(spark, root)
        assert by_id(health_state.health_from_facts(kept, as_of)) == by_id(batch_health(now, mood, none, as_of))

    check()
    # the newest contact is taken back once: another one of the same day is left; then that goes too
    for batch, gone in enumerate(("1", "2"), 1):
        row = now["interaction"].filter(F.col("interaction_id") == gone).withColumn("sign", F.lit(-1))
        health_state.add(spark, root, health_state.facts({"interaction": row}), batch)
        now["interaction"] = now["interaction"].filter(F.col("interaction_id") != gone)
        check()
    # a claim is settled: its old row goes, its new one comes
    old = now["claim"].filter("claim_id = '0'")
    new = old.withColumns({"status": F.lit("Settled"), "resolution_days": F.lit(30)})
    change = old.withColumn("sign", F.lit(-1)).unionByName(new.withColumn("sign", F.lit(1)))
    health_state.add(spark, root, health_state.facts({"claim": change}), 3)
    now["claim"] = now["claim"].filter("claim_id <> '0'").unionByName(new)
    check()
    # all rows of a kind go, and a customer: defaults come back, nothing is divided by zero
    for batch, name in enumerate(("payment", "claim"), 4):
        health_state.add(spark, root, health_state.facts({name: now[name].withColumn("sign", F.lit(-1))}), batch)
        now[name] = now[name].limit(0)
    gone = now["customer"].filter("customer_id = 'C'").withColumn("sign", F.lit(-1))
    health_state.add(spark, root, health_state.facts({"customer": gone}), 6)
    now["customer"] = now["customer"].filter("customer_id <> 'C'")
    check()
    health_state.add(spark, root, empty, 7)  # a batch without rows
    check()
    # a batch that comes again counts once
    state = snapshots.newest(spark, root)
    assert health_state.add(spark, root, health_state.facts({"customer": gone}), 6) == state
    check()


def test_scores_at_a_later_date_need_no_detail_rows(spark, make, as_of):
    policy = make("policy", dict(policy_id="1", customer_id="A", status="Active", end_date=date(2024, 4, 1)))
    wide = "customer_id string, sentiment_score double, sentiment_sum double, sentiment_rows bigint, entities struct<competitors: array<string>>, intents struct<cancellation_intent: boolean>"
    named = spark.createDataFrame([("A", 0.0, 0.0, 1, (["rival"],), (False,))], wide)
    rows = health_state.facts({"customer": make("customer", dict(customer_id="A")), "policy": policy, "signals": named})
    at = lambda when: health_state.health_from_facts(rows, when).first()["churn_risk"]
    assert at(as_of) == 0.0 and at(datetime(2024, 3, 1)) == 0.4 and at(datetime(2024, 4, 1)) == 0.0


def test_hot_customer_is_few_rows(spark, as_of):
    rows = spark.range(200_000).select(
        F.lit("A").alias("customer_id"), F.timestamp_add("DAY", (F.col("id") % 300).cast("int"), F.lit("2023-01-01").cast("timestamp_ntz")).alias("interaction_date")
    )
    kept = health_state.facts({"interaction": rows})
    assert kept.count() == 300 and kept.agg(F.sum("contacts")).first()[0] == 200_000
    assert "partial_sum" in kept._jdf.queryExecution().executedPlan().toString()


def test_look_up_reads_the_customers_buckets(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    monkeypatch.setattr(health_state, "BUCKET_ROWS", 100)
    customers = spark.range(3000).select(F.concat(F.lit("C"), "id").alias("customer_id"))
    for batch in range(6):
        health_state.add(spark, root, health_state.facts({"customer": customers.withColumn("sign", F.lit(1 if batch % 2 == 0 else 0))}), batch)
        levels = [s["level"] for s in snapshots.newest(spark, root).value["segments"]]
        assert len(levels) <= 2 * (health_state.TIER - 1) and levels == sorted(levels, reverse=True)
    files = glob.glob(f"{root}/segment=*/bucket=*/*.parquet")
    two = customers.filter("customer_id in ('C7', 'C2999')")
    found = health_state.read(spark, root, two)
    assert {r[0] for r in found.groupBy("customer_id").agg(F.sum("known")).collect()} == {"C7", "C2999"}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*bucket", plan)
    assert found.select(F.input_file_name()).distinct().count() <= 2 * 6 < len(files)


def test_ingest_scores_by_the_batch_formula(spark, make, small, as_of, tmp_path):
    src, sink, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    known = make("customer_ai_enrichment", dict(enrichment_id="1", customer_id="A", source_table="TRANSCRIPT", source_id="1", sentiment_score=0.5))
    none = make("customer_moment")
    start = batch_health(small, known, none, as_of)

    def arrive(*items):
        spark.createDataFrame(list(items), ARRIVAL).coalesce(1).write.mode("append").parquet(src)

    def run():
        live = feeds.stream_reader(spark, src, spark.createDataFrame([], ARRIVAL).schema)
        first = health_state.facts(small | {"sentiment": known})
        drained(feeds.ingest_interaction(live, start, known, sink, ck, ONCE, as_of, first))
        return by_id(feeds.newest_health(spark, sink))

    def want():
        tables = small | {"interaction": small["interaction"].unionByName(feeds.read_sink(spark, sink, "interaction"), allowMissingColumns=True)}
        moods = known.select("customer_id", "sentiment_score").unionByName(
            feeds.read_sink(spark, sink, "customer_ai_enrichment").select("customer_id", "sentiment_score"))
        return by_id(batch_health(tables, moods, none, as_of))

    arrive(("A", "1", "Phone", "Cancellation Request", "t", -0.9), ("A", "2", "Phone", "Claim Status", "t", None), ("nobody", "7", "Chat", "x", "t", 0.1))
    got = run()
    assert got == want() and set(got) == set("ABC") and got["A"] != by_id(start)["A"] and got["C"] == by_id(start)["C"]
    arrive(("A", "1", "Phone", "Cancellation Request", "t", -0.9), ("C", "3", "Chat", "Complaint", "t", 0.9), (None, "8", "Chat", "x", "t", 0.1))
    got = run()
    assert got == want() and got["C"][1] > by_id(start)["C"][1]  # a pleased customer's health rises


def test_enrichment_rows_count_as_the_documents(spark):
    w = open_workspace(spark, DATA)
    names = ("customer_id", "sentiment_micro", "sentiment_rows")
    a = health_state.facts({"sentiment": enrich.tall_from_wide(w.wide, w.as_of)}).select(*names)
    b = health_state.facts({"signals": w.wide}).select(*names).filter("sentiment_rows > 0")
    assert sorted(a.collect()) == sorted(b.collect())
