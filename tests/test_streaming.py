"""Streams drained in several micro-batches equal the batch result; replays add nothing."""

import os
import shutil

import pytest
from conftest import DATA

from custlattice.operators import enrich, events, evidence, search_log
from custlattice.plans.registry import QUERIES, open_workspace
from custlattice.sources.schemas import SCHEMAS
from custlattice.streaming import feeds

ONCE = {"availableNow": True}


@pytest.fixture(scope="module")
def w(spark):
    return open_workspace(spark, DATA)


def drained(query):
    query.awaitTermination()
    assert query.exception() is None


def rows(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


def test_event_feed_in_batches_with_replayed_files(spark, w, tmp_path):
    src = str(tmp_path / "in")
    table = w.tables["interaction"]
    table.repartition(3).write.parquet(src)
    table.limit(500).write.mode("append").parquet(src)  # the same rows delivered again
    live = feeds.stream_reader(spark, src, SCHEMAS["interaction"], max_files=1)
    feed = feeds.event_feed({"interaction": live}, w.as_of)
    sink, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    drained(feeds.stream_customer_events(feed, sink, ck, ONCE))
    want = rows(events.events_interaction(table), "event_id", "event_type", "event_payload")
    assert rows(spark.read.parquet(sink), "event_id", "event_type", "event_payload") == want
    drained(feeds.stream_customer_events(feed, sink, ck, ONCE))  # restart: nothing new
    assert spark.read.parquet(sink).count() == table.count()
    # rows that come again later add nothing, however late: ids are keyed state without a time limit
    table.limit(700).write.mode("append").parquet(src)
    query = feeds.stream_customer_events(feed, sink, ck, ONCE)
    drained(query)
    state = query.lastProgress["stateOperators"][0]
    assert "watermark" not in query.lastProgress.get("eventTime", {}) and state["numRowsTotal"] == table.count()
    assert spark.read.parquet(sink).count() == table.count()


def test_enrichment_stream_is_idempotent(spark, w, tmp_path):
    src, sink, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    table = w.tables["transcript"]
    table.repartition(3).write.parquet(src)
    table.limit(50).write.mode("append").parquet(src)
    live = feeds.stream_reader(spark, src, SCHEMAS["transcript"], max_files=1)

    def go(checkpoint):
        drained(feeds.stream_enrichment(live, enrich.TRANSCRIPT, w.lexicon, sink, checkpoint, ONCE, w.as_of))
        return rows(feeds.read_sink(spark, sink, "customer_ai_enrichment"), "enrichment_id", "sentiment_score")

    wide = enrich.wide_from_source(table, enrich.TRANSCRIPT, w.lexicon)
    want = rows(enrich.tall_from_wide(wide, w.as_of), "enrichment_id", "sentiment_score")
    assert go(ck) == want
    assert go(str(tmp_path / "ck2")) == want  # lost checkpoint: all batches run again


def test_evidence_stream_grows_the_index(spark, w, tmp_path):
    src, sink, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    corpus = w.corpus.filter("source_type = 'NOTE'")
    corpus.repartition(2).write.parquet(src)
    live = feeds.stream_reader(spark, src, corpus.schema, max_files=1)
    drained(feeds.stream_evidence_refresh(live, sink, ck, ONCE))
    query = "stupid worthless the"
    got = search_log.open_log(spark, sink).search(query)[0].select("doc_id", "score").collect()
    assert got == evidence.search_corpus(corpus, query).select("doc_id", "score").collect()


@pytest.mark.parametrize("name", ["stream_enrichment", "stream_evidence_refresh", "stream_customer_events"])
def test_tables_that_are_folders_of_files(spark, tmp_path, name):
    small = "/root/testdata/sf0.001"
    for table in os.listdir(small):
        if table in ("documents.parquet", "labels.parquet", "lineitem.parquet"):
            spark.read.parquet(f"{small}/{table}").repartition(3).write.parquet(str(tmp_path / table))
        else:
            os.symlink(f"{small}/{table}", tmp_path / table)
    want, got = (QUERIES[name](spark, d) for d in (small, str(tmp_path)))
    assert got.count() and rows(got, *got.columns) == rows(want, *want.columns)


ARRIVAL = "customer_id string, arrival_id string, channel string, topic string, text string, sentiment double"


def test_ingest_worsens_once_per_batch(spark, make, as_of, tmp_path):
    src, sink, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    before = make("customer_health", *[dict(customer_id=c, health_score=80.0, churn_risk=0.1, sentiment_score=60.0, risk_level="HEALTHY") for c in "AB"])
    known = make("customer_ai_enrichment", dict(enrichment_id="1", customer_id="A", source_table="TRANSCRIPT", source_id="1", sentiment_score=0.5))

    def arrive(*items):
        spark.createDataFrame(list(items), ARRIVAL).coalesce(1).write.mode("append").parquet(src)

    def run():
        live = feeds.stream_reader(spark, src, spark.createDataFrame([], ARRIVAL).schema)
        drained(feeds.ingest_interaction(live, before, known, sink, ck, ONCE, as_of))
        return {r["customer_id"]: r for r in feeds.newest_health(spark, sink).collect()}

    arrive(("A", "1", "Phone", "Cancellation Request", "t", -0.5), ("A", "2", "Phone", "Claim Status", "t", -0.3))
    got = run()
    assert (got["A"]["health_score"], got["A"]["churn_risk"], got["A"]["risk_level"]) == (70, 0.25, "MONITOR")
    assert got["A"]["sentiment_score"] == pytest.approx(25 * (0.5 - 0.5 - 0.3) / 3 + 50)
    assert got["B"]["health_score"] == 80
    arrive(("A", "1", "Phone", "Cancellation Request", "t", -0.5), ("B", "3", "Chat", "Complaint", "t", 0.3))
    got = run()
    assert got["A"]["health_score"] == 70  # arrival 1 was a repeat
    assert got["B"]["health_score"] == 70 and got["B"]["churn_risk"] == 0.25
    enr = {r["enrichment_id"]: r for r in feeds.read_sink(spark, sink, "customer_ai_enrichment").collect()}
    assert {k: (r["classification"], r["sentiment_label"], r["source_id"]) for k, r in enr.items()} == {
        "ES1": ("CHURN", "NEGATIVE", "TS1"), "ES2": ("CLAIM_FRICTION", "NEGATIVE", "TS2"), "ES3": ("GENERAL_INQUIRY", "POSITIVE", "TS3"),
    }
    links = feeds.read_sink(spark, sink, "transcript").join(feeds.read_sink(spark, sink, "interaction"), "interaction_id")
    assert links.count() == 3
    # a batch that runs again after a crash rewrites itself
    shutil.rmtree(f"{sink}/customer_health/batch=1")
    shutil.rmtree(f"{ck}/commits")
    assert run()["B"]["health_score"] == 70
    assert feeds.read_sink(spark, sink, "interaction").count() == 3


def test_folders_read_do_not_grow_with_the_batches(spark, tmp_path):
    sink = str(tmp_path)
    for i in range(30):
        feeds.write_sink(spark.createDataFrame([(f"a{i}",)], "customer_id string"), sink, "ids", i)
        feeds.compact(spark, sink, "ids", i)
        assert len(feeds.sink_folders(spark, sink, "ids", i + 1)) <= feeds.COMPACT_EVERY
    assert feeds.read_sink(spark, sink, "ids").count() == 30
    assert len(feeds.sink_batches(spark, sink, "ids")) == 30
    shutil.rmtree(f"{sink}/ids/through=29", ignore_errors=True)
    (tmp_path / "ids" / "through=28").mkdir(exist_ok=True)  # not complete: it has no _SUCCESS
    assert feeds.read_sink(spark, sink, "ids").count() == 30


def test_sink_reader_before_any_batch(spark, tmp_path):
    assert feeds.read_sink(spark, str(tmp_path), "nothing") is None
    assert feeds.newest_health(spark, str(tmp_path)) is None
