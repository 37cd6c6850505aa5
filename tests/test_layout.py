"""Tables in buckets: joins without a shuffle, the same rows, folders that other sessions can open."""

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from custlattice.operators import enrich, evidence
from custlattice.plans.registry import QUERIES, open_workspace
from custlattice.sources.layout import open_bucketed, write_bucketed


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for k in keys:
        spark.conf.set(k, "-1")
    yield
    for k in keys:
        spark.conf.unset(k)


def test_labels_join_the_texts_without_a_shuffle(spark, make, tmp_path, no_broadcast):
    w = open_workspace(spark, DATA)
    fixed = {"note": make("note"), "survey": make("survey")}  # these join nothing; the sample's surveys come from a join of their own
    tables = dict(fixed)
    for table, key in (("transcript", "transcript_id"), ("email", "email_id")):
        tables[table] = open_bucketed(spark, write_bucketed(w.tables[table], str(tmp_path), table, key, 6))
    unlaid = fixed | {t: w.tables[t] for t in ("transcript", "email")}
    wide = enrich.enrichment_wide(w.enrichment)
    labels = open_bucketed(spark, write_bucketed(wide, str(tmp_path), "labels", "source_id", 6))
    out = evidence.evidence_source(tables, labels)
    assert "SortMergeJoin" in plan(out) and "Exchange" not in plan(out)
    got = sorted(map(str, out.select(*evidence.CORPUS).collect()))
    assert got == sorted(map(str, evidence.evidence_source(unlaid, wide).select(*evidence.CORPUS).collect()))


def test_another_session_learns_the_layout(spark, tmp_path, no_broadcast):
    rows = spark.range(500).select(F.when(F.col("id") % 9 > 0, F.col("id").cast("string")).alias("k"), F.array("id").alias("a `b`"))
    paths = [write_bucketed(rows, str(tmp_path), name, "k", 3) for name in ("one", "it's")]
    other = spark.newSession()
    for t in [t.name for t in spark.catalog.listTables() if t.name.startswith("bucketed_")]:
        spark.sql(f"DROP TABLE {t}")  # what is left is files alone
    other.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    one, two = (open_bucketed(other, p) for p in paths)
    both = one.join(two, "k")
    assert "Exchange" not in plan(both) and both.count() == 444
    assert one.count() == 500  # rows without a key are kept
    with pytest.raises(Exception, match="(?i)exist|not empty"):
        write_bucketed(rows, str(tmp_path), "one", "k", 3)
    with pytest.raises(ValueError, match="dot"):
        write_bucketed(rows, str(tmp_path), "x", "a.b", 3)


def test_empty_table(spark, tmp_path):
    path = write_bucketed(spark.range(0), str(tmp_path), "none", "id", 4)
    assert open_bucketed(spark, path).count() == 0


def test_query_has_no_exchange_above_the_texts(spark, no_broadcast):
    text = plan(QUERIES["evidence_source_colocated"](spark, DATA))
    assert text.count("Bucketed: true") == 4 and not any(f"hashpartitioning({key}" in text for key in ("transcript_id", "email_id", "source_id"))
