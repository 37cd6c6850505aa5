"""Hot customers, bounded groups, and plan shape."""

import json
from collections import Counter

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from custlattice.operators import actions, enrich, evidence, grouping, search_log
from custlattice.sources import tables as store
from custlattice.plans import lookup
from custlattice.plans.registry import QUERIES, open_workspace


@pytest.fixture(scope="module")
def hot(spark):
    """3,000 documents, a third of them by one customer, many with equal timestamps."""
    base = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("C"), F.col("id") % 400)).alias("customer_id"),
        F.format_string("D%05d", "id").alias("doc_id"),
        F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(cast(id % 7 as int))").alias("at"),
        F.concat(F.lit("text number "), F.col("id").cast("string")).alias("body"),
    )
    tr = base.select("customer_id", F.col("doc_id").alias("transcript_id"), F.col("body").alias("transcript_text"), F.col("at").alias("created_at"))
    none = tr.limit(0)
    em = none.select("customer_id", F.col("transcript_id").alias("email_id"), F.lit("s").alias("subject"), F.col("transcript_text").alias("body"), F.col("created_at").alias("sent_at"))
    nt = none.select("customer_id", F.col("transcript_id").alias("note_id"), F.col("transcript_text").alias("note_text"), "created_at")
    return tr, em, nt


def test_digest_of_a_hot_customer_is_whole_and_in_bounded_parts(hot):
    whole = {r["customer_id"]: r["digest"] for r in enrich.customer_digest(*hot).collect()}
    rows = enrich.customer_digest(*hot, max_lines=100).collect()
    assert {r["customer_id"] for r in rows if r["part"] > 0} == {"HOT"}
    hot_parts = sorted((r for r in rows if r["customer_id"] == "HOT"), key=lambda r: r["part"])
    assert [r["part"] for r in hot_parts] == list(range(10)) and {r["n_lines"] for r in hot_parts} == {100}
    assert "\n".join(r["digest"] for r in hot_parts) == whole["HOT"]
    assert {r["customer_id"]: r["digest"] for r in rows if r["customer_id"] != "HOT"} == {
        c: d for c, d in whole.items() if c != "HOT"
    }


def test_paged_arrays_keep_every_item(spark):
    items = spark.range(5000).select(
        F.when(F.col("id") < 3000, "HOT").otherwise((F.col("id") % 300).cast("string")).alias("k"), F.col("id").alias("item")
    )
    header = items.select("k").distinct().union(spark.createDataFrame([("EMPTY",)], "k string")).withColumn("title", F.lower("k"))
    got = grouping.paged_arrays(items, "k", "item", {"all": F.col("item")}, 200, header).collect()
    assert sorted(i for r in got for i in r["all"]) == list(range(5000))
    hot = [r for r in got if r["k"] == "HOT"]
    assert sorted(r["page"] for r in hot) == list(range(15)) and {len(r["all"]) for r in hot} == {200}
    assert all(r["title"] == r["k"].lower() for r in got)
    assert [(r["page"], r["all"]) for r in got if r["k"] == "EMPTY"] == [(0, [])]


def test_customer_360_pages_hold_everything(spark):
    w = open_workspace(spark, DATA)
    one = lookup.customer_360(w.tables, w.health, w.moments, w.as_of)
    small = lookup.customer_360(w.tables, w.health, w.moments, w.as_of, page_size=5)
    assert small.filter("page > 0").count() > 0
    size = [F.sum(F.size(c)).alias(c) for c in ("active_moments", "policies", "recent_claims")]
    assert small.agg(*size).first() == one.agg(*size).first()
    assert small.filter("customer is null or health is null").count() == 0


def test_action_evidence_equals_brute_force(spark):
    docs = spark.range(200).select(
        F.lit("HOT").alias("customer_id"), F.format_string("D%03d", "id").alias("doc_id"), F.lit("NOTE").alias("source_type"),
        F.lit("UNKNOWN").alias("sentiment"), F.lit("X").alias("moment_type"),
        F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(cast(id % 9 as int))").alias("event_date"),
        F.lit("c").alias("content"),
    )
    acts = spark.range(50).select(F.col("id").cast("string").alias("action_id"), F.lit("HOT").alias("customer_id"), F.lit("A").alias("action_type"))
    best = sorted(((r["event_date"], r["doc_id"]) for r in docs.collect()), key=lambda x: (-x[0].toordinal(), x[1]))[:3]
    got = evidence.action_evidence(acts, docs, 3).collect()
    assert len(got) == 150 and {r["doc_id"] for r in got} == {d for _, d in best}


def test_hot_join_equals_plain_join(spark):
    many = spark.range(20000).select(
        F.when(F.col("id") % 3 == 0, "HOT").when(F.col("id") % 50 == 1, None).otherwise((F.col("id") % 5000).cast("string")).alias("k"),
        F.col("id").alias("row"),
    )
    few = many.select("k").distinct().filter("k is null or k <> '4'").withColumn("x", F.length("k"))
    got = grouping.join_hot(many, few, "k")
    want = many.join(few, "k")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))


def test_hot_anti_join_equals_plain_anti_join(spark):
    many = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "HOT").when(F.col("id") % 5 == 0, None).otherwise((F.col("id") % 40).cast("string")).alias("k"), F.col("id").alias("row"))
    few = spark.createDataFrame([("HOT",), ("7",), (None,)], "k string")
    got = grouping.anti_hot(many, few, "k")
    assert sorted(map(str, got.collect())) == sorted(map(str, many.join(few, "k", "left_anti").select(got.columns).collect()))


def largest_task(df):
    """Rows of the largest partition just above the last exchange."""
    return max(r[0] for r in df.groupBy(F.spark_partition_id()).count().select("count").collect())


def test_pages_do_not_depend_on_the_number_of_tasks(spark, hot):
    items = spark.range(2000).select(F.when(F.col("id") < 1500, "HOT").otherwise("x").alias("k"), F.col("id").alias("item"))
    got = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("3", "17"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            pages = grouping.paged_arrays(items.repartition(int(n)), "k", "item", {"all": F.col("item")}, 70)
            digest = enrich.customer_digest(*[t.repartition(int(n)) for t in hot], max_lines=90)
            got.append((sorted(map(str, pages.collect())), sorted(map(str, digest.collect()))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1]


def test_hot_key_is_many_tasks_work(spark):
    many = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("row"))
    few = many.select("k").distinct()
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "32")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        numbered = grouping.positions(many, "k", F.col("row") % 64, F.col("row"), first_bucket=F.col("_bucket"))
        assert largest_task(numbered) < 2_500
    finally:
        for key in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"):
            spark.conf.unset(key)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


SPLIT_AT = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def split_early(spark):
    """Adaptive execution with the limits of a large cluster's partitions cut to those of the test tables."""
    before = {k: spark.conf.get(k, None) for k in SPLIT_AT}
    for k, v in SPLIT_AT.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("kind", ["join", "anti"])
def test_hot_key_of_a_join_is_split(spark, split_early, kind):
    many = spark.range(0, 40_000, 1, 16).select(F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("row"), F.md5(F.col("id").cast("string")).alias("x"))
    # one row per key, as an aggregation leaves it: without an exchange of its own this side would hide the join from the splitting
    few = many.filter("k <> 'HOT' or row < 9000").groupBy("k").agg(F.max("row").alias("top"))
    out = grouping.join_hot(many, few, "k") if kind == "join" else grouping.anti_hot(many, few.filter("k <> 'HOT'"), "k")
    out = out.withColumn("task", F.spark_partition_id())
    rows = Counter(r["task"] for r in out.collect())
    assert rows.total() == (40_000 if kind == "join" else 13_334)
    assert max(rows.values()) < 4_500  # the hot key has 13,334 rows
    assert "skew=true" in plan(out)


def test_escalations_and_action_evidence_split_a_hot_customer(spark, split_early, make, as_of):
    claims = make("claim", *[dict(claim_id=f"C{i}", customer_id="HOT" if i % 3 else f"c{i}", status="Open", filed_date=as_of.date().replace(day=1), claim_amount=1.0) for i in range(6_000)])
    claims = claims.repartition(16)
    scored = claims.select("customer_id").distinct().select("customer_id", F.lit(10.0).alias("sentiment_score"))
    none = make("next_best_action")
    out = actions.nba_claims(claims, scored, none, as_of)
    assert out.count() == 6_000
    out.collect()
    assert "skew=true" in plan(out)
    docs = claims.select(
        "customer_id", F.col("claim_id").alias("doc_id"), F.lit("NOTE").alias("source_type"), F.lit("UNKNOWN").alias("sentiment"),
        F.lit("X").alias("moment_type"), F.lit(as_of).cast("timestamp_ntz").alias("event_date"), F.lit("c").alias("content"),
    )
    acts = claims.select(F.col("claim_id").alias("action_id"), "customer_id", F.lit("A").alias("action_type"))
    found = evidence.action_evidence(acts, docs, 2)
    assert found.count() == 4_000 * 2 + 2_000
    found.collect()
    assert "skew=true" in plan(found)


@pytest.mark.parametrize("name", ["customer_policies", "customer_claims", "customer_payments", "customer_interactions", "customer_actions", "customer_nba", "active_moments"])
def test_listings_of_all_customers_are_not_sorted(spark, name):
    assert "rangepartitioning" not in plan(QUERIES[name](spark, DATA))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_is_cut_before_the_shuffle(spark):
    text = plan(lookup.customer_timeline(open_workspace(spark, DATA).events))
    assert text.count("WindowGroupLimit") == 2


def test_pages_come_from_the_counts_of_the_positions(spark, make):
    items = make("claim", *[dict(claim_id=str(i), customer_id="A") for i in range(25)], dict(claim_id="x", customer_id="B"))
    header = make("customer", *[dict(customer_id=c) for c in "ABC"]).select("customer_id", F.upper("customer_id").alias("name"))
    out = grouping.paged_arrays(items, "customer_id", "claim_id", {"claims": F.col("claim_id")}, 10, header)
    rows = out.collect()
    assert "ReusedExchange" in plan(out)
    assert {(r["customer_id"], r["page"]): len(r["claims"]) for r in rows} == {("A", 0): 10, ("A", 1): 10, ("A", 2): 5, ("B", 0): 1, ("C", 0): 0}


NO_CROSS = [
    "moments_every_row", "customer_moments", "nba_generate", "customer_health", "customer_360", "check_customer",
    "evidence_source_joined", "action_evidence", "sem_view", "retention_metrics", "evidence_search", "check_keys",
]


@pytest.mark.parametrize("name", NO_CROSS)
def test_no_query_builds_pairs(spark, name):
    text = plan(QUERIES[name](spark, DATA))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_filters_and_columns_reach_the_scan(spark):
    from custlattice.operators import moments

    w = open_workspace(spark, DATA)
    text = plan(w.tables["transcript"].select("transcript_id"))
    assert "PushedFilters: [In(source" in text and "ReadSchema: struct<doc_id:bigint,source:string>" in text
    stored = w.tables["policy"].limit(100)
    path = w._root + "/policy"
    stored.write.parquet(path)
    text = plan(moments.next_renewal(spark.read.parquet(path), w.as_of, 45))
    assert "(status,Active), GreaterThanOrEqual(end_date" in text and "premium_amount" not in text


def test_result_does_not_depend_on_partitioning(spark):
    w = open_workspace(spark, DATA)
    one = enrich.customer_signals(w.wide.coalesce(1)).orderBy("customer_id").collect()
    many = enrich.customer_signals(w.wide.repartition(17)).orderBy("customer_id").collect()
    assert one == many


def test_pipeline_writes_and_equals_the_lazy_tables(spark, tmp_path):
    from custlattice.plans.pipeline import run_pipeline

    w = open_workspace(spark, DATA)
    out = run_pipeline(spark, w.tables, w.lexicon, str(tmp_path), w.as_of, w.prior_actions)
    assert out["customer_event"].count() == w.events.count()
    for table, mine, key in (("customer_health", w.health, "customer_id"), ("next_best_action", w.actions, "action_id")):
        columns = [c for c in mine.columns]
        assert out[table].select(columns).orderBy(key).collect() == mine.orderBy(key).collect()
    context = out["customer_moment"].filter("moment_type = 'CHURN'").first()["context"]
    assert "reason" in json.loads(context)
    assert store.load(spark, str(tmp_path), "customer_health").count() == w.health.count()
    index = search_log.open_log(spark, f"{tmp_path}/evidence_index")
    query = "stupid worthless license onwh"
    a = index.search(query)[0].select("doc_id", "score").collect()
    assert a == evidence.search_corpus(w.corpus, query).select("doc_id", "score").collect()
