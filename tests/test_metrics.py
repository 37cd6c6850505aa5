"""Metric layer, portfolio options and generators."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from custlattice.plans import checks, portfolio, semantic
from custlattice.sources.schemas import KEYS, SCHEMAS
from custlattice.sources.synth import Generator


@pytest.fixture
def frames(make):
    return {
        "customer_health": make("customer_health", *[dict(customer_id=c, health_score=h, churn_risk=0.1, risk_level=r) for c, h, r in (("A", 10.0, "CRITICAL"), ("B", 20.0, "HEALTHY"), ("X", 30.0, "HEALTHY"))]),
        "customers": make("customer", *[dict(customer_id=c, segment=s, region=r) for c, s, r in (("A", "Premium", "N"), ("B", "Basic", "N"), ("C", None, "S"))]),
        "nba": make("next_best_action", *[dict(action_id=str(i), customer_id=c, action_type="CROSS_SELL", status="PENDING") for i, c in enumerate("AAAC")]),
    }


def test_two_facts_do_not_multiply(frames):
    got = semantic.metrics(semantic.VIEW, frames, ["total customers", "average health", "recommendation count"], by=["tier"])
    rows = {r["segment"]: (r["customer_count"], r["avg_health"], r["action_count"]) for r in got.filter("segment is not null").collect()}
    assert rows == {"Premium": (1, 10.0, 3), "Basic": (1, 20.0, None)}
    # a NULL segment on both sides is one group: the unknown customer X and customer C's action
    assert [tuple(r) for r in got.filter("segment is null").collect()] == [(None, 1, 30.0, 1)]


def test_no_dimensions_filters_order_limit(frames):
    got = semantic.metrics(semantic.VIEW, frames, ["customer_count", "action_count"]).collect()
    assert [tuple(r) for r in got] == [(3, 4)]
    some = semantic.metrics(semantic.VIEW, frames, ["customer_count"], by=["region"], where=F.col("dim.risk_level") == "HEALTHY")
    assert {(r["region"], r["customer_count"]) for r in some.collect()} == {("N", 1), (None, 1)}
    top = semantic.metrics(semantic.VIEW, frames, ["avg_health"], by=["segment"], order=[F.col("avg_health").desc()], limit=1)
    assert [r["avg_health"] for r in top.collect()] == [30.0]
    with pytest.raises(KeyError):
        semantic.metrics(semantic.VIEW, frames, ["no such metric"])


def test_model_from_mapping(make):
    spec = {"tables": [{"name": "T", "dimensions": [{"name": "status", "expr": "STATUS"}],
                        "measures": [{"name": "share", "expr": "COUNT(CASE WHEN STATUS = 'Active' THEN 1 END)::FLOAT / NULLIF(COUNT(*), 0)"}]}]}
    model = semantic.SemanticModel.from_dict(spec)
    df = make("policy", dict(policy_id="1", customer_id="C", status="Active"), *[dict(policy_id=str(i), customer_id="C", status="Expired") for i in (2, 3)])
    assert semantic.metrics(model, {"t": df}, ["share"]).first()["share"] == 1 / 3


def test_model_file_fits_its_tables(make):
    model = semantic.SemanticModel.from_yaml(os.path.join(os.path.dirname(semantic.__file__), "models", "health.yaml"))
    found = {"customer_health": make("customer_health"), "customer": make("customer")}
    assert semantic.problems(model, found) == [] and semantic.checked(model, found) is model
    assert semantic.problems(semantic.MODEL, {t: make(t) for t in ("customer_health", "customer", "policy")} | {"next_best_action_log": make("next_best_action_log")}) == []
    assert semantic.problems(semantic.CLAIMS, {t: make(t) for t in ("claim", "policy", "customer")}) == []


def test_what_a_model_gets_wrong_is_reported(make, tmp_path):
    path = tmp_path / "model.yaml"
    path.write_text("""
tables:
  - name: policy
    dimensions:
      - {name: good, expr: "upper(status)"}
      - {name: lost, expr: "sttaus"}
      - {name: folded, expr: "max(status)"}
      - {name: dice, expr: "rand()"}
    measures:
      - {name: held, expr: "COUNT(DISTINCT POLICY_ID)::FLOAT"}
      - {name: plain, expr: "premium_amount"}
      - {name: broken, expr: "sum(premium_amount"}
      - {name: other, expr: "sum((select max(premium_amount) from policy))"}
      - {name: split, expr: "a / b", parts: {a: [sum(premium_amount), sum]}}
      - {name: merged, expr: "a", parts: {a: [sum(premium_amount), collect_list]}}
  - {name: office}
relationships:
  - {table: policy, key: branch, target: office}
  - {table: policy, key: customer_id, target: customers}
""")
    model = semantic.SemanticModel.from_yaml(str(path))
    found = {"policy": make("policy")}
    lines = semantic.problems(model, found)
    told = dict(line.split(": ", 1) for line in lines if line.startswith("policy."))
    assert set(told) == {f"policy.{n}" for n in ("lost", "folded", "dice", "plain", "broken", "other", "split", "merged (a)")}
    assert "UNRESOLVED_COLUMN" in told["policy.lost"] and "sttaus" in told["policy.lost"]
    assert told["policy.dice"] == "function rand is not allowed" and told["policy.other"] == "function subquery is not allowed"
    assert "PARSE_SYNTAX_ERROR" in told["policy.broken"] and "`b`" in told["policy.split"]
    assert {"office: no such table", "policy to office: policy has no column branch", "policy to customers: no table customers"} <= set(lines)
    with pytest.raises(ValueError, match="sttaus"):
        semantic.checked(model, found)


def test_queue_filter_and_empty_sums(make):
    acts = make("next_best_action", *[dict(action_id=str(i), customer_id="C", action_type=t, status="PENDING", suppressed=s, priority=1, confidence=0.5) for i, (t, s) in enumerate((("A", False), ("B", False), ("B", None), ("B", True)))])
    cust = make("customer", dict(customer_id="C", first_name="F", last_name="L"))
    assert portfolio.nba_queue(acts, cust).count() == 2
    assert [r["customer_name"] for r in portfolio.nba_queue(acts, cust, "B").collect()] == ["F L"]
    empty = portfolio.nba_status_summary(make("next_best_action")).first()
    assert empty["total"] == 0 and empty["pending"] is None


def test_generated_tables(spark):
    gen = Generator(spark, datetime(2024, 1, 31))
    tables = gen.tables(0.02)
    for name, df in tables.items():
        assert {f.name: f.dataType.simpleString() for f in df.schema} == {f.name: f.dataType.simpleString() for f in SCHEMAS[name]}, name
        n = df.count()
        assert n == checks.TARGETS[name] // 50 and df.select(KEYS[name]).distinct().count() == n
    again = Generator(spark, datetime(2024, 1, 31)).customer(200)
    assert sorted(map(str, again.repartition(5).collect())) == sorted(map(str, tables["customer"].collect()))
    other = Generator(spark, datetime(2024, 1, 31), seed=8).customer(200)
    assert sorted(map(str, other.collect())) != sorted(map(str, again.collect()))
    claims = tables["claim"]
    unresolved = F.col("status").isin("Open", "Under Review")
    assert claims.filter(unresolved & F.col("resolution_days").isNotNull()).count() == 0
    assert claims.filter(~unresolved & ~F.col("resolution_days").between(3, 60)).count() == 0


def test_check_keys_finds_problems(make):
    t = {
        "customer": make("customer", dict(customer_id="A"), dict(customer_id="A")),
        "note": make("note", dict(note_id="1", customer_id="A"), dict(note_id="2", customer_id="Z")),
    }
    got = {(r["table_name"], r["problem"]): r["value"] for r in checks.check_keys(t).collect()}
    assert got == {("CUSTOMER", "duplicate_keys"): 1, ("CUSTOMER", "unknown_customers"): 0, ("NOTE", "duplicate_keys"): 0, ("NOTE", "unknown_customers"): 1}


def _star(*links):
    columns = lambda *names: [{"name": n, "expr": n} for n in names]
    total = {"name": "total", "expr": "s", "parts": {"s": ("sum(x)", "sum")}}
    tables = [
        {"name": "a", "dimensions": columns("kind"), "measures": [total, {"name": "ids", "expr": "count(distinct x)"}]},
        {"name": "b", "dimensions": columns("b_name")}, {"name": "c", "dimensions": columns("c_name")}, {"name": "d", "dimensions": columns("d_name")},
    ]
    return semantic.SemanticModel.from_dict({"tables": tables, "relationships": [dict(zip(("table", "key", "target", "cardinality"), r)) for r in links]})


@pytest.fixture
def star(spark):
    return {
        "a": spark.createDataFrame([(1, "k", 1), (1, "l", 2), (2, "k", 4), (3, "k", 8), (None, "k", 16)], "b_id int, kind string, x int"),
        "b": spark.createDataFrame([(1, 10, "b1"), (2, 20, "b2"), (3, None, "b3")], "b_id int, c_id int, b_name string"),
        "c": spark.createDataFrame([(10, 100, "c1"), (20, 100, "c2")], "c_id int, d_id int, c_name string"),
        "d": spark.createDataFrame([(100, "d1")], "d_id int, d_name string"),
    }


def test_metrics_over_several_hops(star):
    model = _star(("a", "b_id", "b"), ("b", "c_id", "c"), ("c", "d_id", "d"))
    got = lambda names, by, **k: sorted(map(tuple, semantic.metrics(model, star, names, by, **k).collect()), key=str)
    assert got(["total"], ["c_name"]) == [("c1", 3), ("c2", 4), (None, 24)]
    assert got(["total"], ["d_name", "kind"]) == sorted([("d1", "k", 5), ("d1", "l", 2), (None, "k", 24)], key=str)
    assert got(["total", "ids"], ["d_name"]) == sorted([("d1", 7, 3), (None, 24, 2)], key=str)
    assert got(["total"], ["b_name"], where=F.col("dim.d_name") == "d1") == [("b1", 3), ("b2", 4)]
    assert got(["total"], []) == [(31,)]


def test_added_up_per_key_before_the_first_join(star):
    model = _star(("a", "b_id", "b"), ("b", "c_id", "c"))
    plan = semantic.metrics(model, star, ["total"], ["c_name"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2 and plan.index("Join") < plan.rindex("Aggregate")
    plan = semantic.metrics(model, star, ["ids"], ["c_name"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1


def test_rows_are_never_multiplied(star):
    fan_out = _star(("b", "b_id", "a"), ("b", "c_id", "c"))  # a row of b has one a, so an a has many b
    with pytest.raises(ValueError, match="c_name"):
        semantic.metrics(fan_out, star, ["total"], ["c_name"])
    both_ways = _star(("b", "b_id", "a", "one_to_one"), ("b", "c_id", "c"))
    assert semantic.metrics(both_ways, star, ["total"], ["c_name"]).count() == 3
    turned = _star(("b", "b_id", "a", "one_to_many"))
    assert semantic.metrics(turned, star, ["total"], ["b_name"]).count() == 4
    two_paths = _star(("a", "b_id", "b"), ("a", "b_id", "c"), ("b", "c_id", "d"), ("c", "d_id", "d"))
    with pytest.raises(ValueError, match="d_name"):
        semantic.metrics(two_paths, star, ["total"], ["d_name"])
    assert semantic.metrics(two_paths, star, ["total"], ["b_name"]).count() == 4
    with pytest.raises(ValueError, match="cardinality"):
        _star(("a", "b_id", "b", "some"))
    with pytest.raises(KeyError):
        semantic.metrics(both_ways, star, ["total"], ["nothing"])


def test_check_keys_reads_each_table_once(make):
    names = ("customer", "policy", "claim", "note", "customer_event")
    t = {n: make(n, *[{KEYS[n]: f"{n}{i % 3}", "customer_id": f"customer{i}"} for i in range(4)]) for n in names}
    df = checks.check_keys(t)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 2 and "Join" not in plan and plan.count("Scan") == len(names)
    got = {(r["table_name"], r["problem"]): r["value"] for r in df.collect()}
    assert got[("CUSTOMER", "duplicate_keys")] == 0 and got[("CUSTOMER", "unknown_customers")] == 0
    assert all(got[(n.upper(), "duplicate_keys")] == 1 for n in names[1:]) and got[("NOTE", "unknown_customers")] == 0


def test_check_keys_counts_marks_in_two_numbers(make):
    names = ("policy", "claim", "customer", "note", "customer_event")
    t = {n: make(n, {KEYS[n]: "1", "customer_id": "A"}, {KEYS[n]: "1", "customer_id": "Y"}, {KEYS[n]: "2", "customer_id": "Z"}) for n in names if n != "customer"}
    t["customer"] = make("customer", dict(customer_id="A"), dict(customer_id="A"))
    df = checks.check_keys({n: t[n] for n in names})
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    counted = next(line for line in reversed(plan.splitlines()) if "Aggregate [" in line)
    assert counted.count("count(") == 2  # for any number of tables
    got = {(r["table_name"], r["problem"]): r["value"] for r in df.collect()}
    assert got == {(n.upper(), "duplicate_keys"): 1 for n in names} | {(n.upper(), "unknown_customers"): 0 if n == "customer" else 2 for n in names}


def test_check_keys_of_empty_tables(make):
    got = checks.check_keys({n: make(n) for n in ("customer", "claim")}).collect()
    assert [r["value"] for r in got] == [0, 0, 0, 0]


def test_sums_beyond_64_bits_of_millionths(spark):
    from custlattice.plans import semantic

    rows = spark.range(100).selectExpr("cast(1e11 as double) as x")
    assert rows.selectExpr(semantic._total("x") + " as t", semantic._mean("x") + " as m").first() == (1e13, 1e11)
