"""SQL access to tables and look-ups."""

import json
from datetime import date, datetime

from conftest import DATA

from custlattice.plans import views
from custlattice.plans.registry import open_workspace


def test_views_and_functions(spark, make, as_of):
    later = datetime(2024, 2, 9)
    frames = {
        "customer": make("customer", dict(customer_id="A", first_name="F", last_name="L"), dict(customer_id="B")),
        "policy": make("policy", dict(policy_id="P", customer_id="A", premium_amount=1.0)),
        "claim": make("claim", dict(claim_id="old", customer_id="A", filed_date=date(2023, 7, 30)), dict(claim_id="new", customer_id="A", filed_date=date(2023, 7, 31))),
        "customer_health": make("customer_health", dict(customer_id="A", health_score=70.0)),
        "customer_moment": make("customer_moment", dict(moment_id="m", customer_id="A", moment_type="CHURN", expires_at=later), dict(moment_id="n", customer_id="A", expires_at=as_of)),
        "next_best_action": make(
            "next_best_action",
            *[dict(action_id=a, customer_id="A", priority=p, status=s, suppressed=x, expires_at=e) for a, p, s, x, e in (("1", 2, "PENDING", False, later), ("2", 1, "APPROVED", False, None), ("3", 1, "PENDING", True, later), ("4", 1, "PENDING", False, as_of))],
        ),
    }
    views.register_views(spark, frames)
    views.register_functions(spark, frames, as_of)
    got = spark.sql("SELECT action_id FROM get_customer_nba('A') ORDER BY priority, confidence DESC").collect()
    assert [r[0] for r in got] == ["2", "1"]
    rec = json.loads(spark.sql("SELECT actions FROM get_nba_recommendation('A')").first()[0])
    assert [r["action_id"] for r in rec] == ["1"]
    record = "SELECT record FROM customer_360_lookup('{}')"
    one = json.loads(spark.sql(record.format("A")).first()[0])
    assert one["customer"]["name"] == "F L" and one["health"]["health_score"] == 70
    assert [c["claim_id"] for c in one["recent_claims"]] == ["new"] and len(one["active_moments"]) == 1
    assert json.loads(spark.sql(record.format("B")).first()[0])["policies"] == []
    assert spark.sql("SELECT count(*) FROM customer c JOIN customer_health h USING (customer_id)").first()[0] == 1


def test_lookup_filter_reaches_the_scans(spark, as_of, tmp_path):
    w = open_workspace(spark, DATA)
    frames = {t: w.tables[t] for t in ("customer", "policy", "claim")}
    for t, df in frames.items():
        df.limit(50).write.parquet(f"{tmp_path}/{t}")
    frames = {t: spark.read.parquet(f"{tmp_path}/{t}") for t in frames}
    frames |= {"customer_health": w.health, "customer_moment": w.moments, "next_best_action": w.actions}
    views.register_functions(spark, frames, as_of)
    plan = spark.sql("SELECT * FROM customer_360_lookup('CUST-000001')")._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.split("\n") if "Filter" in line]
    assert len(filters) >= 5 and all("CUST-000001" in line for line in filters), plan
