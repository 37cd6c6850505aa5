"""Boundaries and NULL rules on hand-made rows."""

import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from custlattice.functions import scores, text
from custlattice.functions.values import clamp, days_between, padded_id, strict_least
from custlattice.operators import actions as nba, search_log
from custlattice.operators import enrich, evidence, health, moments, workflow
from custlattice.sources import tables as store

DAY = date(2024, 1, 31)


def ago(n):
    return DAY - timedelta(days=n)


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def null(kind="double"):
    return F.lit(None).cast(kind)


# --- column functions ------------------------------------------------------------------------


def test_null_strict_helpers(spark):
    assert value(spark, clamp(null(), 0.0, 100.0)) is None
    assert value(spark, clamp(F.lit(120.0), 0.0, 100.0)) == 100.0
    assert value(spark, strict_least(null(), F.lit(60.0))) is None


def test_days_are_calendar_boundaries(spark):
    a, b = (F.lit(s).cast("timestamp_ntz") for s in ("2024-01-01 23:59:00", "2024-01-02 00:01:00"))
    assert value(spark, days_between(a, b)) == 1


def test_padded_id_keeps_long_numbers(spark):
    assert value(spark, padded_id("C-", F.lit(42), 6)) == "C-000042"
    assert value(spark, padded_id("C-", F.lit(12345678), 6)) == "C-12345678"


@pytest.mark.parametrize(
    "score,label", [(0.3, "POSITIVE"), (0.29, "NEUTRAL"), (-0.29, "NEUTRAL"), (-0.3, "NEGATIVE"), (None, None)]
)
def test_sentiment_bands(spark, score, label):
    assert value(spark, text.sentiment_label(F.lit(score).cast("double"))) == label


@pytest.mark.parametrize(
    "days,points",
    [(7, 95), (8, 80), (30, 80), (31, 60), (90, 60), (91, 40), (180, 40), (181, 20), (None, 20)],
)
def test_engagement_steps(spark, days, points):
    assert value(spark, scores.score_engagement(F.lit(days).cast("int"))) == points


@pytest.mark.parametrize(
    "churn,level",
    [(0.7, "CRITICAL"), (0.69, "AT_RISK"), (0.4, "AT_RISK"), (0.39, "MONITOR"), (0.2, "MONITOR"), (0.19, "HEALTHY"), (None, "HEALTHY")],
)
def test_risk_bands(spark, churn, level):
    assert value(spark, scores.risk_level(F.lit(churn).cast("double"))) == level


def test_component_defaults(spark):
    assert value(spark, scores.score_sentiment(null())) == 50
    assert value(spark, scores.score_payment(null())) == 90
    # only unresolved claims, however many: no average resolution, hence the default
    assert value(spark, scores.score_claims(F.lit(9), F.lit(0), null())) == 80
    assert value(spark, scores.score_claims(F.lit(1), F.lit(1), F.lit(100.0))) == 45


def test_churn_parts_are_strict(spark):
    none = scores.churn_risk(null("int"), null(), null(), null("int"), null("int"))
    assert float(value(spark, none)) == 0
    at_bounds = scores.churn_risk(F.lit(0), F.lit(-0.3), F.lit(0.2), F.lit(2), F.lit(90))
    assert float(value(spark, at_bounds)) == 0
    everything = scores.churn_risk(F.lit(1), F.lit(-0.31), F.lit(0.21), F.lit(3), F.lit(91))
    assert float(value(spark, everything)) == 1.0


# --- text ------------------------------------------------------------------------------------

LEX = text.Lexicon(
    positive=("good",), negative=("bad",),
    entities={"competitors": ("rival",), "products": ("auto", "home"), "people": ()},
    intents={"cancellation_intent": ("cancel",), "price_sensitivity": ("price",), "complaint": ("bad",)},
)


def test_signals(spark, make):
    rows = [
        ("a", "Good, good; BAD rival! rival"), ("b", "nothing here"), ("c", None), ("d", ""),
        ("e", "cancel the bad price"), ("f", "price of home and auto"), ("g", "goodish badly"),
    ]
    df = text.with_signals(spark.createDataFrame(rows, "id string, t string"), F.col("t"), LEX)
    got = {r["id"]: r for r in df.collect()}
    assert got["a"]["sentiment_score"] == 0.333333
    assert got["a"]["entities"]["competitors"] == ["rival"]
    assert got["b"]["sentiment_score"] == 0 and got["b"]["classification"] == "GENERAL_INQUIRY"
    assert got["c"]["sentiment_score"] is None and got["c"]["entities"] is None and got["c"]["classification"] is None
    assert got["d"]["sentiment_label"] == "NEUTRAL"
    assert got["e"]["classification"] == "CHURN" and got["e"]["intents"]["complaint"]
    assert got["f"]["entities"]["products"] == ["auto", "home"] and got["f"]["classification"] == "PRICE_SENSITIVITY"
    assert got["g"]["sentiment_score"] == 0


def test_lexicon_may_be_large(spark):
    many = text.Lexicon(tuple(f"w{i}" for i in range(6_000)), ("bad",), {}, {})
    df = spark.createDataFrame([("w5999 w3 bad",)], "t string")
    assert df.select(text._score(text._known_tokens(F.col("t"), many.terms()), many)).first()[0] == 0.333333
    with pytest.raises(ValueError):
        text.Lexicon((), (), {"cities": ("x",)}, {})


def test_lexicon_from_table(spark):
    df = spark.createDataFrame([("positive", "good"), ("competitors", "rival")], "list string, term string")
    lex = text.Lexicon.from_table(df)
    assert lex.positive == ("good",) and lex.entities["competitors"] == ("rival",)


def test_bad_json_is_null(spark):
    df = spark.createDataFrame([('{"competitors":["x"],"products":[],"people":[]}',), ("no json",)], "j string")
    got = [r[0] for r in df.select(enrich.entities_from_json(F.col("j"))).collect()]
    assert got[0]["competitors"] == ["x"] and got[1] is None


def test_unprocessed_survives_null_ids_and_caps(spark, make, as_of):
    src = make("transcript", *[dict(transcript_id=f"T{i}", interaction_id="I", customer_id="C", transcript_text="good") for i in range(4)])
    done = make(
        "customer_ai_enrichment",
        dict(enrichment_id="1", customer_id="C", source_table="TRANSCRIPT", source_id=None, sentiment_score=0.1),
        dict(enrichment_id="2", customer_id="C", source_table="TRANSCRIPT", source_id="T0", sentiment_score=0.1),
        dict(enrichment_id="3", customer_id="C", source_table="TRANSCRIPT", source_id="T1", classification="CHURN"),
    )
    todo = enrich.unprocessed(src, "transcript_id", done, "TRANSCRIPT", "sentiment_score")
    assert sorted(r[0] for r in todo.select("transcript_id").collect()) == ["T1", "T2", "T3"]
    capped = enrich.unprocessed(src, "transcript_id", done, "TRANSCRIPT", "sentiment_score", 2)
    assert sorted(r[0] for r in capped.select("transcript_id").collect()) == ["T1", "T2"]


def test_model_hook_scores_in_batches(spark, make, as_of):
    src = make("transcript", dict(transcript_id="T1", interaction_id="I", customer_id="C", transcript_text="xx"))
    rows = enrich.enrich_sentiment_with_model(src, enrich.TRANSCRIPT, lambda s: s.str.len() / -4.0, as_of).collect()
    assert rows[0]["sentiment_score"] == -0.5 and rows[0]["sentiment_label"] == "NEGATIVE"
    assert rows[0]["enrichment_id"] == "ENR-T-T1"


def test_tall_and_wide_agree(spark, make, as_of):
    tr = make("transcript", dict(transcript_id="T1", interaction_id="I", customer_id="C", transcript_text="good rival cancel"))
    em = make("email", dict(email_id="E1", customer_id="C", subject="cancel", body="bad"))
    wide = enrich.wide_from_text(tr, em, LEX)
    tall = enrich.tall_from_wide(wide, as_of)
    assert tall.count() == 6
    single = [
        enrich.enrich_sentiment(tr, enrich.TRANSCRIPT, LEX, as_of), enrich.enrich_sentiment(em, enrich.EMAIL, LEX, as_of),
        enrich.enrich_entities(tr, LEX, as_of), enrich.enrich_intents(tr, enrich.TRANSCRIPT, LEX, as_of),
        enrich.enrich_intents(em, enrich.EMAIL, LEX, as_of), enrich.enrich_classification(tr, LEX, as_of),
    ]
    expected = sorted(str(r) for df in single for r in df.collect())
    assert sorted(str(r) for r in tall.collect()) == expected
    key = ["source_table", "source_id"]
    back = enrich.enrichment_wide(tall).select(sorted(wide.columns)).orderBy(key).collect()
    assert back == wide.select(sorted(wide.columns)).orderBy(key).collect()


# --- moments ---------------------------------------------------------------------------------


def policies(make, *days, status="Active"):
    return make(
        "policy",
        *[dict(policy_id=f"P{d}", customer_id=f"C{d}", status=status, end_date=DAY + timedelta(days=d)) for d in days],
    )


def entity_rows(make, *customers):
    return make(
        "customer_ai_enrichment",
        *[
            dict(enrichment_id=f"ENR-ENT-{c}", customer_id=c, source_table="TRANSCRIPT", source_id=c,
                 entities=(["rival"], [], []))
            for c in customers
        ],
    )


def signals_of(df):
    return enrich.customer_signals(enrich.enrichment_wide(df))


def test_renewal_windows(spark, make, as_of):
    days = (0, 1, 45, 46, 60, 61)
    pol = policies(make, *days)
    sig = signals_of(entity_rows(make, *[f"C{d}" for d in days]))
    found = moments.moments_churn_competitor(sig, pol, as_of).collect()
    assert sorted(r["customer_id"] for r in found) == ["C1", "C45"]
    assert json.loads(found[0]["context"])["reason"] == moments.COMPETITOR_REASON
    none = make("next_best_action")
    assert sorted(r["customer_id"] for r in nba.nba_competitor(sig, pol, none, as_of).collect()) == ["C1", "C45"]
    hl = make(
        "customer_health",
        *[dict(customer_id=f"C{d}", churn_risk=0.4, sentiment_score=49.9, health_score=50.0) for d in days],
    )
    assert sorted(r["customer_id"] for r in nba.nba_retention(hl, pol, none, as_of).collect()) == ["C1", "C45", "C46", "C60"]
    assert moments.moments_churn_competitor(sig, policies(make, 10, status="Expired"), as_of).count() == 0


def test_one_moment_per_customer_or_all(spark, make, as_of):
    rows = make(
        "customer_ai_enrichment",
        *[dict(enrichment_id=f"ENR-ENT-{i}", customer_id="C", source_table="TRANSCRIPT", source_id=str(i), entities=(["r"], [], [])) for i in range(3)],
    )
    pol = make("policy", *[dict(policy_id=f"P{i}", customer_id="C", status="Active", end_date=DAY + timedelta(days=5 + i)) for i in (0, 0, 1)])
    wide = enrich.enrichment_wide(rows)
    one = moments.moments_churn_competitor(enrich.customer_signals(wide), pol, as_of).collect()
    assert len(one) == 1 and one[0]["source_event_id"] == "ENR-ENT-0"
    assert json.loads(one[0]["context"])["renewal_days"] == 5
    every = moments.moments_churn_competitor(None, pol, as_of, "all", wide)
    assert every.count() == 6  # 3 rows x 2 distinct renewal days


def test_churn_intent_needs_both_signals_on_one_document(spark, make, as_of):
    rows = make(
        "customer_ai_enrichment",
        dict(enrichment_id="s", customer_id="C", source_table="TRANSCRIPT", source_id="1", sentiment_score=-0.5),
        dict(enrichment_id="i", customer_id="C", source_table="TRANSCRIPT", source_id="1", intents=(True, False, False, False, False, False)),
        dict(enrichment_id="s2", customer_id="D", source_table="TRANSCRIPT", source_id="2", sentiment_score=-0.3),
        dict(enrichment_id="i2", customer_id="D", source_table="TRANSCRIPT", source_id="2", intents=(True, False, False, False, False, False)),
    )
    none = make("customer_moment")
    sig = signals_of(rows)
    assert [r["customer_id"] for r in moments.moments_churn_intent(sig, none, as_of).collect()] == ["C"]
    assert moments.moments_churn_intent(sig, none, as_of, "row", enrichment=rows).count() == 0
    held = make("customer_moment", dict(moment_id="m", customer_id="C", moment_type="CHURN"))
    assert moments.moments_churn_intent(sig, held, as_of).count() == 0


def test_claim_friction_bounds(spark, make, as_of):
    claims = make(
        "claim",
        dict(claim_id="K14", customer_id="C", status="Open", filed_date=ago(14)),
        dict(claim_id="K15", customer_id="C", status="Under Review", filed_date=ago(15)),
        dict(claim_id="KD", customer_id="C", status="Denied", filed_date=ago(99)),
        dict(claim_id="KX", customer_id="D", status="Open", filed_date=ago(99)),
    )

    def rows(customer, *sents):
        return [dict(enrichment_id=f"{customer}{i}", customer_id=customer, source_table="TRANSCRIPT", source_id=f"{customer}{i}", sentiment_score=s) for i, s in enumerate(sents)]

    enr = make("customer_ai_enrichment", *rows("C", -0.21), *rows("D", -0.2, -0.2, -0.2))
    got = moments.moments_claim_friction(claims, health.agg_sentiment(enr), as_of).collect()
    assert [r["source_event_id"] for r in got] == ["EVT-CLM-K15"]


def test_expiry(spark, make, as_of):
    now = datetime(2024, 1, 31)
    rows = make(
        "customer_moment",
        dict(moment_id="never", customer_id="C"), dict(moment_id="now", customer_id="C", expires_at=now),
        dict(moment_id="later", customer_id="C", expires_at=now + timedelta(seconds=1)),
    )
    assert {r["moment_id"] for r in moments.active_moments(rows, as_of).collect()} == {"never", "later"}


# --- health ----------------------------------------------------------------------------------


def test_customer_without_anything(spark, make, as_of):
    got = health.customer_health(
        make("customer", dict(customer_id="C")), health.agg_sentiment(make("customer_ai_enrichment")),
        health.agg_claims(make("claim")), health.agg_payments(make("payment")),
        health.agg_engagement(make("interaction"), as_of), health.agg_moments(make("customer_moment")), as_of,
    ).first()
    assert (got["health_score"], got["churn_risk"], got["risk_level"]) == (69.5, 0.0, "HEALTHY")
    assert (got["sentiment_score"], got["claims_score"], got["payment_score"], got["engagement_score"]) == (50, 80, 90, 20)


def test_delta_and_rescore(spark, make, as_of):
    rows = make(
        "customer_health",
        dict(customer_id="A", health_score=5.0, churn_risk=0.55, sentiment_score=50.0, risk_level="AT_RISK"),
        dict(customer_id="B", health_score=80.0, churn_risk=0.1, sentiment_score=50.0, risk_level="HEALTHY"),
    )
    sent = make("customer_ai_enrichment", dict(enrichment_id="1", customer_id="A", source_table="T", source_id="1", sentiment_score=-1.0))
    touched = spark.createDataFrame([("A",), ("Z",)], "customer_id string")
    got = {r["customer_id"]: r for r in health.health_apply_delta(rows, health.agg_sentiment(sent), touched, as_of).collect()}
    assert set(got) == {"A", "B"}
    assert (got["A"]["health_score"], got["A"]["churn_risk"], got["A"]["sentiment_score"], got["A"]["risk_level"]) == (0, 0.7, 25, "CRITICAL")
    assert got["B"]["health_score"] == 80
    fresh = make("customer_health", dict(customer_id="A", health_score=1.0), dict(customer_id="B", health_score=2.0))
    mixed = {r["customer_id"]: r["health_score"] for r in health.health_rescore(rows, fresh, touched).collect()}
    assert mixed == {"A": 1.0, "B": 80.0}


# --- actions ---------------------------------------------------------------------------------


def test_escalation_confidence_cap_and_block(spark, make, as_of):
    claims = make("claim", *[dict(claim_id=f"K{d}", customer_id="C", status="Open", filed_date=ago(d), claim_amount=1.0) for d in (14, 15, 44, 60)])
    hl = make("customer_health", dict(customer_id="C", sentiment_score=49.0))
    got = {r["action_id"]: r["confidence"] for r in nba.nba_claims(claims, hl, make("next_best_action"), as_of).collect()}
    assert got == {"NBA-CLM-C-K15": 0.61, "NBA-CLM-C-K44": 0.9, "NBA-CLM-C-K60": 0.9}
    for status, blocked in (("APPROVED", True), ("PENDING", True), ("REJECTED", False), ("COMPLETED", False)):
        held = make("next_best_action", dict(action_id="x", customer_id="C", action_type="CLAIMS_ESCALATION", status=status))
        assert (nba.nba_claims(claims, hl, held, as_of).count() == 0) is blocked


def test_escalation_that_fires_again_gets_a_new_id(make, as_of):
    claims = make("claim", *[dict(claim_id=f"K{d}", customer_id="C", status="Open", filed_date=ago(d)) for d in (15, 44)])
    hl = make("customer_health", dict(customer_id="C", sentiment_score=49.0))
    held = make("next_best_action", dict(action_id="NBA-CLM-C-K44", customer_id="C", action_type="CLAIMS_ESCALATION", status="REJECTED"))
    got = {r["action_id"] for r in nba.nba_claims(claims, hl, held, as_of).collect()}
    assert got == {"NBA-CLM-C-K15", "NBA-CLM-C-K44-20240131000000"}


@pytest.mark.parametrize("churn,confidence", [(0.4, 0.7), (0.9, 0.95), (1.0, 0.95)])
def test_retention_confidence(spark, make, as_of, churn, confidence):
    hl = make("customer_health", dict(customer_id="C5", churn_risk=churn, sentiment_score=10.0))
    row = nba.nba_retention(hl, policies(make, 5), make("next_best_action"), as_of).first()
    assert row["confidence"] == confidence
    assert f"({churn * 100:.1f}%)" in row["rationale"] and "(10.0)" in row["rationale"]


@pytest.mark.parametrize(
    "sentiment,risk,status,reason",
    [
        (39.9, "AT_RISK", "SUPPRESSED", nba.SUPPRESSED_MOOD), (40.0, "HEALTHY", "PENDING", None),
        (40.0, "CRITICAL", "SUPPRESSED", nba.SUPPRESSED_CHURN), (None, "HEALTHY", "PENDING", None),
    ],
)
def test_cross_sell_suppression(spark, make, as_of, sentiment, risk, status, reason):
    cust = make("customer", dict(customer_id="C", segment="Premium"), dict(customer_id="D", segment="Basic"))
    hl = make("customer_health", *[dict(customer_id=c, health_score=60.0, sentiment_score=sentiment, risk_level=risk) for c in "CD"])
    got = nba.nba_cross_sell(cust, hl, make("next_best_action"), as_of).collect()
    assert [(r["customer_id"], r["status"], r["suppression_reason"], r["suppressed"]) for r in got] == [("C", status, reason, reason is not None)]


def test_payment_assistance(spark, make, as_of):
    edge = date(2023, 10, 31)  # exactly three months before: counted
    rows = [dict(payment_id=f"{c}{i}", customer_id=c, status="Failed", payment_date=edge) for c, n in (("A", 1), ("B", 2), ("C", 3)) for i in range(n)]
    rows += [dict(payment_id=f"D{i}", customer_id="D", status="Failed", payment_date=edge - timedelta(days=1)) for i in range(3)]
    rows.append(dict(payment_id="B9", customer_id="B", status="Completed", payment_date=DAY + timedelta(days=9)))
    got = {r["customer_id"]: r for r in nba.nba_payment(make("payment", *rows), make("next_best_action"), as_of).collect()}
    assert {c: r["confidence"] for c, r in got.items()} == {"B": 0.8, "C": 0.9}
    assert json.loads(got["B"]["evidence"]) == {"failed_payments": 2, "total_payments": 3, "failure_rate": 0.667}


def test_clear_pending_modes(spark, make):
    rows = make("next_best_action", *[dict(action_id=str(s), customer_id="C", status=s) for s in ("PENDING", "SUPPRESSED", "APPROVED", None)])
    assert {r["status"] for r in nba.clear_pending(rows).collect()} == {"APPROVED", None}
    assert {r["status"] for r in nba.clear_pending(rows, "accumulate").collect()} == {"SUPPRESSED", "APPROVED", None}


# --- workflow --------------------------------------------------------------------------------


def test_decide_log_outcome(spark, make, as_of):
    acts = make("next_best_action", *[dict(action_id=a, customer_id="C", action_type="CROSS_SELL", status=s) for a, s in (("a", "PENDING"), ("b", "PENDING"), ("c", "PENDING"), ("d", "REJECTED"))])
    dec = spark.createDataFrame(
        [("a", "APPROVED", "u"), ("b", "MAYBE", "u"), ("c", "REJECTED", "u"), ("d", "APPROVED", "u")],
        "action_id string, decision string, decided_by string",
    )
    new = workflow.decide(acts, dec)
    assert {r["action_id"]: r["status"] for r in new.collect()} == {"a": "APPROVED", "b": "PENDING", "c": "REJECTED", "d": "REJECTED"}
    flipped = dec.withColumn("decision", F.lit("REJECTED"))
    again = {r["action_id"]: r["status"] for r in workflow.decide(new, flipped).collect()}
    assert again["a"] == "APPROVED" and again["b"] == "REJECTED"
    log = workflow.decision_log(acts, dec, as_of)
    assert {r["log_id"] for r in log.collect()} == {"LOG-a-20240131000000", "LOG-c-20240131000000"}
    assert workflow.decision_log(acts, dec, as_of, "always").count() == 3
    out = spark.createDataFrame([(a, "SUCCESSFUL", "n") for a in "abcd"], "action_id string, outcome string, notes string")
    noted = {r["action_id"]: r["outcome"] for r in workflow.record_outcome_log(log, out, as_of).collect()}
    assert noted == {"a": "SUCCESSFUL", "c": None}
    always = workflow.record_outcome_log(log, out, as_of, "always")
    assert {r["outcome"] for r in always.collect()} == {"SUCCESSFUL"}
    second = workflow.record_outcome_log(always, out.withColumn("outcome", F.lit("FAILED")), as_of, "always")
    assert {r["outcome"] for r in second.collect()} == {"SUCCESSFUL"}
    final = {r["action_id"]: r["status"] for r in workflow.record_outcome_actions(new, out).collect()}
    assert final == {"a": "COMPLETED", "b": "PENDING", "c": "REJECTED", "d": "REJECTED"}


def test_first_decision_of_a_batch_counts(spark, make):
    acts = make("next_best_action", dict(action_id="a", customer_id="C", status="PENDING"))
    dec = spark.createDataFrame([("a", "APPROVED", "u", 2), ("a", "REJECTED", "v", 1)], "action_id string, decision string, decided_by string, seq int")
    assert [r["status"] for r in workflow.decide(acts, dec).collect()] == ["REJECTED"]


# --- evidence --------------------------------------------------------------------------------


def evidence_tables(make):
    return {
        "transcript": make("transcript", dict(transcript_id="T", interaction_id="I", customer_id="C", transcript_text="good rival")),
        "email": make("email", dict(email_id="E", customer_id="C", subject=None, body="b")),
        "note": make("note", dict(note_id="N", customer_id="C", note_text="n")),
        "survey": make("survey", *[dict(survey_id=str(n), customer_id="C", survey_type="NPS", nps_score=n, csat_score=3) for n in (6, 7, 8, 9)],
                       dict(survey_id="x", customer_id="C", survey_type="NPS", csat_score=3, comments="z")),
    }


def test_evidence_rules(spark, make, as_of):
    t = evidence_tables(make)
    got = {r["doc_id"]: r for r in evidence.evidence_from_text(t, LEX).collect()}
    assert {d: r["sentiment"] for d, r in got.items() if d.startswith("SRV")} == {
        "SRV-6": "NEGATIVE", "SRV-7": "NEUTRAL", "SRV-8": "NEUTRAL", "SRV-9": "POSITIVE", "SRV-x": "NEUTRAL",
    }
    assert got["SRV-9"]["content"] == "NPS Survey (NPS: 9, CSAT: 3): "
    assert got["SRV-x"]["content"] is None and got["EML-E"]["content"] is None
    assert got["NTE-N"]["moment_type"] == "UNCLASSIFIED"


def test_evidence_joined_wide_or_row(spark, make, as_of):
    t = evidence_tables(make)
    tall = enrich.tall_from_wide(enrich.wide_from_text(t["transcript"], t["email"], LEX), as_of)
    wide = evidence.evidence_source(t, enrich.enrichment_wide(tall))
    assert sorted(map(str, wide.collect())) == sorted(map(str, evidence.evidence_from_text(t, LEX).collect()))
    row = evidence.evidence_source(t, tall)
    assert row.filter(F.col("doc_id") == "TRN-T").count() == 4


def test_search_index_equals_corpus(spark, make, tmp_path):
    corpus = evidence.evidence_from_text(evidence_tables(make), LEX)
    search_log.refresh(spark, str(tmp_path), corpus)
    index = search_log.open_log(spark, str(tmp_path))
    for query in ("good nps", "rival", "absent", "3 nps survey"):
        for flt in (None, evidence.Filters(source_type="SURVEY"), evidence.Filters(customer_id="nobody")):
            a = evidence.search_corpus(corpus, query, 3, flt).collect()
            b = index.search(query, 3, flt)[0].select(a[0].__fields__ if a else ["doc_id"]).collect()
            assert [(r["doc_id"]) for r in a] == [r["doc_id"] for r in b]
            if a:
                assert [r["score"] for r in a] == [r["score"] for r in b]
    with pytest.raises(ValueError):
        evidence.query_terms(" ,. ")


# --- tables ----------------------------------------------------------------------------------


def test_table_round_trip(spark, make, as_of, tmp_path):
    root = str(tmp_path)
    one = spark.createDataFrame([("A1", "C")], "action_id string, customer_id string")
    store.append(one, root, "next_best_action", as_of)
    row = store.load(spark, root, "next_best_action").first()
    assert (row["status"], row["suppressed"], row["created_at"]) == ("PENDING", False, as_of)
    store.append(one.withColumn("status", F.lit("APPROVED")), root, "next_best_action", as_of)
    rows = store.load(spark, root, "next_best_action")
    assert rows.count() == 2
    v1 = store.new_version(rows, f"{root}/v", "next_best_action", as_of, "v1")
    v2 = store.new_version(store.delete_where(rows, F.col("status") == "PENDING"), f"{root}/v", "next_best_action", as_of, "v2")
    assert [r["status"] for r in v2.collect()] == ["APPROVED"]
    changed = store.update_where(v2, F.col("status") == "APPROVED", status=F.lit("COMPLETED"))
    assert changed.first()["status"] == "COMPLETED"
    merged = store.merge_update(v2, spark.createDataFrame([("A1", "X"), ("no", "Y")], "action_id string, status string"), "action_id", ["status"])
    assert [r["status"] for r in merged.collect()] == ["X"]
    # the newest version needs no name, a repeated name is a new version, and a reader keeps what it has opened
    assert store.load(spark, f"{root}/v", "next_best_action").count() == 1 and v1.count() == 2
    again = store.new_version(one.withColumn("status", F.lit("REJECTED")), f"{root}/v", "next_best_action", as_of, "v1")
    assert [r["status"] for r in store.load(spark, f"{root}/v", "next_best_action").collect()] == ["REJECTED"] == [r["status"] for r in again.collect()]
    assert store.load(spark, f"{root}/v", "next_best_action", "v2").count() == 1 and store.load(spark, f"{root}/v", "next_best_action", 0).count() == 2 == v1.count()
    assert [tuple(r) for r in store.changes(spark, f"{root}/v", "next_best_action", "action_id", "v2").collect()] == [("A1", "changed")]
    with pytest.raises(ValueError):
        store.load(spark, f"{root}/v", "next_best_action", "v9")
    store.overwrite(one, root, "next_best_action", as_of)
    assert store.load(spark, root, "next_best_action").count() == 1
    assert store.one_row(spark, a=1, b="x").collect()[0].asDict() == {"a": 1, "b": "x"}
