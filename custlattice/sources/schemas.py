"""One explicit schema per table: nine source tables and six derived ones."""

from pyspark.sql import types as T

_STR, _INT, _DBL = T.StringType(), T.IntegerType(), T.DoubleType()
_DATE, _TS, _BOOL = T.DateType(), T.TimestampNTZType(), T.BooleanType()

ENTITIES = T.StructType(
    [T.StructField(k, T.ArrayType(_STR)) for k in ("competitors", "products", "people")]
)
INTENTS = T.StructType(
    [
        T.StructField(k, _BOOL)
        for k in (
            "cancellation_intent", "payment_issue", "product_request", "complaint",
            "price_sensitivity", "competitor_comparison",
        )
    ]
)


def _table(required, **columns):
    return T.StructType([T.StructField(n, t, n not in required) for n, t in columns.items()])


SCHEMAS = {
    "customer": _table(
        ("customer_id",),
        customer_id=_STR, first_name=_STR, last_name=_STR, email=_STR, phone=_STR,
        date_of_birth=_DATE, gender=_STR, segment=_STR, region=_STR, state=_STR, city=_STR,
        zip_code=_STR, tenure_months=_INT, lifetime_value=_DBL, created_at=_TS, updated_at=_TS,
    ),
    "policy": _table(
        ("policy_id", "customer_id"),
        policy_id=_STR, customer_id=_STR, policy_type=_STR, premium_amount=_DBL,
        start_date=_DATE, end_date=_DATE, status=_STR, coverage_amount=_DBL, deductible=_DBL,
        created_at=_TS,
    ),
    "claim": _table(
        ("claim_id", "customer_id"),
        claim_id=_STR, customer_id=_STR, policy_id=_STR, claim_type=_STR, claim_amount=_DBL,
        status=_STR, filed_date=_DATE, resolved_date=_DATE, resolution_days=_INT,
        description=_STR, created_at=_TS,
    ),
    "payment": _table(
        ("payment_id", "customer_id"),
        payment_id=_STR, customer_id=_STR, policy_id=_STR, amount=_DBL, payment_date=_DATE,
        due_date=_DATE, status=_STR, payment_method=_STR, failure_reason=_STR, created_at=_TS,
    ),
    "interaction": _table(
        ("interaction_id", "customer_id"),
        interaction_id=_STR, customer_id=_STR, channel=_STR, direction=_STR,
        interaction_date=_TS, duration_seconds=_INT, agent_id=_STR, disposition=_STR,
        topic=_STR, created_at=_TS,
    ),
    "transcript": _table(
        ("transcript_id", "interaction_id", "customer_id"),
        transcript_id=_STR, interaction_id=_STR, customer_id=_STR, transcript_text=_STR,
        speaker_labels=T.ArrayType(_STR), created_at=_TS,
    ),
    "email": _table(
        ("email_id", "customer_id"),
        email_id=_STR, interaction_id=_STR, customer_id=_STR, subject=_STR, body=_STR,
        direction=_STR, sent_at=_TS, created_at=_TS,
    ),
    "note": _table(
        ("note_id", "customer_id"),
        note_id=_STR, customer_id=_STR, interaction_id=_STR, agent_id=_STR, note_text=_STR,
        created_at=_TS,
    ),
    "survey": _table(
        ("survey_id", "customer_id"),
        survey_id=_STR, customer_id=_STR, survey_type=_STR, nps_score=_INT, csat_score=_INT,
        comments=_STR, submitted_at=_TS, created_at=_TS,
    ),
    "customer_event": _table(
        ("event_id", "customer_id"),
        event_id=_STR, customer_id=_STR, event_type=_STR, event_timestamp=_TS,
        source_table=_STR, source_id=_STR, event_payload=_STR, created_at=_TS,
    ),
    "customer_moment": _table(
        ("moment_id", "customer_id"),
        moment_id=_STR, customer_id=_STR, moment_type=_STR, detected_at=_TS, confidence=_DBL,
        context=_STR, source_event_id=_STR, expires_at=_TS, created_at=_TS,
    ),
    "customer_health": _table(
        ("customer_id",),
        customer_id=_STR, health_score=_DBL, churn_risk=_DBL, sentiment_score=_DBL,
        claims_score=_DBL, payment_score=_DBL, engagement_score=_DBL, risk_level=_STR,
        scored_at=_TS,
    ),
    "next_best_action": _table(
        ("action_id", "customer_id"),
        action_id=_STR, customer_id=_STR, action_type=_STR, confidence=_DBL, rationale=_STR,
        priority=_INT, status=_STR, suppressed=_BOOL, suppression_reason=_STR, evidence=_STR,
        created_at=_TS, expires_at=_TS,
    ),
    "next_best_action_log": _table(
        ("log_id", "action_id", "customer_id"),
        log_id=_STR, action_id=_STR, customer_id=_STR, action_type=_STR, decision=_STR,
        decided_by=_STR, decided_at=_TS, outcome=_STR, outcome_date=_TS, notes=_STR,
        created_at=_TS,
    ),
    "customer_ai_enrichment": _table(
        ("enrichment_id", "customer_id"),
        enrichment_id=_STR, customer_id=_STR, source_table=_STR, source_id=_STR,
        sentiment_score=_DBL, sentiment_label=_STR, entities=ENTITIES, intents=INTENTS,
        classification=_STR, summary=_STR, enriched_at=_TS,
    ),
}

SOURCE_TABLES = (
    "customer", "policy", "claim", "payment", "interaction", "transcript", "email", "note",
    "survey",
)

KEYS = {
    "customer": "customer_id", "policy": "policy_id", "claim": "claim_id",
    "payment": "payment_id", "interaction": "interaction_id", "transcript": "transcript_id",
    "email": "email_id", "note": "note_id", "survey": "survey_id",
    "customer_event": "event_id", "customer_moment": "moment_id",
    "customer_health": "customer_id", "next_best_action": "action_id",
    "next_best_action_log": "log_id", "customer_ai_enrichment": "enrichment_id",
}
