"""Health component scores, churn risk and risk level as column functions.

A component is NULL when its inputs are, and only then takes its default: a customer whose claims
are all unresolved has no average resolution and therefore gets the default claims score.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from custlattice.functions.values import clamp, round_exact, strict_least

# Fixed values: (upper bound in days since last contact, score)
ENGAGEMENT_STEPS = ((7, 95.0), (30, 80.0), (90, 60.0), (180, 40.0))
ENGAGEMENT_FLOOR = 20.0
# Component weights of the composite, churn enters as 100 * (1 - churn)
WEIGHTS = {"sentiment": 0.25, "claims": 0.20, "payment": 0.20, "engagement": 0.15, "churn": 0.20}
# Contribution of each churn signal
CHURN_PARTS = {"moment": "0.40", "sentiment": "0.20", "payment": "0.15", "claims": "0.15", "silence": "0.10"}
# Lower churn bound of each risk level
RISK_STEPS = (("0.70", "CRITICAL"), ("0.40", "AT_RISK"), ("0.20", "MONITOR"))


def score_sentiment(avg_sentiment: Column) -> Column:
    return F.coalesce(clamp(avg_sentiment * 50 + 50, 0.0, 100.0), F.lit(50.0))


def score_claims(open_claims: Column, denied_claims: Column, avg_resolution: Column) -> Column:
    penalty = open_claims * 15 + denied_claims * 10 + strict_least(avg_resolution, F.lit(60.0)) * 0.5
    return F.coalesce(clamp(F.lit(100.0) - penalty, 0.0, 100.0), F.lit(80.0))


def score_payment(failure_rate: Column) -> Column:
    return F.coalesce(clamp(F.lit(100.0) - failure_rate * 200, 0.0, 100.0), F.lit(90.0))


def score_engagement(days_since_last: Column) -> Column:
    score = F.when(F.lit(False), F.lit(0.0))
    for days, points in ENGAGEMENT_STEPS:
        score = score.when(days_since_last <= days, F.lit(points))
    return score.otherwise(F.lit(ENGAGEMENT_FLOOR))


def churn_risk(
    churn_moments: Column, avg_sentiment: Column, failure_rate: Column, open_claims: Column,
    days_since_last: Column,
) -> Column:
    """Exact decimal sum of the signals that are present, at most 1."""
    signals = {
        "moment": churn_moments > 0,
        "sentiment": avg_sentiment < -0.3,
        "payment": failure_rate > 0.2,
        "claims": open_claims > 2,
        "silence": days_since_last > 90,
    }
    zero = F.lit("0.00").cast("decimal(3,2)")
    total = zero
    for name, present in signals.items():
        total = total + F.when(present, F.lit(CHURN_PARTS[name]).cast("decimal(3,2)")).otherwise(zero)
    return F.least(F.lit("1.00").cast("decimal(3,2)"), total.cast("decimal(3,2)"))


def risk_level(churn: Column) -> Column:
    exact = F.round(churn.cast("decimal(18,6)"), 4)
    level = F.when(F.lit(False), F.lit(""))
    for bound, name in RISK_STEPS:
        level = level.when(exact >= F.lit(bound).cast("decimal(3,2)"), name)
    return level.otherwise("HEALTHY")


def health_score(sentiment: Column, claims: Column, payment: Column, engagement: Column, churn: Column) -> Column:
    composite = (
        sentiment * WEIGHTS["sentiment"]
        + claims * WEIGHTS["claims"]
        + payment * WEIGHTS["payment"]
        + engagement * WEIGHTS["engagement"]
        + (F.lit(1.0) - churn.cast("double")) * 100 * WEIGHTS["churn"]
    )
    return round_exact(composite, 2)
