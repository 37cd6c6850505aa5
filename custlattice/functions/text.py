"""Token-lexicon text scoring as column expressions.

A document is tokenised once and reduced to the few tokens the lexicon knows (``hits``); every
score, entity and intent is then computed from that short array, so the text itself is scanned a
single time inside the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custlattice.vocab import ENTITY_KINDS, INTENTS

TOKEN_SPLIT = "[^a-z0-9]+"


@dataclass(frozen=True)
class Lexicon:
    """Term lists of any length. A lexicon is configuration, and compiled into the plan as hash sets."""

    positive: tuple[str, ...]
    negative: tuple[str, ...]
    entities: dict[str, tuple[str, ...]] = field(hash=False)
    intents: dict[str, tuple[str, ...]] = field(hash=False)

    def __post_init__(self):
        unknown = (set(self.entities) - set(ENTITY_KINDS)) | (set(self.intents) - set(INTENTS))
        if unknown:
            raise ValueError(f"unknown entity or intent names: {sorted(unknown)}")

    def terms(self) -> list[str]:
        lists = [self.positive, self.negative, *self.entities.values(), *self.intents.values()]
        return sorted({t for terms in lists for t in terms})

    @classmethod
    def from_table(cls, terms: DataFrame) -> Lexicon:
        """Read a (list, term) table; list names are positive, negative, an entity or an intent."""
        rows = terms.select("list", "term").distinct().collect()

        def of(name):
            return tuple(sorted(r["term"] for r in rows if r["list"] == name))

        return cls(
            of("positive"), of("negative"), {k: of(k) for k in ENTITY_KINDS},
            {k: of(k) for k in INTENTS},
        )


# Plain-English insurance words; pass another Lexicon for other data.
INSURANCE = Lexicon(
    positive=("thank", "thanks", "great", "excellent", "happy", "helpful", "appreciate", "smooth"),
    negative=(
        "frustrated", "terrible", "disappointed", "unacceptable", "ridiculous", "angry", "denied",
        "worst",
    ),
    entities={
        "competitors": ("geico", "progressive", "allstate", "usaa", "lemonade", "nationwide"),
        "products": ("auto", "home", "life", "umbrella", "renters", "travel", "pet"),
        "people": (),
    },
    intents={
        "cancellation_intent": ("cancel", "cancellation", "switch", "switching"),
        "payment_issue": ("declined", "autopay", "refund", "overdraft"),
        "product_request": ("adding", "quote", "bundle", "bundling"),
        "complaint": ("complain", "complaint", "dissatisfaction", "frustrated"),
        "price_sensitivity": ("cheaper", "expensive", "premium", "rates"),
        "competitor_comparison": (
            "geico", "progressive", "allstate", "usaa", "lemonade", "nationwide",
        ),
    },
)


def tokens(text: Column) -> Column:
    return F.split(F.lower(text), TOKEN_SPLIT)


def _words(terms) -> Column:
    return F.array(*[F.lit(t) for t in terms]).cast("array<string>")


def _known_tokens(text: Column, terms) -> Column:
    return F.filter(tokens(text), lambda t: t.isin(list(terms)))


def _score(hits: Column, lexicon: Lexicon) -> Column:
    """Both lists are counted with repetitions; a word on both counts on both sides."""
    good = F.size(F.filter(hits, lambda t: t.isin(list(lexicon.positive))))
    bad = F.size(F.filter(hits, lambda t: t.isin(list(lexicon.negative))))
    score = (good - bad).cast("double") / F.nullif(good + bad, F.lit(0))
    return F.when(hits.isNotNull(), F.coalesce(F.round(score, 6), F.lit(0.0)))


def sentiment_label(score: Column) -> Column:
    """Bands of the score; both ends belong to the outer bands."""
    return (
        F.when(score >= 0.3, "POSITIVE")
        .when(score <= -0.3, "NEGATIVE")
        .when(score.isNotNull(), "NEUTRAL")
    )


def _entities(hits: Column, lexicon: Lexicon) -> Column:
    lists = [
        F.sort_array(F.array_intersect(hits, _words(lexicon.entities.get(k, ())))).alias(k)
        for k in ENTITY_KINDS
    ]
    return F.when(hits.isNotNull(), F.struct(*lists))


def _intents(hits: Column, lexicon: Lexicon) -> Column:
    flags = [F.arrays_overlap(hits, _words(lexicon.intents.get(k, ()))).alias(k) for k in INTENTS]
    return F.when(hits.isNotNull(), F.struct(*flags))


# One class per document, the first intent that is set wins.
CLASS_BY_INTENT = (
    ("cancellation_intent", "CHURN"),
    ("complaint", "CLAIM_FRICTION"),
    ("price_sensitivity", "PRICE_SENSITIVITY"),
    ("payment_issue", "PAYMENT_ISSUE"),
    ("product_request", "CROSS_SELL_OPPORTUNITY"),
)


def classification(intents: Column, score: Column) -> Column:
    label = F.when(intents.isNull(), F.lit(None).cast("string"))
    for intent, name in CLASS_BY_INTENT:
        label = label.when(intents[intent], name)
    return label.when(score >= 0.3, "POSITIVE_ENGAGEMENT").otherwise("GENERAL_INQUIRY")


def with_signals(
    docs: DataFrame, text: Column, lexicon: Lexicon, intent_text: Column | None = None
) -> DataFrame:
    """Add sentiment_score, sentiment_label, entities, intents and classification.

    ``intent_text`` replaces ``text`` for the intents only (e-mails: subject and body). Columns
    that a consumer does not select are pruned again.
    """
    known = lexicon.terms()
    out = docs.withColumn("_hits", _known_tokens(text, known))
    intent_hits = F.col("_hits")
    if intent_text is not None:
        out = out.withColumn("_intent_hits", _known_tokens(intent_text, known))
        intent_hits = F.col("_intent_hits")
    return (
        out.withColumn("sentiment_score", _score(F.col("_hits"), lexicon))
        .withColumn("sentiment_label", sentiment_label(F.col("sentiment_score")))
        .withColumn("entities", _entities(F.col("_hits"), lexicon))
        .withColumn("intents", _intents(intent_hits, lexicon))
        .withColumn("classification", classification(F.col("intents"), F.col("sentiment_score")))
        .drop("_hits", "_intent_hits")
    )
