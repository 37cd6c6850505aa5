"""Text enrichment into the sparse enrichment table, and its collapsed forms.

Each enricher takes the sources that still lack its column, scores their text and returns rows
that fill only that column. ``wide_from_text`` produces the same facts in one pass over the text,
one row per document, for pipelines that start from the raw text.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custlattice import vocab
from custlattice.functions.text import Lexicon, sentiment_label, with_signals
from custlattice.functions.values import fixed_units, mean_exact, one_decimal, ts_lit
from custlattice.operators.grouping import positions
from custlattice.sources.schemas import SCHEMAS

ENRICHMENT = SCHEMAS["customer_ai_enrichment"]


@dataclass(frozen=True)
class TextSource:
    """Where a kind of document keeps its id and text, and the prefixes of its enrichment ids."""

    table: str
    id_column: str
    text: str
    intent_text: str | None
    sentiment_prefix: str
    intent_prefix: str


TRANSCRIPT = TextSource("TRANSCRIPT", "transcript_id", "transcript_text", None, "ENR-T-", "ENR-INT-")
EMAIL = TextSource(
    "EMAIL", "email_id", "body", "concat(subject, '\\n', body)", "ENR-E-", "ENR-INT-E-"
)
ENTITY_PREFIX, CLASS_PREFIX, SUMMARY_PREFIX = "ENR-ENT-", "ENR-CLS-", "ENR-SUM-"


def unprocessed(
    source: DataFrame, id_column: str, enrichment: DataFrame | None, source_table: str,
    column: str, batch: int | None = None,
) -> DataFrame:
    """Sources with no value in ``column`` yet. ``batch`` bounds one run, lowest ids first.

    A left anti join on non-NULL ids: unlike ``NOT IN`` it needs no broadcast, and one NULL id in
    the enrichment table does not suppress every source. The anti join sees ids only; the texts
    meet the ids that are left in a semi join, which Spark broadcasts when few are left, so an
    incremental run does not shuffle the texts.
    """
    if enrichment is None and batch is None:
        return source
    todo = source.select(id_column).distinct()
    if enrichment is not None:
        done = enrichment.filter(
            (F.col("source_table") == source_table)
            & F.col(column).isNotNull()
            & F.col("source_id").isNotNull()
        ).select(F.col("source_id").alias(id_column))
        todo = todo.join(done, id_column, "left_anti")
    if batch is not None:
        todo = todo.orderBy(id_column).limit(batch)
    return source.join(todo, id_column, "left_semi")


def _rows(df: DataFrame, prefix: str, id_column: str, source_table: str, as_of: datetime, filled) -> DataFrame:
    """Sparse enrichment rows: the named columns are filled, the others NULL."""
    values = {
        "enrichment_id": F.concat(F.lit(prefix), F.col(id_column)),
        "customer_id": F.col("customer_id"),
        "source_table": F.lit(source_table),
        "source_id": F.col(id_column),
        "enriched_at": ts_lit(as_of),
        **{c: F.col(c) for c in filled},
    }
    return df.select(
        *[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in ENRICHMENT.fields]
    )


def scored(source: DataFrame, kind: TextSource, lexicon: Lexicon) -> DataFrame:
    intent_text = F.expr(kind.intent_text) if kind.intent_text else None
    return with_signals(source, F.col(kind.text), lexicon, intent_text)


def enrich_sentiment(source, kind: TextSource, lexicon, as_of, done=None, batch=None) -> DataFrame:
    todo = unprocessed(source, kind.id_column, done, kind.table, "sentiment_score", batch)
    filled = ("sentiment_score", "sentiment_label")
    return _rows(scored(todo, kind, lexicon), kind.sentiment_prefix, kind.id_column, kind.table, as_of, filled)


def enrich_entities(transcript, lexicon, as_of, done=None, batch=None) -> DataFrame:
    kind = TRANSCRIPT
    todo = unprocessed(transcript, kind.id_column, done, kind.table, "entities", batch)
    return _rows(scored(todo, kind, lexicon), ENTITY_PREFIX, kind.id_column, kind.table, as_of, ("entities",))


def enrich_intents(source, kind: TextSource, lexicon, as_of, done=None, batch=None) -> DataFrame:
    todo = unprocessed(source, kind.id_column, done, kind.table, "intents", batch)
    return _rows(scored(todo, kind, lexicon), kind.intent_prefix, kind.id_column, kind.table, as_of, ("intents",))


def enrich_classification(transcript, lexicon, as_of, done=None, batch=None) -> DataFrame:
    kind = TRANSCRIPT
    todo = unprocessed(transcript, kind.id_column, done, kind.table, "classification", batch)
    labelled = scored(todo, kind, lexicon).withColumn("classification", F.trim("classification"))
    return _rows(labelled, CLASS_PREFIX, kind.id_column, kind.table, as_of, ("classification",))


def entities_from_json(reply: Column) -> Column:
    """Parse an external model's JSON reply; NULL, not a struct of NULLs, when it is no JSON."""
    parsed = F.from_json(reply, SCHEMAS["customer_ai_enrichment"]["entities"].dataType)
    return F.when(F.try_parse_json(reply).isNotNull(), parsed)


def intents_from_json(reply: Column) -> Column:
    parsed = F.from_json(reply, SCHEMAS["customer_ai_enrichment"]["intents"].dataType)
    return F.when(F.try_parse_json(reply).isNotNull(), parsed)


def enrich_sentiment_with_model(source, kind: TextSource, model, as_of, done=None, batch=None) -> DataFrame:
    """Sentiment by any Python scorer: ``model`` maps a pandas Series of texts to scores.

    The model runs once per Arrow batch on the executors; only id, customer and text are shipped.
    """
    todo = unprocessed(source, kind.id_column, done, kind.table, "sentiment_score", batch)
    narrow = todo.select(kind.id_column, "customer_id", F.col(kind.text).alias("text"))

    def score(batches):
        for pdf in batches:
            yield pd.DataFrame(
                {
                    kind.id_column: pdf[kind.id_column],
                    "customer_id": pdf["customer_id"],
                    "sentiment_score": model(pdf["text"]),
                }
            )

    schema = f"{kind.id_column} string, customer_id string, sentiment_score double"
    scored = narrow.mapInPandas(score, schema).withColumn(
        "sentiment_label", sentiment_label(F.col("sentiment_score"))
    )
    filled = ("sentiment_score", "sentiment_label")
    return _rows(scored, kind.sentiment_prefix, kind.id_column, kind.table, as_of, filled)


# --- one pass over the text ------------------------------------------------------------------

def wide_from_source(source: DataFrame, kind: TextSource, lexicon: Lexicon) -> DataFrame:
    """All signals of one kind of document."""
    is_transcript = kind is TRANSCRIPT
    key = F.col(kind.id_column)
    nothing = F.lit(None).cast("string")
    return scored(source, kind, lexicon).select(
        F.lit(kind.table).alias("source_table"),
        key.alias("source_id"),
        "customer_id",
        "sentiment_score",
        F.col("sentiment_score").alias("sentiment_sum"),
        F.when(F.col("sentiment_score").isNotNull(), F.lit(1)).otherwise(0).cast("bigint").alias("sentiment_rows"),
        "sentiment_label",
        (F.col("entities") if is_transcript else F.lit(None).cast(ENRICHMENT["entities"].dataType)).alias("entities"),
        "intents",
        (F.col("classification") if is_transcript else nothing).alias("classification"),
        (F.concat(F.lit(ENTITY_PREFIX), key) if is_transcript else nothing).alias("entities_row"),
        F.concat(F.lit(kind.intent_prefix), key).alias("intents_row"),
    )


def wide_from_text(transcript: DataFrame, email: DataFrame, lexicon: Lexicon) -> DataFrame:
    """All signals of a document on one row, straight from the text: no shuffle."""
    return wide_from_source(transcript, TRANSCRIPT, lexicon).unionByName(
        wide_from_source(email, EMAIL, lexicon)
    )


def tall_from_wide(wide: DataFrame, as_of: datetime) -> DataFrame:
    """The sparse rows the single enrichers would write, without reading the text again."""
    is_transcript = F.col("source_table") == "TRANSCRIPT"
    sentiment_id = F.concat(
        F.when(is_transcript, TRANSCRIPT.sentiment_prefix).otherwise(EMAIL.sentiment_prefix), "source_id"
    )

    def row(enrichment_id: Column, *filled):
        parts = {"enrichment_id": enrichment_id, "enriched_at": ts_lit(as_of)}
        keep = ("customer_id", "source_table", "source_id", *filled)
        return F.struct(
            *[
                parts.get(f.name, F.col(f.name) if f.name in keep else F.lit(None))
                .cast(f.dataType)
                .alias(f.name)
                for f in ENRICHMENT.fields
            ]
        )

    both = [
        row(sentiment_id, "sentiment_score", "sentiment_label"),
        row(F.col("intents_row"), "intents"),
    ]
    transcript_only = [
        row(F.col("entities_row"), "entities"),
        row(F.concat(F.lit(CLASS_PREFIX), F.col("source_id")), "classification"),
    ]
    rows = F.when(is_transcript, F.array(*both, *transcript_only)).otherwise(F.array(*both))
    return wide.select(F.inline(rows))


def enrichment_wide(enrichment: DataFrame) -> DataFrame:
    """Collapse the sparse rows to one row per source document."""
    docs = enrichment.filter(F.col("source_table").isin("TRANSCRIPT", "EMAIL"))
    entities_row = F.when(F.col("entities").isNotNull(), F.col("enrichment_id"))
    intents_row = F.when(F.col("intents").isNotNull(), F.col("enrichment_id"))
    return docs.groupBy("source_table", "source_id").agg(
        F.min("customer_id").alias("customer_id"),
        F.min("sentiment_score").alias("sentiment_score"),
        F.sum("sentiment_score").alias("sentiment_sum"),
        F.count("sentiment_score").alias("sentiment_rows"),
        F.min("sentiment_label").alias("sentiment_label"),
        F.min_by("entities", entities_row).alias("entities"),
        F.min_by("intents", intents_row).alias("intents"),
        F.min("classification").alias("classification"),
        F.min(entities_row).alias("entities_row"),
        F.min(intents_row).alias("intents_row"),
    )


def customer_signals(wide: DataFrame) -> DataFrame:
    """Everything the moment, health and action rules need from the texts: one row per customer.

    A single partial-then-final aggregation, so a customer with a third of all texts is reduced
    before the shuffle. ``competitor`` is the first entity row that names a competitor, ``cancel``
    the most negative document with a cancellation intent, ``price_row`` the first row with a
    price intent.
    """
    intents = F.col("intents")
    names = F.col("entities.competitors")
    wants_out = (F.col("sentiment_score") < -0.3) & intents["cancellation_intent"]
    # avg over all sentiment rows, in integer micro-units so that row order cannot matter
    micro = fixed_units(F.col("sentiment_sum"), 6)
    rows = F.sum("sentiment_rows")
    return wide.groupBy("customer_id").agg(
        F.round(F.sum(micro).cast("double") / 1_000_000.0 / F.nullif(rows, F.lit(0)), 12).alias("avg_sentiment"),
        rows.alias("sentiment_count"),
        F.min(
            F.when(F.array_size(names) > 0, F.struct(F.col("entities_row").alias("row_id"), names.alias("names")))
        ).alias("competitor"),
        F.min(
            F.when(wants_out, F.struct(F.col("sentiment_score").alias("score"), F.col("intents_row").alias("row_id")))
        ).alias("cancel"),
        F.min(F.when(intents["price_sensitivity"], F.col("intents_row"))).alias("price_row"),
        *[F.count_if(intents[i]).alias(f"n_{i}") for i in vocab.INTENTS],
    )


# --- customer digest and summary -------------------------------------------------------------


def text_lines(transcript: DataFrame, email: DataFrame, note: DataFrame) -> DataFrame:
    """One line per document: kind and the first 200 characters (the digest's line format)."""
    mail = F.concat("subject", F.lit(": "), "body")
    parts = [
        transcript.select(
            "customer_id", F.lit("Transcript").alias("kind"), F.col("transcript_id").alias("doc_id"),
            F.col("created_at").alias("written_at"), F.col("transcript_text").alias("content"),
        ),
        email.select(
            "customer_id", F.lit("Email").alias("kind"), F.col("email_id").alias("doc_id"),
            F.col("sent_at").alias("written_at"), mail.alias("content"),
        ),
        note.select(
            "customer_id", F.lit("Note").alias("kind"), F.col("note_id").alias("doc_id"),
            F.col("created_at").alias("written_at"), F.col("note_text").alias("content"),
        ),
    ]
    lines = reduce(DataFrame.unionByName, parts)
    line = F.concat(F.lit("- ["), "kind", F.lit("] "), F.left("content", F.lit(200)))
    return lines.withColumn("line", line).drop("content")


def _fold_lines(lines: DataFrame, *keys) -> DataFrame:
    """Concatenate the lines of each group, newest first; NULL lines drop out."""
    item = F.struct("written_at", "doc_id", "line")
    ordered = F.reverse(F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), item))))
    return lines.groupBy(*keys).agg(
        F.count("line").alias("n_lines"),
        F.min("written_at").alias("oldest"),
        F.max("written_at").alias("newest"),
        F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("digest"),
    )


def customer_digest(
    transcript: DataFrame, email: DataFrame, note: DataFrame, max_lines: int = 10_000
) -> DataFrame:
    """Per customer, the digest lines joined newest first, in parts of ``max_lines`` documents.

    Part n holds the documents at positions n * ``max_lines`` to (n + 1) * ``max_lines`` - 1 of the
    customer, newest first and by descending document id within a moment. Read in order of ``part``, the
    parts are the whole digest; the rule is the same for every customer, and no task holds more than a part.
    """
    lines = text_lines(transcript, email, note)
    numbered = positions(
        lines, "customer_id", F.col("written_at").cast("date"),
        F.col("written_at").desc_nulls_last(), F.col("doc_id").desc(), first_bucket=F.col("_bucket").desc_nulls_last(),
    )
    part = F.floor(F.col("_at") / max_lines).cast("bigint")
    # explicit exchange: the partitioning by customer and day that the numbering leaves is not enough
    dealt = numbered.withColumn("part", part).drop("_at").repartition("customer_id", "part")
    return _fold_lines(dealt, "customer_id", "part").select("customer_id", "part", "n_lines", "oldest", "newest", "digest")


def customer_summary(
    customer: DataFrame, transcript: DataFrame, email: DataFrame, note: DataFrame,
    signals: DataFrame, as_of: datetime, done: DataFrame | None = None, batch: int | None = None,
) -> DataFrame:
    """Extractive summary: text counts, average sentiment, intents, newest line.

    Built from bounded aggregates only, never from the full digest.
    """
    lines = text_lines(transcript, email, note)
    newest = F.struct("written_at", F.col("doc_id"))
    stats = lines.groupBy("customer_id").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("Transcript", "Email", "Note")],
        F.max_by("line", F.when(F.col("line").isNotNull(), newest)).alias("latest"),
    )
    todo = unprocessed(customer.select("customer_id"), "customer_id", done, "CUSTOMER", "summary", batch)
    flags = F.array_compact(
        F.array(*[F.when(F.col(f"n_{i}") > 0, F.concat(F.lit(i + " "), F.col(f"n_{i}").cast("string"))) for i in vocab.INTENTS])
    )
    text = F.concat(
        F.col("n_Transcript").cast("string"), F.lit(" transcripts, "),
        F.col("n_Email").cast("string"), F.lit(" e-mails, "),
        F.col("n_Note").cast("string"), F.lit(" notes. Average sentiment: "),
        F.coalesce(one_decimal(F.col("avg_sentiment") * 100), F.lit("none")),
        F.lit(". Intents: "),
        F.coalesce(F.nullif(F.array_join(flags, ", "), F.lit("")), F.lit("none")),
        F.lit(". Latest: "), F.coalesce("latest", F.lit("none")),
    )
    joined = todo.join(stats, "customer_id", "left").join(signals, "customer_id", "left")
    with_text = joined.withColumn("summary", F.coalesce(text, F.lit(vocab.NO_INTERACTIONS)))
    return _rows(with_text, SUMMARY_PREFIX, "customer_id", "CUSTOMER", as_of, ("summary",))


def _incomplete(source: DataFrame, kind: TextSource, done: DataFrame) -> DataFrame:
    """Documents that lack a row of some enricher. Only ids are compared; texts stay where they are."""
    wanted = ("sentiment_score", "intents", *(("entities", "classification") if kind is TRANSCRIPT else ()))
    own = done.filter((F.col("source_table") == kind.table) & F.col("source_id").isNotNull())
    has = own.groupBy("source_id").agg(*[F.max(F.col(c).isNotNull()).alias(f"_{c}") for c in wanted])
    complete = has.filter(reduce(lambda x, y: x & y, [F.col(f"_{c}") for c in wanted]))
    return source.join(complete.select(F.col("source_id").alias(kind.id_column)), kind.id_column, "left_anti")


def new_rows(tables: dict[str, DataFrame], lexicon: Lexicon, as_of: datetime, done: DataFrame) -> DataFrame:
    """The text enrichers' rows that ``done`` lacks; documents that have all of theirs are not scored again."""
    todo = [(tables["transcript"], TRANSCRIPT), (tables["email"], EMAIL)]
    wide = reduce(DataFrame.unionByName, [wide_from_source(_incomplete(t, k, done), k, lexicon) for t, k in todo])
    return tall_from_wide(wide, as_of).join(done.select("enrichment_id"), "enrichment_id", "left_anti")


def run_enrichment(
    tables: dict[str, DataFrame], lexicon: Lexicon, as_of: datetime, done: DataFrame | None = None
) -> DataFrame:
    """All enrichers over everything unprocessed: tall rows plus summaries, to be appended to ``done``.

    ``done`` is the enrichment table of earlier runs; no id of it comes again. Summaries are written for
    customers that have none, from the signals of all rows, old and new.
    """
    if done is None:
        wide = wide_from_text(tables["transcript"], tables["email"], lexicon)
        fresh, signals = tall_from_wide(wide, as_of), customer_signals(wide)
    else:
        fresh = new_rows(tables, lexicon, as_of, done)
        signals = customer_signals(enrichment_wide(done.select(fresh.columns).unionByName(fresh)))
    summaries = customer_summary(
        tables["customer"], tables["transcript"], tables["email"], tables["note"], signals, as_of, done
    )
    return fresh.unionByName(summaries)


def mean_sentiment(enrichment: DataFrame) -> DataFrame:
    """Average and number of all sentiment rows per customer, from the sparse table."""
    rows = enrichment.filter(F.col("sentiment_score").isNotNull())
    return rows.groupBy("customer_id").agg(
        F.round(mean_exact(F.col("sentiment_score"), 6), 12).alias("avg_sentiment"),
        F.count("*").alias("sentiment_count"),
    )
