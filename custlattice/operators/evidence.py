"""Evidence corpus over transcripts, e-mails, notes and surveys, and ranked search (BM25).

Ranking reads postings -- (term, doc_id, tf) with the document attributes used for filtering. ``search_log`` keeps them as an index on
storage, for a corpus that is asked more than once; ``search_corpus`` ranks without an index.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from custlattice.functions.text import TOKEN_SPLIT, Lexicon, tokens
from custlattice.functions.values import date_lit
from custlattice.operators.enrich import EMAIL, TRANSCRIPT, scored
from custlattice.operators.grouping import join_hot, top_per_key
from custlattice.sources.tables import scratch_dir

K1, B = 1.2, 0.75
CORPUS = ("doc_id", "customer_id", "source_type", "content", "sentiment", "moment_type", "event_date")
ATTRIBUTES = ("customer_id", "source_type", "sentiment", "moment_type", "event_date")


def _branch(df, prefix, key, kind, content, at, sentiment=None, moment=None) -> DataFrame:
    unknown, none = F.lit("UNKNOWN"), F.lit("UNCLASSIFIED")
    return df.select(
        F.concat(F.lit(prefix), F.col(key)).alias("doc_id"),
        "customer_id",
        F.lit(kind).alias("source_type"),
        content.alias("content"),
        (unknown if sentiment is None else F.coalesce(sentiment, unknown)).alias("sentiment"),
        (none if moment is None else F.coalesce(moment, none)).alias("moment_type"),
        F.col(at).alias("event_date"),
    )


def _fixed_branches(note: DataFrame, survey: DataFrame) -> list[DataFrame]:
    nps = F.col("nps_score")
    mood = F.when(nps >= 9, "POSITIVE").when(nps <= 6, "NEGATIVE").otherwise("NEUTRAL")
    # The wording of a survey's evidence line; NULL scores make it NULL
    line = F.concat(
        F.col("survey_type"), F.lit(" Survey (NPS: "), nps.cast("string"), F.lit(", CSAT: "),
        F.col("csat_score").cast("string"), F.lit("): "), F.coalesce("comments", F.lit("")),
    )
    return [
        _branch(note, "NTE-", "note_id", "NOTE", F.col("note_text"), "created_at"),
        _branch(survey, "SRV-", "survey_id", "SURVEY", line, "submitted_at", mood),
    ]


def evidence_source(tables: dict[str, DataFrame], labels: DataFrame) -> DataFrame:
    """The corpus with labels from an enrichment table.

    ``labels`` is ``enrichment_wide`` output (one corpus row per document) or the sparse table
    itself (a document repeats once per enrichment row, each copy with that row's labels).
    With text tables and labels in buckets by document id (``sources.layout``) the join is local.
    """

    def labelled(table, key, kind):
        own = labels.filter(F.col("source_table") == kind).select(
            F.col("source_id").alias(key), "sentiment_label", "classification"
        )
        return tables[table].join(own, key, "left")

    mail = F.concat("subject", F.lit(": "), "body")
    parts = [
        _branch(
            labelled("transcript", "transcript_id", "TRANSCRIPT"), "TRN-", "transcript_id", "TRANSCRIPT",
            F.col("transcript_text"), "created_at", F.col("sentiment_label"), F.col("classification"),
        ),
        _branch(
            labelled("email", "email_id", "EMAIL"), "EML-", "email_id", "EMAIL", mail, "sent_at",
            F.col("sentiment_label"), F.col("classification"),
        ),
        *_fixed_branches(tables["note"], tables["survey"]),
    ]
    return reduce(DataFrame.unionByName, parts)


def evidence_from_text(tables: dict[str, DataFrame], lexicon: Lexicon) -> DataFrame:
    """The same corpus with labels scored in place: the text is read once and never shuffled."""
    mail = F.concat("subject", F.lit(": "), "body")
    parts = [
        _branch(
            scored(tables["transcript"], TRANSCRIPT, lexicon), "TRN-", "transcript_id", "TRANSCRIPT",
            F.col("transcript_text"), "created_at", F.col("sentiment_label"), F.col("classification"),
        ),
        _branch(
            scored(tables["email"], EMAIL, lexicon), "EML-", "email_id", "EMAIL", mail, "sent_at",
            F.col("sentiment_label"),
        ),
        *_fixed_branches(tables["note"], tables["survey"]),
    ]
    return reduce(DataFrame.unionByName, parts)


@dataclass(frozen=True)
class Filters:
    """Metadata filters; None means any. Dates are inclusive calendar days."""

    customer_id: str | None = None
    sentiment: str | None = None
    moment_type: str | None = None
    source_type: str | None = None
    since: datetime | None = None
    until: datetime | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        for name in ("customer_id", "sentiment", "moment_type", "source_type"):
            value = getattr(self, name)
            if value is not None:
                df = df.filter(F.col(name) == F.lit(value))
        day = F.col("event_date").cast("date")
        if self.since is not None:
            df = df.filter(day >= date_lit(self.since))
        if self.until is not None:
            df = df.filter(day <= date_lit(self.until))
        return df


def query_terms(query: str) -> list[str]:
    terms = sorted({t for t in re.split(TOKEN_SPLIT, query.lower()) if t})
    if not terms:
        raise ValueError("a query needs at least one term")
    return terms


# --- index -----------------------------------------------------------------------------------


def doc_lengths(corpus: DataFrame) -> DataFrame:
    """One narrow row per document: attributes and number of tokens."""
    words = F.size(F.filter(tokens(F.col("content")), lambda t: t != ""))
    return corpus.select("doc_id", *ATTRIBUTES, F.coalesce(words, F.lit(0)).alias("dl"))


def _folded(words: Column) -> Column:
    """Distinct words of an array with their counts: the sorted words' runs."""

    def runs(w: Column) -> Column:
        # 0-based; before the first word lies NULL, and so does the only place of an empty array
        starts = F.filter(
            F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0))),
            lambda i: ~F.get(w, i).eqNullSafe(F.get(w, i - 1)),
        )

        def counted(at: Column) -> Column:
            def one(i: Column, n: Column) -> Column:
                ends = F.coalesce(F.get(at, n + 1), F.size(w))
                return F.struct(F.get(w, i).alias("term"), (ends - i).cast("bigint").alias("tf"))

            return F.transform(at, one)

        # binding through a one-element array, so that neither the sort nor the starts are computed again per word
        return F.get(F.transform(F.array(starts), counted), F.lit(0))

    return F.get(F.transform(F.array(F.sort_array(words)), runs), F.lit(0))


def postings(corpus: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """(term, doc_id, tf) with the document's length and attributes carried along, of all words or of ``terms``.

    All words of a document lie in one row and are counted there: nothing is shuffled.
    """
    words = corpus.withColumn("_words", F.filter(tokens(F.col("content")), lambda t: t != ""))
    wanted = F.col("_words") if terms is None else F.filter("_words", lambda t: t.isin(terms))
    each = words.select("doc_id", *ATTRIBUTES, F.size("_words").alias("dl"), F.explode(_folded(wanted)).alias("_p"))
    return each.select(F.col("_p.term").alias("term"), "doc_id", F.col("_p.tf").alias("tf"), "dl", *ATTRIBUTES)


@dataclass(frozen=True)
class EvidenceIndex:
    postings: DataFrame  # term, doc_id, tf, attributes
    documents: DataFrame  # doc_id, attributes, dl


def build_index(corpus: DataFrame) -> EvidenceIndex:
    return EvidenceIndex(postings(corpus), doc_lengths(corpus))


def _idf(n_docs: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n_docs - df + 0.5) / (df + 0.5))


def _gain(tf: Column, dl: Column, avg_dl: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avg_dl))


def _kept(df: DataFrame) -> DataFrame:
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def search_index(
    index: EvidenceIndex, query: str, k: int = 5, filters: Filters | None = None
) -> DataFrame:
    """Top ``k`` (doc_id, score, attributes) from the postings of the query's terms.

    Collection statistics cover the filtered documents. Postings carry their document's length, so
    ranking joins nothing but the document frequency of each query term; ties go to the lower
    doc_id.
    """
    terms = query_terms(query)
    flt = filters or Filters()
    docs = flt.apply(index.documents)
    stats = docs.agg(F.count("*").alias("n"), F.avg("dl").alias("avg_dl"))
    row = stats.select(F.struct("n", "avg_dl").alias("s")).scalar()
    n_docs, avg_dl = row["n"], row["avg_dl"]
    hits = index.postings.filter(F.col("term").isin(terms))
    hits = _kept(flt.apply(hits))  # the question's words alone: statistics and ranking both read them, the index is read once
    frequency = hits.groupBy("term").agg(F.count("*").alias("df"))  # one row per term of the question
    gain = _idf(n_docs, F.col("df")) * _gain(F.col("tf"), F.col("dl"), avg_dl)
    scored = (
        hits.join(F.broadcast(frequency), "term")
        .groupBy("doc_id", *ATTRIBUTES)
        .agg(F.round(F.sum(F.round(gain, 9).cast("decimal(18,9)")), 6).cast("double").alias("score"))
    )
    return scored.orderBy(F.col("score").desc(), "doc_id").limit(k)


def ranked(hits: DataFrame, df: dict[str, int], n_docs: int, avg_dl: float, k: int) -> DataFrame:
    """Top ``k`` (doc_id, score) of postings, with the words' document frequencies and the collection's statistics given."""
    idf = F.lit(None).cast("double")
    for term, n in df.items():
        idf = F.when(F.col("term") == term, _idf(F.lit(n_docs), F.lit(n))).otherwise(idf)
    gain = idf * _gain(F.col("tf"), F.col("dl"), F.lit(avg_dl))
    scored = hits.groupBy("doc_id").agg(F.round(F.sum(F.round(gain, 9).cast("decimal(18,9)")), 6).cast("double").alias("score"))
    return scored.orderBy(F.col("score").desc(), "doc_id").limit(k)


def search_corpus(corpus: DataFrame, query: str, k: int = 5, filters: Filters | None = None) -> DataFrame:
    """Top ``k`` straight from the corpus, without an index: for a corpus that is asked once, and as a check.

    One pass counts the question's terms per document, whatever their number; these narrow rows are
    written to the checkpoint folder, because statistics and ranking both read them, and ranked as
    ``search_index`` ranks.
    """
    terms = query_terms(query)
    words = (filters or Filters()).apply(corpus).withColumn("_words", F.filter(tokens(F.col("content")), lambda t: t != ""))
    counts = words.select(
        "doc_id", *ATTRIBUTES, F.coalesce(F.size("_words"), F.lit(0)).alias("dl"),
        _folded(F.filter("_words", lambda t: t.isin(terms))).alias("hits"),
    )
    counted = _kept(counts)
    hits = counted.select("doc_id", *ATTRIBUTES, "dl", F.explode("hits").alias("_p")).select(
        F.col("_p.term").alias("term"), "doc_id", F.col("_p.tf").alias("tf"), "dl", *ATTRIBUTES
    )
    return search_index(EvidenceIndex(hits, counted.select("doc_id", *ATTRIBUTES, "dl")), query, k)


def with_content(hits: DataFrame, corpus: DataFrame) -> DataFrame:
    """Attach the text of the few ranked documents (``hits`` is limited to k rows, so broadcast)."""
    return corpus.select("doc_id", "content").join(F.broadcast(hits), "doc_id")


def context_lines(hits: DataFrame) -> DataFrame:
    """One text of the ranked passages, 300 characters of each (the context line's format)."""
    line = F.concat(
        F.lit("["), "source_type", F.lit("] (Customer: "), "customer_id", F.lit(", Sentiment: "), "sentiment",
        F.lit("): "), F.left("content", F.lit(300)),
    )
    item = F.struct((-F.col("score")).alias("o"), F.col("doc_id"), line.alias("line"))
    ordered = F.array_sort(F.collect_list(item))  # k items
    return hits.agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n\n").alias("context"))


# --- evidence per customer and per action ----------------------------------------------------


def customer_evidence(corpus: DataFrame, customer_id: str | None = None, k: int = 10) -> DataFrame:
    """Latest ``k`` documents of one customer, or of every customer; 300-character preview."""
    newest = (F.col("event_date").desc_nulls_last(), F.col("doc_id"))
    preview = corpus.select(
        "customer_id", "doc_id", "source_type", F.left("content", F.lit(300)).alias("content_preview"),
        "sentiment", "moment_type", "event_date",
    )
    if customer_id is not None:
        return preview.filter(F.col("customer_id") == F.lit(customer_id)).orderBy(*newest).limit(k)
    return top_per_key(preview, "customer_id", k, *newest)


def action_evidence(actions: DataFrame, corpus: DataFrame, k: int | None = 3) -> DataFrame:
    """Latest ``k`` documents for each action (our own number; None: all). Texts are cut to ``k`` per customer before the
    join, so a customer's actions never meet all of that customer's documents."""
    newest = (F.col("event_date").desc_nulls_last(), F.col("doc_id"))
    best = top_per_key(
        corpus.select("customer_id", "doc_id", "source_type", "sentiment", "moment_type", "event_date"),
        "customer_id", 2**31 - 1 if k is None else k, *newest, rank="evidence_rank",
    )
    return join_hot(actions.select("action_id", "customer_id", "action_type"), best, "customer_id")

