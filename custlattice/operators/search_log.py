"""A log-structured evidence index: documents arrive, change and go, and questions read the postings of their own words.

A refresh compares digests with the live documents and writes one segment: the new versions, their postings by word bucket, the versions that they end
(`dead`), and how many documents each word has lost by that (`lost`). Segments are merged in tiers, so there are at most TIER - 1 of each size and a row is
rewritten a logarithmic number of times. The commit (see `snapshots`) names the live segments and holds the number of documents and words.

Documents belong to one of RANGES by a hash of their id. A block is a word's postings of one range and segment; it keeps their number, the largest count
and the smallest length, which bound the score that its documents can get from the word. A question first ranks the ranges with the largest
bounds; ranges whose bound stays below the k-th score found there are not read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custlattice.operators import evidence
from custlattice.operators.evidence import ATTRIBUTES, Filters
from custlattice.sources import snapshots
from custlattice.sources.tables import scratch_dir

TIER = 4
RANGES = 1024
#: Words of documents per word bucket of a segment, and buckets at most.
BUCKET_WORDS = 2_000_000
BUCKETS = 4_096
#: Share of a question's postings that the first look reads, at least.
FIRST_LOOK = 0.02
TABLES = ("documents", "postings", "blocks", "dead", "lost")


def _digest():
    """Tells versions of a document apart: its text and attributes, NULL and empty different."""
    parts = [F.coalesce(F.concat(F.lit("+"), F.col(c).cast("string")), F.lit("-")) for c in ("content", *ATTRIBUTES)]
    return F.md5(F.concat_ws("\x1f", *parts).cast("binary"))


def _stage(df: DataFrame) -> DataFrame:
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _read(spark: SparkSession, root: str, table: str, segments: list[dict]) -> DataFrame | None:
    """A table's rows of the segments with the column segment, or None."""
    paths = [f"{root}/{table}/segment={s['id']}" for s in segments if table not in s["empty"]]
    return spark.read.option("basePath", f"{root}/{table}").parquet(*paths).withColumn("segment", F.col("segment").cast("string")) if paths else None


def _without_dead(rows: DataFrame, dead: DataFrame | None) -> DataFrame:
    if dead is None:
        return rows
    return rows.join(dead.select("doc_id", F.col("of").alias("segment")), ["doc_id", "segment"], "left_anti")


def _bucket(term, n: int):
    return F.pmod(F.xxhash64(term), F.lit(n)).cast("int")


def _write_words(df: DataFrame, root: str, table: str, entry: dict, *order: str) -> None:
    """Rows with words by bucket; buckets that frequent words make large are split, small ones share a task."""
    bucketed = df.withColumn("bucket", _bucket(F.col("term"), entry["buckets"]))
    balanced = df.sparkSession.sql("SELECT /*+ REBALANCE(bucket) */ * FROM {rows}", rows=bucketed)
    balanced.sortWithinPartitions("bucket", *order).write.partitionBy("bucket").parquet(f"{root}/{table}/segment={entry['id']}")


def _segment(root: str, level: int, documents: DataFrame, postings, dead: DataFrame | None, lost: DataFrame | None) -> dict:
    """Writes a segment and gives its entry for the commit. documents are live; postings(documents as written) makes their postings."""
    spark = documents.sparkSession
    entry = {"id": uuid.uuid4().hex, "level": level, "empty": [n for n, t in (("dead", dead), ("lost", lost)) if t is None]}
    path = f"{root}/documents/segment={entry['id']}"
    documents.sortWithinPartitions("doc_id").write.parquet(path)
    written = spark.read.schema(documents.schema).parquet(path)
    found = written.agg(F.count("*").alias("docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("words")).first()
    entry |= {"docs": found.docs, "words": int(found.words), "buckets": min(BUCKETS, 1 + int(found.words) // BUCKET_WORDS)}
    entry["empty"] += (["documents"] if not found.docs else []) + (["postings", "blocks"] if not found.words else [])
    if found.words:
        _write_words(postings(written), root, "postings", entry, "term", "range", "doc_id")
        blocks = _read(spark, root, "postings", [entry]).groupBy("term", "range").agg(F.count("*").alias("n"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"))
        _write_words(blocks, root, "blocks", entry, "term", "range")
    if dead is not None:
        dead.select("doc_id", "of").write.parquet(f"{root}/dead/segment={entry['id']}")
    if lost is not None:
        lost.select("term", "n").write.parquet(f"{root}/lost/segment={entry['id']}")
    return entry


def _postings(documents: DataFrame) -> DataFrame:
    """Narrow rows, since a text has hundreds of them that are sorted and written: attributes are the documents'."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(RANGES)).cast("int").alias("range")
    return evidence.postings(documents).select("term", "doc_id", "tf", "dl", place)


def refresh(spark: SparkSession, root: str, arrived: DataFrame) -> snapshots.Commit | None:
    """Bring the index to the state of the arrived documents (columns of the corpus, and optionally `deleted`); other documents stay.

    A document that is live with the same text and attributes changes nothing, so rows may be delivered again. Of several versions of a document in
    `arrived` the one with the latest event_date, then the largest digest, counts; a deletion counts over all. Rows without doc_id
    are left out. Gives the commit, which is the old one if nothing has changed.
    """
    state = snapshots.newest(spark, root)
    segments = state.value["segments"] if state else []
    removed = F.coalesce("deleted", F.lit(False)) if "deleted" in arrived.columns else F.lit(False)
    rows = arrived.filter(F.col("doc_id").isNotNull()).withColumns({"deleted": removed, "digest": _digest()})
    last = F.max(F.struct("deleted", "event_date", "digest")).alias("v")
    now = rows.groupBy("doc_id").agg(last).select("doc_id", "v.digest", "v.deleted")
    dead_rows, live = _read(spark, root, "dead", segments), _read(spark, root, "documents", segments)
    if live is None:
        now = now.withColumns({"segment": F.lit(None).cast("string"), "_known": F.lit(None).cast("string")})
    else:
        known = _without_dead(live.select("doc_id", "segment", F.col("digest").alias("_known")), dead_rows)
        now = now.join(known, "doc_id", "left")
    same = F.col("_known").eqNullSafe(F.when(~F.col("deleted"), F.col("digest")))
    now = _stage(now.filter(~same))  # narrow: ids, digests, and where the live version is
    if now.isEmpty():
        return state
    fresh = now.filter(~F.col("deleted")).select("doc_id", "digest")
    texts = rows.join(fresh, ["doc_id", "digest"], "left_semi")
    words = F.coalesce(F.size(F.filter(evidence.tokens(F.col("content")), lambda t: t != "")), F.lit(0))
    documents = texts.select("doc_id", *ATTRIBUTES, words.alias("dl"), "digest", "content").dropDuplicates(["doc_id"])
    ended = now.filter(F.col("segment").isNotNull()).select("doc_id", F.col("segment").alias("of"))
    gone = lost = None
    if live is not None and not ended.isEmpty():
        old = _stage(live.join(ended.withColumnRenamed("of", "segment"), ["doc_id", "segment"], "left_semi"))
        gone = old.agg(F.count("*").alias("docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("words")).first()
        lost = evidence.postings(old).groupBy("term").agg(F.count("*").alias("n"))
    made = _segment(root, 0, documents, _postings, ended if gone else None, lost)
    totals = {k: made[k] + (state.value[k] if state else 0) - (int(gone[k]) if gone else 0) for k in ("docs", "words")}
    segments = _merged(spark, root, [*segments, made])
    return snapshots.publish(spark, root, totals | {"segments": segments}, state)


def _merged(spark: SparkSession, root: str, segments: list[dict]) -> list[dict]:
    """Segments after merging the last ones of a tier as long as TIER of them have one level."""
    while len(segments) >= TIER and len({s["level"] for s in segments[-TIER:]}) == 1:
        kept, merged = segments[:-TIER], segments[-TIER:]
        inside = [m["id"] for m in merged]
        dead, lost = _read(spark, root, "dead", merged), _read(spark, root, "lost", merged)
        documents, postings = _read(spark, root, "documents", merged), _read(spark, root, "postings", merged)
        if documents is None:  # nothing but deletions
            documents = _read(spark, root, "documents", segments).limit(0)
        earlier = None
        if dead is not None:
            earlier = dead.filter(~F.col("of").isin(inside))  # what the merged segments end in earlier ones
            own = dead.filter(F.col("of").isin(inside)).select("doc_id", F.col("of").alias("segment"))
            if postings is not None:  # words lost inside the merged segments are not in the new blocks any more
                ended = postings.join(own, ["doc_id", "segment"], "left_semi").groupBy("term").agg((-F.count("*")).alias("n"))
                lost = lost.select("term", "n").unionByName(ended).groupBy("term").agg(F.sum("n").alias("n")).filter("n <> 0")
        kept_postings = None if postings is None else _without_dead(postings, dead).drop("segment", "bucket")
        made = _segment(root, merged[0]["level"] + 1, _without_dead(documents, dead).drop("segment"), lambda _, rows=kept_postings: rows, earlier, lost)
        segments = [*kept, made]
    return segments


@dataclass(frozen=True)
class SearchLog:
    """One state of the index."""

    spark: SparkSession
    root: str
    commit: snapshots.Commit

    def _table(self, name: str) -> DataFrame | None:
        return _read(self.spark, self.root, name, self.commit.value["segments"])

    @property
    def documents(self) -> DataFrame | None:
        """doc_id, attributes, dl, digest, content of the live documents."""
        rows = self._table("documents")
        return None if rows is None else _without_dead(rows, self._table("dead")).drop("segment")

    def postings(self, terms: list[str] | None = None) -> DataFrame | None:
        """Postings of live documents, of all words or of some, with range and segment."""
        rows = self._table("postings")
        if rows is None:
            return None
        if terms is not None:
            rows = self._of(rows, terms)
        return _without_dead(rows, self._table("dead")).drop("bucket")

    def _of(self, rows: DataFrame, terms: list[str]) -> DataFrame:
        """Rows of some words, of which only the words' buckets are read in each segment."""
        segments = self.commit.value["segments"]
        counts = sorted({s["buckets"] for s in segments})
        words = F.array(*map(F.lit, terms))
        buckets_of = lambda n: F.array_distinct(F.transform(words, lambda t: _bucket(t, n))).alias(f"b{n}")
        found = self.spark.range(1).select(*map(buckets_of, counts)).first()
        where = F.lit(False)
        for n in counts:
            where |= F.col("segment").isin([s["id"] for s in segments if s["buckets"] == n]) & F.col("bucket").isin(list(found[f"b{n}"]))
        return rows.filter(where & F.col("term").isin(terms))

    def _frequencies(self, terms: list[str]) -> dict[str, int]:
        """Live documents of each word, from blocks and losses."""
        blocks, lost = self._table("blocks"), self._table("lost")
        out = dict.fromkeys(terms, 0)
        for rows, sign in ((self._of(blocks, terms), 1), (None if lost is None else lost.filter(F.col("term").isin(terms)), -1)):
            for r in [] if rows is None else rows.groupBy("term").agg(F.sum("n").alias("n")).collect():  # one row a word of the question
                out[r.term] += sign * r.n
        return out

    def search(self, query: str, k: int = 5, filters: Filters | None = None) -> tuple[DataFrame, float]:
        """Top k (doc_id, score, attributes) as `evidence.search_index` ranks, and the share of the words' postings that was read.

        With filters the statistics cover the filtered documents, so their narrow rows and all of the words' postings are read.
        """
        terms = evidence.query_terms(query)
        if filters is not None and filters != Filters() or self._table("blocks") is None:
            docs, postings = self.documents, self.postings(terms)  # narrow postings meet the attributes by doc_id
            if docs is None or postings is None:
                empty = self.spark.createDataFrame([], "doc_id string, score double, customer_id string, source_type string, sentiment string, moment_type string, event_date timestamp_ntz")
                return empty, 0.0
            docs = docs.select("doc_id", *ATTRIBUTES, "dl")
            wanted = (filters or Filters()).apply(docs)
            hits = postings.select("term", "doc_id", "tf", "dl").join(wanted.drop("dl"), "doc_id")
            return evidence.search_index(evidence.EvidenceIndex(hits, docs), query, k, filters), 1.0
        n_docs, avg_dl = self.commit.value["docs"], self.commit.value["words"] / max(1, self.commit.value["docs"])
        df = {t: n for t, n in self._frequencies(terms).items() if n > 0}
        if not df:
            return self._with(ATTRIBUTES, evidence.ranked(self.postings(terms).limit(0), df, n_docs, avg_dl, k)).select("doc_id", "score", *ATTRIBUTES), 0.0
        bounds = self._bounds(df, n_docs, avg_dl)
        total = sum(n for *_, n in bounds)
        first, read = 0, 0
        while first < len(bounds) and read < max(FIRST_LOOK * total, 4 * k):
            read, first = read + bounds[first][3], first + 1
        found = _stage(self._ranked(bounds[:first], df, n_docs, avg_dl, k))
        scores = sorted((r.score for r in found.select("score").collect()), reverse=True)
        least = scores[k - 1] - 1e-5 if len(scores) >= k else 0.0  # scores are rounded to six digits
        more = [b for b in bounds[first:] if b[2] >= least]
        if more:
            rest = self._ranked(more, df, n_docs, avg_dl, k)
            found = found.unionByName(rest).orderBy(F.desc("score"), "doc_id").limit(k)
        found = self._with(ATTRIBUTES, found).select("doc_id", "score", *ATTRIBUTES)
        return found.orderBy(F.desc("score"), "doc_id"), (read + sum(b[3] for b in more)) / total

    def _bounds(self, df: dict[str, int], n_docs: int, avg_dl: float) -> list[tuple]:
        """(segment, range, bound, postings), largest bound first: at most RANGES for each segment."""
        blocks = self._of(self._table("blocks"), list(df))
        idf = F.lit(None)
        for term, n in df.items():
            idf = F.when(F.col("term") == term, evidence._idf(F.lit(n_docs), F.lit(n))).otherwise(idf)
        bound = F.sum(idf * evidence._gain(F.col("max_tf"), F.col("min_dl"), F.lit(avg_dl)))
        rows = blocks.groupBy("segment", "range").agg(bound.alias("bound"), F.sum("n").alias("n")).collect()
        return sorted(((r.segment, r["range"], r.bound, r.n) for r in rows), key=lambda b: (-b[2], b[0], b[1]))

    def _ranked(self, chosen: list[tuple], df: dict[str, int], n_docs: int, avg_dl: float, k: int) -> DataFrame:
        wanted = self.spark.createDataFrame([(s, r) for s, r, *_ in chosen], "segment string, range int")
        hits = self.postings(list(df)).join(F.broadcast(wanted), ["segment", "range"], "left_semi")  # at most RANGES x segments rows
        return evidence.ranked(hits, df, n_docs, avg_dl, k)

    def _with(self, columns: tuple, hits: DataFrame) -> DataFrame:
        """The k ranked documents with columns of theirs: files are sorted by doc_id, so the few ids prune what is read."""
        hits = _stage(hits)  # k rows, that are not ranked again for each use
        ids = [r.doc_id for r in hits.select("doc_id").collect()]  # k
        return self.documents.filter(F.col("doc_id").isin(ids)).select("doc_id", *columns).join(F.broadcast(hits), "doc_id")

    def with_content(self, hits: DataFrame) -> DataFrame:
        return self._with(("content",), hits)


def open_log(spark: SparkSession, root: str, number: int | None = None) -> SearchLog:
    """The newest state, or that of a commit number."""
    found = snapshots.newest(spark, root) if number is None else snapshots.read(spark, root, number)
    if found is None:
        raise ValueError(f"no index at {root}")
    return SearchLog(spark, root, found)
