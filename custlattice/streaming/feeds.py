"""Structured Streaming variants: event feed, interaction ingest, enrichment, evidence refresh.

All jobs run the same column logic as the batch operators. Sinks written in ``foreachBatch`` put
each micro-batch in its own ``batch=<id>`` directory with overwrite, so a replayed batch replaces
itself instead of being added twice; the event feed uses the exactly-once file sink. Ids that have been seen are keyed
state: a batch looks up its own ids, whenever they came before, and the state lies in RocksDB, whose changes alone are checkpointed.

What later batches look up besides (sums, health rows) lies in narrow tables that are compacted:
every ``COMPACT_EVERY`` batches a ``through=<id>`` directory takes over all up to that batch, so the files a batch reads
follow the size of these tables and not the number of batches. Only complete directories are read.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from custlattice.functions.text import Lexicon
from custlattice.functions.values import fixed_units, ts_lit
from custlattice.operators import enrich, events, health, health_state, search_log
from custlattice.operators.health import HEALTH

COMPACT_EVERY = 8
#: Settings of a stream that keeps ids for good: state larger than memory, checkpointed by its changes.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def stream_reader(spark: SparkSession, path: str, schema, glob: str | None = None, max_files: int | None = None):
    """A file stream; ``max_files`` per trigger is the work cap of one run."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def event_feed(tables: dict[str, DataFrame], as_of: datetime) -> DataFrame:
    """The unified events of streaming sources, each event id once, however late it comes again.

    Works on whichever of policy, claim, payment, interaction and survey are present; back-dated rows are kept.
    """
    builders = {
        "policy": events.events_policy,
        "claim": lambda df: events.events_claim(df, as_of),
        "payment": lambda df: events.events_payment(df, as_of),
        "interaction": events.events_interaction,
        "survey": events.events_survey,
    }
    parts = [build(tables[name]) for name, build in builders.items() if name in tables]
    union = reduce(DataFrame.unionByName, parts)
    return once(union, "event_id")


def once(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a stream whose key has not come before. There is no time limit, so the state holds all keys; each batch reads its own."""
    for name, value in STATE.items():
        rows.sparkSession.conf.set(name, value)
    return rows.dropDuplicates([key])


def stream_customer_events(feed: DataFrame, sink: str, checkpoint: str, trigger: dict) -> StreamingQuery:
    return (
        feed.writeStream.format("parquet").outputMode("append").option("path", sink)
        .option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


def _batch_path(sink: str, table: str, batch_id: int) -> str:
    return f"{sink}/{table}/batch={batch_id}"


def _ids(spark: SparkSession, sink: str, table: str, kind: str) -> list[int]:
    """Ids of a table's complete ``batch=`` or ``through=`` directories, in order."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    path = hadoop(f"{sink}/{table}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith(kind + "=")]
    return sorted(int(p.getName().split("=")[1]) for p in found if fs.exists(hadoop(p, "_SUCCESS")))


def sink_batches(spark: SparkSession, sink: str, table: str, before: int | None = None) -> list[int]:
    """Ids of the batches a sink table holds, in order."""
    return [i for i in _ids(spark, sink, table, "batch") if before is None or i < before]


def sink_folders(spark: SparkSession, sink: str, table: str, before: int | None = None) -> list[str]:
    """The newest compacted directory (before a batch) and the batches after it."""
    whole = [i for i in _ids(spark, sink, table, "through") if before is None or i < before]
    later = [i for i in sink_batches(spark, sink, table, before) if not whole or i > whole[-1]]
    start = [f"{sink}/{table}/through={whole[-1]}"] if whole else []
    return start + [_batch_path(sink, table, i) for i in later]


def read_sink(spark: SparkSession, sink: str, table: str, before: int | None = None) -> DataFrame | None:
    """What the batches (before one) wrote, or None when there is nothing yet."""
    paths = sink_folders(spark, sink, table, before)
    return spark.read.parquet(*paths) if paths else None


def write_sink(rows: DataFrame, sink: str, table: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(_batch_path(sink, table, batch_id))


def compact(spark: SparkSession, sink: str, table: str, batch_id: int, merge=lambda df: df) -> None:
    """After ``COMPACT_EVERY`` batches, write all that readers need up to this one as one directory."""
    if len(sink_folders(spark, sink, table, batch_id + 1)) > COMPACT_EVERY:
        whole = merge(read_sink(spark, sink, table, batch_id + 1)).hint("rebalance")
        whole.write.mode("overwrite").parquet(f"{sink}/{table}/through={batch_id}")


def stream_enrichment(
    source: DataFrame, kind: enrich.TextSource, lexicon: Lexicon, sink: str, checkpoint: str, trigger: dict,
    as_of: datetime,
) -> StreamingQuery:
    """Enrich each document once. Rows are scored as they come and told apart when they no longer carry text."""

    def write(batch: DataFrame, batch_id: int) -> None:
        write_sink(enrich.tall_from_wide(batch, as_of), sink, "customer_ai_enrichment", batch_id)

    scored = once(enrich.wide_from_source(source, kind, lexicon), "source_id")
    return scored.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def stream_evidence_refresh(source: DataFrame, sink: str, checkpoint: str, trigger: dict) -> StreamingQuery:
    """Keep the index at ``sink`` at the state of the documents that arrive: new ones are added, changed ones replaced, and with a column ``deleted`` they go.

    With an hourly trigger the lag is one hour. A batch that runs again finds its documents live and changes nothing.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        search_log.refresh(batch.sparkSession, sink, batch)

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def ingest_rows(arrivals: DataFrame, as_of: datetime) -> dict[str, DataFrame]:
    """Split arriving interactions into the three table rows each of them becomes.

    ``arrivals``: customer_id, arrival_id, channel, topic, text, sentiment. All ids derive from
    arrival_id once, so interaction, transcript and enrichment always link.
    """
    # Topics that decide the class of an ingested interaction
    label = (
        F.when(F.col("topic") == "Cancellation Request", "CHURN")
        .when(F.col("topic") == "Claim Status", "CLAIM_FRICTION")
        .otherwise("GENERAL_INQUIRY")
    )
    mood = enrich.sentiment_label(F.col("sentiment"))
    interaction, transcript = (F.concat(F.lit(p), F.col("arrival_id")) for p in ("IS", "TS"))
    now = ts_lit(as_of)
    return {
        "interaction": arrivals.select(
            interaction.alias("interaction_id"), "customer_id", "channel", F.lit("Inbound").alias("direction"),
            now.alias("interaction_date"), F.lit(300).alias("duration_seconds"), "topic",
        ),
        "transcript": arrivals.select(
            transcript.alias("transcript_id"), interaction.alias("interaction_id"), "customer_id",
            F.col("text").alias("transcript_text"), now.alias("created_at"),
        ),
        "customer_ai_enrichment": arrivals.select(
            F.concat(F.lit("ES"), "arrival_id").alias("enrichment_id"), "customer_id",
            F.lit("TRANSCRIPT").alias("source_table"), transcript.alias("source_id"),
            F.col("sentiment").alias("sentiment_score"), mood.alias("sentiment_label"),
            label.alias("classification"), now.alias("enriched_at"),
        ),
    }


def ingest_interaction(
    arrivals: DataFrame, health_rows: DataFrame, enrichment: DataFrame, sink: str, checkpoint: str, trigger: dict,
    as_of: datetime, facts: DataFrame | None = None,
) -> StreamingQuery:
    """Append each arrival's three rows, then bring the health of the touched customers up to date.

    With ``facts`` (``health_state.facts`` of all that has come before) by the batch formula: the arrivals' contacts and sentiments are
    added to the state at ``sink``/health_state, and the touched customers are scored from their own numbers. Without, by the quick
    step that always worsens (``health_apply_delta``).

    A batch reads and writes only what its customers need, and a batch that runs again counts once. The sink's health
    starts as a copy of ``health_rows``; ``newest_health`` gives all customers. Sink and checkpoint belong together.
    """
    spark = health_rows.sparkSession
    state = f"{sink}/health_state"
    if not sink_folders(spark, sink, "customer_health"):
        start = health_rows.select(*HEALTH).withColumn("batch_id", F.lit(-1).cast("bigint"))
        start.write.mode("overwrite").parquet(f"{sink}/customer_health/through=-1")
    if facts is not None:
        health_state.add(spark, state, facts, -1)
    elif not sink_folders(spark, sink, "sentiment_sums"):  # the earlier enrichment is read once
        sentiment_sums(enrichment).write.mode("overwrite").parquet(f"{sink}/sentiment_sums/through=-1")

    def rescored(spark: SparkSession, rows: dict[str, DataFrame], touched: DataFrame, batch_id: int) -> DataFrame:
        change = health_state.facts({"interaction": rows["interaction"], "sentiment": rows["customer_ai_enrichment"]})
        health_state.add(spark, state, change, batch_id)
        return health_state.health_from_facts(health_state.read(spark, state, touched), as_of)

    def worsened(spark: SparkSession, fresh: DataFrame, touched: DataFrame, batch_id: int) -> DataFrame:
        write_sink(sentiment_sums(fresh.withColumnRenamed("sentiment", "sentiment_score")), sink, "sentiment_sums", batch_id)
        sums = read_sink(spark, sink, "sentiment_sums", batch_id + 1).join(touched, "customer_id", "left_semi")
        mood = added_sums(sums).select("customer_id", F.round(F.col("micro").cast("double") / 1_000_000.0 / F.col("n"), 12).alias("avg_sentiment"))
        before = newest_rows(read_sink(spark, sink, "customer_health", batch_id).join(touched, "customer_id", "left_semi"))
        return health.health_apply_delta(before, mood, touched, as_of)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        write_sink(batch, sink, "arrivals", batch_id)
        fresh = spark.read.schema(batch.schema).parquet(_batch_path(sink, "arrivals", batch_id))
        rows = ingest_rows(fresh, as_of)
        for table, part in rows.items():
            write_sink(part, sink, table, batch_id)
        touched = fresh.select("customer_id").distinct()
        by_formula = facts is not None
        updated = rescored(spark, rows, touched, batch_id) if by_formula else worsened(spark, fresh, touched, batch_id)
        write_sink(updated.withColumn("batch_id", F.lit(batch_id).cast("bigint")), sink, "customer_health", batch_id)
        if not by_formula:
            compact(spark, sink, "sentiment_sums", batch_id, added_sums)
        compact(spark, sink, "customer_health", batch_id, newest_rows)

    return once(arrivals, "arrival_id").writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def sentiment_sums(rows: DataFrame) -> DataFrame:
    """Per customer the sum of the scores in millionths, exact in any order, and their number."""
    micro = fixed_units(F.col("sentiment_score"), 6)
    return rows.filter(F.col("sentiment_score").isNotNull()).groupBy("customer_id").agg(F.sum(micro).alias("micro"), F.count("*").alias("n"))


def added_sums(sums: DataFrame) -> DataFrame:
    return sums.groupBy("customer_id").agg(F.sum("micro").alias("micro"), F.sum("n").alias("n"))


def newest_rows(rows: DataFrame) -> DataFrame:
    """Of each customer the rows' columns of the latest batch."""
    latest = F.max_by(F.struct(*rows.columns), "batch_id").alias("r")
    return rows.groupBy("customer_id").agg(latest).select("r.*")


def newest_health(spark: SparkSession, sink: str, before: int | None = None) -> DataFrame | None:
    """The health of all customers after the last batch (before one), or None."""
    rows = read_sink(spark, sink, "customer_health", before)
    return None if rows is None else newest_rows(rows).drop("batch_id")
