"""The nine insurance tables derived from the retail sample tables (TESTDATA.md, FIXTURES.md 3).

Every row of the mapped sample tables is used: each order is a policy, each returned line item a
claim, each other line item a payment, each event an interaction, each document exactly one of
transcript, e-mail or note (by its source), each label a survey. All rules are portable integer
arithmetic, so the same tables can be written as plain SQL for checking.
"""

from __future__ import annotations

from datetime import datetime
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from custlattice import vocab
from custlattice.functions.text import Lexicon
from custlattice.functions.values import date_lit, days_between, padded_id, pick
from custlattice.sources.schemas import SOURCE_TABLES

AS_OF = datetime(2024, 1, 31)
BASE = datetime(1995, 1, 1)
ACTIVE_SHARE = 10  # texts and events belong to a tenth of the customers

# Declared, so that opening a table starts no schema-inference job.
RAW_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_extendedprice double, l_returnflag string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string",
    "documents": "doc_id bigint, text string, source string",
    "labels": "doc_id bigint, quality int, toxic int",
}

TRANSCRIPT_SOURCES = [f"src{i}" for i in range(10)]
EMAIL_SOURCES = [f"src{i}" for i in range(10, 15)]

# Arbitrary tokens of the sample documents, standing in for insurance words.
LEXICON = Lexicon(
    positive=("best", "reat", "reing", "enst", "rely"),
    negative=("worthless", "stupid", "idiot", "annt", "onor", "aning"),
    entities={
        "competitors": ("license", "onwh", "ansh"),
        "products": ("inth", "reor", "onsh"),
        "people": ("anes", "onea"),
    },
    intents={
        "cancellation_intent": ("worthless", "inan", "annd"),
        "payment_issue": ("innd", "enon"),
        "product_request": ("ener", "reon"),
        "complaint": ("stupid", "idiot", "onor"),
        "price_sensitivity": ("ones", "anth"),
        "competitor_comparison": ("license", "onwh", "ansh"),
    },
)


def customer_id(number: Column) -> Column:
    return padded_id("CUST-", number, 6)


def _by_share(share: Column, steps) -> Column:
    """Category by upper bound of a number, the last one takes the rest."""
    out = F.when(share < steps[0][0], steps[0][1])
    for bound, name in steps[1:-1]:
        out = out.when(share < bound, name)
    return out.otherwise(steps[-1][1])


class SampleTables:
    """The nine tables, by attribute or by key."""

    def __init__(self, spark: SparkSession, path: str, streaming: bool = False):
        self.spark = spark
        self.path = path
        self.streaming = streaming

    def _static(self, name: str) -> DataFrame:
        return self.spark.read.schema(RAW_SCHEMAS[name]).parquet(f"{self.path}/{name}.parquet")

    def _driving(self, name: str) -> DataFrame:
        """The table whose rows become the result's rows: a file stream in streaming use."""
        if not self.streaming:
            return self._static(name)
        # a pattern, because a file stream takes a single file by pattern only; a folder of part files fits it as well
        return self.spark.readStream.schema(RAW_SCHEMAS[name]).parquet(f"{self.path}/{name}[.]parquet")

    # a mapping of table name to DataFrame; a table is opened when it is first asked for
    def __getitem__(self, table: str) -> DataFrame:
        return getattr(self, table)

    def items(self):
        return [(t, self[t]) for t in SOURCE_TABLES]

    @cached_property
    def _active_customers(self) -> int:
        """How many customers own texts: a row count, answered from the file footers."""
        return max(1, self._static("customer").count() // ACTIVE_SHARE)

    def _document_customer(self) -> Column:
        return customer_id(F.col("doc_id") % self._active_customers)

    def _document_date(self) -> Column:
        return (date_lit(AS_OF) - (F.col("doc_id") * 7 % 180).cast("int")).cast("timestamp_ntz")

    @cached_property
    def customer(self) -> DataFrame:
        number = F.col("c_custkey")
        nations = self._static("nation").join(
            self._static("region"), F.col("n_regionkey") == F.col("r_regionkey")
        )
        segment = (
            F.when(F.col("c_mktsegment") == "BUILDING", "Premium")
            .when(F.col("c_mktsegment") == "HOUSEHOLD", "Enterprise")
            .when(F.col("c_mktsegment") == "MACHINERY", "Basic")
            .otherwise("Standard")
        )
        born = date_lit(AS_OF) - (number % 18251 + 7300).cast("int")
        joined = (date_lit(AS_OF) - (number % 2000 + 1).cast("int")).cast("timestamp_ntz")
        return self._driving("customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
            customer_id(number).alias("customer_id"),
            F.lit("Customer").alias("first_name"),
            F.right(F.col("c_name"), F.lit(9)).alias("last_name"),
            F.concat(F.lower(customer_id(number)), F.lit("@email.com")).alias("email"),
            padded_id("+1-555-", number % 10_000_000, 7).alias("phone"),
            born.alias("date_of_birth"),
            pick(vocab.GENDERS, number % 3).alias("gender"),
            segment.alias("segment"),
            F.col("r_name").alias("region"),
            F.col("n_name").alias("state"),
            F.concat(F.lit("City "), (number % 97).cast("string")).alias("city"),
            padded_id("", number % 100_000, 5).alias("zip_code"),
            (number % 240 + 1).cast("int").alias("tenure_months"),
            F.col("c_acctbal").alias("lifetime_value"),
            joined.alias("created_at"),
            joined.alias("updated_at"),
        )

    @cached_property
    def policy(self) -> DataFrame:
        age = days_between(date_lit(BASE), F.col("o_orderdate"))
        start = date_lit(AS_OF) - (age % 731)
        status = (
            F.when(F.col("o_orderstatus").isin("O", "P"), "Active")
            .when(F.col("o_orderpriority").startswith("1"), "Cancelled")
            .when(F.col("o_orderpriority").startswith("5"), "Pending")
            .otherwise("Expired")
        )
        return self._driving("orders").select(
            padded_id("POL-", F.col("o_orderkey"), 7).alias("policy_id"),
            customer_id(F.col("o_custkey")).alias("customer_id"),
            pick(vocab.POLICY_TYPES, F.expr("o_orderkey div 4") % 8).alias("policy_type"),
            (F.col("o_totalprice") / 100).alias("premium_amount"),
            start.alias("start_date"),
            (date_lit(AS_OF) + (age % 336 + 30)).alias("end_date"),
            status.alias("status"),
            F.col("o_totalprice").alias("coverage_amount"),
            (F.col("o_orderkey") % 4751 + 250).cast("double").alias("deductible"),
            start.cast("timestamp_ntz").alias("created_at"),
        )

    def _lines(self, returned: bool) -> DataFrame:
        is_return = F.col("l_returnflag") == "R"
        orders = self._static("orders").select("o_orderkey", "o_custkey")
        lines = self._driving("lineitem").filter(is_return if returned else ~is_return)
        return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))

    def _line_id(self, prefix: str) -> Column:
        return F.concat_ws(
            "-", F.lit(prefix), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"
        )

    @cached_property
    def claim(self) -> DataFrame:
        share = F.col("l_partkey") % 20
        status = _by_share(
            share,
            [(1, "Open"), (2, "Under Review"), (7, "Approved"), (10, "Denied"), (16, "Settled"), (20, "Closed")],
        )
        age = days_between(date_lit(BASE), F.col("l_shipdate"))
        filed = date_lit(AS_OF) - (age % 365 + 1)
        days = F.when(share >= 2, (F.col("l_suppkey") % 58 + 3).cast("int"))
        kind = pick(vocab.CLAIM_TYPES, F.col("l_suppkey") % 8)
        return self._lines(returned=True).select(
            self._line_id("CLM").alias("claim_id"),
            customer_id(F.col("o_custkey")).alias("customer_id"),
            padded_id("POL-", F.col("l_orderkey"), 7).alias("policy_id"),
            kind.alias("claim_type"),
            F.col("l_extendedprice").alias("claim_amount"),
            status.alias("status"),
            filed.alias("filed_date"),
            F.date_add(filed, days).alias("resolved_date"),
            days.alias("resolution_days"),
            F.concat(kind, F.lit(" reported")).alias("description"),
            filed.cast("timestamp_ntz").alias("created_at"),
        )

    @cached_property
    def payment(self) -> DataFrame:
        share = (F.col("l_partkey") + F.col("l_suppkey")) % 20
        status = _by_share(
            share, [(2, "Failed"), (3, "Pending"), (4, "Refunded"), (20, "Completed")]
        )
        age = days_between(date_lit(BASE), F.col("l_shipdate"))
        paid = date_lit(AS_OF) - (age % 366)
        reason = F.when(share < 2, pick(vocab.FAILURE_REASONS, F.col("l_partkey") % 5))
        return self._lines(returned=False).select(
            self._line_id("PAY").alias("payment_id"),
            customer_id(F.col("o_custkey")).alias("customer_id"),
            padded_id("POL-", F.col("l_orderkey"), 7).alias("policy_id"),
            F.col("l_extendedprice").alias("amount"),
            paid.alias("payment_date"),
            (paid - (F.col("l_suppkey") % 15).cast("int")).alias("due_date"),
            status.alias("status"),
            pick(vocab.PAYMENT_METHODS, F.col("l_suppkey") % 6).alias("payment_method"),
            reason.alias("failure_reason"),
            paid.cast("timestamp_ntz").alias("created_at"),
        )

    @cached_property
    def interaction(self) -> DataFrame:
        channel = (
            F.when(F.col("event_type") == "view", "Web Portal")
            .when(F.col("event_type") == "click", "Mobile App")
            .when(F.col("event_type") == "error", "Phone")
            .when(F.col("event_type") == "signup", "Chat")
            .otherwise("Email")
        )
        shift = F.make_dt_interval((F.col("user_id") % 8 * 30).cast("int"))
        when = F.col("ts").cast("timestamp_ntz") - shift
        number = F.col("event_id")
        return self._driving("events").select(
            padded_id("INT-", number, 7).alias("interaction_id"),
            customer_id(F.col("user_id")).alias("customer_id"),
            channel.alias("channel"),
            pick(vocab.DIRECTIONS, number % 2).alias("direction"),
            when.alias("interaction_date"),
            (number % 1771 + 30).cast("int").alias("duration_seconds"),
            padded_id("AGT-", F.col("user_id") % 200 + 1, 4).alias("agent_id"),
            pick(vocab.DISPOSITIONS, number % 6).alias("disposition"),
            pick(vocab.TOPICS, number % 10).alias("topic"),
            when.alias("created_at"),
        )

    @cached_property
    def transcript(self) -> DataFrame:
        docs = self._driving("documents").filter(F.col("source").isin(TRANSCRIPT_SOURCES))
        return docs.select(
            padded_id("TRN-", F.col("doc_id"), 7).alias("transcript_id"),
            padded_id("INT-", F.col("doc_id"), 7).alias("interaction_id"),
            self._document_customer().alias("customer_id"),
            F.col("text").alias("transcript_text"),
            F.array(F.lit("Customer"), F.lit("Agent")).alias("speaker_labels"),
            self._document_date().alias("created_at"),
        )

    @cached_property
    def email(self) -> DataFrame:
        docs = self._driving("documents").filter(F.col("source").isin(EMAIL_SOURCES))
        return docs.select(
            padded_id("EML-", F.col("doc_id"), 7).alias("email_id"),
            padded_id("INT-", F.col("doc_id"), 7).alias("interaction_id"),
            self._document_customer().alias("customer_id"),
            F.col("source").alias("subject"),
            F.col("text").alias("body"),
            pick(vocab.DIRECTIONS, F.col("doc_id") % 2).alias("direction"),
            self._document_date().alias("sent_at"),
            self._document_date().alias("created_at"),
        )

    @cached_property
    def note(self) -> DataFrame:
        taken = TRANSCRIPT_SOURCES + EMAIL_SOURCES
        docs = self._driving("documents").filter(~F.coalesce(F.col("source").isin(taken), F.lit(False)))
        return docs.select(
            padded_id("NTE-", F.col("doc_id"), 7).alias("note_id"),
            self._document_customer().alias("customer_id"),
            padded_id("INT-", F.col("doc_id"), 7).alias("interaction_id"),
            padded_id("AGT-", F.col("doc_id") % 200 + 1, 4).alias("agent_id"),
            F.col("text").alias("note_text"),
            self._document_date().alias("created_at"),
        )

    @cached_property
    def survey(self) -> DataFrame:
        good, toxic = F.col("quality") == 1, F.col("toxic") == 1
        base = F.when(good & ~toxic, 9).when(good, 7).when(~toxic, 5).otherwise(2)
        nps = (base + F.col("doc_id") % 2).cast("int")
        docs = self._static("documents").select("doc_id", "text")
        return self._driving("labels").join(docs, "doc_id").select(
            padded_id("SRV-", F.col("doc_id"), 7).alias("survey_id"),
            self._document_customer().alias("customer_id"),
            pick(vocab.SURVEY_TYPES, F.col("doc_id") % 5).alias("survey_type"),
            nps.alias("nps_score"),
            F.least(F.lit(5), F.floor(nps / 2).cast("int") + 1).alias("csat_score"),
            F.col("text").alias("comments"),
            self._document_date().alias("submitted_at"),
            self._document_date().alias("created_at"),
        )

    # --- workflow inputs ---------------------------------------------------------------------

    @cached_property
    def prior_actions(self) -> DataFrame:
        """One earlier action per customer, in every type and status."""
        number = F.col("c_custkey")
        kind = pick(vocab.ACTION_TYPES, F.col("c_nationkey") % 5)
        status = pick(("APPROVED", "REJECTED", "COMPLETED", "PENDING", "SUPPRESSED"), number % 5)
        created = (date_lit(AS_OF) - 30).cast("timestamp_ntz")
        return self._driving("customer").select(
            F.concat(F.lit("NBA-OLD-"), customer_id(number)).alias("action_id"),
            customer_id(number).alias("customer_id"),
            kind.alias("action_type"),
            F.lit(0.75).alias("confidence"),
            F.lit("Carried over from an earlier run").alias("rationale"),
            F.lit(2).alias("priority"),
            status.alias("status"),
            (status == "SUPPRESSED").alias("suppressed"),
            F.when(status == "SUPPRESSED", "Suppressed: earlier run").alias("suppression_reason"),
            F.lit("{}").alias("evidence"),
            created.alias("created_at"),
            (date_lit(AS_OF) + (number % 21 - 10).cast("int")).cast("timestamp_ntz").alias("expires_at"),
        )

    @staticmethod
    def _number(customer: Column) -> Column:
        return F.split_part(customer, F.lit("-"), F.lit(2)).cast("bigint")

    def decisions(self, actions: DataFrame) -> DataFrame:
        """One decision per action; a third of them carry an invalid word."""
        n = self._number(F.col("customer_id"))
        return actions.select(
            "action_id",
            pick(("APPROVED", "REJECTED", "MAYBE"), n % 3).alias("decision"),
            F.concat(F.lit("user-"), (n % 4).cast("string")).alias("decided_by"),
        )

    def outcomes(self, log: DataFrame) -> DataFrame:
        """Outcome per logged action; a fifth of the customers report none."""
        n = self._number(F.col("customer_id"))
        return log.select(
            "action_id",
            F.when(n % 5 == 0, F.lit(None).cast("string"))
            .when(n % 2 == 0, "SUCCESSFUL")
            .otherwise("FAILED")
            .alias("outcome"),
            F.concat(F.lit("note for "), F.col("customer_id")).alias("notes"),
        ).filter(F.col("outcome").isNotNull())
