"""Tables cut off from their lineage, and row keys that do not depend on who reads them."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_SHIPPED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`. Only a session on one machine may leave it unset; it gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    key = context.applicationId
    if key not in _LOCAL:
        _LOCAL[key] = tempfile.mkdtemp(prefix="custlattice-llm-")
    return _LOCAL[key]


def ship(spark: SparkSession) -> None:
    """Once per application, send this package to the executors, so that their Python workers can import it wherever they run.

    Texts can be long, so where the session says nothing else, fewer of them go to Python at a time.
    """
    context = spark.sparkContext
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, "1024")
    if context.applicationId not in _SHIPPED:
        _SHIPPED.add(context.applicationId)
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        folder = tempfile.mkdtemp(prefix="custlattice-code-")  # the driver serves it from here
        shutil.copytree(package, f"{folder}/code/custlattice", ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(f"{folder}/custlattice", "zip", f"{folder}/code"))


def staged(df: DataFrame, name: str) -> DataFrame:
    """`df` written once to the shared folder and read back: a lost executor repeats nothing that came before."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column, modulus: int):
    """crc32 of a column's text (null: the empty text) modulo `modulus`."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))
