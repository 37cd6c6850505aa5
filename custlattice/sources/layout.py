"""Tables laid out by a key in buckets, so that joins by that key read both sides where they lie and shuffle neither.

The layout is part of the folder's name, ``<table>.<key>.<buckets>``, so a reader cannot take a wrong one. Tables that are joined want the
same number of buckets; the session's ``spark.sql.shuffle.partitions`` is the default, since a bucket is what one task reads. A key with very
many rows is one bucket's: this is for keys that tell rows apart, such as document ids.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession


def _registered(path: str) -> str:
    return "bucketed_" + hashlib.sha256(path.encode()).hexdigest()[:24]


def write_bucketed(df: DataFrame, root: str, name: str, key: str, buckets: int | None = None) -> str:
    """Write ``df`` below ``root`` in buckets by ``key``, one sorted file each; returns the folder. A folder that is there is not overwritten."""
    if "." in key:
        raise ValueError(f"the layout's name cannot hold a key with a dot: {key}")
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    path = f"{root}/{name}.{key}.{n}"
    laid = df.repartition(n, key).write.format("parquet").bucketBy(n, key).sortBy(key)
    laid.option("path", path).mode("error").saveAsTable(_registered(path))
    return path


def open_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """A table that ``write_bucketed`` has left, also in another session: the session's catalog learns its layout, no row is read."""
    _, key, buckets = path.rstrip("/").rpartition("/")[2].rsplit(".", 2)
    table = _registered(path.rstrip("/"))
    if not spark.catalog.tableExists(table):
        columns = spark.read.parquet(path).schema.toDDL()
        where = path.rstrip("/").replace("'", "\\'")
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {int(buckets)} BUCKETS LOCATION '{where}'")
    return spark.table(table)
