"""Readers and writers for the fifteen tables, stored as Parquet directories.

Parquet has no row-level update, so a changed table is written as a new directory and published as a commit (see ``snapshots``);
readers take the newest commit, or one by name or number. A failed, retried or repeated write never touches a directory that is being read.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custlattice.functions.values import ts_lit
from custlattice.sources import snapshots
from custlattice.sources.schemas import SCHEMAS


def scratch_dir(spark: SparkSession) -> str:
    """A new folder on shared storage: below ``spark.checkpoint.dir``, or the folder the caller gave to
    ``SparkContext.setCheckpointDir``. Without either there is none, on any master."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def conform(df: DataFrame, table: str, as_of: datetime) -> DataFrame:
    """Order and type the columns as the table declares; fill the declared defaults."""
    defaults = {"status": F.lit("PENDING"), "suppressed": F.lit(False)} if table == "next_best_action" else {}
    columns = []
    for f in SCHEMAS[table].fields:
        default = defaults.get(f.name)
        if f.name in ("created_at", "updated_at", "scored_at", "enriched_at"):
            default = ts_lit(as_of)
        if f.name in df.columns:
            column = F.col(f.name)
            if default is not None:
                column = F.coalesce(column, default)
        else:
            column = default if default is not None else F.lit(None)
        columns.append(column.cast(f.dataType).alias(f.name))
    return df.select(columns)


def load(spark: SparkSession, root: str, table: str, version: str | int | None = None) -> DataFrame:
    """Typed scan. No inference: the declared schema is given to the reader.

    Of a table with versions the newest one is read, or the newest of a name, or the commit of a number. A table that is only appended to is its directory.
    """
    path = f"{root}/{table}"
    if isinstance(version, int):
        found = snapshots.read(spark, path, version)
    else:
        found = snapshots.newest(spark, path, lambda value: version is None or value["name"] == version)
    if found is None and version is not None:
        raise ValueError(f"{table} has no version {version}")
    return spark.read.schema(SCHEMAS[table]).parquet(f"{path}/{found.value['folder']}" if found else path)


def changes(spark: SparkSession, root: str, table: str, key: str, before: str | int, after: str | int | None = None) -> DataFrame:
    """(key, change): rows added, removed or changed from one version to another (by default the newest). Keys are unique and not NULL.

    Rows meet as hashes of their columns, so the exchange is narrow whatever the table holds.
    """
    columns = [f.name for f in SCHEMAS[table].fields if f.name != key]
    old, new = (load(spark, root, table, v).select(key, F.xxhash64(*columns).alias(name)) for v, name in ((before, "_old"), (after, "_new")))
    kind = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed")
    return old.join(new, key, "full").select(key, kind.alias("change")).filter(F.col("change").isNotNull())


def append(df: DataFrame, root: str, table: str, as_of: datetime) -> None:
    conform(df, table, as_of).write.mode("append").parquet(f"{root}/{table}")


def overwrite(df: DataFrame, root: str, table: str, as_of: datetime, partition_by: tuple = ()) -> None:
    """Truncate and reload. ``df`` must not read the table it replaces; use ``new_version`` then."""
    conform(df, table, as_of).write.mode("overwrite").partitionBy(*partition_by).parquet(f"{root}/{table}")


def new_version(
    df: DataFrame, root: str, table: str, as_of: datetime, version: str, cluster_by: tuple = ()
) -> DataFrame:
    """Write a complete new version of a table, publish it and read it back, which also ends its lineage.

    Every call writes a folder of its own and becomes the newest version, also under a name that is in use. ``cluster_by``
    range-partitions and sorts the files, so that a look-up by the first column skips almost all row groups; further columns split a first
    value that has very many rows.
    """
    spark = df.sparkSession
    rows = conform(df, table, as_of)
    if cluster_by:
        rows = rows.repartitionByRange(*cluster_by).sortWithinPartitions(*cluster_by)
    folder, path = f"{version}-{uuid.uuid4().hex}", f"{root}/{table}"
    rows.write.parquet(f"{path}/{folder}")
    while True:  # the versions are whole, so a writer that was overtaken just comes later
        try:
            snapshots.publish(spark, path, {"name": version, "folder": folder, "as_of": as_of.isoformat()}, snapshots.newest(spark, path))
            break
        except snapshots.Conflict:
            continue
    return spark.read.schema(SCHEMAS[table]).parquet(f"{path}/{folder}")


def delete_where(df: DataFrame, predicate) -> DataFrame:
    """Rows a SQL ``DELETE`` would keep: the predicate is false or NULL."""
    return df.filter(~F.coalesce(predicate, F.lit(False)))


def update_where(df: DataFrame, guard, **changes) -> DataFrame:
    """Guarded update: rows where ``guard`` is true take the new values."""
    fires = F.coalesce(guard, F.lit(False))
    return df.withColumns({c: F.when(fires, v).otherwise(F.col(c)) for c, v in changes.items()})


def merge_update(target: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """MERGE with only a matched-update branch. ``changes`` holds one row per key."""
    source = changes.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = target.join(source, key, "left")
    return joined.select(
        *[
            F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
            if c in columns
            else F.col(c)
            for c in target.columns
        ]
    )


def one_row(spark: SparkSession, **values) -> DataFrame:
    """A one-row literal relation."""
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
