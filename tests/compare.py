"""Run queries on Spark and DuckDB side by side: ``python tests/compare.py DIR [name ...]``."""

import datetime
import decimal
import glob
import math
import os
import sys
import tempfile
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def value(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    if isinstance(x, (datetime.date, datetime.datetime)):
        return str(x)
    return x


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(value(r[i]) for i in order) for r in rows), key=lambda r: tuple(str(v) for v in r)
    )


def duck(directory):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{directory}/*.parquet"):
        name = os.path.basename(f)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{f}')")
    return con


def spark_session(cores=8, partitions=8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("custlattice")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="custlattice-tests-"))
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def differences(spark, con, directory, name):
    """None when equal, else a short description."""
    import __spark_entry__ as e

    df = e.queries()[name](spark, directory)
    got = table(df.columns, df.collect())
    cur = con.execute(e.oracle_sql()[name])
    want = table([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows != {len(want[1])}"
    wrong = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    if wrong:
        a, b = wrong[0]
        cells = [(c, str(x)[:80], str(y)[:80]) for c, x, y in zip(got[0], a, b) if x != y]
        return f"{len(wrong)} of {len(want[1])} rows differ, first: {cells}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as e

    directory, names = sys.argv[1], sys.argv[2:] or list(e.queries())
    spark, con = spark_session(), duck(directory)
    bad = 0
    for n in names:
        t = time.time()
        try:
            d = differences(spark, con, directory, n)
        except Exception as ex:
            d = f"{type(ex).__name__}: {str(ex)[:600]}"
        spark.catalog.clearCache()
        bad += d is not None
        rows = "" if d else len(con.execute(e.oracle_sql()[n]).fetchall())
        print(f"{'ok  ' if d is None else 'FAIL'} {n} {rows} {time.time() - t:.1f}s {d or ''}", flush=True)
    print(f"{bad} of {len(names)} differ")
