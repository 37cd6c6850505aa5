"""Commits: which folders make up a table, as numbered entries of which the newest one counts.

An entry is written aside and renamed to its number, which fails if that number is taken, so readers see a whole entry or none and of two
writers that start from the same state one is refused. Data folders are never written twice; an entry only names them.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession

COMMITS = "_commits"


class Conflict(RuntimeError):
    """Another writer has committed since the state was read."""


@dataclass(frozen=True)
class Commit:
    number: int
    value: dict


def _hadoop(spark: SparkSession, root: str):
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{root}/{COMMITS}")
    return jvm, folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def numbers(spark: SparkSession, root: str) -> list[int]:
    _, folder, fs = _hadoop(spark, root)
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())


def read(spark: SparkSession, root: str, number: int) -> Commit:
    jvm, folder, fs = _hadoop(spark, root)
    stream = fs.open(jvm.org.apache.hadoop.fs.Path(folder, f"{number:012d}.json"))
    try:
        return Commit(number, json.loads(bytes(stream.readAllBytes()).decode()))
    finally:
        stream.close()


def newest(spark: SparkSession, root: str, where=lambda value: True) -> Commit | None:
    """The newest commit whose value meets a condition, or None."""
    for number in reversed(numbers(spark, root)):
        found = read(spark, root, number)
        if where(found.value):
            return found
    return None


def publish(spark: SparkSession, root: str, value: dict, after: Commit | None) -> Commit:
    """Make `value` the newest state. `after` is the state it was made from (None: there was none); if that is not the newest one any more, `Conflict`."""
    jvm, folder, fs = _hadoop(spark, root)
    number = after.number + 1 if after else 0
    aside = jvm.org.apache.hadoop.fs.Path(folder, f".{uuid.uuid4().hex}")
    stream = fs.create(aside, False)
    stream.write(json.dumps(value, sort_keys=True).encode())
    stream.close()
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(folder.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(aside), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(folder, f"{number:012d}.json")), options)
    except Exception as e:
        if "FileAlreadyExistsException" in str(e):
            fs.delete(aside, False)
            raise Conflict(f"{root} has a commit {number} already") from e
        raise
    return Commit(number, value)
