"""Numbered commits of small facts in a shared folder: each number is written once, so of two writers that started from the
same commit one is refused and a reader sees a whole commit or the one before it."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

_FOLDER = "_commits"


class StaleWriterError(RuntimeError):
    """Another writer has committed since this one looked."""


def _path(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _path(spark, path)
    return fs.exists(at)


def complete(spark: SparkSession, table: str) -> bool:
    """Spark's writer marks a whole table by a file of its own, last of all."""
    return exists(spark, f"{table}/_SUCCESS")


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _path(spark, path)
    fs.delete(at, True)


def moved_once(spark: SparkSession, staged: str, target: str) -> bool:
    """staged gets the name target, unless that is taken. The file system does both in one step, as HDFS does."""
    fs, at = _path(spark, target)
    fs.mkdirs(at.getParent())
    jvm = spark.sparkContext._jvm
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(_path(spark, staged)[1], at, options)
    except Exception as e:
        if fs.exists(at) and exists(spark, staged):
            return False
        raise e
    return True


def latest(spark: SparkSession, root: str) -> tuple[int, dict]:
    """(number, facts) of the last commit; (0, {}) if there is none."""
    fs, at = _path(spark, f"{root}/{_FOLDER}")
    if not fs.exists(at):
        return 0, {}
    numbers = [int(s.getPath().getName().removesuffix(".json")) for s in fs.listStatus(at) if s.getPath().getName().endswith(".json")]
    if not numbers:
        return 0, {}
    text = spark.read.text(f"{root}/{_FOLDER}/{max(numbers):012d}.json", wholetext=True).head()["value"]
    return max(numbers), json.loads(text)


def commit(spark: SparkSession, root: str, after: int, facts: dict) -> int:
    """Write the commit that follows the one numbered `after`, or raise StaleWriterError if that has a follower already."""
    staged = f"{root}/_staged-{uuid.uuid4().hex}"
    fs, at = _path(spark, staged)
    out = fs.create(at, True)
    out.write(bytearray(json.dumps(facts, sort_keys=True).encode()))
    out.close()
    if not moved_once(spark, staged, f"{root}/{_FOLDER}/{after + 1:012d}.json"):
        remove(spark, staged)
        raise StaleWriterError(f"commit {after + 1} of {root} is another writer's")
    return after + 1
