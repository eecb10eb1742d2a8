"""Shared work folder: where jobs cut lineage by writing a table and reading it back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    It is the session's ``spark.checkpoint.dir``.  Only where that setting is missing (local
    sessions, as in tests) a temporary folder is made and remembered in the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("sightline.work.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="sightline-")
        spark.conf.set("sightline.work.dir", found)
    return found.rstrip("/")


#: Folders that this process made, by session, for ``clear``.
_made: dict[str, list[str]] = {}


def _session(spark: SparkSession) -> str:
    return spark._jsparkSession.sessionUUID()


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return it as read from there.

    Later stages then start from stored files: nothing upstream runs twice, and a lost executor
    costs only the tasks that it held.
    """
    path = f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(_session(df.sparkSession), []).append(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Remove the files of a table that ``cut`` returned, once no later step reads it."""
    remove(df.sparkSession, df.stored_at)


def clear(spark: SparkSession) -> None:
    """Remove the tables that ``cut`` has made in this session so far.  To be called once results are written
    elsewhere, as results still read from these tables."""
    for path in _made.pop(_session(spark), []):
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared store."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
