"""A table of rows with a key, in which the last write of a key wins: one base, some deltas, and snapshots.

Layout of the table's folder:

* ``data/commit=<name>/bucket=N``: rows in buckets of their key's hash, with the number ``seq`` of their commit;
* ``snapshots/<number>.json``: the folders that make up the table after a commit.  Snapshots are numbered by the table,
  never by a stream's checkpoint, and are written after their data, so that readers see whole commits.

A commit adds a delta, or merges all into a new base once deltas hold more than ``SHARE`` of the base's rows or are
more than ``DELTAS``; so reading costs a bounded part more than the base.  A stream's batch that was committed before
(the same stream and batch number) is left out.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructType

#: Deltas are merged into a new base beyond this share of its rows, or this many.
SHARE, DELTAS = 0.3, 16
#: Buckets of a new table; a later commit keeps the table's own.
BUCKETS = 16
#: Snapshots, with their data, that ``vacuum`` keeps for readers.
KEPT = 3
_EMPTY = {"number": 0, "seq": 0, "base": None, "deltas": [], "streams": {}, "schema": None, "buckets": BUCKETS}


def _store(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _numbers(spark: SparkSession, path: str) -> list[int]:
    fs, where = _store(spark, f"{path}/snapshots")
    if not fs.exists(where):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(where)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def load_json(spark: SparkSession, path: str) -> dict | None:
    """A small file of the shared store; None if it isn't there, or not whole."""
    fs, where = _store(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    except ValueError:
        return None  # its writer has not finished, or never will
    finally:
        stream.close()


def save_json(spark: SparkSession, path: str, content: dict, overwrite: bool = True) -> None:
    fs, where = _store(spark, path)
    out = fs.create(where, overwrite)  # fails if it is there and not to be overwritten
    out.write(bytearray(json.dumps(content).encode()))
    out.close()


def _load(spark: SparkSession, path: str, number: int) -> dict | None:
    return load_json(spark, f"{path}/snapshots/{number:012d}.json")


def snapshot(spark: SparkSession, path: str, number: int | None = None) -> dict:
    """The newest whole snapshot, or that of a number; an empty one for a table that isn't there."""
    for n in [number] if number is not None else _numbers(spark, path)[::-1]:
        found = _load(spark, path, n)
        if found:
            return found
    if number is not None:
        raise FileNotFoundError(f"snapshot {number} of {path}")
    return dict(_EMPTY)


def _publish(spark: SparkSession, path: str, state: dict, after: int) -> dict:
    """Writes a snapshot with the next number; fails if another writer's came in since ``after``."""
    number = max([after, *_numbers(spark, path)]) + 1
    newer = [n for n in _numbers(spark, path) if n > after and _load(spark, path, n)]
    if newer:
        raise RuntimeError(f"another writer has committed snapshot {newer[-1]} of {path}")
    state = state | {"number": number}
    save_json(spark, f"{path}/snapshots/{number:012d}.json", state, overwrite=False)
    return state


def _write(rows: DataFrame, path: str, buckets: int, key: str) -> tuple[str, int]:
    name = f"commit={uuid.uuid4().hex}"
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    rows.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/data/{name}")
    return name, rows.sparkSession.read.parquet(f"{path}/data/{name}").count() if _has_files(rows.sparkSession, f"{path}/data/{name}") else 0


def _has_files(spark: SparkSession, path: str) -> bool:
    fs, where = _store(spark, path)
    return any(f.isDirectory() for f in fs.listStatus(where))


def _rows(spark: SparkSession, path: str, state: dict) -> DataFrame | None:
    """All rows of a snapshot with ``seq`` and ``bucket``, older writes of a key among them."""
    parts = ([state["base"]] if state["base"] else []) + state["deltas"]
    folders = [f"{path}/data/{p['name']}" for p in parts if p["rows"]]
    if not state["schema"]:
        return None
    schema = StructType.fromJson(json.loads(state["schema"])).add("seq", LongType()).add("bucket", IntegerType())
    if not folders:
        return spark.createDataFrame([], schema)
    stored = spark.read.schema(schema.add("commit", StringType())).option("basePath", f"{path}/data").parquet(*folders)
    return stored.drop("commit")


def _newest(rows: DataFrame, key: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in (key, "bucket")]
    best = rows.groupBy("bucket", key).agg(F.max_by(F.struct(*rest), F.col("seq")).alias("r"))
    return best.select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def commit(rows: DataFrame, path: str, key: str = "id", stream: str | None = None, number: int = -1) -> dict:
    """Adds ``rows``, one for each key, as the newest writes of their keys, and returns the new snapshot.

    ``stream`` and ``number``: of a stream's batch; one that the table has seen changes nothing.  An
    empty batch is committed as well.  One writer at a time: a second one fails and changes nothing.
    """
    spark = rows.sparkSession
    state = snapshot(spark, path)
    if stream is not None and state["streams"].get(stream, -1) >= number:
        return state
    seq = state["seq"] + 1
    name, n = _write(rows.withColumn("seq", F.lit(seq).cast("long")), path, state["buckets"], key)
    columns = StructType([f for f in rows.schema.fields])
    streams = state["streams"] | ({stream: number} if stream is not None else {})
    after = state["number"]
    state = state | {"seq": seq, "deltas": [*state["deltas"], {"name": name, "rows": n}], "streams": streams, "schema": columns.json()}
    held = sum(d["rows"] for d in state["deltas"])
    if held > SHARE * (state["base"] or {"rows": 0})["rows"] or len(state["deltas"]) > DELTAS:
        state = state | _merged(spark, path, state, key)
    return _publish(spark, path, state, after)


def _merged(spark: SparkSession, path: str, state: dict, key: str) -> dict:
    name, n = _write(_newest(_rows(spark, path, state), key), path, state["buckets"], key)
    return {"base": {"name": name, "rows": n}, "deltas": []}


def compact(spark: SparkSession, path: str, key: str = "id") -> dict:
    """Merges all deltas into a new base."""
    state = snapshot(spark, path)
    return _publish(spark, path, state | _merged(spark, path, state, key), state["number"]) if state["deltas"] else state


def read(spark: SparkSession, path: str, key: str = "id", number: int | None = None, keys: list | None = None) -> DataFrame:
    """The newest row of each key, of the newest snapshot or of a ``number``.

    ``keys``: only rows of these few keys; other buckets are not read.
    """
    state = snapshot(spark, path, number)
    rows = _rows(spark, path, state)
    if rows is None:
        raise FileNotFoundError(path)
    if keys is not None:
        kind = rows.schema[key].dataType
        some = spark.createDataFrame([(k,) for k in keys], StructType().add("k", kind)).select(F.pmod(F.xxhash64("k"), F.lit(state["buckets"])).cast("int"))
        rows = rows.where(F.col("bucket").isin([r[0] for r in some.collect()]) & F.col(key).isin(keys))
    return (_newest(rows, key) if state["deltas"] else rows).drop("seq", "bucket")


def vacuum(spark: SparkSession, path: str, kept: int = KEPT) -> int:
    """Removes snapshots but the last ``kept`` whole ones, and data that none of these names; returns how many folders
    went.  Not to be run while a writer is at work."""
    whole = [(n, s) for n in _numbers(spark, path) if (s := _load(spark, path, n))][-kept:]
    used = {p["name"] for _, s in whole for p in [*s["deltas"], *([s["base"]] if s["base"] else [])]}
    for n in _numbers(spark, path):
        if n < (whole[0][0] if whole else 0):
            fs, where = _store(spark, f"{path}/snapshots/{n:012d}.json")
            fs.delete(where, False)
    fs, where = _store(spark, f"{path}/data")
    gone = [f.getPath() for f in fs.listStatus(where) if f.getPath().getName() not in used] if fs.exists(where) else []
    for p in gone:
        fs.delete(p, True)
    return len(gone)
