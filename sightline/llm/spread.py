"""Joins with a table of unique keys, where one key may hold a large share of the other table's rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.sources.work import cut, discard

#: Rows of one key that one task takes, and the part of all rows that a key holds at least to be split.
#: So at most ``PARTS`` keys are split, and only those are broadcast.
ROWS, PARTS = 20_000, 20_000


def _same(df: DataFrame) -> DataFrame:
    return df


def join_spread(
    left: DataFrame,
    right: DataFrame,
    key: str,
    counts: DataFrame | None = None,
    then: Callable[[DataFrame], DataFrame] = _same,
    rows: int | None = None,
) -> DataFrame:
    """Inner join on ``key``, which is unique in ``right``.  Keys with many rows in ``left`` are dealt
    over several tasks, each with a copy of the key's row of ``right``.

    ``left`` is read twice and should be stored.  ``counts``: its ``key, rows`` if known.  ``then`` is
    applied to the rows of ``left`` before the join.  ``rows``: of one key that one task takes, for wide
    rows fewer than ``ROWS``.
    """
    if counts is None:
        counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    total = counts.agg(F.sum("rows")).first()[0] or 0
    most = max(rows or ROWS, total // PARTS)
    if total <= most:
        return then(left).join(right, key)
    hot = cut(counts.where(F.col("rows") > most).select(key, F.ceil(F.col("rows") / most).cast("int").alias("copies")), "hot")
    if hot.isEmpty():
        discard(hot)
        return then(left).join(right, key)
    others = [c for c in left.columns if c != key]
    dealt = left.join(F.broadcast(hot), key).withColumn("salt", F.pmod(F.xxhash64(*others), "copies").cast("int")).drop("copies")
    copied = right.join(F.broadcast(hot), key).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    cold = then(left.join(F.broadcast(hot), key, "left_anti")).join(right, key)
    return cold.unionByName(then(dealt).join(copied, [key, "salt"]).drop("salt"))
