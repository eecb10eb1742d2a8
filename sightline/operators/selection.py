"""Exact medians without all values of a group in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline.sources.work import cut

#: Buckets of a round; values of a group that are sorted at once in the end.
BUCKETS, SORTED = 1024, 10_000


def medians(rows: DataFrame, by: list[str], column: str, upper: bool = False, buckets: int = BUCKETS, most: int = SORTED) -> DataFrame:
    """``by, median`` for each group with a value: the middle one, or the mean of the two middle ones (with ``upper``
    the upper one of them).  Nulls and NaN don't count.

    Values are counted in ``buckets`` between the least and the greatest of their group, and the bucket that holds the
    middle is divided again, until it has ``most`` values or all are equal; only those are sorted.  A round is one pass
    over what is left of the rows, from which buckets' counts are shuffled.  ``rows`` is read several times and should be stored.
    """
    x = F.col(column).cast("double")
    values = rows.select(*by, x.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    ends = values.groupBy(*by).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("n"))
    wanted = F.array(F.floor(F.col("n") / 2)) if upper else F.array_distinct(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)))
    # rank of a wanted value among all of its group, and number of values before the bucket lo to hi
    targets = cut(ends.withColumn("rank", F.explode(wanted)).select(*by, "rank", "lo", "hi", "n", F.lit(0).cast("long").alias("before")), "targets")
    while True:
        large = (F.col("n") > most) & (F.col("lo") < F.col("hi"))
        if targets.where(large).isEmpty():
            break
        met = _within(values, targets.where(large), by)
        width = F.col("hi") / buckets - F.col("lo") / buckets
        bucket = F.least(F.lit(buckets - 1), F.floor((F.col("x") - F.col("lo")) / width)).cast("int")
        key = [*by, "rank"]
        counts = met.withColumn("bucket", bucket).groupBy(*key, "before", "bucket").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("n"))
        order = W.partitionBy(*key).orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
        counts = counts.withColumn("before", F.col("before") + F.sum("n").over(order) - F.col("n"))
        found = counts.where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n")))
        targets = cut(found.select(*targets.columns).unionByName(targets.where(~large)), "targets")
    equal = targets.where("lo = hi").select(*by, "rank", F.col("lo").alias("x"))
    small = _within(values, targets.where("lo < hi"), by).withColumn("at", F.row_number().over(W.partitionBy(*by, "rank").orderBy("x")) - 1 + F.col("before"))
    both = equal.unionByName(small.where("at = rank").select(*by, "rank", "x"))
    return both.groupBy(*by).agg((F.sum("x") / F.count("x")).alias("median"))


def _within(values: DataFrame, targets: DataFrame, by: list[str]) -> DataFrame:
    """The values in the bucket of each target of their group."""
    of = targets.select(*[F.col(k).alias(f"of_{k}") for k in by], "rank", "lo", "hi", "before")
    same = F.lit(True)
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    inside = (F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi"))
    return values.join(of, same & inside).drop(*[f"of_{k}" for k in by])
