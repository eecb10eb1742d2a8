"""Scoring of searches against labelled queries.

``hits``: ``query_id, variant, rank, score, video_id, frame_idx, source, yolo_class``.
``labels``: ``query_id, gt_type, category, scorable, golden_video, golden_frame``.
``relevant``: ``query_id, video_id``, one row for each relevant video.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline.operators.selection import medians
from sightline.sources.work import cut

CUTS = (1, 5, 10)
#: Fixed value: the normal quantile of a 95 % interval.
Z = 1.96


def first_ranks(labels: DataFrame, hits: DataFrame, relevant: DataFrame, variants: tuple[str, ...]) -> DataFrame:
    """``query_id, variant, rank, golden_rank, scene_rank``: first rank of a hit in a relevant video, of the
    golden frame, and of a whole frame in a relevant video; null where there is none."""
    good = hits.join(relevant.withColumn("__rel", F.lit(True)), ["query_id", "video_id"], "left")
    good = good.join(labels.select("query_id", "golden_video", "golden_frame"), "query_id")
    is_rel = F.col("__rel").isNotNull()
    golden = (F.col("video_id") == F.col("golden_video")) & (F.col("frame_idx") == F.col("golden_frame"))
    ranks = good.groupBy("query_id", "variant").agg(
        F.min(F.when(is_rel, F.col("rank"))).alias("rank"),
        F.min(F.when(golden, F.col("rank"))).alias("golden_rank"),
        F.min(F.when(is_rel & (F.col("source") == "frame"), F.col("rank"))).alias("scene_rank"),
    )
    every = labels.select("query_id", F.explode(F.array(*[F.lit(v) for v in variants])).alias("variant"))
    return every.join(ranks, ["query_id", "variant"], "left")


def reciprocal(rank: str) -> Column:
    return F.coalesce(1.0 / F.col(rank), F.lit(0.0))


def recall_at(rank: str, cut: int) -> Column:
    """1 if the first rank is within the cut, else 0."""
    return F.coalesce((F.col(rank) <= cut).cast("int"), F.lit(0))


def wilson(hits: Column, n: Column) -> tuple[Column, Column]:
    """Wilson score interval of a share, within 0 and 1; (0, 0) of nothing."""
    p, zz = hits / n, Z * Z
    mid = (p + zz / (2 * n)) / (1 + zz / n)
    half = Z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    empty = n == 0
    return F.when(empty, 0.0).otherwise(F.greatest(F.lit(0.0), mid - half)), F.when(empty, 0.0).otherwise(F.least(F.lit(1.0), mid + half))


def blocks(scored: DataFrame) -> DataFrame:
    """Recall at each cut with interval, and mean reciprocal rank, by block and variant.

    ``scored`` is ``first_ranks`` joined with the labels.  Blocks: ``video`` (rank of a relevant video),
    ``golden`` (queries with a golden frame) and ``all`` (both).  Each variant has its own mean
    reciprocal rank.
    """
    rows = scored.where("scorable").select(
        "query_id",
        "variant",
        F.explode(
            F.array(
                F.struct(F.lit("video").alias("block"), F.col("rank").alias("r"), F.col("golden_video").isNull().alias("on")),
                F.struct(F.lit("golden").alias("block"), F.col("golden_rank").alias("r"), F.col("golden_video").isNotNull().alias("on")),
                F.struct(
                    F.lit("all").alias("block"),
                    F.when(F.col("golden_video").isNotNull(), F.col("golden_rank")).otherwise(F.col("rank")).alias("r"),
                    F.lit(True).alias("on"),
                ),
            )
        ).alias("b"),
    ).where("b.on").select("variant", "b.block", "b.r")
    out = rows.groupBy("block", "variant").agg(
        F.count(F.lit(1)).alias("n"), F.avg(reciprocal("r")).alias("mrr"), *[F.sum(recall_at("r", c)).alias(f"hits_{c}") for c in CUTS]
    )
    for c in CUTS:
        low, high = wilson(F.col(f"hits_{c}"), F.col("n"))
        out = out.withColumns({f"recall_{c}": F.col(f"hits_{c}") / F.col("n"), f"low_{c}": low, f"high_{c}": high})
    return out.drop(*[f"hits_{c}" for c in CUTS])


def macro_recall(scored: DataFrame, cut: int = 5, rank: str = "rank") -> DataFrame:
    """Mean over categories of each category's recall, by variant."""
    per = scored.where("scorable").groupBy("variant", "category").agg(F.avg(recall_at(rank, cut)).alias("r"))
    return per.groupBy("variant").agg(F.avg("r").alias("macro_recall"), F.count(F.lit(1)).alias("categories"))


def crop_margin(scored: DataFrame, cut: int = 5, rank: str = "rank") -> DataFrame:
    """What crops add: recall of the combined variant less that of frames alone, one row."""
    of = lambda v: F.avg(F.when(F.col("variant") == v, recall_at(rank, cut)))
    return scored.where("scorable").agg(of("all").alias("combined"), of("frame").alias("frame")).withColumn(
        "margin", F.col("combined") - F.col("frame")
    )


def miss_attribution(scored: DataFrame, pool: DataFrame, cut: int = 10) -> DataFrame:
    """For golden frames missed by the combined variant: ``dedup`` if the fetched pool had them, else
    ``retrieval``."""
    missed = scored.where((F.col("variant") == "all") & F.col("golden_video").isNotNull() & (recall_at("golden_rank", cut) == 0))
    had = pool.where("variant = 'all'").select(
        "query_id", F.col("video_id").alias("golden_video"), F.col("frame_idx").alias("golden_frame"), F.lit(True).alias("__had")
    ).distinct()
    out = missed.join(had, ["query_id", "golden_video", "golden_frame"], "left")
    return out.select("query_id", F.when(F.col("__had"), "dedup").otherwise("retrieval").alias("cause"))


def top_hits(hits: DataFrame, n: int = 5) -> DataFrame:
    """The best hit and the videos of the first ``n``, of the combined variant."""
    some = hits.where((F.col("variant") == "all") & (F.col("rank") <= n))
    listed = F.array_sort(F.collect_list(F.struct("rank", "video_id", "source", "score")))
    out = some.groupBy("query_id").agg(listed.alias("top"), F.max(F.when(F.col("rank") == 1, F.col("yolo_class"))).alias("top1_class"))
    return out.select(
        "query_id", F.col("top")[0]["video_id"].alias("top1_video"), F.col("top")[0]["score"].alias("top1_score"), "top1_class",
        F.array_join(F.transform("top", lambda t: t["video_id"]), ",").alias("videos"),
    )


def negatives(labels: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row: negatives gated and in all, their rate, and the scorable queries that were gated by mistake.
    ``gated_queries`` names them."""
    o = _with_gates(labels, outcomes)
    neg = F.col("gt_type") == "negatif"
    counts = o.agg(
        F.count_if(neg & F.col("g")).alias("gated"), F.count_if(neg).alias("negatives"), F.count_if(F.col("scorable") & F.col("g")).alias("false_gates")
    )
    return counts.withColumn("rate", F.try_divide("gated", "negatives"))


def gated_queries(labels: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The negatives that were gated, and the scorable queries that were gated by mistake (not ``right``)."""
    o = _with_gates(labels, outcomes).where(F.col("g") & ((F.col("gt_type") == "negatif") | F.col("scorable")))
    return o.select("query_id", "gt_type", (~F.col("scorable")).alias("right"))


def _with_gates(labels: DataFrame, outcomes: DataFrame) -> DataFrame:
    return labels.join(outcomes.select("query_id", "gated"), "query_id", "left").withColumn("g", F.coalesce("gated", F.lit(False)))


def score_separation(labels: DataFrame, tops: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row: least top score of the scorable queries, largest of the negatives that were not gated, and
    the margin between them."""
    o = labels.join(tops, "query_id").join(outcomes.select("query_id", "gated"), "query_id", "left")
    pos = F.min(F.when(F.col("scorable"), F.col("top1_score")))
    neg = F.max(F.when((F.col("gt_type") == "negatif") & ~F.coalesce("gated", F.lit(False)), F.col("top1_score")))
    return o.agg(pos.alias("least_positive"), neg.alias("largest_negative")).withColumn("margin", F.col("least_positive") - F.col("largest_negative"))


def composition(labels: DataFrame) -> DataFrame:
    """Queries of each type, and the scorable ones."""
    return labels.groupBy("gt_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("scorable").alias("scorable"))


def time_audit(parsed: DataFrame, labels: DataFrame) -> DataFrame:
    """How time words were read, for queries about time and scene queries that mention the night."""
    about = (F.col("gt_type") == "zaman") | ((F.col("gt_type") == "scene") & F.lower("raw_query").contains("gece"))
    return parsed.join(labels.select("query_id", "gt_type"), "query_id").where(about).select("query_id", "gt_type", "visual_text", "time_phrase")


def check_targets(metrics: DataFrame, targets: list[tuple[str, float]]) -> DataFrame:
    """``metrics`` (``metric, value``) against targets declared beforehand: ``met`` if not below."""
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(float(t)).alias("target")) for m, t in targets])).alias("t")
    goals = metrics.sparkSession.range(1).select(rows).select("t.*")
    return goals.join(metrics, "metric", "left").withColumn("met", F.coalesce(F.col("value") >= F.col("target"), F.lit(False)))


def z_gap(pool: DataFrame, relevant: DataFrame, k: int = 40) -> DataFrame:
    """How far the best crop stands above the best relevant whole frame in the first ``k`` fetched hits, in
    standard deviations: 0 if no crop is above it, null if there is no such frame."""
    some = pool.where((F.col("variant") == "all") & (F.col("pos") <= k))
    w = W.partitionBy("query_id")
    z = (F.col("score") - F.avg("score").over(w)) / F.nullif(F.stddev_pop("score").over(w), F.lit(0.0))
    marked = some.withColumn("z", z).join(relevant.withColumn("__rel", F.lit(True)), ["query_id", "video_id"], "left")
    frame = F.max(F.when((F.col("source") == "frame") & F.col("__rel"), F.col("z"))).over(w)
    crop = F.max(F.when((F.col("source") == "crop") & (F.col("z") > F.col("frame_z")), F.col("z")))
    out = marked.withColumn("frame_z", frame).groupBy("query_id").agg(F.first("frame_z").alias("frame_z"), crop.alias("crop_z"))
    return out.select("query_id", F.when(F.col("frame_z").isNotNull(), F.coalesce(F.col("crop_z") - F.col("frame_z"), F.lit(0.0))).alias("z_gap"))


def upper_median(values: DataFrame, column: str) -> DataFrame:
    """The middle value, or the upper one of the two middle values, one row.  Nulls don't count."""
    values = cut(values.select(F.lit(0).alias("one"), F.col(column).alias("x")), "values")
    n = values.agg(F.lit(0).alias("one"), F.count("x").alias("n"))
    return n.join(medians(values, ["one"], "x", upper=True), "one", "left").select((F.col("median") + 0.0).alias("median"), "n")


def accuracy(pairs: DataFrame) -> DataFrame:
    """One row: share of rows whose ``predicted`` is ``expected``, their number, and how many differ."""
    ok = F.col("predicted").eqNullSafe(F.col("expected"))
    return pairs.agg(F.avg(ok.cast("int")).alias("accuracy"), F.count(F.lit(1)).alias("n"), F.count_if(~ok).alias("differing"))


def differing(pairs: DataFrame) -> DataFrame:
    """The rows whose ``predicted`` is not ``expected``."""
    return pairs.where(~F.col("predicted").eqNullSafe(F.col("expected")))


def outcome_axis(expected: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``got`` (``not_found`` or ``has_results``) and ``passed`` of each query with an expectation."""
    o = expected.join(outcomes.select("query_id", "n_hits", "not_found_reason"), "query_id", "left")
    got = F.when(F.col("not_found_reason").isNotNull() | (F.coalesce("n_hits", F.lit(0)) == 0), "not_found").otherwise("has_results")
    return o.withColumn("got", got).withColumn("passed", (F.col("expect") == "any") | (F.col("expect") == F.col("got"))).select(
        "query_id", "bucket", "expect", "got", "passed"
    )


def leak_axis(forbidden: DataFrame, hits: DataFrame) -> DataFrame:
    """Crops of a forbidden class among kept (``leaked``) and filtered (``caught``) hits of each query.

    ``ok`` if nothing leaked, null where verification was down; ``vacuous`` if nothing was there to leak.
    ``forbidden``: ``query_id, yolo_class``; ``hits``: with ``status`` and ``unavailable``.
    """
    bad = hits.where("source = 'crop'").join(forbidden, ["query_id", "yolo_class"])
    per = bad.groupBy("query_id").agg(F.count_if(F.col("status") == "kept").alias("leaked"), F.count_if(F.col("status") == "filtered").alias("caught"))
    down = hits.groupBy("query_id").agg(F.bool_or("unavailable").alias("down"))
    out = forbidden.select("query_id").distinct().join(per, "query_id", "left").join(down, "query_id", "left").na.fill(0, ["leaked", "caught"])
    return out.select(
        "query_id", "leaked", "caught", F.when(~F.coalesce("down", F.lit(False)), F.col("leaked") == 0).alias("ok"),
        ((F.col("leaked") == 0) & (F.col("caught") == 0)).alias("vacuous"),
    )


def bucket_rates(axis: DataFrame) -> DataFrame:
    """Passed, number and percentage of each bucket, and of all (null bucket)."""
    return axis.rollup("bucket").agg(F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("n")).withColumn(
        "percent", F.round(100.0 * F.col("passed") / F.col("n"), 1)
    )


def paired_runs(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two runs of the same queries (``query_id, hit``): agreeing and discordant counts, queries in one run
    only, and McNemar's statistic with continuity correction (null without discordant pairs)."""
    b, a = before.select("query_id", F.col("hit").alias("was")), after.select("query_id", F.col("hit").alias("now"))
    j = b.join(a, "query_id", "full_outer")
    out = j.agg(
        F.count_if(F.col("was") & F.col("now")).alias("both"),
        F.count_if(~F.col("was") & F.col("now")).alias("gained"),
        F.count_if(F.col("was") & ~F.col("now")).alias("lost"),
        F.count_if(~F.col("was") & ~F.col("now")).alias("neither"),
        F.count_if(F.col("was").isNull() | F.col("now").isNull()).alias("unpaired"),
    )
    d = F.col("gained") + F.col("lost")
    return out.withColumn("mcnemar", F.when(d > 0, F.pow(F.greatest(F.abs(F.col("gained") - F.col("lost")) - 1, F.lit(0)), F.lit(2.0)) / d))


def answer_tally(answers: DataFrame) -> DataFrame:
    """Answers by variant, object and colour: yes to presence, yes to colour, invalid, all."""
    yes = lambda k: F.count_if((F.col("kind") == k) & F.lower(F.trim("answer")).startswith("y"))
    return answers.groupBy("variant", "object_en", "color_en").agg(
        yes("presence").alias("present"), yes("color").alias("colored"), F.count_if(F.col("answer").isNull()).alias("invalid"), F.count(F.lit(1)).alias("n")
    )


def repeat_agreement(answers: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Inputs asked more than once, and those that got the same answer each time, one row."""
    per = answers.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("times"), (F.min("answer").eqNullSafe(F.max("answer")) & (F.count("answer").isin(0) | (F.count("answer") == F.count(F.lit(1))))).alias("same")
    ).where("times > 1")
    return per.agg(F.count(F.lit(1)).alias("repeated"), F.count_if("same").alias("agreeing"))


def latency(calls: DataFrame, column: str = "seconds") -> DataFrame:
    """Calls of each kind: number, median, least, most, mean."""
    calls = cut(calls.select("kind", F.col(column).alias("x")), "calls")
    middle = medians(calls, ["kind"], "x").withColumnRenamed("kind", "of")
    counts = calls.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("least"), F.max("x").alias("most"), F.avg("x").alias("mean"))
    return counts.join(middle, F.col("kind").eqNullSafe(F.col("of")), "left").select("kind", "n", "median", "least", "most", "mean")


def negative_detail(labels: DataFrame, tops: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Each negative query: its kind, whether it was gated, and what stood first."""
    o = labels.where("gt_type = 'negatif'").join(outcomes.select("query_id", "gated"), "query_id", "left").join(tops, "query_id", "left")
    return o.select("query_id", "category", F.coalesce("gated", F.lit(False)).alias("gated"), "top1_score", "top1_class")
