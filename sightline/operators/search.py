"""What happens to the hits of a query: gates, ranking, thinning and sighting events.

All windows here nest in ``query_id``: after one shuffle on it the later steps need no other.
``hits`` have ``query_id, variant, id, score, video_id, frame_idx, offset_s, ts, source``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline.params import DEFAULT, Params

#: The classes that are vehicles.
VEHICLES = ("bisiklet", "araba", "motosiklet", "otobüs", "kamyon")
GROUP = ("query_id", "variant")
#: Seconds of the slices of a video that tasks work on.
SLICE_S = 86_400.0


def not_found_gate(queries: DataFrame, inventory: DataFrame) -> DataFrame:
    """Adds ``missing`` (sorted classes that the query wants and the archive lacks), ``no_vehicle`` (any
    vehicle is wanted and there is none) and ``gated``.  ``inventory`` is one row for each class."""
    have = inventory.agg(F.collect_set("yolo_class").alias("have"))
    missing = F.array_sort(F.array_except("required", "have"))
    vehicles = F.array(*[F.lit(v) for v in VEHICLES])
    out = queries.crossJoin(F.broadcast(have))  # one row, as long as the classes are many
    return (
        out.withColumn("missing", missing)
        .withColumn("no_vehicle", (F.size("missing") == 0) & F.col("generic_vehicle") & ~F.arrays_overlap("have", vehicles))
        .withColumn("gated", (F.size("missing") > 0) | F.col("no_vehicle"))
        .drop("have")
    )


def intent_rerank(hits: DataFrame, boost: Column | float = DEFAULT.scene_boost, keys: tuple[str, ...] = GROUP) -> DataFrame:
    """Adds ``rank_score``: for scene queries the standardised score plus ``boost`` for whole frames; else,
    or where scores hardly differ, the score.  ``hits`` carry ``intent``."""
    boost = F.lit(boost) if not isinstance(boost, Column) else boost
    w = W.partitionBy(*keys)
    mean, dev = F.avg("score").over(w), F.stddev_pop("score").over(w)
    z = (F.col("score") - mean) / dev + F.when(F.col("source") == "frame", boost).otherwise(0.0)
    boosted = (F.col("intent") == "scene") & (boost > 0) & (dev >= 1e-6)
    return hits.withColumn("rank_score", F.when(boosted, z).otherwise(F.col("score")))


def one_per_frame(hits: DataFrame, keys: tuple[str, ...] = GROUP) -> DataFrame:
    """The best hit of each frame; of equal ones the higher score, then the smaller id."""
    w = W.partitionBy(*keys, "video_id", "frame_idx").orderBy(F.desc("rank_score"), F.desc("score"), "id")
    return hits.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def suppress_near(hits: DataFrame, window_s: float = DEFAULT.group_window_s, keys: tuple[str, ...] = GROUP) -> DataFrame:
    """Hits that no better kept hit of the same video is nearer to than ``window_s``.

    A greedy fold over the hits of one query and video, best first.  Videos do not touch each other,
    so the folds are independent; a group holds at most the query's fetched hits.
    """
    rest = [c for c in hits.columns if c not in (*keys, "video_id")]
    entry = F.struct((-F.col("rank_score")).alias("o1"), (-F.col("score")).alias("o2"), F.col("id").alias("o3"), F.struct(*rest).alias("h"))
    grouped = hits.groupBy(*keys, "video_id").agg(F.array_sort(F.collect_list(entry)).alias("hits"))
    kind = dict(grouped.select(F.col("hits.h").alias("h")).dtypes)["h"]
    near = lambda kept, x: F.exists(kept, lambda y: F.abs(y["offset_s"] - x["h"]["offset_s"]) < window_s)
    kept = F.aggregate(
        "hits", F.array().cast(kind), lambda acc, x: F.when(near(acc, x), acc).otherwise(F.concat(acc, F.array(x["h"])))
    )
    return grouped.select(*keys, "video_id", F.explode(kept).alias("h")).select(*keys, "video_id", "h.*")


def ranked(hits: DataFrame, k: int | None = None, keys: tuple[str, ...] = GROUP) -> DataFrame:
    """Adds ``rank`` from 1 by rank score (then score, then id), and keeps the first ``k``."""
    w = W.partitionBy(*keys).orderBy(F.desc("rank_score"), F.desc("score"), "id")
    out = hits.withColumn("rank", F.row_number().over(w))
    return out.where(F.col("rank") <= k) if k else out


def thin(hits: DataFrame, p: Params = DEFAULT, keys: tuple[str, ...] = GROUP) -> DataFrame:
    """One hit a frame, none near a better one, the first ``top_k``."""
    return ranked(suppress_near(one_per_frame(hits, keys), p.group_window_s, keys), p.top_k, keys)


def sighting_events(
    sightings: DataFrame, gap_s: float = DEFAULT.event_gap_s, keys: tuple[str, ...] = (), slice_s: float = SLICE_S
) -> DataFrame:
    """Runs of sightings in one video with no gap above ``gap_s``: ``event_no``, ``first_ts``, ``last_ts``,
    ``n`` and the representative ``rep_id``, ``rep_score`` (best score, then earliest, then smallest id).

    They are intervals in which something was seen; nothing is said about one object being tracked.  A sighting
    without ``ts`` is an event of its own, before all others.

    A video is worked on in slices of ``slice_s`` seconds, by as many tasks: runs are found within slices, and a table
    with one row for each slice tells which of them go on from one slice to the next.
    """
    by = [*keys, "video_id"]
    sliced = sightings.withColumn("slice", F.floor(F.col("ts") / slice_s))
    w = W.partitionBy(*by, "slice").orderBy("ts", "id")
    new = F.when(F.col("ts") - F.lag("ts").over(w) <= gap_s, 0).otherwise(1)
    marked = sliced.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    rep = F.min(F.struct((-F.col("score")).alias("s"), F.col("ts").alias("t"), F.col("id").alias("id")))
    runs = marked.groupBy(*by, "slice", "run").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"), rep.alias("rep"))
    # one row for each slice: its ends, its runs
    slices = runs.groupBy(*by, "slice").agg(F.min("first_ts").alias("a"), F.max("last_ts").alias("z"), F.count(F.lit(1)).alias("runs"))
    order = W.partitionBy(*by).orderBy("slice")
    goes_on = F.coalesce((F.col("a") - F.lag("z").over(order) <= gap_s).cast("int"), F.lit(0))
    before = F.sum(F.col("runs") - F.col("goes_on")).over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("runs")
    slices = slices.withColumn("goes_on", goes_on).select(*[F.col(k).alias(f"of_{k}") for k in by], F.col("slice").alias("of_slice"), before.alias("before"))
    same = [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in (*by, "slice")]
    numbered = runs.join(slices, same).withColumn("event_no", F.col("before") + F.col("run"))
    return (
        numbered.groupBy(*by, "event_no")
        .agg(F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("n").alias("n"), F.min("rep").alias("rep"))
        .select(*by, "event_no", "first_ts", "last_ts", "n", F.col("rep.id").alias("rep_id"), (-F.col("rep.s")).alias("rep_score"))
    )


def clock(ts: Column) -> Column:
    return F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd HH:mm:ss")


def event_labels(events: DataFrame) -> DataFrame:
    """Adds ``label``: one instant, or first and last instant with whole seconds and number of frames."""
    instant = (F.col("n") == 1) | (F.col("first_ts") == F.col("last_ts"))
    span = F.format_string(
        "%s – %s (%d s, %d)", clock(F.col("first_ts")), clock(F.col("last_ts")), (F.col("last_ts") - F.col("first_ts")).cast("int"), F.col("n")
    )
    return events.withColumn("label", F.when(instant, clock(F.col("first_ts"))).otherwise(span))


def hit_listing(hits: DataFrame) -> DataFrame:
    """Readable columns of ranked hits: rank, score to three places, kind, video, time, offset mm:ss.s."""
    tenths = F.round(F.col("offset_s") * 10).cast("long")
    offset = F.format_string("%02d:%02d.%d", F.floor(tenths / 600), F.floor(tenths % 600 / 10), tenths % 10)
    return hits.select(
        "query_id", "variant", "rank", (F.round("score", 3) + 0.0).alias("score"), "source", "video_id", clock(F.col("ts")).alias("time"), offset.alias("offset")
    )
