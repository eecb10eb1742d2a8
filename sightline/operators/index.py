"""The vector index: deterministic ids, idempotent upsert, inventories and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline.sources.work import cut

#: Fixed value: the URL namespace of name-based UUIDs.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """Name-based (SHA-1) UUID of a string column, as text."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.instr(F.lit("0123456789abcdef"), F.substring(h, 17, 1)), F.lit(1))
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)),
        F.substring(h, 21, 12),
    )


def point_ids(points: DataFrame, prefix: str) -> DataFrame:
    """Adds ``id``: from video and frame for frames, and from the crop's ordinal ``k`` too for crops."""
    base = F.concat_ws(":", F.lit(prefix), F.col("video_id"), F.col("frame_idx").cast("string"))
    name = F.when(F.col("source") == "crop", F.concat_ws(":", base, F.lit("crop"), F.col("k").cast("string"))).otherwise(base)
    return points.withColumn("id", uuid5(name))


def upsert_latest(batches: DataFrame, key: str = "id", order: str = "batch_no") -> DataFrame:
    """The row of the latest batch for each key; of several in that batch, the one with the greatest
    other columns, in their order, so that the result does not depend on the order of rows.

    One shuffle on the key.  ``max_by`` combines before it, so a key that comes in many batches is
    no hot spot.
    """
    rest = [c for c in batches.columns if c != key]
    best = batches.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order])).alias("r"))
    return best.select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def write_points(points: DataFrame, path: str, merge_with: DataFrame | None = None, files_per_video: int = 1) -> None:
    """Replace the stored points of the videos in ``points``; with ``merge_with`` (the stored points)
    keep those points of theirs that were not sent again."""
    points = cut(points, "points")  # read twice below; what made them runs once
    if merge_with is not None:
        old = merge_with.join(points.select("video_id").distinct(), "video_id", "left_semi")
        both = old.withColumn("batch_no", F.lit(0)).unionByName(points.withColumn("batch_no", F.lit(1)))
        points = upsert_latest(both).drop("batch_no")
    spread = F.pmod(F.hash("id"), F.lit(files_per_video))
    (
        points.repartition("video_id", spread)
        .write.partitionBy("video_id")
        .option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
        .parquet(path)
    )


def link_crops(crops: DataFrame, frames: DataFrame) -> DataFrame:
    """Crops with their parent frame's camera, times and thumbnail, by video and frame number."""
    parent = frames.select("video_id", "frame_idx", "camera_id", "ts", "offset_s", "thumb_path")
    return crops.join(parent, ["video_id", "frame_idx"])


def class_inventory(points: DataFrame) -> DataFrame:
    """Distinct detected classes; reads one column of the crops."""
    return points.where("source = 'crop' and yolo_class <> ''").select("yolo_class").distinct()


def index_summary(points: DataFrame) -> DataFrame:
    """Frames and crops of each video, and of all (null video)."""
    return points.rollup("video_id").agg(
        F.count_if(F.col("source") == "frame").alias("frames"), F.count_if(F.col("source") == "crop").alias("crops")
    )


def corpus_manifest(points: DataFrame) -> DataFrame:
    """Points of each video in all and by source, a total row (null video), and the classes seen."""
    return points.rollup("video_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("source") == "frame").alias("frame"),
        F.count_if(F.col("source") == "crop").alias("crop"),
        F.array_join(F.array_sort(F.collect_set("yolo_class")), ",").alias("classes"),
    )


def class_by_video(points: DataFrame, classes: list[str]) -> DataFrame:
    """Crops of each video and class, one column for each of ``classes``."""
    crops = points.where("source = 'crop'")
    return crops.groupBy("video_id").pivot("yolo_class", classes).count().na.fill(0)


def unique_latest(points: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """First row of each key in ``order``, for keys whose rows compare by more than one column."""
    w = W.partitionBy(key).orderBy(*order)
    return points.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
