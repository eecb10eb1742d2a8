"""Reading and writing around the jobs: video folders, query sets and result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Suffixes of video files, in lower case.
VIDEO_SUFFIXES = (".mp4", ".avi", ".mkv", ".mov", ".ts", ".dav")


def stem(path: Column) -> Column:
    """File name without folders and last suffix."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]+$", "")


def video_catalog(spark: SparkSession, folder: str, camera: str | None = None) -> DataFrame:
    """``path, video_id, camera_id, modification_time, length`` of the videos in a folder.

    Only file metadata is read.  An empty folder is an error.
    """
    files = spark.read.format("binaryFile").load(folder).select("path", F.col("modificationTime").alias("modification_time"), "length")
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    found = files.where(suffix.isin(*VIDEO_SUFFIXES))
    if found.isEmpty():
        raise FileNotFoundError(f"no video files in {folder}")
    name = stem(F.regexp_replace("path", "%20", " "))
    return found.select("path", name.alias("video_id"), (F.lit(camera) if camera else name).alias("camera_id"), "modification_time", "length").orderBy("path")


def recording_start(videos: DataFrame, durations: DataFrame) -> DataFrame:
    """Adds ``start_ts``: the file's time less its duration (``durations``: ``video_id, duration_s``)."""
    out = videos.join(durations, "video_id")
    return out.withColumn("start_ts", F.unix_micros("modification_time") / 1e6 - F.col("duration_s"))


_GOLDEN = T.StructType([T.StructField("video_id", T.StringType()), T.StructField("frame_idx", T.LongType())])
#: Schemas of the three kinds of query sets.
QUERY_SETS = {
    "retrieval": T.StructType(
        [
            T.StructField("id", T.StringType()),
            T.StructField("query", T.StringType()),
            T.StructField("gt_type", T.StringType()),
            T.StructField("scorable_recall", T.BooleanType()),
            T.StructField("relevant_videos", T.ArrayType(T.StringType())),
            T.StructField("golden_frame", _GOLDEN),
            T.StructField("category", T.StringType()),
            T.StructField("neg_type", T.StringType()),
            T.StructField("notes", T.StringType()),
        ]
    ),
    "end_to_end": T.StructType(
        [T.StructField(c, T.StringType()) for c in ("id", "query", "bucket", "expect", "forbid")]
        + [T.StructField("forbid_classes", T.ArrayType(T.StringType()))]
    ),
    "scene": T.StructType(
        [T.StructField(c, T.StringType()) for c in ("id", "query", "intent", "kind")] + [T.StructField("relevant_videos", T.ArrayType(T.StringType()))]
    ),
}


def load_query_set(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A query set from JSON lines, by its kind's schema; malformed lines are an error."""
    return spark.read.schema(QUERY_SETS[kind]).option("mode", "FAILFAST").json(path)


def write_results(tables: dict[str, DataFrame], folder: str, form: str = "parquet") -> None:
    """One folder of files for each result table."""
    for name, df in tables.items():
        df.write.mode("overwrite").format(form).save(f"{folder}/{name}")
