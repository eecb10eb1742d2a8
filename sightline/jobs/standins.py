"""Stand-in tables with the jobs' schemas, derived from the generic test tables.

Each has a Spark form and the same as a DuckDB common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_TS = 1704067200
#: Labels of the embeddings table become classes.
CLASS_OF = ("insan", "araba", "kamyon", "otobüs", "bisiklet", "motosiklet")
EVERY = 50  # embeddings whose number it divides serve as query vectors


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def idx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index points: one in four embeddings is a frame, the others are its crops."""
    e = read(spark, sf_dir, "embeddings")
    grp = F.floor(F.col("vec_id") / 4)
    is_frame = F.col("vec_id") % 4 == 0
    classes = F.array(*[F.lit(c) for c in CLASS_OF])
    return e.select(
        "vec_id",
        F.concat(F.lit("p"), F.lpad(F.col("vec_id").cast("string"), 12, "0")).alias("id"),
        F.concat(F.lit("v"), (grp % 5).cast("string")).alias("video_id"),
        F.concat(F.lit("c"), (grp % 3).cast("string")).alias("camera_id"),
        grp.alias("frame_idx"),
        (grp * 0.5).alias("offset_s"),
        (F.lit(float(BASE_TS)) + grp * 0.5).alias("ts"),
        F.when(is_frame, "frame").otherwise("crop").alias("source"),
        F.when(~is_frame, F.get(classes, (F.col("label") % len(CLASS_OF)).cast("int"))).alias("yolo_class"),
        F.when(~is_frame, F.col("vec_id") % 4 - 1).alias("k"),
        F.col("label").cast("int").alias("label"),
        F.col("embedding").alias("vector"),
    )


IDX = f"""idx AS (
  SELECT vec_id, 'p' || lpad(vec_id::VARCHAR, 12, '0') AS id, 'v' || ((vec_id // 4) % 5) AS video_id,
         'c' || ((vec_id // 4) % 3) AS camera_id, vec_id // 4 AS frame_idx, (vec_id // 4) * 0.5::DOUBLE AS offset_s,
         {BASE_TS} + (vec_id // 4) * 0.5::DOUBLE AS ts, CASE WHEN vec_id % 4 = 0 THEN 'frame' ELSE 'crop' END AS source,
         CASE WHEN vec_id % 4 <> 0 THEN ({list(CLASS_OF)})[label % {len(CLASS_OF)} + 1] END AS yolo_class,
         CASE WHEN vec_id % 4 <> 0 THEN vec_id % 4 - 1 END AS k, label::INT AS label, embedding::DOUBLE[] AS vector
  FROM embeddings)"""


def det(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections: eight orders are a frame; boxes lie on a coarse grid, so that equal ones recur."""
    li = read(spark, sf_dir, "lineitem")
    frame = F.floor(F.col("l_orderkey") / 8)
    cls = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "R", 2).when(F.col("l_linestatus") == "O", 7).otherwise(9)
    x1 = (F.col("l_partkey") % 6) * 100.0
    y1 = (F.col("l_suppkey") % 4) * 150.0
    h = 10.0 + F.floor(F.col("l_quantity") / 10) * 15
    return li.select(
        F.concat(F.lit("v"), (frame % 10).cast("string")).alias("video_id"),
        frame.alias("frame_idx"),
        (F.col("l_orderkey") % 8 * 10 + F.col("l_linenumber")).alias("det_idx"),
        cls.alias("cls_id"),
        F.round(F.col("l_discount") * 10, 2).alias("conf"),
        x1.alias("x1"),
        y1.alias("y1"),
        (x1 + h * 1.5).alias("x2"),
        (y1 + h).alias("y2"),
        F.lit(640).alias("w"),
        F.lit(480).alias("h"),
        "l_partkey",
        "l_suppkey",
        "l_extendedprice",
    )


DET = """det AS (
  SELECT 'v' || ((l_orderkey // 8) % 10) AS video_id, l_orderkey // 8 AS frame_idx,
         l_orderkey % 8 * 10 + l_linenumber AS det_idx,
         CASE WHEN l_returnflag = 'A' THEN 0 WHEN l_returnflag = 'R' THEN 2 WHEN l_linestatus = 'O' THEN 7 ELSE 9 END AS cls_id,
         round(l_discount * 10, 2) AS conf, (l_partkey % 6) * 100.0::DOUBLE AS x1, (l_suppkey % 4) * 150.0::DOUBLE AS y1,
         (l_partkey % 6) * 100.0::DOUBLE + (10.0 + floor(l_quantity / 10) * 15) * 1.5::DOUBLE AS x2,
         (l_suppkey % 4) * 150.0::DOUBLE + (10.0 + floor(l_quantity / 10) * 15)::DOUBLE AS y2,
         640 AS w, 480 AS h, l_partkey, l_suppkey, l_extendedprice
  FROM lineitem)"""
DET_TIES = ("det_idx", "l_partkey", "l_suppkey", "l_extendedprice")


def sight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sightings: an event of a user is a sighting in a video."""
    return read(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("video_id"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"),
        F.col("event_id").cast("string").alias("id"),
        F.col("value").alias("score"),
        F.col("event_type").alias("class"),
        F.col("event_id"),
    )


SIGHT = """sight AS (
  SELECT 'u' || user_id AS video_id, epoch_us(ts) / 1e6 AS ts, event_id::VARCHAR AS id, value AS score,
         event_type AS class, event_id FROM events)"""


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth embedding as a query; of them, every third has a time window, every fourth a camera."""
    n = F.floor(F.col("vec_id") / EVERY)
    q = idx(spark, sf_dir).where(F.col("vec_id") % EVERY == 0)
    start = F.when(n % 6 == 0, F.lit(BASE_TS + 20.0)).when(n % 6 == 3, F.lit(10.0))
    return q.select(
        F.concat(F.lit("q"), F.lpad(n.cast("string"), 9, "0")).alias("query_id"),
        "vector",
        start.alias("ts_from"),
        (start + 30.0).alias("ts_to"),
        F.when(n % 4 == 1, "c1").alias("camera_id"),
        "label",
        F.when(n % 2 == 0, "scene").otherwise("object").alias("intent"),
    )


def query_number(query_id: str = "query_id"):
    return F.substring(query_id, 2, 9).cast("long")


NUMBER = "substr(query_id, 2, 9)::BIGINT"
_N = f"(vec_id // {EVERY})"
_START = f"CASE WHEN {_N} % 6 = 0 THEN {BASE_TS + 20.0}::DOUBLE WHEN {_N} % 6 = 3 THEN 10.0::DOUBLE END"
QUERY = f"""qv AS (
  SELECT 'q' || lpad({_N}::VARCHAR, 9, '0') AS query_id, vector, {_START} AS ts_from, {_START} + 30.0 AS ts_to,
         CASE WHEN {_N} % 4 = 1 THEN 'c1' END AS camera_id, label,
         CASE WHEN {_N} % 2 = 0 THEN 'scene' ELSE 'object' END AS intent
  FROM idx WHERE vec_id % {EVERY} = 0)"""


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of 8 x 8 gray values from embeddings, half a second apart in each of five videos."""
    e = read(spark, sf_dir, "embeddings")
    byte = lambda x: F.unhex(F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x + 0.5) * 255).cast("int")))), 2, "0"))
    gray = F.aggregate("embedding", F.lit(b""), lambda a, x: F.concat(a, byte(x)))
    n = F.floor(F.col("vec_id") / 5)
    return e.select(
        F.concat(F.lit("v"), (F.col("vec_id") % 5).cast("string")).alias("video_id"),
        n.alias("frame_idx"),
        (n * 0.5).alias("t"),
        F.lit(8).alias("w"),
        F.lit(8).alias("h"),
        gray.alias("gray"),
        F.lit(float(BASE_TS)).alias("base_ts"),
    )


def decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grids as decoded frames of 16 x 16 pixels with three equal bytes, two by two of each gray value."""
    g = grids(spark, sf_dir)
    at = lambda i: (F.floor(i / 32) * 8 + F.floor(i % 16 / 2) + 1).cast("int")
    pixel = lambda i: F.substring(F.col("gray"), at(i), F.lit(1))
    bgr = F.aggregate(F.sequence(F.lit(0), F.lit(255)), F.lit(b""), lambda a, i: F.concat(a, pixel(i), pixel(i), pixel(i)))
    return g.select("video_id", "frame_idx", "t", "base_ts", F.lit(16).alias("width"), F.lit(16).alias("height"), bgr.alias("bgr"))


NOW = "2024-03-10 15:30:00"
#: Our own query phrases; each conversation turn gets one before its text.
PHRASES = (
    "dün gece kapıdan giren beyaz araba",
    "saat 9:05 gibi geçen kırmızı kamyon var mı?",
    "dün saat 22 civarı duran otobüsler",
    "son 3 saatte yürüyen insan göster",
    "SON 30 DAKİKA içinde kedi",
    "bugün gelen motosikletli adam",
    "otoparkta bekleyen kadın",
    "araçlarla dolu otopark",
    "siyah köpek gezdiren çocuk bul",
    "karanlık yol",
    "Bisiklet süren yaya nerede?",
    "dün sabah mavi sedan",
    "bu akşamüstü kavşak",
    "bir erkek ve tır",
    "bu gece yağmur",
    "taşıt geçti mi",
    "dün, (pembe) SUV!",
)


def phr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query texts with the moment they are asked at."""
    c = read(spark, sf_dir, "conversations")
    n = (F.col("conv_id") * 5 + F.col("turn")) % len(PHRASES)
    phrase = F.get(F.array(*[F.lit(p) for p in PHRASES]), n.cast("int"))
    return c.select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id"),
        F.concat(phrase, F.when(F.col("turn") % 2 == 1, F.concat(F.lit(" "), F.col("text"))).otherwise("")).alias("raw_query"),
        F.lit(NOW).cast("timestamp").alias("now"),
    )


_QUOTED = ", ".join("'" + p.replace("'", "''") + "'" for p in PHRASES)
PHR = f"""phr AS (
  SELECT conv_id || ':' || turn AS query_id, ([{_QUOTED}])[(conv_id * 5 + turn) % {len(PHRASES)} + 1]
         || CASE WHEN turn % 2 = 1 THEN ' ' || text ELSE '' END AS raw_query, TIMESTAMP '{NOW}' AS now
  FROM conversations)"""
