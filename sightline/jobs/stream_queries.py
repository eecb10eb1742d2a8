"""Registered queries that run a stream over a table, as far as it goes, and read what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.jobs import standins as s
from sightline.jobs.queries import _EVENTS, GAP_S, GRID_GATE, SQL, query
from sightline.sources.work import work_dir
from sightline.streaming import live


@query(f"WITH {_EVENTS} SELECT video_id, first_ts, last_ts, n, rep_id, rep_score FROM events_")
def stream_events(spark, sf_dir: str) -> DataFrame:
    base = f"{work_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = s.sight(spark, sf_dir).withColumn("time", F.timestamp_micros(F.round(F.col("ts") * 1e6).cast("long")))
    # a last row far in the future of each run moves the watermark past every event
    end = rows.agg(F.max("time").alias("time")).select(
        F.lit("end").alias("video_id"), (F.unix_micros("time") / 1e6 + 1e7).alias("ts"), F.lit("end").alias("id"), F.lit(0.0).alias("score"),
        F.lit("end").alias("class"), F.lit(-1).cast("long").alias("event_id"), (F.col("time") + F.expr("INTERVAL 115 DAYS")).alias("time"),
    )
    rows.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
    events = live.event_stream(stream, GAP_S, late="1 day")

    _drain(events, base)
    end.write.mode("append").parquet(f"{base}/in")
    _drain(events, base)
    return spark.read.schema(events.schema).parquet(f"{base}/out").where("video_id <> 'end'")


def _drain(rows: DataFrame, base: str) -> None:
    q = rows.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()


_LATE = _EVENTS.replace("FROM events)", "FROM events WHERE event_id % 10 <> 3)")


@query(f"WITH {_LATE} SELECT video_id, first_ts, last_ts, n, rep_id, rep_score FROM events_")
def stream_late_rows(spark, sf_dir: str) -> DataFrame:
    """As ``stream_events``, where every tenth sighting comes after the watermark has passed it."""
    base = f"{work_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = s.sight(spark, sf_dir).withColumn("time", F.timestamp_micros(F.round(F.col("ts") * 1e6).cast("long")))
    late = F.col("event_id") % 10 == 3
    far = rows.agg(F.max("time").alias("time")).select(
        F.lit("end").alias("video_id"), F.lit(0.0).alias("ts"), F.lit("end").alias("id"), F.lit(0.0).alias("score"), F.lit("end").alias("class"),
        F.lit(-1).cast("long").alias("event_id"), (F.col("time") + F.expr("INTERVAL 115 DAYS")).alias("time"),
    )
    rows.where(~late).write.parquet(f"{base}/in")
    events = live.event_stream(spark.readStream.schema(rows.schema).parquet(f"{base}/in"), GAP_S, late="1 day")
    _drain(events, base)
    for more in (far, rows.where(late)):
        more.write.mode("append").parquet(f"{base}/in")
        _drain(events, base)
    return spark.read.schema(events.schema).parquet(f"{base}/out").where("video_id <> 'end'")


_DELAYED = f"""WITH {s.SIGHT}, far AS (SELECT max(ts) + 114 * 86400 AS mark FROM sight)
SELECT id, event_id % 10 = 3 AS late, CASE WHEN event_id % 10 = 3 THEN round(mark - ts, 3) END AS delay_s FROM sight, far"""


@query(_DELAYED)
def stream_late_table(spark, sf_dir: str) -> DataFrame:
    """Sightings of which every tenth comes behind the watermark: all of them, late ones with their delay."""
    base = f"{work_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = s.sight(spark, sf_dir).select("id", "event_id", F.timestamp_micros(F.round(F.col("ts") * 1e6).cast("long")).alias("time"))
    late = F.col("event_id") % 10 == 3
    far = rows.agg(F.max("time").alias("time")).select(F.lit("end").alias("id"), F.lit(-1).cast("long").alias("event_id"), (F.col("time") + F.expr("INTERVAL 115 DAYS")).alias("time"))
    for more in (rows.where(~late), far, rows.where(late)):
        more.write.mode("append").parquet(f"{base}/in")
        live.route_late(spark.readStream.schema(rows.schema).parquet(f"{base}/in"), f"{base}/out", f"{base}/state", 86_400.0).awaitTermination()
    behind = live.late_rows(spark, f"{base}/out").select("id", F.lit(True).alias("late"), F.round("delay_s", 3).alias("delay_s"))
    others = live.on_time(spark, f"{base}/out").where("event_id >= 0").select("id", F.lit(False).alias("late"), F.lit(None).cast("double").alias("delay_s"))
    return behind.unionByName(others)


@query(SQL["upsert_latest"].replace("SELECT id, source, frame_idx, batch_no FROM b", "SELECT id, source, frame_idx FROM b"))
def stream_upsert(spark, sf_dir: str) -> DataFrame:
    """Points that come in three runs, later ones for ids that are there already."""
    base = f"{work_dir(spark)}/stream-{uuid.uuid4().hex}"
    p = s.idx(spark, sf_dir).select("id", "source", "frame_idx", "vec_id")
    for n, (some, by) in enumerate(((p, 0), (p.where("vec_id % 3 = 0"), 1000), (p.where("vec_id % 7 = 0"), 2000))):
        sent = some.select("id", "source", (F.col("frame_idx") + by).alias("frame_idx"), F.timestamp_seconds(F.lit(s.BASE_TS + n)).alias("time"))
        sent.write.mode("append").parquet(f"{base}/in")
        live.upsert_stream(spark.readStream.schema(sent.schema).parquet(f"{base}/in"), f"{base}/out", f"{base}/state").awaitTermination()
    return live.stored_points(spark, f"{base}/out").select("id", "source", "frame_idx")


@query()
def stream_gate(spark, sf_dir: str) -> DataFrame:
    """The frame gate over a stream of frames that comes in two runs."""
    base = f"{work_dir(spark)}/stream-{uuid.uuid4().hex}"
    frames = s.grids(spark, sf_dir)
    half = frames.agg(F.max("frame_idx")).first()[0] or 0
    kept = None
    for part in (frames.where(F.col("frame_idx") * 2 < half), frames.where(F.col("frame_idx") * 2 >= half)):
        part.write.mode("append").parquet(f"{base}/in")
        kept = live.gate_stream(spark.readStream.schema(frames.schema).parquet(f"{base}/in"), GRID_GATE)
        _drain(kept, base)
    return spark.read.schema(kept.schema).parquet(f"{base}/out")
