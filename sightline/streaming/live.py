"""Live cameras: the frame gate, sighting events and index upsert as streams."""

from __future__ import annotations

import json
import pickle
import zlib

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sightline.operators.index import upsert_latest
from sightline.operators.sampling import Gate, gate_rows
from sightline.params import DEFAULT, Params
from sightline.sources import versioned

_KEPT = "video_id string, frame_idx long, t double, motion_score double, why string"


def gate_stream(frames: DataFrame, p: Params = DEFAULT, blur: bool = True, ttl_s: float | None = None) -> DataFrame:
    """Kept frames of a stream of frames (``video_id, frame_idx, t, w, h, gray``), with one gate's state
    for each video.

    Within a micro-batch a video's frames are taken in order of time, for which the task holds their
    grids, compressed: bound a batch at the source (``maxFilesPerTrigger`` or the like).  Frames of one
    video must not overtake each other across batches, as in a camera's own stream.

    A video that sends nothing for ``ttl_s`` seconds of the clock gives its state up, and begins anew when it comes
    back (None: never).  With a time to live Spark runs batches without data, to look for states that have timed out, so
    that an ``availableNow`` run ends only where ``spark.sql.streaming.noDataMicroBatches.enabled`` is off.
    """

    def step(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        now = state.getCurrentProcessingTimeMs()
        gate, seen = state.get if state.exists else (None, now)
        # frames may come before Spark has looked for states that timed out
        fresh = gate is not None and (ttl_s is None or now - seen <= ttl_s * 1000)
        gates = {key[0]: pickle.loads(gate) if fresh else Gate()}
        # pixels are kept compressed until all of the micro-batch's rows are here and in order
        held = []
        for pdf in batches:
            for v, i, t, w, h, gray in zip(*(pdf[c] for c in ("video_id", "frame_idx", "t", "w", "h", "gray"))):
                held.append((t, i, v, w, h, zlib.compress(gray, 1)))
        held.sort(key=lambda r: r[:2])
        rows = ((v, i, t, w, h, zlib.decompress(gray)) for t, i, v, w, h, gray in held)
        kept = [(v, i, t, score, why) for v, i, t, ok, score, why in gate_rows(rows, gates, p, blur) if ok]
        state.update((pickle.dumps(gates[key[0]]), now))
        if ttl_s is not None:
            state.setTimeoutDuration(max(1, int(ttl_s * 1000)))
        yield pd.DataFrame(kept, columns=["video_id", "frame_idx", "t", "motion_score", "why"])

    picked = frames.select("video_id", "frame_idx", "t", "w", "h", "gray")
    timeout = GroupStateTimeout.NoTimeout if ttl_s is None else GroupStateTimeout.ProcessingTimeTimeout
    return picked.groupBy("video_id").applyInPandasWithState(step, _KEPT, "gate binary, seen long", "append", timeout)


def event_stream(sightings: DataFrame, gap_s: float = DEFAULT.event_gap_s, late: str = "10 minutes", time: str = "time") -> DataFrame:
    """Sighting events of a stream: ``video_id, first_ts, last_ts, n, rep_id, rep_score``.

    An event is given out once the watermark has passed its end.  A gap of exactly ``gap_s`` does not
    split an event.  Rows later than ``late`` behind the newest one are dropped; Spark counts them in
    the query's progress (``numRowsDroppedByWatermark``).
    """
    # a session ends `gap` after its last row, and a row at that very moment would begin a new one
    gap = f"{int(round(gap_s * 1_000_000)) + 1} microseconds"
    seconds = F.unix_micros(F.col(time)) / 1e6
    rep = F.min(F.struct((-F.col("score")).alias("s"), seconds.alias("t"), F.col("id").alias("id")))
    return (
        sightings.withWatermark(time, late)
        .groupBy("video_id", F.session_window(time, gap))
        .agg(F.min(seconds).alias("first_ts"), F.max(seconds).alias("last_ts"), F.count(F.lit(1)).alias("n"), rep.alias("rep"))
        .select("video_id", "first_ts", "last_ts", "n", F.col("rep.id").alias("rep_id"), (-F.col("rep.s")).alias("rep_score"))
    )


def route_late(rows: DataFrame, path: str, checkpoint: str, late_s: float, time: str = "time"):
    """Starts a stream that stores every row at ``path``, those behind the watermark apart from the others.

    The watermark of a micro-batch is ``late_s`` seconds before the greatest time of all batches before it, and never goes
    back.  ``on_time`` and ``late_rows`` read the two parts, which add up to the input.  A later stream over the rows on
    time, with the same delay, drops none of them.  The greatest time is observed while the rows are written; a batch that is tried again
    replaces its own rows.  Rows without a time are on time.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        name = stream_name(spark, checkpoint)
        seen = Observation()
        mark = versioned.load_json(spark, f"{path}/marks/{name}-{number - 1}.json")["mark"] if number else None
        at = F.unix_micros(F.col(time).cast("timestamp")) / 1e6
        delay = F.greatest(F.lit(mark).cast("double") - at, F.lit(0.0))
        marked = batch.withColumn("delay_s", delay).withColumn("late", F.coalesce(F.col("delay_s") > 0, F.lit(False)))
        marked.observe(seen, F.max(at).alias("top"), F.count_if("late").alias("late")).write.mode("overwrite").partitionBy("late").parquet(f"{path}/rows/batch={name}-{number}")
        top = seen.get["top"]
        marks = [m for m in (mark, None if top is None else top - late_s) if m is not None]
        versioned.save_json(spark, f"{path}/marks/{name}-{number}.json", {"mark": max(marks, default=None), "late": seen.get["late"]})

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _routed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows").withColumn("late", F.col("late").cast("boolean"))


def on_time(spark: SparkSession, path: str) -> DataFrame:
    """The rows that ``route_late`` found on time."""
    return _routed(spark, path).where("not late").drop("late", "delay_s", "batch")


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows that came behind the watermark, with the seconds by which (``delay_s``)."""
    return _routed(spark, path).where("late").drop("late", "batch")


def stream_name(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark keeps in a stream's checkpoint; a new checkpoint is a new stream."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def upsert_stream(points: DataFrame, path: str, checkpoint: str, order: str = "time"):
    """Starts a stream that writes index points to the versioned table at ``path``: the last write of an ``id`` wins.

    Every micro-batch is one commit, with the latest row of each of its ids (by ``order``).  Commits are numbered by the
    table: a new checkpoint goes on after all that is stored, and a batch that is tried again changes nothing.
    ``stored_points`` reads the latest row of each id.
    """

    def write(batch: DataFrame, number: int) -> None:
        name = stream_name(batch.sparkSession, checkpoint)
        versioned.commit(upsert_latest(batch, order=order), path, stream=name, number=number)

    return points.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_points(spark: SparkSession, path: str, ids: list[str] | None = None) -> DataFrame:
    """The latest row of each id that ``upsert_stream`` wrote to ``path``, or of a few ``ids``."""
    return versioned.read(spark, path, keys=ids)
