"""One video over many tasks: events, thinning and previous frames by slices; medians by buckets."""

import random

import pytest
from pyspark.sql import functions as F

from sightline.jobs import standins
from sightline.operators import detections, sampling, search
from sightline.operators.selection import medians


def busy(df):
    """Tasks that have rows."""
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


@pytest.mark.parametrize("slice_s", [7.0, 50.0, 1e9])
def test_events_of_one_video(spark, slice_s):
    r = random.Random(4)
    rows, ts = [], 1000.0
    for i in range(600):
        ts += r.choice([0.0, 0.5, 3.0, 20.0, 50.0, 50.5, 400.0])
        rows.append(("v" if i % 3 else "w", ts if i % 50 else None, f"i{i:04}", float(r.randrange(5))))
    df = spark.createDataFrame(rows, "video_id string, ts double, id string, score double").repartition(4)
    want = []
    for v in ("v", "w"):
        mine = sorted((x for x in rows if x[0] == v), key=lambda x: (x[1] is not None, x[1] or 0.0, x[2]))
        events = []
        for x in mine:
            if events and x[1] is not None and events[-1][-1][1] is not None and x[1] - events[-1][-1][1] <= 50.0:
                events[-1].append(x)
            else:
                events.append([x])
        for n, e in enumerate(events, 1):
            best = min(e, key=lambda x: (-x[3], x[1] or 0.0, x[2]))
            want.append((v, n, e[0][1], e[-1][1], len(e), best[2], best[3]))
    # events without a time have no order among each other but by id
    got = [tuple(x) for x in search.sighting_events(df, 50.0, slice_s=slice_s).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_repeated_sightings_without_time_are_events_of_their_own(spark):
    df = spark.createDataFrame([("v", None, "i", 1.0)] * 2 + [("v", 5.0, "i", 1.0)] * 2, "video_id string, ts double, id string, score double")
    assert sorted((e.event_no, e.first_ts, e.n) for e in search.sighting_events(df, 50.0).collect()) == [(1, None, 1), (2, None, 1), (3, 5.0, 2)]


def test_events_are_those_of_the_registered_query(spark, sf_dir):
    one = standins.sight(spark, sf_dir).withColumn("video_id", F.lit("v"))
    whole = sorted(map(tuple, search.sighting_events(one, 600.0, slice_s=1e12).collect()))
    sliced = search.sighting_events(one, 600.0, slice_s=3600.0)
    assert sorted(map(tuple, sliced.collect())) == whole and len(whole) > 100


@pytest.mark.parametrize("slice_s", [0.1, 3.0, 64.0, 1e9])
@pytest.mark.parametrize("step", [0.0, 0.5, 2.0, 9.0])
def test_thinning_of_one_video(spark, slice_s, step):
    r = random.Random(int(step * 10))
    rows = [("v", None if r.random() < 0.02 else round(r.random() ** 2 * 200, 1), i) for i in range(800)] + [("w", float(i), i) for i in range(30)] + [(None, 1.0, 1), (None, 1.0, 2)]
    df = spark.createDataFrame(rows, "video_id string, t double, slice int").repartition(3)
    want = []
    for v in ("v", "w", None):
        due = float("-inf")
        for x in sorted((x for x in rows if x[0] == v and x[1] is not None), key=lambda x: x[1:]):
            if x[1] >= due:
                want.append(x)
                due = x[1] + step
    got = [tuple(x) for x in sampling.thin(df, step, slice_s=slice_s).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_thinning_uses_several_tasks(spark):
    df = spark.range(4000).select(F.lit("v").alias("video_id"), (F.col("id") * 0.25).alias("t"))
    out = sampling.thin(df, 0.5, slice_s=1000 / 64)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert out.count() == 2000 and busy(sampling.thin(df, 0.5, slice_s=1000 / 64)) > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_previous_frames_across_slices(spark, monkeypatch):
    monkeypatch.setattr(detections, "SLICE", 10)
    box = (0.0, 0.0, 10.0, 10.0)
    frames = [("v", i) for i in (1, 3, 9, 10, 11, 29, 45, 50)] + [("w", 3)]
    det = [("v", i, 0, *box) for i in (1, 9, 10, 45, 50)] + [("w", 3, 0, *box)]
    f = spark.createDataFrame(frames, "video_id string, frame_idx long")
    d = spark.createDataFrame(det, "video_id string, frame_idx long, cls_id int, x1 double, y1 double, x2 double, y2 double")
    assert sorted((x.video_id, x.frame_idx) for x in detections.suppress_static(d, f).collect()) == [("v", 1), ("v", 9), ("v", 45), ("w", 3)]


@pytest.mark.parametrize("how", [{}, {"buckets": 4, "most": 3}, {"buckets": 2, "most": 1}])
def test_medians(spark, how):
    r = random.Random(8)
    groups = {
        "even": [1.0, 2.0, 3.0, 10.0], "odd": [5.0, 1.0, 3.0], "ties": [2.0] * 50 + [1.0] * 50, "one": [7.5], "wide": [10.0 ** r.randrange(-200, 200) for _ in range(101)],
        "signs": [r.uniform(-1, 1) for _ in range(200)], "ends": [-1.7e308, 1.7e308, 0.0, 5.0], None: [4.0, 8.0], "nothing": [None, float("nan")], "holes": [None, 1.0, float("nan"), 9.0, 2.0],
    }
    rows = [(g, x) for g, some in groups.items() for x in some]
    df = spark.createDataFrame(rows, "g string, x double").repartition(3)
    for upper in (False, True):
        want = {}
        for g, some in groups.items():
            some = sorted(x for x in some if x is not None and x == x)
            if some:
                lo, hi = some[(len(some) - 1) // 2], some[len(some) // 2]
                want[g] = hi if upper or lo == hi else (lo + hi) / 2
        assert {x.g: x["median"] for x in medians(df, ["g"], "x", upper, **how).collect()} == want
    assert medians(df.where("false"), ["g"], "x").count() == 0
