"""Boundaries of the detection rules."""

import pytest
from pyspark.sql import functions as F

from sightline.operators import detections as d
from sightline.params import Params

COLUMNS = "video_id string, frame_idx long, det_idx int, cls_id int, conf double, x1 double, y1 double, x2 double, y2 double"


def box(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def test_clean_thresholds(spark):
    rows = [
        ("v", 0, 0, 2, 0.24, 0.0, 0.0, 50.0, 40.0),
        ("v", 0, 1, 2, 0.25, 0.0, 0.0, 50.0, 40.0),
        ("v", 0, 2, 0, 0.15, 0.0, 0.0, 50.0, 31.0),
        ("v", 0, 3, 0, 0.14, 0.0, 0.0, 50.0, 40.0),
        ("v", 0, 4, 0, 0.9, 0.0, 0.0, 50.0, 15.0),
        ("v", 0, 5, 0, 0.9, 0.0, 0.0, 50.0, 16.0),
        ("v", 0, 6, 0, 0.9, 0.0, 0.0, 50.0, 32.0),
        ("v", 0, 7, 9, 0.9, 0.0, 0.0, 50.0, 40.0),
        ("v", 0, 8, None, 0.9, 0.0, 0.0, 50.0, 40.0),
    ]
    got = {r.det_idx: (r.cls_name, r.tiny) for r in d.clean(box(spark, rows)).collect()}
    assert got == {1: ("araba", False), 2: ("insan", True), 5: ("insan", True), 6: ("insan", False)}


def test_static_suppression(spark):
    same = (0.0, 0.0, 100.0, 100.0)
    nearly = (0.0, 0.0, 100.0, 85.0)  # overlap over union is exactly 0.85
    rows = [
        ("v", 0, 0, 2, 0.9, *same),
        ("v", 1, 0, 2, 0.9, *same),  # gone: the same box in the frame before
        ("v", 1, 1, 0, 0.9, *same),  # another class
        ("v", 3, 0, 2, 0.9, *same),  # frame 2 without detections lies between
        ("v", 4, 0, 2, 0.9, *nearly),  # not above the threshold
        ("w", 1, 0, 2, 0.9, *same),  # another video
        ("v", 5, 0, 2, 0.9, *nearly),  # compared with a frame whose own box stayed
        ("v", 6, 0, 2, 0.9, *nearly),  # compared with a suppressed box
    ]
    frames = spark.createDataFrame([("v", i) for i in range(7)] + [("w", 0), ("w", 1)], "video_id string, frame_idx long")
    kept = {(r.video_id, r.frame_idx, r.det_idx) for r in d.suppress_static(box(spark, rows), frames).collect()}
    assert kept == {("v", 0, 0), ("v", 1, 1), ("v", 3, 0), ("v", 4, 0), ("w", 1, 0)}


def test_cap_takes_people_first(spark):
    rows = [("v", 0, i, 2, 0.9, 0.0, 0.0, 50.0, 40.0) for i in range(30)] + [("v", 0, 30 + i, 0, 0.2, 0.0, 0.0, 50.0, 40.0) for i in range(2)]
    got = d.cap_crops(box(spark, rows)).orderBy("k").collect()
    assert len(got) == 24 and [r.det_idx for r in got[:3]] == [30, 31, 0] and [r.k for r in got] == list(range(24))


def test_crop_boxes_at_the_edge_and_empty(spark):
    rows = [("v", 0, 0, 2, 0.9, 0.0, 0.0, 10.0, 40.0), ("v", 0, 1, 2, 0.9, 700.0, 0.0, 710.0, 10.0), ("v", 0, 2, 2, 0.9, 10.0, 10.0, 15.0, 15.0)]
    det = box(spark, rows).withColumns({"w": F.lit(640), "h": F.lit(480)})
    got = {r.det_idx: (r.cx1, r.cy1, r.cx2, r.cy2) for r in d.crop_boxes(det, Params(crop_margin=0.2)).collect()}
    # 40 high: side 56 about (5, 20); 5 wide: side 7 about 12.5, so 9 to 16
    assert got == {0: (0, 0, 33, 48), 2: (9, 9, 16, 16)}


@pytest.mark.parametrize("a, b, want", [((0, 0, 2, 2), (2, 0, 4, 2), 0.0), ((0, 0, 2, 2), (1, 0, 3, 2), 1 / 3), ((0, 0, 2, 2), (0, 0, 2, 2), 1.0)])
def test_iou(spark, a, b, want):
    names = [f"{s}{k}" for s in ("a_", "b_") for k in ("x1", "y1", "x2", "y2")]
    df = spark.createDataFrame([tuple(map(float, a + b))], names)
    assert df.select(d.iou("a_", "b_")).first()[0] == pytest.approx(want)
