"""Detections of objects in frames: clean-up, suppression of parked things, caps and crop geometry."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline.params import DEFAULT, Params

#: Detector class ids and their labels.
CLASSES = ((0, "insan"), (1, "bisiklet"), (2, "araba"), (3, "motosiklet"), (5, "otobüs"), (7, "kamyon"))
PERSON = 0


def clean(det: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Detections of known classes, sure and tall enough, with ``cls_name`` and ``tiny``."""
    name = F.create_map(*[F.lit(x) for pair in CLASSES for x in pair])
    height = F.col("y2") - F.col("y1")
    sure = F.when(F.col("cls_id") == PERSON, F.col("conf") >= p.person_conf).otherwise(F.col("conf") >= p.vehicle_conf)
    return (
        det.where(F.col("cls_id").isin([c for c, _ in CLASSES]) & sure & (height >= p.min_height))
        .withColumn("cls_name", F.element_at(name, F.col("cls_id")))
        .withColumn("tiny", height < p.tiny_height)
    )


_FOUND = "det_idx int, cls_id int, conf double, x1 double, y1 double, x2 double, y2 double"


def detect(frames: DataFrame, make: Callable[[], Callable], image: str = "image", batch: int = 8) -> DataFrame:
    """Detections of a user's model: ``video_id, frame_idx, det_idx, cls_id, conf, x1, y1, x2, y2``.

    ``make`` is called once in each Python worker and gives ``detect(list of images) -> list of lists of
    (cls_id, conf, x1, y1, x2, y2)``; images are the values of the column ``image``, in batches of
    ``batch``.  A frame without detections, or without image, has no row.  ``det_idx`` is the place in
    the model's list.
    """

    def run(it: Iterator[pa.RecordBatch]):
        model = make()
        for b in it:
            for i in range(0, b.num_rows, batch):
                part = b.slice(i, batch)
                rows = [
                    (v, f, n, int(c), *map(float, box))
                    for v, f, found in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), model(part.column(2).to_pylist()))
                    for n, (c, *box) in enumerate(found)
                ]
                if rows:
                    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), *[pa.float64()] * 5]
                    names = ["video_id", "frame_idx", *[x.split()[0] for x in _FOUND.split(", ")]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    picked = frames.where(F.col(image).isNotNull()).select("video_id", F.col("frame_idx").cast("long").alias("frame_idx"), image)
    return picked.mapInArrow(run, f"video_id string, frame_idx long, {_FOUND}")


def iou(a: str, b: str) -> Column:
    """Intersection over union of the boxes ``{a}x1 ...`` and ``{b}x1 ...``; 0 if they don't meet."""
    c = lambda s, k: F.col(f"{s}{k}")
    w = F.least(c(a, "x2"), c(b, "x2")) - F.greatest(c(a, "x1"), c(b, "x1"))
    h = F.least(c(a, "y2"), c(b, "y2")) - F.greatest(c(a, "y1"), c(b, "y1"))
    area = lambda s: (c(s, "x2") - c(s, "x1")) * (c(s, "y2") - c(s, "y1"))
    both = w * h
    return F.when((w <= 0) | (h <= 0), 0.0).otherwise(both / (area(a) + area(b) - both))


#: Frame numbers of a slice of a video.
SLICE = 100_000


def suppress_static(det: DataFrame, frames: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Detections without a box of the same class and nearly the same place in the kept frame before.

    The comparison is with the previous frame's cleaned detections, whether or not those were
    suppressed; frames without detections count as frames.  An anti join on video, frame and class; the
    box condition rides on the equal keys.  The previous frame of each is found over the distinct frame
    numbers alone, once, in slices of ``SLICE`` numbers of a video; for the first of a slice, in a table of slices.
    """
    kept = frames.select("video_id", "frame_idx", F.floor(F.col("frame_idx") / SLICE).alias("slice")).distinct()
    within = F.lag("frame_idx").over(W.partitionBy("video_id", "slice").orderBy("frame_idx"))
    lasts = kept.groupBy("video_id", "slice").agg(F.max("frame_idx").alias("last"))
    lasts = lasts.withColumn("last_before", F.lag("last").over(W.partitionBy("video_id").orderBy("slice"))).drop("last")
    previous = kept.withColumn("within", within).join(lasts, ["video_id", "slice"])
    previous = previous.select("video_id", "frame_idx", F.coalesce("within", "last_before").alias("frame_before"))
    box = ["x1", "y1", "x2", "y2"]
    now = det.join(previous, ["video_id", "frame_idx"]).select("*", *[F.col(k).alias(f"now_{k}") for k in box])
    before = det.select(
        F.col("video_id").alias("v"), F.col("frame_idx").alias("n"), F.col("cls_id").alias("c"), *[F.col(k).alias(f"before_{k}") for k in box]
    )
    same = (F.col("video_id") == F.col("v")) & (F.col("frame_before") == F.col("n")) & (F.col("cls_id") == F.col("c"))
    return now.join(before, same & (iou("before_", "now_") > p.static_iou), "left_anti").drop("frame_before", *[f"now_{k}" for k in box])


def cap_crops(det: DataFrame, p: Params = DEFAULT, ties: tuple[str, ...] = ("det_idx",)) -> DataFrame:
    """At most ``max_crops`` detections of a frame, people first, then the surest; ``k`` is the place."""
    order = [(F.col("cls_id") != PERSON).asc(), F.col("conf").desc(), *[F.col(t).asc() for t in ties]]
    w = W.partitionBy("video_id", "frame_idx").orderBy(*order)
    return det.withColumn("k", F.row_number().over(w) - 1).where(F.col("k") < p.max_crops)


def _square(x1: Column, y1: Column, x2: Column, y2: Column, margin: float, whole, w: Column, h: Column):
    """Corners of the square around a box with a margin, made whole by ``whole`` and clamped."""
    bw, bh = x2 - x1, y2 - y1
    side = F.greatest(bw + 2 * margin * bw, bh + 2 * margin * bh)
    cx, cy = (x1 + x2) / 2, (y1 + y2) / 2
    low = lambda c: F.greatest(F.lit(0), whole(c - side / 2))
    high = lambda c, most: F.least(most.cast("int"), whole(c + side / 2))
    return low(cx), low(cy), high(cx, w), high(cy, h)


def crop_boxes(det: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Pixel rectangle of each crop (``cx1 ...``), rounded half to even, and the normalised box
    (``n_x1 ...``).  Crops without area go."""
    whole = lambda c: F.bround(c, 0).cast("int")
    x1, y1, x2, y2 = _square(*[F.col(k) for k in ("x1", "y1", "x2", "y2")], p.crop_margin, whole, F.col("w"), F.col("h"))
    out = det.withColumns({"cx1": x1, "cy1": y1, "cx2": x2, "cy2": y2})
    return out.where("cx2 > cx1 and cy2 > cy1").withColumns(
        {f"n_{a}{i}": F.col(f"{a}{i}") / F.col(s) for i in (1, 2) for a, s in (("x", "w"), ("y", "h"))}
    )


def recrop_boxes(crops: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Pixel rectangle for looking again (``rx1 ...``), cut to whole pixels, from the normalised box."""
    whole = lambda c: c.cast("int")
    px = [F.col(f"n_{a}{i}") * F.col(s) for i in (1, 2) for a, s in (("x", "w"), ("y", "h"))]
    x1, y1, x2, y2 = _square(*px, p.recrop_margin, whole, F.col("w"), F.col("h"))
    return crops.withColumns({"rx1": x1, "ry1": y1, "rx2": x2, "ry2": y2})
