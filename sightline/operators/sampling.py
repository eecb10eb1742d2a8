"""Frame gate: which decoded frames of a video are worth keeping.

The gate is an ordered scan with state for each video.  In batch, rows are hashed by video, sorted
by time inside the task and streamed through in Arrow batches, so a task holds one video's state and
one batch, however long the video is.  The same step serves live streams (``streaming.live``).
"""

from __future__ import annotations

import bisect
import pickle
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline.operators.selection import medians
from sightline.params import DEFAULT, Params
from sightline.sources.work import cut

# ---- pixels ----


def shrink(bgr: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear resize of a decoded picture (uint8; rows, columns, colours), pixel centres on pixel centres."""

    def places(n: int, m: int):
        x = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        i = np.minimum(np.floor(x).astype(int), max(0, n - 2))
        return i, np.minimum(i + 1, n - 1), x - i

    top, below, dy = places(bgr.shape[0], height)
    left, right, dx = places(bgr.shape[1], width)
    g = bgr.astype(np.float64)
    g = g[top] * (1 - dy)[:, None, None] + g[below] * dy[:, None, None]
    g = g[:, left] * (1 - dx)[None, :, None] + g[:, right] * dx[None, :, None]
    return np.floor(g + 0.5).astype(np.uint8)


def gray_of(bgr: np.ndarray) -> np.ndarray:
    """Luma of a picture in whole numbers: 0.114 blue, 0.587 green, 0.299 red."""
    b, g, r = (bgr[..., i].astype(np.int32) for i in range(3))
    return ((1868 * b + 9617 * g + 4899 * r + 8192) >> 14).astype(np.uint8)


def gray_grids(frames: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """The gate's grids (``w, h, gray``) of decoded frames: ``width, height, bgr`` (row-major bytes, three of
    a pixel).  Other columns stay.  Frames without pixels have none afterwards and can't be gated."""
    rest = [c for c in frames.columns if c not in ("width", "height", "bgr")]
    picked = frames.where("bgr is not null and width > 0 and height > 0").select(*rest, "width", "height", "bgr")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.select(*rest).schema.fields)

    def run(it):
        for b in it:
            out = []
            for w, h, raw in zip(*(b.column(c).to_pylist() for c in ("width", "height", "bgr"))):
                out.append(gray_of(shrink(np.frombuffer(raw, np.uint8).reshape(h, w, 3), p.grid_width, p.grid_height)).tobytes())
            size = [pa.array([n] * b.num_rows, pa.int32()) for n in (p.grid_width, p.grid_height)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), *size, pa.array(out, pa.binary())], names=[*rest, "w", "h", "gray"])

    return picked.mapInArrow(run, f"{ddl}, w int, h int, gray binary")


def smooth(gray: np.ndarray) -> np.ndarray:
    """5 x 5 binomial blur with mirrored borders, of whole numbers (rounded half up)."""
    g = gray.astype(np.int32)
    for axis in (0, 1):
        n = g.shape[axis]
        if n < 3:  # nothing to mirror: the border pixel stands for what lies beyond
            p = np.pad(g, [(2, 2) if i == axis else (0, 0) for i in (0, 1)], mode="edge")
        else:
            p = np.pad(g, [(2, 2) if i == axis else (0, 0) for i in (0, 1)], mode="reflect")
        part = lambda i, p=p, n=n, axis=axis: np.take(p, range(i, i + n), axis=axis)
        g = part(0) + part(4) + 4 * (part(1) + part(3)) + 6 * part(2)
    return ((g + 128) >> 8).astype(np.uint8)


def level(gray: np.ndarray) -> np.ndarray:
    """Gray values about their mean, so that exposure shifts are no change."""
    g = gray.astype(np.float32)
    return g - g.mean(dtype=np.float64).astype(np.float32)


def large_blobs(mask: np.ndarray, least: int) -> np.ndarray:
    """The mask without 8-connected components of fewer than ``least`` pixels.

    Horizontal runs are joined with touching runs of the row above, then areas are added up by root.
    """
    if not mask.any():
        return mask.copy()
    h, w = mask.shape
    edge = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, start = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1]
    parent = list(range(len(row)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = np.searchsorted(row, np.arange(h + 1))
    for r in range(1, h):
        i, j = int(first[r - 1]), int(first[r])
        while i < first[r] and j < first[r + 1]:
            if start[i] <= end[j] and start[j] <= end[i]:  # ends are exclusive, so corners touch
                parent[root(j)] = root(i)
            if end[i] < end[j]:
                i += 1
            else:
                j += 1
    roots = np.array([root(i) for i in range(len(row))])
    area = np.bincount(roots, weights=end - start, minlength=len(row))
    keep = area[roots] >= least
    out = np.zeros((h, w + 1), np.int8)
    np.add.at(out, (row[keep], start[keep]), 1)
    np.add.at(out, (row[keep], end[keep]), -1)
    return np.cumsum(out[:, :w], axis=1) > 0


# ---- the gate ----


@dataclass
class Gate:
    """State of one video."""

    next_t: float = float("-inf")
    before: np.ndarray | None = None  # candidate before
    kept: np.ndarray | None = None  # last kept frame
    busy: np.ndarray | None = None  # how often each pixel changed lately
    last_t: float = float("-inf")
    hour: int | None = None
    in_hour: int = 0
    counts: dict = field(default_factory=dict)

    def step(self, t: float, gray: np.ndarray, p: Params = DEFAULT, blur: bool = True) -> tuple[bool, float | None, str]:
        """(kept, motion score, why) for the next frame.

        A clock burnt into the picture changes all the time: pixels that changed in more than
        ``clock_threshold`` of the recent candidates don't count as motion.  The first change counts
        in full, so whatever moved between the first two candidates is masked for a while.
        """
        if t < self.next_t:
            return False, None, "thinned"
        self.next_t = t + 1.0 / p.sample_fps
        now = level(smooth(gray) if blur else gray)
        far = lambda other: np.abs(now - other) > p.pixel_threshold
        if self.before is None:
            score = 1.0
        else:
            change = far(self.before)
            share = change.astype(np.float32)
            self.busy = share if self.busy is None else p.clock_decay * self.busy + (1 - p.clock_decay) * share
            score = float(large_blobs(change & ~self._clock(p, now.shape), p.min_blob).mean())
        self.before = now
        anchor = t - self.last_t >= p.anchor_s
        if score <= p.keep_ratio and not anchor:
            return False, score, "still"
        everywhere = False
        if self.kept is not None:
            since = far(self.kept)
            everywhere = float(since.mean()) > p.global_ratio
            if not everywhere and not anchor:
                new = large_blobs(since & ~self._clock(p, now.shape), p.min_blob)
                if float(new.mean()) <= p.dedup_ratio:
                    return False, score, "known"
        hour = int(t // 3600)
        if hour != self.hour:
            self.hour, self.in_hour = hour, 0
        if self.in_hour >= p.max_per_hour and not (anchor or everywhere):
            return False, score, "capped"
        self.in_hour += 1
        self.kept, self.last_t = now, t
        return True, score, "everywhere" if everywhere else "anchor" if anchor else "motion"

    def _clock(self, p: Params, shape) -> np.ndarray:
        return np.zeros(shape, bool) if self.busy is None else self.busy > p.clock_threshold

    def dump(self) -> bytes:
        return pickle.dumps(self)


_OUT = pa.schema(
    [("video_id", pa.string()), ("frame_idx", pa.int64()), ("t", pa.float64()), ("kept", pa.bool_()), ("motion_score", pa.float64()), ("why", pa.string())]
)
_OUT_DDL = "video_id string, frame_idx long, t double, kept boolean, motion_score double, why string"


def gate_rows(rows, gates: dict[str, Gate], p: Params, blur: bool):
    """Decisions for (video_id, frame_idx, t, w, h, gray bytes) rows in order of time."""
    for video, i, t, w, h, gray in rows:
        grid = np.frombuffer(gray, np.uint8).reshape(h, w)
        yield (video, i, t, *gates.setdefault(video, Gate()).step(t, grid, p, blur))


def gate_all(frames: DataFrame, p: Params = DEFAULT, blur: bool = True, carried: tuple[str, ...] = ()) -> DataFrame:
    """Every frame with its decision: ``video_id, frame_idx, t, kept, motion_score, why``.

    ``frames``: ``video_id, frame_idx, t, w, h, gray`` (row-major bytes).  ``carried``: further columns of frames that
    come back with each row.
    """
    read = ("video_id", "frame_idx", "t", "w", "h", "gray")

    def run(it):
        gates: dict[str, Gate] = {}
        for b in it:
            rows = list(gate_rows(zip(*(c.to_pylist() for c in b.columns[: len(read)])), gates, p, blur))
            if rows:
                last = rows[-1][0]  # sorted by video: earlier ones are done
                gates = {last: gates[last]}
                decided = [pa.array(x, f.type) for x, f in zip(zip(*rows), _OUT)]
                yield pa.RecordBatch.from_arrays([*decided, *b.columns[len(read) :]], names=[*_OUT.names, *carried])

    picked = frames.select(*read, *carried)
    ddl = ", ".join([_OUT_DDL, *(f"`{c}` {picked.schema[c].dataType.simpleString()}" for c in carried)])
    return picked.repartition("video_id").sortWithinPartitions("video_id", "t", "frame_idx").mapInArrow(run, ddl)


def gate_frames(frames: DataFrame, p: Params = DEFAULT, blur: bool = True) -> DataFrame:
    """Kept frames: ``video_id, frame_idx, offset_s, motion_score`` and, if frames have ``base_ts``, ``ts``.
    Frames are read once; repeated rows of a frame are frames of their own."""
    carried = ("base_ts",) if "base_ts" in frames.columns else ()
    ts = [(F.col(c) + F.col("t")).alias("ts") for c in carried]
    return gate_all(frames, p, blur, carried).where("kept").select("video_id", "frame_idx", F.col("t").alias("offset_s"), "motion_score", *ts)


def gate_funnel(frames: DataFrame, params: dict[str, Params], blur: bool = True) -> DataFrame:
    """Candidates, those past the motion gate and kept frames of each video for several parameter sets,
    with the median and largest score.  One pass over the frames for all sets."""
    ids = sorted(params)

    def run(it):
        gates: dict[str, dict[str, Gate]] = {i: {} for i in ids}
        for b in it:
            rows = list(zip(*(c.to_pylist() for c in b.columns)))
            out = [(i, *r) for i in ids for r in gate_rows(rows, gates[i], params[i], blur)]
            if out:
                last = rows[-1][0]
                gates = {i: {last: g[last]} for i, g in gates.items()}
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["param_id", *_OUT.names])

    picked = frames.select("video_id", "frame_idx", "t", "w", "h", "gray")
    rows = picked.repartition("video_id").sortWithinPartitions("video_id", "t", "frame_idx").mapInArrow(run, f"param_id string, {_OUT_DDL}")
    rows = cut(rows, "funnel")
    by = ["video_id", "param_id"]
    counts = rows.groupBy(*by).agg(
        F.count_if(F.col("why") != "thinned").alias("candidates"),
        F.count_if(~F.col("why").isin("thinned", "still")).alias("moving"),
        F.count_if("kept").alias("kept"),
        F.max("motion_score").alias("max_score"),
    )
    middle = medians(rows, by, "motion_score").withColumnRenamed("median", "median_score")
    same = [counts[k].eqNullSafe(middle[k]) for k in by]
    return counts.join(middle, same, "left").select(*[counts[k] for k in by], "candidates", "moving", "kept", "median_score", "max_score")


# ---- the gate's parts that make sense for any timed table ----


def _exits(t: np.ndarray, step: float) -> tuple[list[float], list[float]]:
    """What a slice of ascending times does to the time that is due: for a due time up to ``starts[i]`` (and above
    ``starts[i - 1]``) rows are taken from there on, and ``exits[i]`` is due after the slice.

    Of a later due time no row is taken.  A due time lies less than ``step`` after the last row before the slice, so only
    starts in the first ``step`` of the slice count, and the next one; runs from them soon meet.
    """
    after = np.maximum(np.searchsorted(t, t + step), np.arange(1, len(t) + 1))
    first = int(np.searchsorted(t, t[0] + step)) + 1
    known: dict[int, float] = {}
    for i in range(min(first, len(t))):
        path = []
        while i < len(t) and i not in known:
            path.append(i)
            i = int(after[i])
        end = known[i] if i < len(t) else float(t[path[-1]] + step)
        known.update(dict.fromkeys(path, end))
    starts, exits = [], []
    for i in range(min(first, len(t))):
        if i + 1 < first and i + 1 < len(t) and known[i] == known[i + 1]:
            continue  # the same from the next row on
        starts.append(float(t[i]))
        exits.append(known[i])
    return starts, exits


def thin(rows: DataFrame, step: float, t: str = "t", key: str = "video_id", slice_s: float = 86_400.0) -> DataFrame:
    """Rows at least ``step`` after the last row taken of their key, greedily from the first.

    Of equal times the row with the smallest other columns is taken; rows without a time never are.

    A key is worked on in slices of ``slice_s``, by as many tasks.  A first pass reads keys and times alone: each slice
    becomes a small map from the time that is due when it begins to that when it ends.  The maps of a key, one row for
    each slice, are followed in order; a second pass takes rows in all slices at once.
    """
    names = [f"{n}_{uuid.uuid4().hex}" for n in ("slice", "due")]  # no column of the input has these names
    columns = rows.columns
    sliced = rows.where(F.col(t).isNotNull()).withColumn(names[0], F.floor(F.col(t) / max(slice_s, step)))

    def maps(it):
        held, last = [], None

        def given():
            times = np.concatenate(held)
            starts, exits = _exits(times, step)
            return pa.RecordBatch.from_arrays([pa.array([last[0]], kind), pa.array([last[1]], pa.int64()), pa.array([starts]), pa.array([exits])], names=["key", "slice", "starts", "exits"])

        for b in it:
            kind = b.column(0).type
            keys, cells, times = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_numpy()
            ends = [i for i in range(1, len(keys) + 1) if i == len(keys) or (keys[i], cells[i]) != (keys[i - 1], cells[i - 1])]
            for a, z in zip([0, *ends], ends):
                if last is not None and (keys[a], cells[a]) != last:
                    yield given()
                    held = []
                last = (keys[a], cells[a])
                held.append(times[a:z])
        if held:
            yield given()

    kind = rows.schema[key].dataType.simpleString()
    times = sliced.select(F.col(key).alias("key"), F.col(names[0]).alias("slice"), F.col(t).cast("double").alias("t"))
    mapped = times.repartition("key", "slice").sortWithinPartitions("key", "slice", "t").mapInArrow(maps, f"key {kind}, slice long, starts array<double>, exits array<double>")

    def follow(table: pa.Table) -> pa.Table:
        table = table.sort_by("slice")
        due, dues = float("-inf"), []
        for starts, exits in zip(table["starts"].to_pylist(), table["exits"].to_pylist()):
            dues.append(due)
            i = bisect.bisect_left(starts, due)
            due = exits[i] if i < len(starts) else due
        return pa.table({"key": table["key"], "slice": table["slice"], "due": pa.array(dues, pa.float64())})

    dues = mapped.groupBy("key").applyInArrow(follow, f"key {kind}, slice long, due double")
    same = F.col(key).eqNullSafe(F.col("key_" + names[1])) & (F.col(names[0]) == F.col("slice_" + names[1]))
    entered = sliced.join(dues.select(F.col("key").alias("key_" + names[1]), F.col("slice").alias("slice_" + names[1]), F.col("due").alias(names[1])), same)

    def run(it):
        last, due = None, 0.0
        for b in it:
            take = []
            for k, c, x, entry in zip(*(b.column(n).to_pylist() for n in (key, names[0], t, names[1]))):
                if (k, c) != last:
                    last, due = (k, c), entry
                ok = x >= due
                due = x + step if ok else due
                take.append(ok)
            yield b.filter(pa.array(take, pa.bool_())).select(columns)

    order = [key, names[0], t, *[c for c in rows.columns if c not in (key, t)]]
    picked = entered.select(*rows.columns, *names).repartition(key, names[0]).sortWithinPartitions(*order)
    return picked.mapInArrow(run, rows.schema)


def hourly_cap(rows: DataFrame, most: int, t: str = "t", key: str = "video_id", exempt: Column | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """The first ``most`` rows of each key and hour, and every ``exempt`` row; exempt rows count too."""
    w = W.partitionBy(key, F.floor(F.col(t) / 3600)).orderBy(t, *ties)
    first = F.col("__n") <= most
    return rows.withColumn("__n", F.row_number().over(w)).where(first if exempt is None else first | exempt).drop("__n")
