"""The frame gate against boundaries and a plain blob search."""

import numpy as np
import pytest

from sightline.operators import sampling as sp
from sightline.params import Params

P = Params(min_blob=2, keep_ratio=0.0005, dedup_ratio=0.001)


def run(grids, p=P, dt=0.5):
    g = sp.Gate()
    return [g.step(i * dt, x, p, blur=False) for i, x in enumerate(grids)]


def block(x, y, size=4, n=32, value=200):
    a = np.full((n, n), 50, np.uint8)
    a[y : y + size, x : x + size] = value
    return a


def test_static_video_keeps_first_and_anchors():
    got = run([block(5, 5)] * 260)
    assert [i for i, r in enumerate(got) if r[0]] == [0, 120, 240]
    assert got[120][2] == "anchor"


def test_second_candidate_is_masked_for_a_while():
    got = run([block(2, 2), block(20, 20)])
    assert got[0][1] == 1.0 and got[1][1] == 0.0 and not got[1][0]
    assert run([block(2, 2), block(2, 2), block(20, 20)])[2][0]


def test_brightness_is_no_change():
    a = block(5, 5)
    got = run([a, a, a + 30, a])
    assert [r[0] for r in got] == [True, False, False, False]


def test_global_event_is_kept():
    a = np.full((32, 32), 50, np.uint8)
    b = a.copy()
    b[:16] = 200
    assert run([a, a, b])[2][2] == "everywhere"


def test_cap_counts_exempt_rows():
    p = Params(min_blob=2, max_per_hour=2, anchor_s=20.0)
    grids = [block(2 + 3 * (i % 9), 2, n=64) for i in range(100)]
    kept = [r[2] for r in run(grids, p) if r[0]]
    assert len(kept) > 2 and set(kept[2:]) <= {"anchor", "everywhere"}


def test_thinning_is_greedy(spark):
    rows = spark.createDataFrame([("v", t) for t in (0.0, 0.2, 0.5, 0.9, 1.1, 1.5)], "video_id string, t double")
    assert sorted(r.t for r in sp.thin(rows, 0.5).collect()) == [0.0, 0.5, 1.1]


def plain_blobs(mask, least):
    out, seen = np.zeros_like(mask), set()
    h, w = mask.shape
    for s in zip(*np.nonzero(mask)):
        if s in seen:
            continue
        todo, part = [s], []
        seen.add(s)
        while todo:
            y, x = todo.pop()
            part.append((y, x))
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    q = (y + dy, x + dx)
                    if 0 <= q[0] < h and 0 <= q[1] < w and mask[q] and q not in seen:
                        seen.add(q)
                        todo.append(q)
        if len(part) >= least:
            for q in part:
                out[q] = True
    return out


@pytest.mark.parametrize("seed", range(20))
def test_blobs(seed):
    r = np.random.default_rng(seed)
    mask = r.random((r.integers(1, 20), r.integers(1, 20))) < r.choice([0.1, 0.3, 0.5])
    for least in (1, 4, 5):
        assert (sp.large_blobs(mask, least) == plain_blobs(mask, least)).all()


def test_batch_does_not_depend_on_partitions(spark, sf_dir):
    from sightline.jobs import standins
    from sightline.jobs.queries import GRID_GATE

    frames = standins.grids(spark, sf_dir)
    want = sorted(map(tuple, sp.gate_all(frames.coalesce(1), GRID_GATE, blur=False).collect()))
    assert sorted(map(tuple, sp.gate_all(frames.repartition(7), GRID_GATE, blur=False).collect())) == want


def plain_gate(frames, p, blur):
    """The gate over one video, frame by frame, with plain loops over pixels."""

    def pixels(gray, h, w):
        a = [[int(gray[y * w + x]) for x in range(w)] for y in range(h)]
        if blur:
            k = (1, 4, 6, 4, 1)
            at = lambda i, n: -i if i < 0 else 2 * n - 2 - i if i >= n else i
            a = [
                [(sum(k[i] * k[j] * a[at(y + i - 2, h)][at(x + j - 2, w)] for i in range(5) for j in range(5)) + 128) >> 8 for x in range(w)]
                for y in range(h)
            ]
        mean = np.float32(sum(map(sum, a)) / (h * w))
        return [[np.float32(v) - mean for v in r] for r in a]

    def far(a, b):
        return np.array([[abs(x - y) > p.pixel_threshold for x, y in zip(r, q)] for r, q in zip(a, b)])

    out, due, before, kept, busy, last, hour, used = [], float("-inf"), None, None, None, float("-inf"), None, 0
    for t, h, w, gray in frames:
        if t < due:
            out.append((False, None))
            continue
        due = t + 1 / p.sample_fps
        now, score = pixels(gray, h, w), 1.0
        if before is not None:
            change = far(now, before)
            share = change.astype(np.float32)
            busy = share if busy is None else p.clock_decay * busy + (1 - p.clock_decay) * share
            score = plain_blobs(change & (busy <= p.clock_threshold), p.min_blob).sum() / (h * w)
        before = now
        anchor = t - last >= p.anchor_s
        keep, free = score > p.keep_ratio or anchor, anchor
        if keep and kept is not None:
            since = far(now, kept)
            free = anchor or since.sum() / (h * w) > p.global_ratio
            seen = since if busy is None else since & (busy <= p.clock_threshold)
            keep = free or plain_blobs(seen, p.min_blob).sum() / (h * w) > p.dedup_ratio
        if keep:
            if int(t // 3600) != hour:
                hour, used = int(t // 3600), 0
            keep = used < p.max_per_hour or free
        if keep:
            kept, last, used = now, t, used + 1
        out.append((keep, score))
    return out


@pytest.mark.parametrize("blur", [True, False])
def test_gate_and_funnel_against_plain_loops(spark, sf_dir, blur):
    from dataclasses import replace

    from sightline.jobs import standins
    from sightline.jobs.queries import GRID_GATE

    frames = standins.grids(spark, sf_dir).where("frame_idx < 60")
    sets = {"usual": GRID_GATE, "blurred": replace(GRID_GATE, pixel_threshold=9.0), "capped": replace(GRID_GATE, keep_ratio=0.05, max_per_hour=7, dedup_ratio=0.01)}
    videos = {}
    for r in frames.orderBy("t").collect():
        videos.setdefault(r.video_id, []).append((r.t, r.h, r.w, bytes(r.gray)))
    funnel = {(r.video_id, r.param_id): r for r in sp.gate_funnel(frames, sets, blur=blur).collect()}
    for name, p in sets.items():
        got = {(r.video_id, r.t): (r.kept, r.motion_score) for r in sp.gate_all(frames, p, blur=blur).collect()}
        for v, rows in videos.items():
            want = plain_gate(rows, p, blur)
            assert [got[v, r[0]] for r in rows] == [(k, pytest.approx(x)) for k, x in want]
            f = funnel[v, name]
            assert (f.candidates, f.kept) == (sum(x is not None for _, x in want), sum(k for k, _ in want))
            assert f.moving >= f.kept and f.max_score == pytest.approx(max(x for _, x in want)) and f.median_score == pytest.approx(np.median([x for _, x in want]))


def test_decoded_frames_become_grids(spark):
    flat = np.full((6, 8, 3), (10, 20, 30), np.uint8)
    assert (sp.shrink(flat, 4, 3) == flat[:3, :4]).all() and sp.gray_of(flat)[0, 0] == round(0.114 * 10 + 0.587 * 20 + 0.299 * 30)
    ramp = np.repeat(np.arange(8, dtype=np.uint8)[None, :, None] * 10, 6, axis=0).repeat(3, axis=2)
    assert sp.shrink(ramp, 4, 3)[0, :, 0].tolist() == [5, 25, 45, 65] and (sp.shrink(ramp, 8, 6) == ramp).all()
    rows = [("v", 0, 0.0, 8, 6, flat.tobytes()), ("v", 1, 0.5, 8, 6, ramp.tobytes()), ("v", 2, 1.0, 8, 6, None)]
    df = spark.createDataFrame(rows, "video_id string, frame_idx long, t double, width int, height int, bgr binary")
    got = {r.frame_idx: r for r in sp.gray_grids(df, Params(grid_width=4, grid_height=3)).collect()}
    assert sorted(got) == [0, 1] and (got[1].w, got[1].h) == (4, 3) and list(got[1].gray) == [5, 25, 45, 65] * 3
    assert sp.gate_all(sp.gray_grids(df), P).count() == 2


def test_blur_rounds_to_whole_numbers():
    a = np.zeros((9, 9), np.uint8)
    a[4, 4] = 255
    assert sp.smooth(a)[4].tolist() == [0, 0, 6, 24, 36, 24, 6, 0, 0] and sp.smooth(np.full((1, 2), 7, np.uint8)).tolist() == [[7, 7]]


def test_decoded_frames_are_gated_as_their_grids(spark, sf_dir):
    from sightline.jobs.all_queries import QUERIES

    rows = lambda name: sorted(map(tuple, QUERIES[name](spark, sf_dir).collect()))
    assert rows("decoded_gate") == rows("gate_frames")


def test_kept_frames_carry_their_start(spark):
    """One row for each kept row, whatever repeats; a video without name keeps its rows."""
    r = np.random.default_rng(3)
    rows = [(v, i, i * 0.5, 8, 8, r.integers(0, 255, 64, np.uint8).tobytes(), b) for v, b in (("a", 100.0), ("b", None), (None, 7.0)) for i in range(12)]
    df = spark.createDataFrame([*rows, rows[3]], "video_id string, frame_idx long, t double, w int, h int, gray binary, base_ts double")
    kept = sorted((x for x in sp.gate_all(df, P).collect() if x.kept), key=str)
    got = sp.gate_frames(df, P).collect()
    base = {"a": 100.0, "b": None, None: 7.0}
    want = [(x.video_id, x.frame_idx, x.t, x.motion_score, None if base[x.video_id] is None else base[x.video_id] + x.t) for x in kept]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and {x.video_id for x in got} == {"a", "b", None}
    assert "ts" not in sp.gate_frames(df.drop("base_ts"), P).columns
