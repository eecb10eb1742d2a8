"""Ranking, thinning, gates, events and verification at their boundaries."""

import random

import pytest
from pyspark.sql import functions as F

from sightline.operators import evaluation as ev
from sightline.operators import search as sr
from sightline.operators import verify as vf

HIT = "query_id string, variant string, id string, score double, rank_score double, video_id string, frame_idx long, offset_s double, ts double, source string, intent string"


def hits(spark, rows):
    """rows: (id, score, video, offset[, source[, intent]])"""
    full = [("q", "all", r[0], r[1], r[1], r[2], int(r[3] * 2), float(r[3]), float(r[3]), *(list(r[4:]) + ["frame", "object"])[:2]) for r in rows]
    return spark.createDataFrame(full, HIT)


def test_suppression_window_and_chain(spark):
    rows = [("a", 0.9, "v", 0.0), ("b", 0.8, "v", 7.5), ("c", 0.7, "v", 8.0), ("d", 0.6, "w", 1.0), ("e", 0.5, "v", 15.5)]
    # b falls to a; c is 8 s from a and kept; e is 7.5 s from c and falls
    assert sorted(r.id for r in sr.suppress_near(hits(spark, rows)).collect()) == ["a", "c", "d"]


def greedy(rows, window):
    kept = []
    for r in sorted(rows, key=lambda r: (-r[1], r[0])):
        if all(k[2] != r[2] or abs(k[3] - r[3]) >= window for k in kept):
            kept.append(r)
    return sorted(r[0] for r in kept)


@pytest.mark.parametrize("seed", range(4))
def test_suppression_against_plain_loop(spark, seed):
    r = random.Random(seed)
    rows = [(f"h{i:03}", r.choice([0.1, 0.2, 0.3, 0.4]), r.choice("vw"), r.randrange(80) / 2) for i in range(60)]
    df = hits(spark, rows)
    assert sorted(x.id for x in sr.suppress_near(df).collect()) == greedy(rows, 8.0)
    assert sorted(x.id for x in sr.suppress_near(df.repartition(5)).collect()) == greedy(rows, 8.0)


def test_one_per_frame_prefers_score_then_id(spark):
    rows = [("b", 0.5, "v", 1.0, "crop"), ("a", 0.5, "v", 1.0), ("c", 0.4, "v", 1.0)]
    assert [r.id for r in sr.one_per_frame(hits(spark, rows)).collect()] == ["a"]


def test_rerank(spark):
    rows = [("a", 0.3, "v", 0.0, "frame", "scene"), ("b", 0.5, "v", 1.0, "crop", "scene")]
    got = {r.id: r.rank_score for r in sr.intent_rerank(hits(spark, rows)).collect()}
    assert got == {"a": pytest.approx(0.0), "b": pytest.approx(1.0)}
    same = [(i, 0.5, "v", 0.0, "frame", "scene") for i in "ab"]
    assert {r.rank_score for r in sr.intent_rerank(hits(spark, same)).collect()} == {0.5}
    assert {r.id: r.rank_score for r in sr.intent_rerank(hits(spark, rows), 0.0).collect()} == {"a": 0.3, "b": 0.5}
    objects = [(*r[:5], "object") for r in rows]
    assert {r.id: r.rank_score for r in sr.intent_rerank(hits(spark, objects)).collect()} == {"a": 0.3, "b": 0.5}


def test_gate_by_inventory(spark):
    q = spark.createDataFrame([("a", ["araba", "kamyon"], False), ("b", [], True), ("c", [], False), ("d", ["insan"], True)], "query_id string, required array<string>, generic_vehicle boolean")
    inv = lambda *c: spark.createDataFrame([(x,) for x in c], "yolo_class string")
    of = lambda i: {r.query_id: (r.missing, r.no_vehicle, r.gated) for r in sr.not_found_gate(q, i).collect()}
    assert of(inv("araba", "insan")) == {"a": (["kamyon"], False, True), "b": ([], False, False), "c": ([], False, False), "d": ([], False, False)}
    got = of(inv("insan"))
    assert got["b"] == ([], True, True) and got["a"][0] == ["araba", "kamyon"]
    assert of(inv())["d"] == (["insan"], False, True)


def test_events(spark):
    rows = [("v", 0.0, "a", 0.1), ("v", 50.0, "b", 0.9), ("v", 100.1, "c", 0.9), ("v", 100.2, "d", 0.9), ("w", 0.0, "e", 0.5)]
    got = sr.sighting_events(spark.createDataFrame(rows, "video_id string, ts double, id string, score double"), 50.0)
    assert sorted(map(tuple, got.collect())) == [("v", 1, 0.0, 50.0, 2, "b", 0.9), ("v", 2, 100.1, 100.2, 2, "c", 0.9), ("w", 1, 0.0, 0.0, 1, "e", 0.5)]


WORK = "query_id string, id string, rank int, score double, source string, yolo_class string, object_en string, color_en string, has_color boolean"


def fused(spark, rows, answers, **kw):
    work = spark.createDataFrame(rows, WORK)
    said = spark.createDataFrame(answers, "query_id string, id string, kind string, answer string")
    return {r.id: r for r in vf.fuse(vf.verdicts(work, said), **kw).collect()}


def test_fusion_is_three_valued(spark):
    rows = [("q", i, n, s, "frame", None, "car", "red", True) for n, (i, s) in enumerate([("null", 0.5), ("no", 0.6), ("wrong", 0.7), ("unsure", 0.8), ("good", 0.4)])]
    said = [("q", "no", "presence", "No"), ("q", "wrong", "presence", "yes"), ("q", "wrong", "color", "no"), ("q", "unsure", "presence", " Yes."), ("q", "good", "presence", "y"), ("q", "good", "color", "YES")]
    got = fused(spark, rows, said)
    assert {i: r.status for i, r in got.items()} == {"null": "kept", "no": "filtered", "wrong": "filtered", "unsure": "kept", "good": "kept"}
    assert got["null"].verdict is None and got["unsure"].verdict.color_match is None and got["wrong"].vrank is None
    plain = {i: (s - 1.7 / 3) / (((0.5 - 1.7 / 3) ** 2 + (0.8 - 1.7 / 3) ** 2 + (0.4 - 1.7 / 3) ** 2) / 3) ** 0.5 for i, s in (("null", 0.5), ("unsure", 0.8), ("good", 0.4))}
    assert got["good"].vrank == pytest.approx(plain["good"] + 0.5) and got["unsure"].vrank == pytest.approx(plain["unsure"])


def test_single_survivor_and_outage(spark):
    rows = [("q", "a", 1, 0.5, "frame", None, "dog", None, False)]
    assert fused(spark, rows, [("q", "a", "presence", "yes")])["a"].vrank == pytest.approx(0.5)
    down = fused(spark, rows, [("q", "a", "presence", None)], service_up=False)["a"]
    assert down.unavailable and down.status == "kept" and down.vrank is None
    assert not fused(spark, rows, [("q", "a", "presence", None)])["a"].unavailable


def test_presence_is_settled_by_the_detector(spark):
    rows = [("q", "a", 1, 0.5, "crop", "araba", "car", "red", True), ("q", "b", 2, 0.4, "frame", "araba", "car", "red", True)]
    got = fused(spark, rows, [("q", "a", "color", "yes"), ("q", "b", "color", "yes")])
    assert got["a"].verdict.object_present and got["a"].presence_question is None and got["b"].verdict is None


def test_wilson(spark):
    rows = [(0, 0), (0, 5), (5, 5), (11, 12)]
    low, high = ev.wilson(F.col("h").cast("double"), F.col("n").cast("double"))
    got = [(round(r[0], 3), round(r[1], 3)) for r in spark.createDataFrame(rows, "h int, n int").select(low, high).collect()]
    assert got[0] == (0.0, 0.0) and got[1][0] == 0.0 and got[2][1] == 1.0 and got[3] == (0.646, 0.985)


def test_models_that_fail(spark):
    from sightline.operators import verify as vf

    calls = []

    def make():
        seen = set()

        def answer(image, question):
            if image == "bad" or (image == "once" and (image, question) not in seen):
                seen.add((image, question))
                raise OSError
            return "No" if image == "none" else " Yes."

        return answer

    rows = [("q", n, n, False, "p?", "c?", "crop") for n in ("good", "bad", "once", "none")] + [("q", "null", None, False, "p?", None, "crop"), ("q", "sure", "good", True, None, "c?", "crop"), ("q", "far", "bad", False, "p?", None, "frame")]
    df = spark.createDataFrame(rows, "query_id string, id string, crop string, settled boolean, presence_question string, color_question string, view string")
    got = sorted((r.id, r.kind, r.answer) for r in vf.ask(df.selectExpr("*", "'good' as frame"), make).collect())
    yes = " Yes."
    assert got == [("bad", "presence", None), ("far", "presence", yes), ("good", "color", yes), ("good", "presence", yes), ("none", "presence", "No"), ("null", "presence", None), ("once", "color", yes), ("once", "presence", yes), ("sure", "color", yes)] and not calls


def test_detector_rows(spark):
    from sightline.operators import detections as d

    frames = spark.createDataFrame([("v", 1, b"ab"), ("v", 2, b""), ("v", 3, None)], "video_id string, frame_idx long, image binary")
    make = lambda: lambda images: [[(c, 0.5, 1, 2, 3, 4) for c in im] for im in images]
    got = sorted(map(tuple, d.detect(frames, make, batch=1).collect()))
    assert got == [("v", 1, 0, 97, 0.5, 1.0, 2.0, 3.0, 4.0), ("v", 1, 1, 98, 0.5, 1.0, 2.0, 3.0, 4.0)]


def test_stored_hits_are_not_broadcast_for_their_answers(spark, tmp_path):
    rows = [("q", f"p{i:012}", i, 0.5, "frame", None, "car", "red", True) for i in range(20)]
    spark.createDataFrame(rows, WORK).write.parquet(f"{tmp_path}/work")
    work = spark.read.parquet(f"{tmp_path}/work")
    said = work.select("query_id", "id", F.lit("presence").alias("kind"), F.lit("yes").alias("answer"))
    got = vf.verdicts(work, said)
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    assert [r.verdict.object_present for r in got.collect()] == [True] * 20
