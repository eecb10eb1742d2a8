import uuid

import numpy as np
import re

import pytest
from pyspark.sql import functions as F

from sightline.functions import querytext as q
from sightline.operators import index as ix
from sightline.operators import vectors as v


@pytest.mark.parametrize("name", ["archive:v:0", "arşiv:kapı:12:crop:3", "", "İ"])
def test_uuid5(spark, name):
    got = spark.createDataFrame([(name,)], "n string").select(ix.uuid5(F.col("n"))).first()[0]
    assert got == str(uuid.uuid5(uuid.NAMESPACE_URL, name))


def test_upsert_and_rewrite(spark, tmp_path):
    df = spark.createDataFrame([("a", "v", 1, 0), ("a", "v", 2, 1), ("b", "w", 3, 0)], "id string, video_id string, x int, batch_no int")
    latest = ix.upsert_latest(df).drop("batch_no")
    assert sorted((r.id, r.x) for r in latest.collect()) == [("a", 2), ("b", 3)]
    path = str(tmp_path / "points")
    ix.write_points(latest, path)
    again = spark.createDataFrame([("c", "v", 9)], "id string, video_id string, x int")
    held = [(r.id, r.video_id, r.x) for r in spark.read.parquet(path).collect()]
    ix.write_points(again, path, merge_with=spark.createDataFrame(held, again.schema))
    assert sorted((r.id, r.x) for r in spark.read.parquet(path).collect()) == [("a", 2), ("b", 3), ("c", 9)]
    ix.write_points(again, path)  # the video's points are replaced
    assert sorted((r.id, r.x) for r in spark.read.parquet(path).collect()) == [("b", 3), ("c", 9)]


def points(spark, n=300, d=8, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d)).astype(np.float32)
    x[n // 2 :] = x[0]  # one very common vector
    rows = [(f"p{i:04}", x[i].tolist(), float(i), "c1" if i % 3 else "c2", "frame" if i % 4 == 0 else "crop") for i in range(n)]
    return x, rows, spark.createDataFrame(rows, "id string, vector array<float>, ts double, camera_id string, source string")


def brute(x, rows, query, k, ts=(None, None), camera=None, source=None):
    ok = [i for i, r in enumerate(rows) if (ts[0] is None or r[2] >= ts[0]) and (ts[1] is None or r[2] <= ts[1]) and camera in (None, r[3]) and source in (None, r[4])]
    s = np.round((x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)) @ (query / np.linalg.norm(query)), 6)
    return [rows[i][0] for i in sorted(ok, key=lambda i: (-s[i], rows[i][0]))[:k]]


def test_top_k_with_windows_and_ties(spark, monkeypatch):
    x, rows, df = points(spark)
    asked = [("a", None, None, None), ("b", 10.0, 20.0, None), ("c", 5.0, None, "c2"), ("d", 9000.0, None, None), ("e", 20.0, 20.0, None)]
    qs = spark.createDataFrame([(n, x[i].tolist(), f, t, c) for i, (n, f, t, c) in enumerate(asked)], "query_id string, vector array<float>, ts_from double, ts_to double, camera_id string")
    for block in (8_000_000, 0):
        monkeypatch.setattr(v, "BROADCAST_BYTES", block)
        got = v.top_k(df.repartition(5), qs, 7, ("all", "frame"), payload=()).orderBy("pos").collect()
        for i, (n, f, t, c) in enumerate(asked):
            dropped = n == "d"
            for variant in ("all", "frame"):
                mine = [r for r in got if r.query_id == n and r.variant == variant]
                # no frame lies in the one-second windows of b and e? those fall back too
                want = brute(x, rows, x[i].astype(float), 7, (f, t), c, None if variant == "all" else variant)
                if not want:
                    want, dropped_here = brute(x, rows, x[i].astype(float), 7, (None, None), c, None if variant == "all" else variant), True
                else:
                    dropped_here = dropped
                assert [r.id for r in mine] == want and {r.time_dropped for r in mine} == {dropped_here}


def test_unit_rows_keep_zero():
    assert (v.unit_rows(np.array([[0.0, 0.0], [3.0, 4.0]])) == [[0, 0], [0.6, 0.8]]).all()


def test_embed_is_batched(spark):
    df = spark.createDataFrame([(i, "ab" * i) for i in range(10)], "n int, t string").coalesce(1)
    out = v.embed(df, "t", lambda: lambda texts: np.array([[len(x), len(texts)] for x in texts], float), batch=4)
    got = {r.n: r.vector for r in out.collect()}
    assert got[1] == pytest.approx([2 / 20**0.5, 4 / 20**0.5]) and got[9] == pytest.approx([18 / 328**0.5, 2 / 328**0.5])


NOW = "2024-03-10 15:30:00"
CASES = [
    ("dün gece siteye giren beyaz transit", "dün gece", "2024-03-09 20:00:00", "2024-03-10 06:00:00", "siteye giren beyaz transit"),
    ("Saat 9:05 gibi geçen araba", "saat 9:05 gibi", "2024-03-10 08:20:00", "2024-03-10 09:50:00", "geçen araba"),
    ("dün saat 22 civarı kırmızı otobüs var mı?", "dün saat 22 civarı", "2024-03-09 21:15:00", "2024-03-09 22:45:00", "kırmızı otobüs"),
    ("son 3 saatte yürüyen insan", "son 3 saatte", "2024-03-10 12:30:00", NOW, "yürüyen insan"),
    ("SON 30 DAKİKA kedi", "son 30 dakika", "2024-03-10 15:00:00", NOW, "kedi"),
    ("bugün gelen KAMYON", "bugün", "2024-03-10 00:00:00", NOW, "gelen kamyon"),
    ("dün", "dün", "2024-03-09 00:00:00", "2024-03-10 00:00:00", ""),
    ("bu akşamüstü otopark", "bu akşamüstü", "2024-03-10 17:00:00", "2024-03-10 23:00:00", "otopark"),
    ("bu gece park", "bu gece", "2024-03-10 20:00:00", "2024-03-11 06:00:00", "park"),
    ("bugün, dün sabah kapı", "dün sabah", "2024-03-09 05:00:00", "2024-03-09 12:00:00", "bugün kapı"),
    ("İnsan bul", None, None, None, "insan"),
    ("gece", None, None, None, "gece"),
    ("dünkü araba", None, None, None, "dünkü araba"),
    ("", None, None, None, ""),
]


def test_parser_table(spark):
    df = spark.createDataFrame([(c[0],) for c in CASES], "raw_query string").withColumn("now", F.lit(NOW).cast("timestamp"))
    at = lambda c: F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd HH:mm:ss")
    got = {r[0]: tuple(r[1:]) for r in q.parse_time(df).select("raw_query", "time_phrase", at("ts_from"), at("ts_to"), "visual_text").collect()}
    assert got == {c[0]: c[1:] for c in CASES}


def test_intent_and_targets(spark):
    rows = {
        "otoparkta yürüyen insan": (["insan"], False, "object", "person", None),
        "araçlarla dolu açık otopark": ([], True, "scene", "vehicle", None),
        "siyah köpek gezdiren adam": (["insan"], False, "object", "dog", "black"),
        "karanlık yol": ([], False, "scene", "snow", None),
        "erkek": (["insan"], False, "object", "object", None),
        "kırmızı araba, mavi kamyon": (["araba", "kamyon"], False, "object", "truck", "red"),
        "bir şey": ([], False, "neutral", None, None),
    }
    df = spark.createDataFrame([(k,) for k in rows], "t string")
    t = F.col("t")
    got = {r[0]: tuple(r[1:]) for r in df.select("t", q.required_classes(t), q.generic_vehicle(t), q.intent(t), q.object_en(t), q.color_en(t)).collect()}
    assert got == rows


def test_fill_unknown_only_fills_gaps(spark):
    p = spark.createDataFrame([("Forklift", None, None), ("forklift", None, "red"), ("araba", "car", None)], "text string, object_en string, color_en string")
    e = spark.createDataFrame([("forklift", "forklift", "blue"), ("araba", "bus", "green")], "text string, object string, color string")
    assert sorted(map(str, q.fill_unknown(p, e).select("text", "object_en", "color_en").collect())) == sorted(
        map(str, spark.createDataFrame([("Forklift", "forklift", "blue"), ("forklift", "forklift", "red"), ("araba", "car", None)], "text string, object_en string, color_en string").collect())
    )


@pytest.mark.parametrize("how", [{}, {"POINTS": 3, "QUERIES": 2}, {"POINTS": 7, "QUERY_BYTES": 1, "BROADCAST_BYTES": 0}, {"MERGE": 1}, {"cells": 10.0}, {"cells": 1000.0, "POINTS": 4}])
def test_top_k_against_a_full_sort(spark, monkeypatch, tmp_path, how):
    """With null times, null vectors, zero vectors, ties, and queries of every kind; few queries and many, in one scan
    and by cells."""
    import random

    for name, value in how.items():
        if name != "cells":
            monkeypatch.setattr(v, name, value)
    r = random.Random(3)
    vec = lambda: None if r.random() < 0.1 else [float(r.randrange(-2, 3)) for _ in range(3)]
    points = [(f"p{i:03}", vec(), None if r.random() < 0.2 else float(i), r.choice(["a", "b", None]), r.choice(["frame", "crop"]), i) for i in range(120)]
    queries = [(f"q{i}", vec(), *r.choice([(None, None), (10.0, 30.0), (None, 20.0), (900.0, None)]), r.choice([None, "a", "z"])) for i in range(40)]
    p = spark.createDataFrame(points, "id string, vector array<float>, ts double, camera_id string, source string, n int").repartition(5)
    q = spark.createDataFrame(queries, "query_id string, vector array<float>, ts_from double, ts_to double, camera_id string")
    if "cells" in how:
        v.write_cells(p, str(tmp_path / "index"), how["cells"])
        found = v.cell_top_k(spark, str(tmp_path / "index"), q, 4, ("all", "crop"), payload=("n", "ts"))
    else:
        found = v.top_k(p, q, 4, ("all", "crop"), payload=("n", "ts"))
    got = {(x.query_id, x.variant, x.pos): (x.id, x.score, x.time_dropped, x.n) for x in found.collect()}
    want = {}
    unit = lambda x: np.array(x) / max(np.linalg.norm(x), 1e-12)
    for qid, qv, lo, hi, cam in queries:
        for variant in ("all", "crop"):
            rows = [x for x in points if x[1] and qv and cam in (None, x[3]) and variant in ("all", x[4])]
            inside = [x for x in rows if (lo is None and hi is None) or (x[2] is not None and (lo is None or x[2] >= lo) and (hi is None or x[2] <= hi))]
            best = sorted((-round(float(unit(x[1]) @ unit(qv)), 6) + 0.0, x[0], x[5]) for x in inside or rows)[:4]
            want |= {(qid, variant, n + 1): (i, pytest.approx(-score, abs=2e-6), not inside, m) for n, (score, i, m) in enumerate(best)}
    assert got == want
    assert v.top_k(p.where("false"), q, 4, payload=("n", "ts")).count() == 0 and v.top_k(p, q.where("false"), 4, payload=("n", "ts")).count() == 0


def test_top_k_of_ten_thousand_queries(spark, sf_dir, monkeypatch):
    """None of them passes through the driver, and the points are scanned once."""
    from sightline.jobs import standins

    monkeypatch.setattr(v, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(v, "QUERY_BYTES", 1 << 20)
    p = standins.idx(spark, sf_dir)
    bend = F.transform("vector", lambda x, i: x + F.sin(F.col("n") * 7 + i) / 8)
    q = p.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(19)))).select(F.concat_ws("-", "id", "n").alias("query_id"), bend.alias("vector"))
    found = v.top_k(p, q, 3, payload=("ts",))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation") - 1 <= 2
    got = found.toPandas().sort_values(["query_id", "pos"])
    asked, held = q.toPandas(), p.select("id", "vector").orderBy("id").toPandas()
    unit = lambda x: v.unit_rows(np.array(x.tolist(), float))
    score = np.round(unit(asked.vector) @ unit(held.vector).T, 6)
    top = np.argsort(-score, axis=1, kind="stable")[:, :3]
    want = {(i, held.id[j], n + 1) for i, t in zip(asked.query_id, top) for n, j in enumerate(t)}
    assert len(got) == 30_000 and len(set(zip(got.query_id, got.id, got.pos)) - want) <= 3  # scores that round either way


def test_cells_skip_files(spark, sf_dir, tmp_path):
    from sightline.jobs import standins

    path = str(tmp_path / "index")
    v.write_cells(standins.idx(spark, sf_dir), path, 5.0)
    stored = spark.read.parquet(path)
    files = lambda df: df.select(F.input_file_name()).distinct().count()
    start = float(standins.BASE_TS)
    asked = lambda a, z, c: spark.createDataFrame([("q", a, z, c)], "query_id string, ts_from double, ts_to double, camera_id string")
    some = [v.cell_points(spark, path, v.touched_cells(spark, path, asked(start + a, start + z, c)).select("cell").distinct()) for a, z, c in ((20, 24, "c1"), (20, 24, None), (20, 49, None))]
    assert 0 < files(some[0]) < files(some[1]) < files(some[2]) < files(stored)
    assert re.search(r"PartitionFilters: \[[^\]]*cell", some[0]._jdf.queryExecution().toString())
    for df, z, c in zip(some, (24, 24, 49), ("c1", None, None)):
        inside = (F.col("ts") >= start + 20) & (F.col("ts") <= start + z) & (F.lit(c is None) | (F.col("camera_id") == c))
        assert df.where(inside).count() == stored.where(inside).count() > 0
    assert v.touched_cells(spark, path, asked(9e9, None, None)).count() == 0


def test_windows_follow_the_wall_clock(spark):
    """On the day on which clocks go from two to three."""
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        rows = [("saat 9:05 gibi kedi",), ("bugün kedi",), ("son 3 saatte kedi",), ("dün saat 22 civarı kedi",)]
        df = spark.createDataFrame(rows, "raw_query string").withColumn("now", F.lit("2024-03-31 15:30:00").cast("timestamp"))
        got = {r.raw_query: (r.ts_from, r.ts_to) for r in q.parse_time(df).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    midnight = 1711839600.0  # 23:00 UTC of the day before
    now, nine = midnight + 14.5 * 3600, midnight + 8 * 3600 + 300
    half = q.CLOCK_MINUTES * 60
    assert got["bugün kedi"] == (midnight, now) and got["son 3 saatte kedi"] == (now - 3 * 3600, now)
    assert got["saat 9:05 gibi kedi"] == (nine - half, nine + half) and got["dün saat 22 civarı kedi"] == (midnight - 7200 - half, midnight - 7200 + half)


def test_unit_vectors_keep_the_sign_of_zero(spark, tmp_path):
    import duckdb

    from sightline.jobs.all_queries import QUERIES, SQL

    rows = [(0, [-1e-7, 1.0]), (1, [1e-7, -0.0]), (2, [0.0, -0.0]), (3, [-4.9e-7, -0.6]), (4, [3.0, -4.0]), (5, []), (6, None), (7, [float("nan"), 1.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["l2_normalize"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, con.execute(SQL["l2_normalize"]).fetchall()))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_blocks_of_many_queries_do_not_pass_the_driver(spark, monkeypatch, tmp_path):
    """Spark takes a block of 4 MB for 100 bytes; it must not broadcast blocks that are too many for that."""
    _, rows, df = points(spark)
    qs = spark.createDataFrame([(f"q{i:02}", r[1]) for i, r in enumerate(rows[:40])], "query_id string, vector array<float>")
    for name, table in (("points", df), ("queries", qs)):
        table.write.parquet(f"{tmp_path}/{name}")
    df, qs = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("points", "queries"))
    assert "BroadcastHashJoin" in plan(v.top_k(df, qs, 3, payload=()))
    monkeypatch.setattr(v, "BROADCAST_BYTES", 0)
    found = v.top_k(df, qs, 3, payload=())
    assert "SortMergeJoin" in plan(found) and "BroadcastHashJoin" not in plan(found)
    assert found.count() == 3 * 40


@pytest.mark.parametrize("how", [{"HITS": 30}, {"HITS": 30, "POINTS": 5, "HELD": 1}, {"HITS": 1, "POINTS": 2}, {"POINTS": 4, "QUERIES": 3}])
def test_top_k_with_few_hits_kept_at_once(spark, monkeypatch, how):
    """Blocks of one query or of some, their hits pruned again and again, half of all points alike."""
    for name, value in ({"BROADCAST_HITS": 0} | how).items():
        monkeypatch.setattr(v, name, value, raising=False)
    x, rows, df = points(spark)
    asked = [(f"q{i}", x[i].tolist(), *((None, None), (3.0 * i, 3.0 * i + 9), (900.0, None))[i % 3], (None, "c2")[i % 2]) for i in range(12)]
    qs = spark.createDataFrame(asked, "query_id string, vector array<float>, ts_from double, ts_to double, camera_id string")
    got = v.top_k(df.repartition(3), qs, 5, ("all", "crop"), payload=("ts",)).orderBy("pos").collect()
    for i, (n, _, a, z, camera) in enumerate(asked):
        for variant in ("all", "crop"):
            of = lambda ts: brute(x, rows, x[i].astype(float), 5, ts, camera, None if variant == "all" else variant)
            mine = [r for r in got if (r.query_id, r.variant) == (n, variant)]
            assert [r.id for r in mine] == (of((a, z)) or of((None, None)))
            assert {r.time_dropped for r in mine} == {not of((a, z))} and all(r.ts == float(r.id[1:]) for r in mine)


def test_queries_of_many_hits_are_not_all_kept_by_every_task(spark):
    """1,500 short vectors are few bytes, but 216,000 hits."""
    x, _, df = points(spark)
    qs = spark.createDataFrame([(f"q{i:04}", x[i % 150].tolist()) for i in range(1500)], "query_id string, vector array<float>")
    variants = ("all", "frame", "crop")
    found = v.top_k(df, qs, 48, variants, payload=())
    assert "SortMergeJoin" in plan(found) and "BroadcastHashJoin" in plan(v.top_k(df, qs, 4, variants, payload=()))
    counts = found.groupBy("variant").agg(F.count(F.lit(1)), F.countDistinct("query_id"), F.max("pos")).collect()
    assert sorted(map(tuple, counts)) == [(n, 1500 * 48, 1500, 48) for n in sorted(variants)]
