import json
import time

import pytest
from pyspark.sql import functions as F

from sightline.jobs import standins
from sightline.jobs.queries import GRID_GATE
from sightline.operators import sampling as sp
from sightline.sources import catalog, versioned
from sightline.streaming import live


def drain(df, path, form="parquet"):
    df.writeStream.format(form).option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()


def test_gate_stream_is_the_batch_gate(spark, sf_dir, tmp_path):
    frames = standins.grids(spark, sf_dir)
    want = sorted((r.video_id, r.frame_idx) for r in sp.gate_frames(frames, GRID_GATE, blur=False).collect())
    base = str(tmp_path)
    out = None
    for lo, hi in ((0, 40), (40, 41), (41, 1000)):
        frames.where((F.col("frame_idx") >= lo) & (F.col("frame_idx") < hi)).write.mode("append").parquet(f"{base}/in")
        out = live.gate_stream(spark.readStream.schema(frames.schema).parquet(f"{base}/in"), GRID_GATE, blur=False)
        drain(out, base)
    got = sorted((r.video_id, r.frame_idx) for r in spark.read.schema(out.schema).parquet(f"{base}/out").collect())
    assert got == want


def test_a_silent_camera_gives_its_state_up(spark, sf_dir, tmp_path, request):
    setting = "spark.sql.streaming.noDataMicroBatches.enabled"
    spark.conf.set(setting, "false")
    request.addfinalizer(lambda: spark.conf.unset(setting))
    frames = standins.grids(spark, sf_dir).where("video_id in ('v0', 'v1')")
    anew = lambda lo: {(r.video_id, r.frame_idx) for r in sp.gate_frames(frames.where(F.col("frame_idx") >= lo), GRID_GATE, blur=False).collect()}
    whole, later = anew(0), anew(50)
    assert {r for r in whole if r[1] >= 50} != later
    for ttl, want in ((0.2, {r for r in whole if r[1] < 50} | later), (3600.0, whole)):
        base, out = str(tmp_path / str(ttl)), None
        for lo, hi in ((0, 50), (50, 1000)):
            frames.where((F.col("frame_idx") >= lo) & (F.col("frame_idx") < hi)).write.mode("append").parquet(f"{base}/in")
            out = live.gate_stream(spark.readStream.schema(frames.schema).parquet(f"{base}/in"), GRID_GATE, blur=False, ttl_s=ttl)
            drain(out, base)
            time.sleep(0.5)
        got = {(r.video_id, r.frame_idx) for r in spark.read.schema(out.schema).parquet(f"{base}/out").collect()}
        # the first run's frames before 50 are those of the whole, as later ones do not touch them
        assert got == want, ttl


def test_late_rows_are_kept_apart(spark, tmp_path):
    base = str(tmp_path)

    def feed(rows, state="state"):
        df = spark.createDataFrame(rows, "id string, t long").select("id", F.timestamp_seconds("t").alias("time"))
        df.write.mode("append").parquet(f"{base}/in")
        live.route_late(spark.readStream.schema(df.schema).parquet(f"{base}/in"), f"{base}/out", f"{base}/{state}", 10.0).awaitTermination()

    feed([("a", 1000), ("b", 1), ("c", None)])
    feed([("d", 990), ("e", 989), ("f", 5000), ("g", None)])
    feed([("h", 4000), ("i", 980)])
    feed([("j", 4990), ("k", 4989)])
    late = {r.id: r.delay_s for r in live.late_rows(spark, f"{base}/out").collect()}
    assert late == {"e": 1.0, "h": 990.0, "i": 4010.0, "k": 1.0}
    on_time = live.on_time(spark, f"{base}/out")
    assert {r.id for r in on_time.collect()} == set("abcdfgj") and on_time.columns == ["id", "time"]
    # a batch that is tried again replaces its rows
    for f in (tmp_path / "state" / "commits").glob("*3*"):
        f.unlink()
    live.route_late(spark.readStream.schema(on_time.schema).parquet(f"{base}/in"), f"{base}/out", f"{base}/state", 10.0).awaitTermination()
    assert {r.id: r.delay_s for r in live.late_rows(spark, f"{base}/out").collect()} == late and live.on_time(spark, f"{base}/out").count() == 7


def test_late_rows_are_dropped(spark, tmp_path):
    base = str(tmp_path)
    schema = "video_id string, time timestamp, id string, score double"

    def feed(rows):
        df = spark.createDataFrame(rows, "video_id string, t long, id string, score double").select("video_id", F.timestamp_seconds("t").alias("time"), "id", "score")
        df.write.mode("append").parquet(f"{base}/in")
        out = live.event_stream(spark.readStream.schema(schema).parquet(f"{base}/in"), 50.0, late="10 seconds")
        drain(out, base)
        return out

    feed([("v", 1000, "a", 0.1), ("v", 1050, "b", 0.2), ("v", 1101, "c", 0.3)])
    feed([("v", 5000, "d", 0.4)])
    out = feed([("v", 1060, "late", 0.9), ("v", 9000, "e", 0.5)])
    got = sorted((r.first_ts, r.last_ts, r.n, r.rep_id) for r in spark.read.schema(out.schema).parquet(f"{base}/out").collect())
    assert got[:2] == [(1000.0, 1050.0, 2, "b"), (1101.0, 1101.0, 1, "c")] and all(r[3] != "late" for r in got)


def test_upsert_stream_keeps_the_last_write(spark, tmp_path):
    base = str(tmp_path)
    schema = "id string, x int, time timestamp"

    def send(rows):
        spark.createDataFrame(rows, "id string, x int, t long").select("id", "x", F.timestamp_seconds("t").alias("time")).write.mode("append").parquet(f"{base}/in")
        live.upsert_stream(spark.readStream.schema(schema).parquet(f"{base}/in"), f"{base}/out", f"{base}/state").awaitTermination()

    stored = lambda: sorted((r.id, r.x) for r in live.stored_points(spark, f"{base}/out").collect())
    send([("a", 1, 1000), ("a", 2, 1001), ("b", 3, 1000)])
    assert stored() == [("a", 2), ("b", 3)]
    send([("a", 9, 900), ("c", 4, 10**6)])  # sent again, whatever its time says
    send([("b", 5, 2 * 10**6)])
    assert stored() == [("a", 9), ("b", 5), ("c", 4)]
    # a batch that is tried again changes nothing: its commit is undone, and the stream starts anew
    for f in (tmp_path / "state" / "commits").glob("*2*"):
        f.unlink()
    live.upsert_stream(spark.readStream.schema(schema).parquet(f"{base}/in"), f"{base}/out", f"{base}/state").awaitTermination()
    assert stored() == [("a", 9), ("b", 5), ("c", 4)]
    # so does a new checkpoint, which sends everything once more, and later points come after all others
    before = versioned.snapshot(spark, f"{base}/out")["seq"]
    live.upsert_stream(spark.readStream.schema(schema).parquet(f"{base}/in"), f"{base}/out", f"{base}/other").awaitTermination()
    assert versioned.snapshot(spark, f"{base}/out")["seq"] == before + 1
    assert {i for i, _ in stored()} == {"a", "b", "c"}
    send([("d", 6, 1000)])
    assert ("d", 6) in stored() and len(stored()) == 4


def test_a_new_checkpoint_loses_nothing(spark, tmp_path):
    base = str(tmp_path)
    schema = "id string, x int, time timestamp"
    for n, some in enumerate(("a", "b", "c")):
        spark.createDataFrame([(some, n, n)], "id string, x int, t long").select("id", "x", F.timestamp_seconds("t").alias("time")).write.parquet(f"{base}/in{n}")
        live.upsert_stream(spark.readStream.schema(schema).parquet(f"{base}/in{n}"), f"{base}/out", f"{base}/state{n}").awaitTermination()
    assert sorted((r.id, r.x) for r in live.stored_points(spark, f"{base}/out").collect()) == [("a", 0), ("b", 1), ("c", 2)]


def test_versioned_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    monkeypatch.setattr(versioned, "SHARE", 0.5)
    monkeypatch.setattr(versioned, "DELTAS", 3)
    rows = lambda some: spark.createDataFrame(some, "id string, x int")
    got = lambda **kw: sorted((r.id, r.x) for r in versioned.read(spark, path, **kw).collect())
    with pytest.raises(FileNotFoundError):
        versioned.read(spark, path)
    want, states = {}, []
    for n in range(8):
        some = {f"k{i}": n for i in range(60 if n == 0 else 6 * (n % 3))}
        want |= some
        states.append((versioned.commit(rows(list(some.items())), path, stream="s", number=n), dict(want)))
        assert got() == sorted(want.items())
    assert any(s["deltas"] for s, _ in states) and sum(not s["deltas"] for s, _ in states) >= 2
    assert all(len(s["deltas"]) <= 3 for s, _ in states)
    # a batch that was seen, a batch of another stream, an older snapshot, a few keys
    assert versioned.commit(rows([("k0", 99)]), path, stream="s", number=7)["seq"] == 8
    assert versioned.commit(rows([("new", 1)]), path, stream="other", number=0)["seq"] == 9
    want["new"] = 1
    assert got(number=states[4][0]["number"]) == sorted(states[4][1].items())
    few = versioned.read(spark, path, keys=["k1", "new", "none"])
    assert sorted((r.id, r.x) for r in few.collect()) == [("k1", want["k1"]), ("new", 1)]
    assert "PartitionFilters: [bucket" in few._jdf.queryExecution().toString() or "bucket" in few._jdf.queryExecution().toString().split("PartitionFilters")[1][:80]
    # a writer that died while writing its snapshot, and one that comes second
    state = versioned.snapshot(spark, path)
    (tmp_path / "t" / "snapshots" / f"{state['number'] + 1:012d}.json").write_text('{"numb')
    assert got() == sorted(want.items())
    assert versioned.commit(rows([("k0", 5)]), path)["number"] == state["number"] + 2
    want["k0"] = 5
    with pytest.raises(RuntimeError):
        versioned._publish(spark, path, state, state["number"])
    state = versioned.compact(spark, path)
    assert not state["deltas"] and state["base"]["rows"] == len(want) and got() == sorted(want.items())
    assert versioned.vacuum(spark, path, kept=1) > 3 and got() == sorted(want.items())
    assert len(list((tmp_path / "t" / "data").iterdir())) == 1
    assert versioned.commit(rows([]), path)["base"]["rows"] == len(want) and got() == sorted(want.items())


def test_stream_gate_query_is_the_batch_gate(spark, sf_dir):
    from sightline.jobs.all_queries import QUERIES

    want = sorted((r.video_id, r.frame_idx) for r in sp.gate_frames(standins.grids(spark, sf_dir), GRID_GATE).collect())
    assert sorted((r.video_id, r.frame_idx) for r in QUERIES["stream_gate"](spark, sf_dir).collect()) == want


def test_catalog(spark, tmp_path):
    for n in ("kapı.MP4", "yol.cam.ts", "note.txt"):
        (tmp_path / n).write_bytes(b"x")
    got = [(r.video_id, r.camera_id, r.length) for r in catalog.video_catalog(spark, str(tmp_path)).collect()]
    assert sorted(got) == [("kapı", "kapı", 1), ("yol.cam", "yol.cam", 1)]
    starts = catalog.recording_start(catalog.video_catalog(spark, str(tmp_path), "c9"), spark.createDataFrame([("kapı", 10.0)], "video_id string, duration_s double"))
    r = starts.first()
    assert r.camera_id == "c9" and r.start_ts == pytest.approx((tmp_path / "kapı.MP4").stat().st_mtime - 10.0, abs=0.01)
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "a.txt").write_text("x")
    with pytest.raises(FileNotFoundError):
        catalog.video_catalog(spark, str(tmp_path / "empty"))


def test_query_sets_and_results(spark, tmp_path):
    row = {"id": "a", "query": "kedi", "gt_type": "golden", "scorable_recall": True, "relevant_videos": ["v"], "golden_frame": {"video_id": "v", "frame_idx": 3}}
    (tmp_path / "q.json").write_text(json.dumps(row) + "\n")
    df = catalog.load_query_set(spark, str(tmp_path / "q.json"), "retrieval")
    assert df.first().golden_frame.frame_idx == 3 and df.first().notes is None
    catalog.write_results({"rows": df}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "rows")).count() == 1
