"""Registered queries on the stand-in tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.jobs import standins as s
from sightline.operators import detections as d
from sightline.operators import index as ix
from sightline.operators import sampling as sp
from sightline.operators import search as sr
from sightline.operators import vectors as v
from sightline.params import Params
from sightline.sources.work import work_dir

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# ---- index ----

_UUID = """
  substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
  substr('89ab89ab89ab89ab', instr('0123456789abcdef', substr(h, 17, 1)), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"""


@query(f"""WITH {s.IDX}, named AS (
  SELECT vec_id, sha1(from_hex('{ix.URL_NAMESPACE}') || encode(CASE WHEN source = 'crop'
    THEN 'archive:' || video_id || ':' || frame_idx || ':crop:' || k ELSE 'archive:' || video_id || ':' || frame_idx END)) AS h
  FROM idx)
SELECT vec_id, {_UUID} AS point_id FROM named""")
def point_ids(spark, sf_dir: str) -> DataFrame:
    return ix.point_ids(s.idx(spark, sf_dir), "archive").select("vec_id", F.col("id").alias("point_id"))


@query(f"""WITH {s.IDX}, b AS (
  SELECT id, source, frame_idx, 0 AS batch_no FROM idx
  UNION ALL SELECT id, source, frame_idx + 1000, 1 FROM idx WHERE vec_id % 3 = 0
  UNION ALL SELECT id, source, frame_idx + 2000, 2 FROM idx WHERE vec_id % 7 = 0)
SELECT id, source, frame_idx, batch_no FROM b
QUALIFY row_number() OVER (PARTITION BY id ORDER BY batch_no DESC) = 1""")
def upsert_latest(spark, sf_dir: str) -> DataFrame:
    p = s.idx(spark, sf_dir)
    batch = lambda df, n, by: df.select("id", "source", (F.col("frame_idx") + by).alias("frame_idx"), F.lit(n).alias("batch_no"))
    both = batch(p, 0, 0).unionByName(batch(p.where("vec_id % 3 = 0"), 1, 1000)).unionByName(batch(p.where("vec_id % 7 = 0"), 2, 2000))
    return ix.upsert_latest(both)


@query(f"""WITH {s.IDX}
SELECT c.id, c.video_id, c.frame_idx, c.yolo_class, f.camera_id, f.ts, f.offset_s, f.id AS thumb_path
FROM idx c JOIN idx f ON c.source = 'crop' AND f.source = 'frame' AND c.video_id = f.video_id AND c.frame_idx = f.frame_idx""")
def linked_crops(spark, sf_dir: str) -> DataFrame:
    p = s.idx(spark, sf_dir)
    crops = p.where("source = 'crop'").select("id", "video_id", "frame_idx", "yolo_class")
    return ix.link_crops(crops, p.where("source = 'frame'").withColumn("thumb_path", F.col("id")))


@query(f"""WITH {s.IDX}
SELECT video_id, count(*) FILTER (source = 'frame') AS frames, count(*) FILTER (source = 'crop') AS crops
FROM idx GROUP BY ROLLUP (video_id)""")
def index_summary(spark, sf_dir: str) -> DataFrame:
    return ix.index_summary(s.idx(spark, sf_dir))


@query(f"""WITH {s.IDX}
SELECT video_id, count(*) AS total, count(*) FILTER (source = 'frame') AS frame, count(*) FILTER (source = 'crop') AS crop,
       coalesce(string_agg(DISTINCT yolo_class, ',' ORDER BY yolo_class), '') AS classes
FROM idx GROUP BY ROLLUP (video_id)""")
def corpus_manifest(spark, sf_dir: str) -> DataFrame:
    return ix.corpus_manifest(s.idx(spark, sf_dir))


@query(f"""WITH {s.IDX}
SELECT video_id, {', '.join(f"count(*) FILTER (yolo_class = '{c}') AS {a}" for c, a in zip(s.CLASS_OF, ('person', 'car', 'truck', 'bus', 'bicycle', 'motorcycle')))}
FROM idx WHERE source = 'crop' GROUP BY video_id""")
def class_by_video(spark, sf_dir: str) -> DataFrame:
    out = ix.class_by_video(s.idx(spark, sf_dir), list(s.CLASS_OF))
    return out.toDF("video_id", "person", "car", "truck", "bus", "bicycle", "motorcycle")


@query(f"WITH {s.IDX} SELECT DISTINCT yolo_class FROM idx WHERE source = 'crop' AND yolo_class <> ''")
def class_inventory(spark, sf_dir: str) -> DataFrame:
    return ix.class_inventory(s.idx(spark, sf_dir))


# ---- detections ----

_NAMES = "CASE cls_id " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in d.CLASSES) + " END"
_CLEAN = f"""clean AS (
  SELECT *, {_NAMES} AS cls_name, y2 - y1 < 32 AS tiny FROM det
  WHERE cls_id IN (0, 1, 2, 3, 5, 7) AND y2 - y1 >= 16 AND conf >= CASE WHEN cls_id = 0 THEN 0.15 ELSE 0.25 END)"""
_STATIC = f"""{_CLEAN}, numbered AS (
  SELECT video_id, frame_idx, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) AS frame_no
  FROM (SELECT DISTINCT video_id, frame_idx FROM det)),
placed AS (SELECT * FROM clean JOIN numbered USING (video_id, frame_idx)),
moving AS (
  SELECT * FROM placed a WHERE NOT EXISTS (
    SELECT 1 FROM placed b WHERE b.video_id = a.video_id AND b.frame_no = a.frame_no - 1 AND b.cls_id = a.cls_id
    AND least(a.x2, b.x2) > greatest(a.x1, b.x1) AND least(a.y2, b.y2) > greatest(a.y1, b.y1)
    AND (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1))
      / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1)
         - (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1))) > 0.85))"""
_CAPPED = f"""{_STATIC}, capped AS (
  SELECT *, row_number() OVER (PARTITION BY video_id, frame_idx
    ORDER BY (cls_id <> 0), conf DESC, det_idx, l_partkey, l_suppkey, l_extendedprice) - 1 AS k FROM moving
  QUALIFY k < 24)"""
_BOXES = f"""{_CAPPED}, sq AS (
  SELECT *, greatest((x2 - x1) * 1.4, (y2 - y1) * 1.4)::DOUBLE AS side, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM capped),
boxes AS (
  SELECT *, greatest(0, round_even(cx - side / 2, 0))::INT AS cx1, greatest(0, round_even(cy - side / 2, 0))::INT AS cy1,
         least(w, round_even(cx + side / 2, 0))::INT AS cx2, least(h, round_even(cy + side / 2, 0))::INT AS cy2,
         x1 / w AS n_x1, y1 / h AS n_y1, x2 / w AS n_x2, y2 / h AS n_y2 FROM sq)"""


def _moving(spark, sf_dir: str) -> DataFrame:
    det = s.det(spark, sf_dir)
    return d.suppress_static(d.clean(det), det.select("video_id", "frame_idx"))


def _capped(spark, sf_dir: str) -> DataFrame:
    return d.cap_crops(_moving(spark, sf_dir), ties=s.DET_TIES)


def _fake_detector():
    """A model in a few lines: up to two boxes of a picture, by its first bytes."""

    def detect(images: list) -> list:
        return [[((0, 2, 7)[g[1 + i] % 3], g[4 + i] % 100 / 100, float(g[8 + i]), float(g[12 + i]), g[8 + i] + 20.0, g[12 + i] + 5.0 + g[16 + i] % 40) for i in range(g[0] % 3)] for g in images]

    return detect


@query("""WITH g AS (SELECT 'v' || (vec_id % 5) AS video_id, vec_id // 5 AS frame_idx,
  list_transform(embedding::DOUBLE[], lambda x: greatest(0, least(255, floor((x + 0.5) * 255)::BIGINT))) AS b FROM embeddings),
n AS (SELECT *, unnest(range(b[1] % 3)) AS i FROM g)
SELECT video_id, frame_idx, i::INT AS det_idx, ([0, 2, 7])[b[2 + i] % 3 + 1] AS cls_id, (b[5 + i] % 100) / 100 AS conf, b[9 + i]::DOUBLE AS x1, b[13 + i]::DOUBLE AS y1,
  b[9 + i] + 20.0::DOUBLE AS x2, b[13 + i] + 5.0::DOUBLE + b[17 + i] % 40 AS y2 FROM n""")
def detect_frames(spark, sf_dir: str) -> DataFrame:
    """Detections of a stand-in for a model on the gray grids."""
    return d.detect(s.grids(spark, sf_dir), _fake_detector, image="gray")


@query(f"""WITH {s.DET}, {_CLEAN}
SELECT video_id, frame_idx, cls_name, tiny, count(*) AS n, round(sum(conf), 4) AS conf, sum(x1 + y2) AS boxes FROM clean GROUP BY ALL""")
def clean_detections(spark, sf_dir: str) -> DataFrame:
    return d.clean(s.det(spark, sf_dir)).groupBy("video_id", "frame_idx", "cls_name", "tiny").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("conf"), 4).alias("conf"), F.sum(F.col("x1") + F.col("y2")).alias("boxes")
    )


@query(f"""WITH {s.DET}, {_STATIC}
SELECT video_id, frame_idx, det_idx, cls_id, conf, x1, y1, x2, y2 FROM moving""")
def suppress_static(spark, sf_dir: str) -> DataFrame:
    return _moving(spark, sf_dir).select("video_id", "frame_idx", "det_idx", "cls_id", "conf", "x1", "y1", "x2", "y2")


@query(f"""WITH {s.DET}, {_CAPPED}
SELECT video_id, frame_idx, k, cls_id, conf, det_idx FROM capped""")
def cap_crops(spark, sf_dir: str) -> DataFrame:
    return _capped(spark, sf_dir).select("video_id", "frame_idx", "k", "cls_id", "conf", "det_idx")


@query(f"""WITH {s.DET}, {_BOXES}
SELECT video_id, frame_idx, k, cx1, cy1, cx2, cy2, n_x1, n_y1, n_x2, n_y2 FROM boxes WHERE cx2 > cx1 AND cy2 > cy1""")
def crop_boxes(spark, sf_dir: str) -> DataFrame:
    return d.crop_boxes(_capped(spark, sf_dir)).select(
        "video_id", "frame_idx", "k", "cx1", "cy1", "cx2", "cy2", "n_x1", "n_y1", "n_x2", "n_y2"
    )


@query(f"""WITH {s.DET}, {_BOXES}, px AS (
  SELECT *, n_x1 * w AS px1, n_y1 * h AS py1, n_x2 * w AS px2, n_y2 * h AS py2 FROM boxes WHERE cx2 > cx1 AND cy2 > cy1),
rsq AS (SELECT *, greatest((px2 - px1) + 0.5::DOUBLE * (px2 - px1), (py2 - py1) + 0.5::DOUBLE * (py2 - py1)) AS rside FROM px)
SELECT video_id, frame_idx, k, greatest(0, trunc((px1 + px2) / 2 - rside / 2)::INT) AS rx1, greatest(0, trunc((py1 + py2) / 2 - rside / 2)::INT) AS ry1,
       least(w, trunc((px1 + px2) / 2 + rside / 2)::INT) AS rx2, least(h, trunc((py1 + py2) / 2 + rside / 2)::INT) AS ry2 FROM rsq""")
def recrop_boxes(spark, sf_dir: str) -> DataFrame:
    return d.recrop_boxes(d.crop_boxes(_capped(spark, sf_dir))).select("video_id", "frame_idx", "k", "rx1", "ry1", "rx2", "ry2")


# ---- vectors and hits ----

_COS = "round(list_dot_product(i.vector, q.vector) / (sqrt(list_dot_product(i.vector, i.vector)) * sqrt(list_dot_product(q.vector, q.vector))), 6)"


def _pool_sql(k: int, variants: str = "('all')", window: str = "q.ts_from", camera: str = "q.camera_id") -> str:
    """Common table expression ``pool``: the best ``k`` hits of each query and variant."""
    return f"""{s.IDX}, {s.QUERY}, scored AS (
  SELECT q.query_id, v.variant, q.label AS wanted, q.intent, i.*, {_COS} AS score,
         {window} IS NULL OR (i.ts >= q.ts_from AND i.ts <= q.ts_to) AS inside
  FROM qv q, idx i, (VALUES {variants}) v(variant)
  WHERE ({camera} IS NULL OR i.camera_id = q.camera_id) AND (v.variant = 'all' OR i.source = v.variant)),
pool AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, variant ORDER BY score DESC, id) AS pos
  FROM (SELECT *, bool_or(inside) OVER (PARTITION BY query_id, variant) AS any_inside FROM scored) WHERE inside = any_inside
  QUALIFY pos <= {k})"""


def _pool(spark, sf_dir: str, k: int, variants=("all",), window: bool = True, camera: bool = True) -> DataFrame:
    q = s.query_vectors(spark, sf_dir)
    asked = q.drop(*([] if window else ["ts_from", "ts_to"]), *([] if camera else ["camera_id"]))
    hits = v.top_k(s.idx(spark, sf_dir), asked, k, variants, payload=("video_id", "frame_idx", "offset_s", "ts", "source", "yolo_class", "label"))
    return hits.join(q.select("query_id", "intent", F.col("label").alias("wanted")), "query_id")


@query("""SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: round(x * 3 / greatest(sqrt(list_dot_product(
  list_transform(embedding::DOUBLE[], lambda y: y * 3), list_transform(embedding::DOUBLE[], lambda y: y * 3))), 1e-12), 6)) AS unit
FROM embeddings""")
def l2_normalize(spark, sf_dir: str) -> DataFrame:
    e = s.read(spark, sf_dir, "embeddings")
    scaled = F.transform("embedding", lambda x: x.cast("double") * 3)
    return e.select("vec_id", F.transform(v.l2_normalize(scaled), _round6).alias("unit"))


def _round6(x: Column) -> Column:
    """Six places as DuckDB rounds, which keeps the sign of what becomes zero."""
    r = F.round(x * 1e6) / 1e6
    return F.when(r == 0, x * 0.0).otherwise(r)


def _fake_encoder():
    """A model in one line: three numbers of an image's name."""

    def encode(images: list) -> list:
        return [[int(i[1:]) % 7 + 1, int(i[1:]) % 5, int(i[1:]) % 3] for i in images]

    return encode


@query(f"""WITH {s.IDX}, n AS (SELECT id, vec_id % 7 + 1.0::DOUBLE AS x, vec_id % 5 * 1.0::DOUBLE AS y, vec_id % 3 * 1.0::DOUBLE AS z FROM idx),
l AS (SELECT *, sqrt(x * x + y * y + z * z) AS d FROM n) SELECT id, round(x / d, 4) AS x, round(y / d, 4) AS y, round(z / d, 4) AS z FROM l""")
def embed_points(spark, sf_dir: str) -> DataFrame:
    """Unit vectors of a stand-in for an embedding model."""
    made = v.embed(s.idx(spark, sf_dir).select("id"), "id", _fake_encoder)
    return made.select("id", *[F.round(F.col("vector")[i].cast("double"), 4).alias(c) for i, c in enumerate("xyz")])


@query(f"WITH {_pool_sql(10, window='NULL', camera='NULL')} SELECT query_id, id, pos, score FROM pool")
def cosine_topk(spark, sf_dir: str) -> DataFrame:
    return _pool(spark, sf_dir, 10, window=False, camera=False).select("query_id", "id", "pos", "score")


@query(f"WITH {_pool_sql(10, window='NULL')} SELECT query_id, id, pos, score, source, yolo_class FROM pool")
def filtered_topk(spark, sf_dir: str) -> DataFrame:
    return _pool(spark, sf_dir, 10, window=False).select("query_id", "id", "pos", "score", "source", "yolo_class")


@query(f"WITH {_pool_sql(10)} SELECT query_id, id, pos, score, NOT any_inside AS time_dropped FROM pool")
def topk_with_fallback(spark, sf_dir: str) -> DataFrame:
    return _pool(spark, sf_dir, 10).select("query_id", "id", "pos", "score", "time_dropped")


_THREE = "('all'), ('frame'), ('crop')"


@query(f"WITH {_pool_sql(10, _THREE)} SELECT query_id, variant, id, pos, score, NOT any_inside AS time_dropped FROM pool")
def cell_topk(spark, sf_dir: str) -> DataFrame:
    """Filtered top-k over an index stored by camera and time cell."""
    path = f"{work_dir(spark)}/index-{uuid.uuid4().hex}"
    v.write_cells(s.idx(spark, sf_dir), path, 10.0)
    found = v.cell_top_k(spark, path, s.query_vectors(spark, sf_dir), 10, ("all", "frame", "crop"))
    return found.select("query_id", "variant", "id", "pos", "score", "time_dropped")


@query(f"WITH {_pool_sql(10, _THREE)} SELECT query_id, variant, id, pos, score FROM pool")
def source_variants_topk(spark, sf_dir: str) -> DataFrame:
    return _pool(spark, sf_dir, 10, ("all", "frame", "crop")).select("query_id", "variant", "id", "pos", "score")


_RERANKED = f"""{_pool_sql(48, _THREE)}, stats AS (
  SELECT *, avg(score) OVER w AS mu, stddev_pop(score) OVER w AS sd FROM pool WINDOW w AS (PARTITION BY query_id, variant)),
reranked AS (
  SELECT *, CASE WHEN intent = 'scene' AND sd >= 1e-6
    THEN (score - mu) / sd + CASE WHEN source = 'frame' THEN 1.0 ELSE 0.0 END ELSE score END AS rank_score FROM stats)"""
_ONE = f"""{_RERANKED}, one AS (
  SELECT * FROM reranked QUALIFY row_number() OVER (
    PARTITION BY query_id, variant, video_id, frame_idx ORDER BY rank_score DESC, score DESC, id) = 1)"""
_THIN = f"""{_ONE}, folded AS (
  SELECT query_id, variant, video_id, list_reduce(list({{'o': [offset_s], 'ids': [id]}} ORDER BY rank_score DESC, score DESC, id),
    lambda a, x: CASE WHEN len(list_filter(a.o, lambda y: abs(y - x.o[1]) < 8.0)) > 0 THEN a
                 ELSE {{'o': list_concat(a.o, x.o), 'ids': list_concat(a.ids, x.ids)}} END).ids AS ids
  FROM one GROUP BY ALL),
apart AS (SELECT o.* FROM one o JOIN (SELECT query_id, variant, unnest(ids) AS id FROM folded) f USING (query_id, variant, id)),
thin AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, variant ORDER BY rank_score DESC, score DESC, id) AS rank FROM apart
  QUALIFY rank <= 12)"""


def _reranked(spark, sf_dir: str) -> DataFrame:
    return sr.intent_rerank(_pool(spark, sf_dir, 48, ("all", "frame", "crop")))


def _thin(spark, sf_dir: str) -> DataFrame:
    return sr.thin(_reranked(spark, sf_dir))


@query(f"WITH {_RERANKED} SELECT query_id, variant, id, round(rank_score, 6) AS rank_score FROM reranked")
def intent_rerank(spark, sf_dir: str) -> DataFrame:
    return _reranked(spark, sf_dir).select("query_id", "variant", "id", F.round("rank_score", 6).alias("rank_score"))


@query(f"WITH {_ONE} SELECT query_id, variant, id, video_id, frame_idx FROM one")
def frame_dedup(spark, sf_dir: str) -> DataFrame:
    return sr.one_per_frame(_reranked(spark, sf_dir)).select("query_id", "variant", "id", "video_id", "frame_idx")


@query(f"WITH {_THIN} SELECT query_id, variant, id, rank, offset_s FROM thin")
def temporal_suppression(spark, sf_dir: str) -> DataFrame:
    return _thin(spark, sf_dir).select("query_id", "variant", "id", "rank", "offset_s")


_TIME = "strftime(make_timestamp((ts * 1000000)::BIGINT), '%Y-%m-%d %H:%M:%S')"


@query(f"""WITH {_THIN}
SELECT query_id, variant, rank, round(score, 3) + 0.0 AS score, source, video_id, {_TIME} AS time,
  printf('%02d:%02d.%d', (round(offset_s * 10)::BIGINT // 600), (round(offset_s * 10)::BIGINT % 600) // 10, round(offset_s * 10)::BIGINT % 10) AS "offset"
FROM thin""")
def hit_listing(spark, sf_dir: str) -> DataFrame:
    return sr.hit_listing(_thin(spark, sf_dir))


GAP_S = 10 * 3600.0  # the stand-in's sightings are hours apart
_EVENTS = f"""{s.SIGHT}, marked AS (
  SELECT *, CASE WHEN ts - lag(ts) OVER w <= {GAP_S} THEN 0 ELSE 1 END AS new FROM sight WINDOW w AS (PARTITION BY video_id ORDER BY ts, id)),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY video_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS event_no FROM marked),
events_ AS (
  SELECT video_id, event_no::BIGINT AS event_no, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n,
         first(id ORDER BY score DESC, ts, id) AS rep_id, max(score) AS rep_score FROM numbered GROUP BY ALL)"""


@query(f"WITH {_EVENTS} SELECT * FROM events_")
def sighting_events(spark, sf_dir: str) -> DataFrame:
    return sr.sighting_events(s.sight(spark, sf_dir), GAP_S)


def _at(c: str) -> str:
    return f"strftime(make_timestamp(({c} * 1000000)::BIGINT), '%Y-%m-%d %H:%M:%S')"


@query(f"""WITH {_EVENTS} SELECT video_id, event_no, CASE WHEN n = 1 OR first_ts = last_ts THEN {_at('first_ts')}
  ELSE {_at('first_ts')} || ' – ' || {_at('last_ts')} || ' (' || trunc(last_ts - first_ts)::INT || ' s, ' || n || ')' END AS label FROM events_""")
def event_labels(spark, sf_dir: str) -> DataFrame:
    return sr.event_labels(sr.sighting_events(s.sight(spark, sf_dir), GAP_S)).select("video_id", "event_no", "label")


# ---- frame gate ----


@query(f"""WITH RECURSIVE {s.SIGHT}, picked AS (
  (SELECT video_id, min(ts) AS ts FROM sight GROUP BY video_id)
  UNION ALL
  SELECT p.video_id, (SELECT min(s.ts) FROM sight s WHERE s.video_id = p.video_id AND s.ts >= p.ts + 86400.0) FROM picked p WHERE p.ts IS NOT NULL)
SELECT video_id, ts FROM picked WHERE ts IS NOT NULL""")
def thin_candidates(spark, sf_dir: str) -> DataFrame:
    rows = s.sight(spark, sf_dir).select("video_id", "ts").distinct()
    return sp.thin(rows, 86400.0, t="ts")


@query(f"""WITH {s.SIGHT}
SELECT video_id, event_id, ts FROM sight
QUALIFY row_number() OVER (PARTITION BY video_id, floor(ts / 3600) ORDER BY ts, event_id) <= 1 OR class = 'error'""")
def hourly_cap(spark, sf_dir: str) -> DataFrame:
    rows = s.sight(spark, sf_dir)
    return sp.hourly_cap(rows, 1, t="ts", exempt=F.col("class") == "error", ties=("event_id",)).select("video_id", "event_id", "ts")


GRID_GATE = Params(pixel_threshold=30.0, keep_ratio=0.3, dedup_ratio=0.15, global_ratio=0.6, min_blob=2, anchor_s=10.0)


GRID_SIZE = replace(GRID_GATE, grid_width=8, grid_height=8)


@query("""SELECT 'v' || (vec_id % 5) AS video_id, vec_id // 5 AS frame_idx, 8 AS w, 8 AS h,
  array_to_string(list_transform(embedding::DOUBLE[], lambda x: printf('%02X', greatest(0, least(255, floor((x + 0.5) * 255)::INT)))), '') AS gray
FROM embeddings""")
def decoded_grids(spark, sf_dir: str) -> DataFrame:
    """The gate's grids of decoded frames."""
    return sp.gray_grids(s.decoded(spark, sf_dir), GRID_SIZE).select("video_id", "frame_idx", "w", "h", F.hex("gray").alias("gray"))


@query()
def decoded_gate(spark, sf_dir: str) -> DataFrame:
    """Decoded frames to kept frames."""
    return sp.gate_frames(sp.gray_grids(s.decoded(spark, sf_dir), GRID_SIZE), GRID_SIZE, blur=False)


@query()
def gate_frames(spark, sf_dir: str) -> DataFrame:
    return sp.gate_frames(s.grids(spark, sf_dir), GRID_GATE, blur=False)


@query()
def gate_funnel(spark, sf_dir: str) -> DataFrame:
    sets = {"usual": GRID_GATE, "strict": replace(GRID_GATE, keep_ratio=0.4), "loose": replace(GRID_GATE, keep_ratio=0.1)}
    return sp.gate_funnel(s.grids(spark, sf_dir), sets, blur=False)
