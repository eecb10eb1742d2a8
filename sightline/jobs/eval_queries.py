"""Registered queries on evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions import querytext
from sightline.jobs import standins as s
from sightline.jobs.queries import _THIN, _pool, _pool_sql, _thin, query
from sightline.jobs.search_queries import _FUSED, _answers, _fused, _with_targets
from sightline.jobs.text_queries import _KIND, _OBJECTS, _PARSED, _TARGETS
from sightline.operators import evaluation as ev
from sightline.operators import search as sr
from sightline.sources.work import cut

THREE = ("all", "frame", "crop")

# ---- labels: a query's relevant videos are those of points with its label;
# queries divisible by three have a golden frame, those divisible by five are negatives ----


def _labels(spark, sf_dir: str) -> DataFrame:
    q = s.query_vectors(spark, sf_dir).select("query_id", s.query_number().alias("n"), "label")
    golden = F.col("n") % 3 == 0
    grp = F.floor((F.col("n") * s.EVERY + 4) / 4)
    return q.select(
        "query_id",
        "n",
        "label",
        F.when(F.col("n") % 5 == 0, "negatif").when(golden, "golden").when(F.col("n") % 2 == 0, "scene").otherwise("class").alias("gt_type"),
        F.concat(F.lit("k"), (F.col("n") % 4).cast("string")).alias("category"),
        (F.col("n") % 5 != 0).alias("scorable"),
        F.when(golden, F.concat(F.lit("v"), (grp % 5).cast("string"))).alias("golden_video"),
        F.when(golden, grp).alias("golden_frame"),
        (F.col("n") % 10 == 5).alias("gated"),
    )


def _relevant(spark, sf_dir: str) -> DataFrame:
    near = s.idx(spark, sf_dir).select("label", "video_id").distinct()
    return _labels(spark, sf_dir).join(near, "label").select("query_id", "video_id")


def _scored(spark, sf_dir: str) -> DataFrame:
    labels = _labels(spark, sf_dir)
    return ev.first_ranks(labels, _thin(spark, sf_dir), _relevant(spark, sf_dir), THREE).join(labels, "query_id")


_LABELS = f"""labels AS (
  SELECT query_id, {s.NUMBER} AS n, label FROM qv),
lab AS (
  SELECT *, CASE WHEN n % 5 = 0 THEN 'negatif' WHEN n % 3 = 0 THEN 'golden' WHEN n % 2 = 0 THEN 'scene' ELSE 'class' END AS gt_type,
    'k' || (n % 4) AS category, n % 5 <> 0 AS scorable, CASE WHEN n % 3 = 0 THEN 'v' || (((n * {s.EVERY} + 4) // 4) % 5) END AS golden_video,
    CASE WHEN n % 3 = 0 THEN (n * {s.EVERY} + 4) // 4 END AS golden_frame, n % 10 = 5 AS gated FROM labels),
relevant AS (SELECT DISTINCT query_id, video_id FROM lab JOIN (SELECT DISTINCT label, video_id FROM idx) USING (label))"""
_SCORED = f"""{_THIN}, {_LABELS}, ranks AS (
  SELECT query_id, variant, min(rank) FILTER (r.video_id IS NOT NULL) AS rank,
    min(rank) FILTER (t.video_id = golden_video AND t.frame_idx = golden_frame) AS golden_rank,
    min(rank) FILTER (r.video_id IS NOT NULL AND source = 'frame') AS scene_rank
  FROM thin t JOIN (SELECT query_id, golden_video, golden_frame FROM lab) USING (query_id) LEFT JOIN relevant r USING (query_id, video_id) GROUP BY ALL),
scored_ AS (
  SELECT l.*, v.variant, rank, golden_rank, scene_rank FROM lab l, (VALUES ('all'), ('frame'), ('crop')) v(variant)
  LEFT JOIN ranks r ON r.query_id = l.query_id AND r.variant = v.variant)"""


@query(f"WITH {_SCORED} SELECT query_id, variant, rank, golden_rank, scene_rank FROM scored_")
def eval_ranks(spark, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("query_id", "variant", "rank", "golden_rank", "scene_rank")


def _wilson(c: int) -> str:
    p, n = f"(h{c} / n)", "n"
    mid, half, den = f"({p} + 3.8416 / (2 * {n}))", f"1.96 * sqrt({p} * (1 - {p}) / {n} + 3.8416 / (4 * {n} * {n}))", f"(1 + 3.8416 / {n})"
    return f"round(greatest(0, ({mid} - {half}) / {den}), 6) AS low_{c}, round(least(1, ({mid} + {half}) / {den}), 6) AS high_{c}, round({p}, 6) AS recall_{c}"


_BLOCKS = f"""{_SCORED}, rows_ AS (
  SELECT 'video' AS block, variant, rank AS r FROM scored_ WHERE scorable AND golden_video IS NULL
  UNION ALL SELECT 'golden', variant, golden_rank FROM scored_ WHERE scorable AND golden_video IS NOT NULL
  UNION ALL SELECT 'all', variant, CASE WHEN golden_video IS NOT NULL THEN golden_rank ELSE rank END FROM scored_ WHERE scorable),
blocks_ AS (
  SELECT block, variant, count(*)::DOUBLE AS n, avg(coalesce(1.0 / r, 0)) AS mrr, (count(*) FILTER (r <= 1))::DOUBLE AS h1,
    (count(*) FILTER (r <= 5))::DOUBLE AS h5, (count(*) FILTER (r <= 10))::DOUBLE AS h10 FROM rows_ GROUP BY ALL)"""


@query(f"WITH {_BLOCKS} SELECT block, variant, n::BIGINT AS n, round(mrr, 6) AS mrr, {', '.join(map(_wilson, ev.CUTS))} FROM blocks_")
def eval_recall_ci(spark, sf_dir: str) -> DataFrame:
    b = ev.blocks(_scored(spark, sf_dir))
    return b.select("block", "variant", "n", *[F.round(c, 6).alias(c) for c in b.columns if c not in ("block", "variant", "n")])


@query(f"""WITH {_SCORED} SELECT variant, round(avg(r), 6) AS macro_recall, count(*) AS categories
FROM (SELECT variant, category, avg((coalesce(rank, 99) <= 5)::INT) AS r FROM scored_ WHERE scorable GROUP BY ALL) GROUP BY variant""")
def eval_macro(spark, sf_dir: str) -> DataFrame:
    return ev.macro_recall(_scored(spark, sf_dir)).withColumn("macro_recall", F.round("macro_recall", 6))


_MARGIN = f"""{_SCORED}, margin AS (
  SELECT avg((coalesce(rank, 99) <= 5)::INT) FILTER (variant = 'all') AS combined, avg((coalesce(rank, 99) <= 5)::INT) FILTER (variant = 'frame') AS frame
  FROM scored_ WHERE scorable)"""


@query(f"WITH {_MARGIN} SELECT round(combined, 6) AS combined, round(frame, 6) AS frame, round(combined - frame, 6) AS margin FROM margin")
def eval_ablation(spark, sf_dir: str) -> DataFrame:
    return ev.crop_margin(_scored(spark, sf_dir)).select(*[F.round(c, 6).alias(c) for c in ("combined", "frame", "margin")])


@query(f"""WITH {_SCORED} SELECT query_id, CASE WHEN EXISTS (SELECT 1 FROM pool p WHERE p.query_id = s.query_id AND p.variant = 'all'
  AND p.video_id = golden_video AND p.frame_idx = golden_frame) THEN 'dedup' ELSE 'retrieval' END AS cause
FROM scored_ s WHERE variant = 'all' AND golden_video IS NOT NULL AND coalesce(golden_rank, 99) > 10""")
def eval_miss_attribution(spark, sf_dir: str) -> DataFrame:
    return ev.miss_attribution(_scored(spark, sf_dir), _pool(spark, sf_dir, 48, THREE))


_TOPS = """tops AS (
  SELECT query_id, first(video_id ORDER BY rank) AS top1_video, first(score ORDER BY rank) AS top1_score, max(yolo_class) FILTER (rank = 1) AS top1_class,
    string_agg(video_id, ',' ORDER BY rank) AS videos FROM thin WHERE variant = 'all' AND rank <= 5 GROUP BY query_id)"""


@query(f"WITH {_THIN}, {_TOPS} SELECT * FROM tops")
def eval_topn(spark, sf_dir: str) -> DataFrame:
    return ev.top_hits(_thin(spark, sf_dir))


@query(f"""WITH {s.IDX}, {s.QUERY}, {_LABELS} SELECT count(*) FILTER (gt_type = 'negatif' AND gated) AS gated, count(*) FILTER (gt_type = 'negatif') AS negatives,
  count(*) FILTER (scorable AND gated) AS false_gates,
  count(*) FILTER (gt_type = 'negatif' AND gated) / count(*) FILTER (gt_type = 'negatif') AS rate FROM lab""")
def eval_negatives(spark, sf_dir: str) -> DataFrame:
    labels = _labels(spark, sf_dir)
    return ev.negatives(labels.drop("gated"), labels)


@query(f"WITH {s.IDX}, {s.QUERY}, {_LABELS} SELECT query_id, gt_type, NOT scorable AS right FROM lab WHERE gated AND (gt_type = 'negatif' OR scorable)")
def eval_gated(spark, sf_dir: str) -> DataFrame:
    labels = _labels(spark, sf_dir)
    return ev.gated_queries(labels.drop("gated"), labels)


@query(f"""WITH {_THIN}, {_LABELS}, {_TOPS} SELECT min(top1_score) FILTER (scorable) AS least_positive,
  max(top1_score) FILTER (gt_type = 'negatif' AND NOT gated) AS largest_negative,
  round(min(top1_score) FILTER (scorable) - max(top1_score) FILTER (gt_type = 'negatif' AND NOT gated), 6) AS margin FROM lab JOIN tops USING (query_id)""")
def eval_separation(spark, sf_dir: str) -> DataFrame:
    labels = _labels(spark, sf_dir)
    out = ev.score_separation(labels.drop("gated"), ev.top_hits(_thin(spark, sf_dir)), labels)
    return out.withColumn("margin", F.round("margin", 6))


@query(f"WITH {s.IDX}, {s.QUERY}, {_LABELS} SELECT gt_type, count(*) AS n, count(*) FILTER (scorable) AS scorable FROM lab GROUP BY gt_type")
def eval_composition(spark, sf_dir: str) -> DataFrame:
    return ev.composition(_labels(spark, sf_dir))


TARGETS = [("recall_5", 0.80), ("golden_1", 0.66), ("margin", 0.0)]


@query(f"""WITH {_BLOCKS}, margin AS (
  SELECT avg((coalesce(rank, 99) <= 5)::INT) FILTER (variant = 'all') - avg((coalesce(rank, 99) <= 5)::INT) FILTER (variant = 'frame') AS m FROM scored_ WHERE scorable),
metrics AS (
  SELECT 'recall_5' AS metric, h5 / n AS value FROM blocks_ WHERE block = 'all' AND variant = 'all'
  UNION ALL SELECT 'golden_1', h1 / n FROM blocks_ WHERE block = 'golden' AND variant = 'all' UNION ALL SELECT 'margin', m FROM margin)
SELECT metric, target, round(value, 6) AS value, coalesce(value >= target, false) AS met
FROM (VALUES ('recall_5', 0.80::DOUBLE), ('golden_1', 0.66::DOUBLE), ('margin', 0.0::DOUBLE)) t(metric, target) LEFT JOIN metrics USING (metric)""")
def eval_targets(spark, sf_dir: str) -> DataFrame:
    scored = cut(_scored(spark, sf_dir), "scored")  # read twice below
    b = ev.blocks(scored).where("variant = 'all'")
    one = lambda name, df, c: df.select(F.lit(name).alias("metric"), F.col(c).alias("value"))
    metrics = one("recall_5", b.where("block = 'all'"), "recall_5").unionByName(one("golden_1", b.where("block = 'golden'"), "recall_1")).unionByName(
        one("margin", ev.crop_margin(scored), "margin")
    )
    return ev.check_targets(metrics, TARGETS).withColumn("value", F.round("value", 6))


LAMBDAS = (0.0, 0.375, 0.75, 1.125)


def _sweep_sql() -> str:
    chain = _THIN[len(_pool_sql(48, "('all'), ('frame'), ('crop')")) :]
    chain = chain.replace("variant", "lambda_").replace("THEN 1.0 ELSE 0.0 END ELSE score END AS rank_score", "THEN lambda_ ELSE 0.0 END ELSE score END AS rank_score")
    chain = chain.replace("intent = 'scene' AND sd >= 1e-6", "intent = 'scene' AND lambda_ > 0 AND sd >= 1e-6").replace("FROM pool WINDOW", "FROM grid WINDOW")
    values = ", ".join(f"({x}::DOUBLE)" for x in LAMBDAS)
    return f"""{_pool_sql(48)}, grid AS (SELECT p.* EXCLUDE (variant), l.lambda_ FROM pool p, (VALUES {values}) l(lambda_)){chain}, {_LABELS},
ranks AS (SELECT query_id, lambda_, min(rank) FILTER (source = 'frame') AS scene_rank FROM thin JOIN relevant USING (query_id, video_id) GROUP BY ALL)
SELECT lambda_ AS "lambda", round(avg((coalesce(scene_rank, 99) <= 1)::INT), 6) AS scene_1, round(avg((coalesce(scene_rank, 99) <= 5)::INT), 6) AS scene_5
FROM lab CROSS JOIN (VALUES {values}) l(lambda_) LEFT JOIN ranks USING (query_id, lambda_) GROUP BY ALL"""


@query(f"WITH {_sweep_sql()}")
def lambda_sweep(spark, sf_dir: str) -> DataFrame:
    """One search for all boosts: the fetched pool is fanned out, ranked and thinned for each."""
    values = F.explode(F.array(*[F.lit(x) for x in LAMBDAS])).alias("lambda")
    keys = ("query_id", "lambda")
    grid = _pool(spark, sf_dir, 48).select("*", values)
    hits = sr.thin(sr.intent_rerank(grid, F.col("lambda"), keys), keys=keys)
    good = hits.join(_relevant(spark, sf_dir), ["query_id", "video_id"]).where("source = 'frame'")
    ranks = good.groupBy(*keys).agg(F.min("rank").alias("scene_rank"))
    every = _labels(spark, sf_dir).select("query_id", values)
    return every.join(ranks, list(keys), "left").groupBy("lambda").agg(
        *[F.round(F.avg(ev.recall_at("scene_rank", c)), 6).alias(f"scene_{c}") for c in (1, 5)]
    )


_GAP = f"""{_pool_sql(40)}, {_LABELS}, zed AS (
  SELECT p.*, r.video_id IS NOT NULL AS rel, (score - avg(score) OVER w) / nullif(stddev_pop(score) OVER w, 0) AS z
  FROM pool p LEFT JOIN relevant r USING (query_id, video_id) WINDOW w AS (PARTITION BY p.query_id)),
best AS (SELECT *, max(z) FILTER (source = 'frame' AND rel) OVER (PARTITION BY query_id) AS fz FROM zed),
gaps AS (SELECT query_id, CASE WHEN any_value(fz) IS NOT NULL THEN coalesce(max(z) FILTER (source = 'crop' AND z > fz) - any_value(fz), 0) END AS z_gap FROM best GROUP BY query_id)"""


@query(f"WITH {_GAP} SELECT query_id, round(z_gap, 6) AS z_gap FROM gaps")
def z_gap(spark, sf_dir: str) -> DataFrame:
    return ev.z_gap(_pool(spark, sf_dir, 40), _relevant(spark, sf_dir)).withColumn("z_gap", F.round("z_gap", 6))


@query(f"WITH {_GAP} SELECT round(list_sort(list(z_gap) FILTER (z_gap IS NOT NULL))[count(z_gap) // 2 + 1], 6) AS median, count(z_gap) AS n FROM gaps")
def z_gap_median(spark, sf_dir: str) -> DataFrame:
    gaps = ev.z_gap(_pool(spark, sf_dir, 40), _relevant(spark, sf_dir))
    return ev.upper_median(gaps, "z_gap").withColumn("median", F.round("median", 6))


# ---- end to end ----

_FUSED_AXIS = f"""{_FUSED}, per AS (SELECT query_id, count(*) FILTER (status = 'kept') AS n_hits FROM fused GROUP BY query_id),
axis AS (
  SELECT query_id, 'b' || ({s.NUMBER} % 3) AS bucket, CASE {s.NUMBER} % 4 WHEN 0 THEN 'any' WHEN 1 THEN 'not_found' ELSE 'has_results' END AS expect,
    CASE WHEN coalesce(n_hits, 0) = 0 THEN 'not_found' ELSE 'has_results' END AS got FROM qv LEFT JOIN per USING (query_id))"""


def _axis(spark, sf_dir: str) -> DataFrame:
    n = s.query_number()
    expected = s.query_vectors(spark, sf_dir).select(
        "query_id", F.concat(F.lit("b"), (n % 3).cast("string")).alias("bucket"),
        F.when(n % 4 == 0, "any").when(n % 4 == 1, "not_found").otherwise("has_results").alias("expect"),
    )
    per = _fused(spark, sf_dir).groupBy("query_id").agg(F.count_if(F.col("status") == "kept").alias("n_hits"))
    return ev.outcome_axis(expected, per.withColumn("not_found_reason", F.when(F.col("n_hits") == 0, "denied")))


@query(f"WITH {_FUSED_AXIS} SELECT *, expect = 'any' OR expect = got AS passed FROM axis")
def outcome_axis(spark, sf_dir: str) -> DataFrame:
    return _axis(spark, sf_dir)


@query(f"""WITH {_FUSED_AXIS} SELECT bucket, count(*) FILTER (expect = 'any' OR expect = got) AS passed, count(*) AS n,
  round(100.0::DOUBLE * count(*) FILTER (expect = 'any' OR expect = got) / count(*), 1) AS percent FROM axis GROUP BY ROLLUP (bucket)""")
def bucket_rollup(spark, sf_dir: str) -> DataFrame:
    return ev.bucket_rates(_axis(spark, sf_dir))


@query(f"""WITH {_FUSED}, per AS (SELECT query_id, count(*) FILTER (status = 'kept') AS leaked, count(*) FILTER (status = 'filtered') AS caught
  FROM fused WHERE source = 'crop' AND yolo_class IN ('araba', 'kamyon') GROUP BY query_id)
SELECT query_id, coalesce(leaked, 0) AS leaked, coalesce(caught, 0) AS caught, coalesce(leaked, 0) = 0 AS ok, coalesce(leaked, 0) + coalesce(caught, 0) = 0 AS vacuous
FROM qv LEFT JOIN per USING (query_id)""")
def leak_axis(spark, sf_dir: str) -> DataFrame:
    bad = F.explode(F.array(F.lit("araba"), F.lit("kamyon"))).alias("yolo_class")
    return ev.leak_axis(s.query_vectors(spark, sf_dir).select("query_id", bad), _fused(spark, sf_dir))


@query(f"""WITH {_SCORED}, runs AS (
  SELECT query_id, bool_or(coalesce(rank, 99) <= 5) FILTER (variant = 'frame') AS was, bool_or(coalesce(rank, 99) <= 5) FILTER (variant = 'all') AS now FROM scored_ GROUP BY query_id)
SELECT count(*) FILTER (was AND now) AS both, count(*) FILTER (NOT was AND now) AS gained, count(*) FILTER (was AND NOT now) AS lost,
  count(*) FILTER (NOT was AND NOT now) AS neither, 0 AS unpaired, CASE WHEN count(*) FILTER (was <> now) > 0 THEN
  greatest(abs(count(*) FILTER (NOT was AND now) - count(*) FILTER (was AND NOT now)) - 1, 0) ** 2::DOUBLE / count(*) FILTER (was <> now) END AS mcnemar FROM runs""")
def paired_runs(spark, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir)
    run = lambda v: scored.where(F.col("variant") == v).select("query_id", (ev.recall_at("rank", 5) == 1).alias("hit"))
    return ev.paired_runs(run("frame"), run("all"))


_SAID = f"""{_FUSED}, answers AS (
  SELECT query_id, id, source AS variant, object_en, color_en, k.kind, CASE WHEN (m + k.d) % 5 = 0 THEN NULL WHEN (m + k.d) % 3 = 0 THEN 'No.' ELSE 'Yes' END AS answer
  FROM fused, (VALUES ('presence', 0), ('color', 1)) k(kind, d))"""


def _tallied(spark, sf_dir: str) -> DataFrame:
    work = _with_targets(_thin(spark, sf_dir)).where("variant = 'all'")
    about = work.select("query_id", "id", F.col("source").alias("variant"), "object_en", "color_en")
    return _answers(work).join(about, ["query_id", "id"])


@query(f"""WITH {_SAID} SELECT variant, object_en, color_en, count(*) FILTER (kind = 'presence' AND answer = 'Yes') AS present,
  count(*) FILTER (kind = 'color' AND answer = 'Yes') AS colored, count(*) FILTER (answer IS NULL) AS invalid, count(*) AS n FROM answers GROUP BY ALL""")
def answer_tally(spark, sf_dir: str) -> DataFrame:
    return ev.answer_tally(_tallied(spark, sf_dir))


@query(f"""WITH {_SAID}, per AS (SELECT id, kind, count(*) AS times, count(answer) AS said, min(answer) AS lo, max(answer) AS hi FROM answers GROUP BY ALL HAVING count(*) > 1)
SELECT count(*) AS repeated, count(*) FILTER (said = 0 OR (said = times AND lo = hi)) AS agreeing FROM per""")
def repeat_agreement(spark, sf_dir: str) -> DataFrame:
    return ev.repeat_agreement(_tallied(spark, sf_dir), ("id", "kind"))


@query(f"""WITH {_THIN}, {_LABELS}, {_TOPS} SELECT query_id, category, gated, top1_score, top1_class
FROM lab LEFT JOIN tops USING (query_id) WHERE gt_type = 'negatif'""")
def eval_negative_detail(spark, sf_dir: str) -> DataFrame:
    labels = _labels(spark, sf_dir)
    return ev.negative_detail(labels.drop("gated"), ev.top_hits(_thin(spark, sf_dir)), labels)


# ---- query texts ----


@query(rf"""WITH {_PARSED} SELECT query_id, CASE WHEN split_part(query_id, ':', 2)::INT % 2 = 0 THEN 'zaman' ELSE 'scene' END AS gt_type, visual_text,
  trim(regexp_replace(phrase, '^[^\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_'']+$', '', 'g')) AS time_phrase
FROM parsed WHERE split_part(query_id, ':', 2)::INT % 2 = 0 OR contains(lower(raw_query), 'gece')""")
def time_audit(spark, sf_dir: str) -> DataFrame:
    rows = s.phr(spark, sf_dir)
    turn = F.substring_index("query_id", ":", -1).cast("int")
    labels = rows.select("query_id", F.when(turn % 2 == 0, "zaman").otherwise("scene").alias("gt_type"))
    return ev.time_audit(querytext.parse_time(rows), labels)


@query(f"""WITH {_PARSED}, kinds AS (SELECT query_id, coalesce(list_filter(list_transform(tok, lambda t: {_KIND}), lambda k: k IS NOT NULL AND k <> 'adjunct')[-1], 'neutral') AS predicted,
  CASE WHEN contains(raw_query, 'otopark') THEN 'scene' ELSE 'object' END AS expected FROM tok)
SELECT round(avg((predicted = expected)::INT), 6) AS accuracy, count(*) AS n, count(*) FILTER (predicted <> expected) AS differing FROM kinds""")
def intent_accuracy(spark, sf_dir: str) -> DataFrame:
    return ev.accuracy(_intents(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 6))


@query(f"""WITH {_PARSED}, kinds AS (SELECT query_id, coalesce(list_filter(list_transform(tok, lambda t: {_KIND}), lambda k: k IS NOT NULL AND k <> 'adjunct')[-1], 'neutral') AS predicted,
  CASE WHEN contains(raw_query, 'otopark') THEN 'scene' ELSE 'object' END AS expected FROM tok)
SELECT * FROM kinds WHERE predicted <> expected""")
def intent_differences(spark, sf_dir: str) -> DataFrame:
    return ev.differing(_intents(spark, sf_dir))


def _intents(spark, sf_dir: str) -> DataFrame:
    parsed = querytext.parse(s.phr(spark, sf_dir))
    expected = F.when(F.contains("raw_query", F.lit("otopark")), "scene").otherwise("object")
    return parsed.select("query_id", F.col("intent").alias("predicted"), expected.alias("expected"))


@query(f"""WITH {_PARSED}, {_OBJECTS}, {_TARGETS}, found AS (
  SELECT t.query_id, t.raw_query, t.object_en, t.color_en FROM targets t)
SELECT query_id, CASE WHEN object_en IS NULL AND color_en IS NULL AND contains(raw_query, 'yol') THEN 'grey' ELSE color_en END AS color_en,
  coalesce(object_en, CASE WHEN contains(raw_query, 'yol') THEN 'road' WHEN contains(raw_query, 'kavşak') THEN 'crossing' END) AS object_en FROM found""")
def extracted_targets(spark, sf_dir: str) -> DataFrame:
    """Unknown objects filled by an extractor, which sees each distinct text once."""
    parsed = cut(querytext.parse(s.phr(spark, sf_dir)), "parsed")  # read three times below
    raw = parsed.where("object_en is null").select("text", "raw_query").groupBy("text").agg(F.min("raw_query").alias("raw"))
    says = querytext.unresolved_texts(parsed).join(raw, "text").select(
        "text",
        F.when(F.contains("raw", F.lit("yol")), "road").when(F.contains("raw", F.lit("kavşak")), "crossing").alias("object"),
        F.when(F.contains("raw", F.lit("yol")), "grey").alias("color"),
    )
    return querytext.fill_unknown(parsed, says).select("query_id", "object_en", "color_en")


@query("""SELECT event_type AS kind, count(*) AS n, median(value) AS median, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean
FROM events GROUP BY event_type""")
def call_latency(spark, sf_dir: str) -> DataFrame:
    calls = s.read(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("value").alias("seconds"))
    return ev.latency(calls).withColumn("mean", F.round("mean", 6))
