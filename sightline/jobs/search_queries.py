"""Registered queries on verification and whole searches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions import querytext as q
from sightline.jobs import standins as s
from sightline.jobs.queries import SQL, _THIN, _pool_sql, _thin, query
from sightline.jobs.text_queries import _KIND, _OBJECTS, _PARSED, _TARGETS, _lit
from sightline.operators import index as ix
from sightline.operators import search as sr
from sightline.operators import vectors as v
from sightline.operators import verify as vf
from sightline.sources.work import cut

# The stand-in's queries: targets by the number of the query, answers by the number of the hit.
_NUM = "cast(substring(query_id, 2, 9) as long)"
_TARGET_ROWS = (("car", "red"), ("man", "blue"), ("dog", None), ("rain", None), ("SUV", "black"), ("umbrella", None))
_TARGET_SQL = (
    f"CASE {s.NUMBER} % 6 " + " ".join(f"WHEN {i} THEN {_lit(o)}" for i, (o, _) in enumerate(_TARGET_ROWS)) + " END AS object_en, "
    f"CASE {s.NUMBER} % 6 " + " ".join(f"WHEN {i} THEN {_lit(c)}" for i, (_, c) in enumerate(_TARGET_ROWS) if c) + " END AS color_en"
)


def _with_targets(hits: DataFrame) -> DataFrame:
    pick = lambda i: F.get(F.array(*[F.lit(r[i]) for r in _TARGET_ROWS]), (F.expr(_NUM) % 6).cast("int"))
    return hits.withColumns({"object_en": pick(0), "color_en": pick(1), "needs_verification": F.lit(True)}).withColumn(
        "has_color", F.col("color_en").isNotNull()
    )


def _answers(work: DataFrame) -> DataFrame:
    n = F.substring("id", 2, 12).cast("long") + F.expr(_NUM)
    kinds = F.explode(F.array(F.lit("presence"), F.lit("color"))).alias("kind")
    m = n + F.when(F.col("kind") == "color", 1).otherwise(0)
    answer = F.when(m % 5 == 0, None).when(m % 3 == 0, "No.").otherwise("Yes")
    return work.select("query_id", "id", kinds).select("query_id", "id", "kind", answer.alias("answer"))


_WORK = f"""{_THIN}, work AS (SELECT *, {_TARGET_SQL} FROM thin WHERE variant = 'all'),
said AS (
  SELECT *, color_en IS NOT NULL AS has_color, substr(id, 2)::BIGINT + {s.NUMBER} AS m,
    color_en IS NOT NULL AND source = 'crop' AND coalesce(CASE object_en {' '.join(f"WHEN {_lit(o)} THEN {_lit(c)}" for o, c in vf.CLASS_OF_OBJECT)} END = yolo_class, false) AS settled
  FROM work),
asked AS (
  SELECT *, CASE WHEN m % 5 = 0 THEN NULL WHEN m % 3 = 0 THEN false ELSE true END AS p,
    CASE WHEN (m + 1) % 5 = 0 THEN NULL WHEN (m + 1) % 3 = 0 THEN false ELSE true END AS c,
    CASE WHEN object_en IN ('rain', 'snow', 'traffic', 'fog', 'smoke') THEN object_en
         WHEN lower(object_en[1]) IN ('a', 'e', 'i', 'o', 'u') THEN 'an ' || object_en ELSE 'a ' || object_en END AS named FROM said),
judged AS (
  SELECT *, CASE WHEN settled THEN true ELSE p END AS present,
    CASE WHEN has_color AND (CASE WHEN settled THEN true ELSE p END) THEN c END AS color_match FROM asked)"""


@query(f"""WITH {_WORK} SELECT query_id, id, rank, CASE WHEN NOT settled THEN 'Is there ' || named ||
  CASE WHEN NOT has_color THEN ' visible anywhere in this image?' WHEN named = object_en THEN ' visible in this image?' ELSE ' in this image?' END END AS presence_question,
  CASE WHEN has_color THEN CASE WHEN object_en IN ('person', 'man', 'woman', 'child', 'pedestrian', 'driver', 'baby')
    THEN 'Is this ' || object_en || ' wearing ' || color_en || ' clothing?' ELSE 'Is the ' || object_en || ' ' || color_en || ' in color?' END END AS color_question,
  CASE WHEN has_color THEN 'crop' ELSE 'frame' END AS view FROM asked""")
def verification_tasks(spark, sf_dir: str) -> DataFrame:
    work = vf.worklist(_with_targets(_thin(spark, sf_dir)))
    return vf.questions(work).select("query_id", "id", "rank", "presence_question", "color_question", "view")


_FUSED = f"""{_WORK}, state AS (
  SELECT *, CASE WHEN present IS NULL THEN 'kept' WHEN NOT present OR (has_color AND color_match IS NOT DISTINCT FROM false) THEN 'filtered' ELSE 'kept' END AS status
  FROM judged),
fused AS (
  SELECT *, CASE WHEN status = 'kept' THEN (score - avg(score) OVER g) / CASE WHEN stddev_pop(score) OVER g = 0 THEN 1e-9 ELSE stddev_pop(score) OVER g END
    + CASE WHEN present IS NULL THEN 0 WHEN NOT present THEN 0 WHEN has_color AND NOT coalesce(color_match, false) THEN 0 ELSE 0.5 END END AS vrank
  FROM state WINDOW g AS (PARTITION BY query_id, status))"""


def _fused(spark, sf_dir: str) -> DataFrame:
    work = vf.worklist(_with_targets(_thin(spark, sf_dir)))
    return vf.fuse(vf.verdicts(work, _answers(work)))


@query(f"""WITH {_FUSED} SELECT query_id, id, status, round(vrank, 6) AS vrank,
  CASE WHEN present IS NULL THEN 'failed' WHEN NOT present THEN 'no match' WHEN has_color AND color_match THEN 'color ok'
       WHEN has_color AND NOT color_match THEN 'color wrong' ELSE 'present' END AS label FROM fused""")
def fuse_verdicts(spark, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir).select("query_id", "id", "status", F.round("vrank", 6).alias("vrank"), vf.verdict_label().alias("label"))


_TASKS = SQL["verification_tasks"].rstrip()


def _fake_model():
    """A model in one line: errors, "No" or "Yes" by the numbers of image and question."""

    def answer(image: str, question: str) -> str:
        m = int(image[1:]) + len(question)
        if m % 7 == 0:
            raise TimeoutError
        return "No" if m % 3 == 0 else "Yes"

    return answer


_SAYS = lambda q: f"CASE WHEN (substr(id, 2)::BIGINT + length({q})) % 7 = 0 THEN NULL WHEN (substr(id, 2)::BIGINT + length({q})) % 3 = 0 THEN 'No' ELSE 'Yes' END"


@query(f"""WITH tasks AS ({_TASKS}), p AS (SELECT *, {_SAYS('presence_question')} AS said FROM tasks)
SELECT query_id, id, 'presence' AS kind, said AS answer FROM p WHERE presence_question IS NOT NULL
UNION ALL SELECT query_id, id, 'color', {_SAYS('color_question')} FROM p WHERE color_question IS NOT NULL AND (presence_question IS NULL OR said = 'Yes')""")
def verify_answers(spark, sf_dir: str) -> DataFrame:
    """Answers of a stand-in for a model, for which an image is its hit's id."""
    asked = vf.questions(vf.worklist(_with_targets(_thin(spark, sf_dir)))).withColumns({"crop": F.col("id"), "frame": F.col("id")})
    return vf.ask(asked, _fake_model)


_OUTAGE = f"""{_WORK}, silent AS (
  SELECT * REPLACE (CASE WHEN {s.NUMBER} % 2 = 0 THEN CASE WHEN settled THEN true END ELSE present END AS present,
    CASE WHEN {s.NUMBER} % 2 = 0 THEN NULL ELSE color_match END AS color_match) FROM judged),
down AS (SELECT *, bool_and(present IS NULL) OVER (PARTITION BY query_id) AS unavailable FROM silent)"""


@query(f"""WITH {_OUTAGE} SELECT query_id, id, rank, unavailable, CASE WHEN unavailable OR present IS NULL THEN 'kept'
  WHEN NOT present OR (has_color AND color_match IS NOT DISTINCT FROM false) THEN 'filtered' ELSE 'kept' END AS status,
  CASE WHEN unavailable THEN 'unverified' WHEN present IS NULL THEN 'failed' WHEN NOT present THEN 'no match' WHEN has_color AND color_match THEN 'color ok'
       WHEN has_color AND NOT color_match THEN 'color wrong' ELSE 'present' END AS label FROM down""")
def verification_outage(spark, sf_dir: str) -> DataFrame:
    """The service answers nothing for every second query and is down: those keep their order, unverified."""
    work = vf.worklist(_with_targets(_thin(spark, sf_dir)))
    answers = _answers(work).withColumn("answer", F.when(F.expr(_NUM) % 2 != 0, F.col("answer")))
    fused = vf.fuse(vf.verdicts(work, answers), service_up=False)
    label = vf.verdict_label(verified=~F.col("unavailable")).alias("label")
    return fused.select("query_id", "id", "rank", "unavailable", "status", label)


# ---- whole searches ----

TOP = 48


def _asked(spark, sf_dir: str) -> DataFrame:
    """Parsed query texts with the gate's columns and a vector: that of the embedding whose number is the
    conversation's, modulo the number of embeddings."""
    parsed = q.parse(s.phr(spark, sf_dir))
    inventory = ix.class_inventory(s.idx(spark, sf_dir)).where("yolo_class <> 'kamyon'")
    gated = sr.not_found_gate(parsed, inventory).drop("ts_from", "ts_to")
    conv = F.substring_index("query_id", ":", 1).cast("long")
    turn = F.substring_index("query_id", ":", -1).cast("long")
    vectors = s.idx(spark, sf_dir).select(F.col("vec_id").alias("n"), "vector")
    n = F.pmod(conv, F.lit(vectors.count()))
    start = F.when(turn % 3 == 0, F.lit(s.BASE_TS + 5.0)).when(turn % 3 == 1, F.lit(10.0))
    rows = gated.withColumns({"n": n, "ts_from": start, "ts_to": start + 40.0, "camera_id": F.lit(None).cast("string")})
    return rows.join(vectors, "n")


_OUTCOMES = f"""{s.IDX}, {_PARSED}, {_OBJECTS}, {_TARGETS},
inv AS (SELECT list(DISTINCT yolo_class) AS have FROM idx WHERE source = 'crop' AND yolo_class <> '' AND yolo_class <> 'kamyon'),
kinds AS (SELECT query_id, coalesce(list_filter(list_transform(tok, lambda t: {_KIND}), lambda k: k IS NOT NULL AND k <> 'adjunct')[-1], 'neutral') AS intent FROM tok),
gate AS (
  SELECT o.query_id, list_sort(list_filter(required, lambda c: NOT list_contains(have, c))) AS missing, generic_vehicle, have, k.intent,
    o.has_color, o.needs_verification, t.object_en, t.color_en, split_part(o.query_id, ':', 1)::BIGINT % (SELECT count(*) FROM idx) AS n, split_part(o.query_id, ':', 2)::BIGINT AS turn
  FROM objects o JOIN kinds k USING (query_id) JOIN targets t USING (query_id), inv),
gates AS (
  SELECT *, len(missing) = 0 AND generic_vehicle AND NOT list_has_any(have, ['bisiklet', 'araba', 'motosiklet', 'otobüs', 'kamyon']) AS no_vehicle,
    CASE WHEN turn % 3 = 0 THEN {s.BASE_TS + 5.0}::DOUBLE WHEN turn % 3 = 1 THEN 10.0::DOUBLE END AS ts_from FROM gate),
scored AS (
  SELECT g.query_id, 'all' AS variant, g.intent, i.*, round(list_dot_product(i.vector, q.vector) / (sqrt(list_dot_product(i.vector, i.vector))
      * sqrt(list_dot_product(q.vector, q.vector))), 6) AS score, g.ts_from IS NULL OR (i.ts >= g.ts_from AND i.ts <= g.ts_from + 40.0) AS inside
  FROM gates g JOIN idx q ON q.vec_id = g.n, idx i WHERE len(missing) = 0 AND NOT no_vehicle),
pool AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, variant ORDER BY score DESC, id) AS pos
  FROM (SELECT *, bool_or(inside) OVER (PARTITION BY query_id, variant) AS any_inside FROM scored) WHERE inside = any_inside
  QUALIFY pos <= {TOP})"""

_CHAIN = _THIN[len(_pool_sql(48, "('all'), ('frame'), ('crop')")) :]  # from the pool to the thinned hits
_JUDGED = f"""{_OUTCOMES}{_CHAIN},
work AS (SELECT t.*, g.has_color, g.object_en, g.color_en FROM thin t JOIN gates g USING (query_id) WHERE g.needs_verification),
said AS (
  SELECT *, substr(id, 2)::INT + length(query_id) AS m, color_en IS NOT NULL AND source = 'crop' AND
    coalesce(CASE coalesce(object_en, 'object') {' '.join(f"WHEN {_lit(o)} THEN {_lit(c)}" for o, c in vf.CLASS_OF_OBJECT)} END = yolo_class, false) AS settled FROM work),
judged AS (
  SELECT *, CASE WHEN settled THEN true WHEN m % 5 = 0 THEN NULL WHEN m % 3 = 0 THEN false ELSE true END AS present,
    CASE WHEN (m + 1) % 5 = 0 THEN NULL WHEN (m + 1) % 3 = 0 THEN false ELSE true END AS c FROM said),
state AS (
  SELECT query_id, has_color, CASE WHEN present IS NULL THEN 'kept' WHEN NOT present OR (has_color AND color_en IS NOT NULL AND c IS NOT DISTINCT FROM false)
    THEN 'filtered' ELSE 'kept' END AS status FROM judged),
nf AS (SELECT query_id, count(*) FILTER (status = 'kept') AS kept, bool_or(has_color) AS colored FROM state GROUP BY query_id),
per AS (SELECT query_id, count(*) AS found, bool_or(NOT any_inside) AS time_dropped FROM thin GROUP BY query_id)
SELECT query_id, CASE WHEN len(missing) > 0 OR no_vehicle THEN 0 WHEN kept IS NOT NULL THEN kept ELSE coalesce(found, 0) END::BIGINT AS n_hits,
  CASE WHEN len(missing) > 0 THEN 'missing: ' || array_to_string(missing, ', ') WHEN no_vehicle THEN 'no vehicle'
       WHEN kept = 0 THEN 'denied: ' || CASE WHEN colored THEN 'color' ELSE 'object' END END AS not_found_reason,
  coalesce(time_dropped, false) AS time_dropped, kept IS NOT NULL AS applied, false AS unavailable
FROM gates LEFT JOIN per USING (query_id) LEFT JOIN nf USING (query_id)"""


def _made_up_answers(work: DataFrame) -> DataFrame:
    m = F.substring("id", 2, 12).cast("int") + F.length("query_id") + F.when(F.col("kind") == "color", 1).otherwise(0)
    kinds = F.explode(F.array(F.lit("presence"), F.lit("color"))).alias("kind")
    answer = F.when(m % 5 == 0, None).when(m % 3 == 0, "no").otherwise("yes")
    return work.select("query_id", "id", kinds).select("query_id", "id", "kind", answer.alias("answer"))


@query(f"WITH {_JUDGED}")
def search_outcomes(spark, sf_dir: str) -> DataFrame:
    """Query texts end to end: parse, gate, search, rank, thin, verify."""
    asked = cut(_asked(spark, sf_dir), "asked")  # parsed once; used by every later step
    open_ = asked.where("not gated")
    pool = v.top_k(s.idx(spark, sf_dir), open_, TOP)
    hits = cut(sr.thin(sr.intent_rerank(pool.join(open_.select("query_id", "intent"), "query_id"))), "hits")
    about = open_.select("query_id", "needs_verification", "has_color", "object_en", "color_en")
    work = vf.worklist(hits.join(about.hint("merge"), "query_id"))  # by its compressed files, Spark would broadcast hits
    return vf.outcomes(asked, hits, vf.fuse(vf.verdicts(work, _made_up_answers(work))))
