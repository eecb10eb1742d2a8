"""Registered queries on query texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions import querytext as q
from sightline.jobs import standins as s
from sightline.jobs.queries import query


def _lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _starts(roots) -> str:
    return "(" + " OR ".join(f"starts_with(t, {_lit(r)})" for r in roots) + ")"


def _first(table) -> str:
    return "CASE " + " ".join(f"WHEN starts_with(t, {_lit(r)}) THEN {_lit(v)}" for r, v in table) + " END"


_CLASS = f"coalesce({_first(q.CLASS_ROOTS)}, CASE {' '.join(f'WHEN t = {_lit(w)} THEN {_lit(c)}' for w, c in q.CLASS_WORDS)} END)"
_FOLDED = f"lower(translate(text, {_lit(q.FOLD[0])}, {_lit(q.FOLD[1])}))"
_RAW = f"list_filter(string_split_regex({_FOLDED}, '\\s+'), lambda t: t <> '')"
_TOK = f"list_filter(list_transform({_RAW}, lambda t: regexp_replace(t, {_lit(q.EDGE)}, '', 'g')), lambda t: t <> '')"
_B = r"[^\p{L}\p{N}_]"
_MIDNIGHT = "epoch(date_trunc('day', now))"


def _span(kind: str, pattern: str) -> tuple[str, str]:
    x = lambda g: f"coalesce(try_cast(nullif(regexp_extract(low, {_lit(pattern)}, {g}), '') AS DOUBLE), 0)"
    if kind == "clock":
        at = f"({_MIDNIGHT} - CASE WHEN regexp_extract(low, {_lit(pattern)}, 1) <> '' THEN 86400 ELSE 0 END + {x(2)} * 3600 + {x(3)} * 60)"
        return f"{at} - 2700", f"{at} + 2700"
    if kind == "last_hours":
        return f"epoch(now) - {x(1)} * 3600", "epoch(now)"
    if kind == "last_minutes":
        return f"epoch(now) - {x(1)} * 60", "epoch(now)"
    if kind == "today":
        return _MIDNIGHT, "epoch(now)"
    a, b = q.DAY_HOURS[kind]
    return f"{_MIDNIGHT} + {a * 3600}", f"{_MIDNIGHT} + {b * 3600}"


def _cases(of) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(low, {_lit(p)}) THEN {of(k, p)}" for k, p in q.TIME_PHRASES) + " END"


_PARSED = f"""{s.PHR}, low AS (
  SELECT *, lower(translate(trim(raw_query), 'İI', 'iı')) AS low FROM phr),
timed AS (
  SELECT *, {_cases(lambda k, p: f'regexp_extract(low, {_lit(p)})')} AS phrase,
         {_cases(lambda k, p: f'({_span(k, p)[0]})::DOUBLE')} AS ts_from, {_cases(lambda k, p: f'({_span(k, p)[1]})::DOUBLE')} AS ts_to FROM low),
cut AS (
  SELECT *, regexp_replace(CASE WHEN phrase IS NULL THEN low ELSE substr(low, 1, instr(low, phrase) - 1) || ' '
           || substr(low, instr(low, phrase) + length(phrase)) END, '\\s+', '  ', 'g') AS rest FROM timed),
parsed AS (
  SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(rest, '(^|{_B})(?:{q.FILLERS})($|{_B})', ' \\1 \\2', 'g'), '[?!.,;]+', ' ', 'g'), '\\s+', ' ', 'g'))
         AS visual_text FROM cut),
texts AS (SELECT *, CASE WHEN visual_text = '' THEN raw_query ELSE visual_text END AS text FROM parsed),
tok AS (SELECT *, {_RAW} AS raw_tok, {_TOK} AS tok FROM texts)"""


def _parsed(spark, sf_dir: str) -> DataFrame:
    return q.parse(s.phr(spark, sf_dir))


@query(rf"""WITH {_PARSED} SELECT query_id, ts_from, ts_to,
  trim(regexp_replace(phrase, '^[^\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_'']+$', '', 'g')) AS time_phrase FROM parsed""")
def parse_time_window(spark, sf_dir: str) -> DataFrame:
    return q.parse_time(s.phr(spark, sf_dir)).select("query_id", "ts_from", "ts_to", "time_phrase")


@query(f"WITH {_PARSED} SELECT query_id, visual_text FROM parsed")
def visual_text(spark, sf_dir: str) -> DataFrame:
    return q.parse_time(s.phr(spark, sf_dir)).select("query_id", "visual_text")


_OBJECTS = f"""objects AS (
  SELECT *, list_sort(list_distinct(list_filter(list_transform(tok, lambda t: {_CLASS}), lambda c: c IS NOT NULL))) AS required,
    len(list_filter(tok, lambda t: ({_CLASS}) IS NULL AND {_starts(q.VEHICLE_ROOTS)})) > 0 AS generic_vehicle,
    len(list_filter(raw_tok, lambda t: {_starts(q.COLOR_ROOTS)})) > 0 AS has_color,
    len(list_filter(raw_tok, lambda t: {_starts(q.COLOR_ROOTS + q.HARD_ROOTS)})) > 0 AS needs_verification FROM tok)"""


@query(f"""WITH {_PARSED}, {_OBJECTS}
SELECT query_id, array_to_string(required, ',') AS required, generic_vehicle, has_color, needs_verification FROM objects""")
def object_intent(spark, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select(
        "query_id", F.array_join("required", ",").alias("required"), "generic_vehicle", "has_color", "needs_verification"
    )


def _kind(rows) -> str:
    ends = lambda r: "(" + " OR ".join(f"suffix(substr(t, {len(r) + 1}), {_lit(e)})" for e in q.CASE_ENDINGS) + ")"
    return " ".join(f"WHEN starts_with(t, {_lit(r)}) THEN CASE WHEN {ends(r)} THEN 'adjunct' ELSE '{k}' END" for r, k in rows)


_KIND = f"""CASE {_kind([(r, 'object') for r, _ in q.CLASS_ROOTS])}
  {' '.join(f"WHEN t = {_lit(w)} THEN 'object'" for w, _ in q.CLASS_WORDS)}
  {_kind([(r, 'object') for r in q.VEHICLE_ROOTS] + [(r, 'scene') for r in q.SCENE_ROOTS])} END"""


@query(f"""WITH {_PARSED} SELECT query_id, coalesce(list_filter(list_transform(tok, lambda t: {_KIND}),
  lambda k: k IS NOT NULL AND k <> 'adjunct')[-1], 'neutral') AS intent FROM tok""")
def scene_intent(spark, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select("query_id", "intent")


_EN = _first(q.ENGLISH)
_TARGETS = f"""targets AS (
  SELECT *, list_transform(list_filter(tok, lambda t: {_starts(q.COLOR_ROOTS)}), lambda t: {_EN})[1] AS color_en,
    coalesce(list_transform(list_filter(tok, lambda t: {_starts(q.HARD_ROOTS)}), lambda t: {_EN})[1],
      list_transform(list_filter(tok, lambda t: ({_CLASS}) IS NOT NULL), lambda t: coalesce({_EN}, 'object'))[-1],
      CASE WHEN len(list_filter(tok, lambda t: {_starts(q.VEHICLE_ROOTS)})) > 0 THEN 'vehicle' END) AS object_en FROM tok)"""


@query(f"WITH {_PARSED}, {_TARGETS} SELECT query_id, object_en, color_en FROM targets")
def verification_targets(spark, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select("query_id", "object_en", "color_en")


_SKIP = "(" + ", ".join(map(_lit, q.SKIPPED)) + ")"


@query(f"""WITH {_PARSED}, w AS (SELECT query_id, text, list_filter(tok, lambda t: t NOT IN {_SKIP}) AS words FROM tok)
SELECT query_id, CASE WHEN len(words) > 0 THEN array_to_string(list_transform(words, lambda t: coalesce({_EN}, t)), ' ') ELSE text END AS english
FROM w""")
def translate_visual(spark, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select("query_id", q.translate_visual(F.col("text")).alias("english"))


@query(f"""WITH {s.IDX}, {_PARSED}, {_OBJECTS},
inv AS (SELECT list(DISTINCT yolo_class) AS have FROM idx WHERE source = 'crop' AND yolo_class <> '' AND yolo_class <> 'kamyon'),
missing AS (SELECT *, list_sort(list_filter(required, lambda c: NOT list_contains(have, c))) AS missing FROM objects, inv)
SELECT query_id, array_to_string(missing, ',') AS missing, len(missing) = 0 AND generic_vehicle
    AND NOT list_has_any(have, ['bisiklet', 'araba', 'motosiklet', 'otobüs', 'kamyon']) AS no_vehicle,
  len(missing) > 0 OR (generic_vehicle AND NOT list_has_any(have, ['bisiklet', 'araba', 'motosiklet', 'otobüs', 'kamyon'])) AS gated
FROM missing""")
def not_found_gate(spark, sf_dir: str) -> DataFrame:
    from sightline.operators import index as ix
    from sightline.operators import search as sr

    inventory = ix.class_inventory(s.idx(spark, sf_dir)).where("yolo_class <> 'kamyon'")
    out = sr.not_found_gate(_parsed(spark, sf_dir), inventory)
    return out.select("query_id", F.array_join("missing", ",").alias("missing"), "no_vehicle", "gated")
