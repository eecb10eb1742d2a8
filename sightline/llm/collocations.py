"""Phrase collocations by Apriori level-wise passes.

1. Words are counted for each language; those with ``least`` occurrences get dense numbers.
2. Texts are written once as arrays of these numbers, -1 for any other word and between pieces and texts.
3. Level k numbers every place by its frequent (k-1)-gram, and counts a k-gram only where both of its
   overlapping (k-1)-grams are frequent.  A gram's key is the number of its first k-1 words and that of
   its last word in one 64-bit integer, so nothing is hashed and counts are exact.
4. Cuts are scored, and phrases inside longer ones dropped, from the level tables alone.

Tables of frequent grams are broadcast up to ``BROADCAST_ROWS`` and ``BROADCAST_BYTES``; larger ones are joined
to the places by a shuffle, in which frequent keys are dealt over tasks.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline.llm.spread import join_spread
from sightline.llm.workers import bound_batches, enter
from sightline.llm.wordhash import column
from sightline.sources.work import cut, discard

#: Words of the longest phrase, and language of texts whose language is null.
LONGEST, UNKNOWN = 4, "und"
#: Largest table of frequent grams that is broadcast; its words' bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 2_000_000, 64_000_000
#: Numbers of words that one stored row holds, places that are counted together, partial counts of words that a task holds.
CHUNK, COUNTED, HELD = 250_000, 1_000_000, 400_000
#: Tasks that choose a language's best phrases before one task merges their choices.
SALTS = 64
#: Bytes between pieces, and between words.
BREAKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"

_BYTES = bytearray(range(256))
for _b in range(65, 91):
    _BYTES[_b] += 32
for _b in BREAKS:
    _BYTES[_b] = 10
_BYTES[9] = 32
_BYTES = bytes(_BYTES)


def _texts(batch: pa.RecordBatch):
    """(language, bytes with A-Z lower-cased, breaks as line feeds and blanks as spaces) of each text."""
    data, offsets = column(batch.column(1))
    raw = data[offsets[0] : offsets[-1]].tobytes().translate(_BYTES)
    ends = (offsets - offsets[0]).tolist()
    for lang, a, z in zip(batch.column(0).to_pylist(), ends, ends[1:]):
        yield lang, raw[a:z]


def _count_words(it):
    enter("collocations")
    held: dict[str, Counter] = {}

    def rows():
        for lang, c in held.items():
            words = list(c)
            for i in range(0, len(words), 50_000):
                some = words[i : i + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(some), pa.string()), pa.array(some, pa.binary()).cast(pa.string()), pa.array([c[w] for w in some], pa.int64())],
                    names=["lang", "word", "f"],
                )
        held.clear()

    for batch in it:
        for lang, text in _texts(batch):
            held.setdefault(lang, Counter()).update(text.split())
            if sum(map(len, held.values())) > HELD:
                yield from rows()
    yield from rows()


def _numbered(grams: DataFrame) -> DataFrame:
    """Stored, with dense numbers ``id`` from 0; ``total`` is how many there are."""
    stored = cut(grams.withColumn("at", F.monotonically_increasing_id()), "grams")
    part = F.shiftright("at", 33)
    sizes = stored.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))  # a row for each task that wrote
    before = sizes.select("part", (F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    if total >= 1 << 31:
        raise ValueError("more frequent grams than 31 bits can number; raise `least`")
    out = stored.withColumn("part", part).join(F.broadcast(before), "part")
    out = out.withColumn("id", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("at", "part", "before")
    out.total = total
    return out


def _rows(it):
    """The stored arrays of each row: ``chunk``, numbers of words, numbers of grams."""
    for batch in it:
        for chunk, x, g in zip(batch["chunk"].to_pylist(), batch["x"], batch["g"]):
            x = np.frombuffer(x.as_buffer(), np.int32)
            yield chunk, x, np.frombuffer(g.as_buffer(), np.int32) if g.is_valid else x


def _state(chunk: int, x: np.ndarray, g: np.ndarray | None = None) -> pa.RecordBatch:
    """``g`` is left out where a gram is a word."""
    g = None if g is None else g.tobytes()
    return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([x.tobytes()], pa.binary()), pa.array([g], pa.binary())], names=["chunk", "x", "g"])


_STATE = "chunk long, x binary, g binary"


def _chunk_numbers():
    from pyspark import TaskContext

    at = TaskContext.get().partitionId() << 33
    while True:
        yield at
        at += 1


def _words(it):
    """(language, words of a text); a line feed stands for what parts two pieces."""
    for batch in it:
        for lang, text in _texts(batch):
            words = [w for w in text.replace(b"\n", b" \n ").split(b" ") if w]
            if words:
                yield lang, words


def _word_places(docs: DataFrame, words: DataFrame, rows: int, size: int) -> DataFrame:
    """The texts as arrays of the numbers of ``words`` (``lang, word, id``), -1 elsewhere."""
    if words.total <= rows and (words.agg(F.sum(F.octet_length("word"))).first()[0] or 0) <= size:
        table: dict[str, dict[bytes, int]] = {}
        for lang, word, i in zip(*(c.to_pylist() for c in words.select("lang", "word", "id").toArrow().columns)):
            table.setdefault(lang, {})[word.encode()] = i
        shared = docs.sparkSession.sparkContext.broadcast(table)

        def run(it):
            enter("collocations")
            chunks, held, n = _chunk_numbers(), [], 0
            for lang, some in _words(it):
                get = shared.value.get(lang, {}).get
                some.append(b"\n")  # no word, so that texts are parted
                held.append(np.fromiter((get(w, -1) for w in some), np.int32, len(some)))
                n += len(some)
                if n >= CHUNK:
                    yield _state(next(chunks), np.concatenate(held))
                    held, n = [], 0
            if held:
                yield _state(next(chunks), np.concatenate(held))

        return cut(docs.mapInArrow(run, _STATE), "places")

    key = F.concat(F.length("lang").cast("string"), F.lit(":"), "lang", "word")

    def rows_of(it):
        enter("collocations")
        chunks = _chunk_numbers()
        chunk, at = next(chunks), 0

        def end():
            return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([at], pa.int64()), pa.array([None], pa.string())], names=["chunk", "at", "key"])

        for lang, some in _words(it):
            if at and at + len(some) > CHUNK:
                yield end()
                chunk, at = next(chunks), 0
            place = [i for i, w in enumerate(some) if w != b"\n"]
            head = f"{len(lang)}:{lang}".encode()
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk] * len(place), pa.int64()), pa.array(np.array(place, np.int64) + at), pa.array([head + some[i] for i in place], pa.binary()).cast(pa.string())],
                names=["chunk", "at", "key"],
            )
            at += len(some) + 1
        if at:
            yield end()

    places = cut(docs.mapInArrow(rows_of, "chunk long, at long, key string"), "words")
    found = join_spread(places.where("key is not null"), words.select(key.alias("key"), "id"), "key").select("chunk", "at", F.col("id").cast("int").alias("id"))
    ends = places.where("key is null").select("chunk", "at", F.lit(-1).alias("id"))

    def gather(t: pa.Table) -> pa.Table:
        at, number = t["at"].to_numpy(), t["id"].to_numpy()
        x = np.full(int(at.max()), -1, np.int32)
        x[at[number >= 0]] = number[number >= 0]
        return pa.Table.from_batches([_state(t["chunk"][0].as_py(), x)])

    out = cut(found.unionByName(ends).groupBy("chunk").applyInArrow(gather, _STATE), "places")
    discard(places)
    return out


def _keys(x: np.ndarray, g: np.ndarray, k: int, a: int, z: int) -> tuple[np.ndarray, np.ndarray]:
    """Places from ``a`` to ``z`` - 1 where a k-gram begins both of whose (k-1)-grams are frequent, and its
    key: the number of its first k-1 words and that of its last word."""
    z = min(z, len(x) - k + 1)
    if z <= a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = a + np.flatnonzero((g[a:z] >= 0) & (g[a + 1 : z + 1] >= 0))
    return at, (g[at].astype(np.int64) << 32) | x[at + k - 1]


def _grams(state: DataFrame, k: int, least: int) -> DataFrame:
    """``key, f`` of every k-gram with ``least`` occurrences."""

    def run(it):
        enter("collocations")

        def counted(held):
            key, n = np.unique(np.concatenate(held), return_counts=True)
            for i in range(0, len(key), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(key[i : i + 100_000]), pa.array(n[i : i + 100_000])], names=["key", "n"])

        held, size = [], 0
        for _, x, g in _rows(it):
            for a in range(0, len(x), CHUNK):
                held.append(_keys(x, g, k, a, a + CHUNK)[1])
                size += len(held[-1])
                if size >= COUNTED:
                    yield from counted(held)
                    held, size = [], 0
        if held:
            yield from counted(held)

    return state.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("f")).where(F.col("f") >= least)


def _gram_places(state: DataFrame, grams: DataFrame, k: int, rows: int) -> DataFrame:
    """The stored texts with ``g`` as numbers of the k-grams ``grams`` (``key, id``), -1 elsewhere."""
    if grams.total <= rows:
        t = grams.select("key", "id").toArrow()
        key, number = t["key"].to_numpy(), t["id"].to_numpy().astype(np.int32)
        order = np.argsort(key)
        shared = state.sparkSession.sparkContext.broadcast((key[order], number[order]))

        def run(it):
            enter("collocations")
            known, ids = shared.value
            for chunk, x, g in _rows(it):
                out = np.full(len(x), -1, np.int32)
                for a in range(0, len(x) if len(known) else 0, CHUNK):
                    at, key = _keys(x, g, k, a, a + CHUNK)
                    i = np.minimum(np.searchsorted(known, key), len(known) - 1)
                    same = known[i] == key
                    out[at[same]] = ids[i[same]]
                yield _state(chunk, x, out)

        return state.mapInArrow(run, _STATE)

    def rows_of(it):
        enter("collocations")
        for chunk, x, g in _rows(it):
            for a in range(0, len(x), CHUNK):
                at, key = _keys(x, g, k, a, a + CHUNK)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), chunk)), pa.array(at), pa.array(key)], names=["chunk", "at", "key"])

    places = cut(state.mapInArrow(rows_of, "chunk long, at long, key long"), "keys")
    found = join_spread(places, grams.select("key", "id"), "key").select("chunk", "at", F.col("id").cast("int").alias("id"))

    def gather(key, left: pa.Table, right: pa.Table) -> pa.Table:
        x = np.frombuffer(left["x"][0].as_buffer(), np.int32)
        out = np.full(len(x), -1, np.int32)
        out[right["at"].to_numpy()] = right["id"].to_numpy()
        return pa.Table.from_batches([_state(left["chunk"][0].as_py(), x, out)])

    out = cut(state.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(gather, _STATE), "places")
    discard(places)
    return out


def _big(c: str) -> Column:
    return F.col(c).cast("decimal(38,0)")


def phrase_tables(
    docs: DataFrame, least: int, text_col: str, lang_col: str, rows: int, size: int
) -> tuple[list[DataFrame], DataFrame]:
    """Tables ``id, lang, phrase, f`` of the frequent phrases of 1, 2, ... words, and ``lang, n`` of all words."""
    bound_batches(docs.sparkSession)
    picked = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).cast("string").alias("t"))
    counts = picked.mapInArrow(_count_words, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))
    counts = cut(counts, "words")
    totals = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    words = _numbered(counts.where(F.col("f") >= least))
    ones = words.select("id", "lang", F.col("word").alias("phrase"), "f")
    tables, state = [ones], _word_places(picked, words, rows, size)
    for k in range(2, LONGEST + 1):
        grams = _numbered(_grams(state, k, least))
        last = ones.select(F.col("id").alias("w"), F.col("phrase").alias("word"))
        head = tables[-1].select(F.col("id").alias("h"), "lang", "phrase")
        t = grams.withColumn("h", F.shiftright("key", 32)).withColumn("w", F.col("key").bitwiseAND(F.lit((1 << 32) - 1)))
        tables.append(cut(t.join(head, "h").join(last, "w").select("id", "lang", F.concat_ws(" ", "phrase", "word").alias("phrase"), "f"), "phrases"))
        if k < LONGEST:
            state = _gram_places(state, grams, k, rows)
    return tables, totals


def collocations(
    docs: DataFrame,
    least: int = 30,
    share: int = 80,
    first: int | None = 2000,
    text_col: str = "text",
    lang_col: str = "lang",
    rows: int = BROADCAST_ROWS,
    size: int = BROADCAST_BYTES,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's ``first`` collocations (None: of all).

    Texts have A-Z lower-cased and are split at ``[.,;:!?\\x0A-\\x0D]`` into pieces, these at space and tab into
    words.  A candidate is a phrase of 2 to 4 words with ``a`` >= ``least`` occurrences within pieces, overlaps
    included.  Its score is the smallest floor(2000000 a / (l + r)) over its cuts, ``l`` and ``r`` the counts
    of both parts (of equal ones, the cut after fewer words).  It is dropped if a longer candidate that holds
    it has ``share`` per cent of its occurrences.  ``n``: all words of the language.

    A null language is ``und``; null and empty texts have no words; repeated rows each count; a very long
    text is read whole, in an array of its own.  Equal scores go by ``a``, then by phrase in byte order.
    An empty table gives no rows.  Other columns are not looked at.  Of words and phrases below ``least``
    nothing but word counts is kept.
    """
    tables, totals = phrase_tables(docs, least, text_col, lang_col, rows, size)
    ones, longer = tables[0], tables[1:]
    candidates = None
    for k, t in enumerate(longer, 2):
        t = t.select("lang", "phrase", F.lit(k).alias("k"), F.col("f").alias("a"))
        candidates = t if candidates is None else candidates.unionByName(t)
    inside = lambda k: [(i, m) for m in range(2, k) for i in range(k - m + 1)]
    w = F.split("phrase", " ")
    parts = None
    for k, t in enumerate(longer[1:], 3):
        of = F.array(*[F.array_join(F.slice(w, i + 1, m), " ") for i, m in inside(k)])
        t = t.select("lang", F.explode(of).alias("phrase"), "f")
        parts = t if parts is None else parts.unionByName(t)
    parts = parts.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    held = F.coalesce(_big("most") * 100 >= _big("a") * share, F.lit(False))
    kept = candidates.join(parts, ["lang", "phrase"], "left").where(~held).drop("most")

    known = None
    for t in tables[:-1]:
        t = t.select("lang", "phrase", "f")
        known = t if known is None else known.unionByName(t)
    cuts = kept.withColumn("j", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.withColumn("left", F.array_join(F.slice(w, F.lit(1), F.col("j")), " "))
    cuts = cuts.withColumn("right", F.array_join(F.slice(w, F.col("j") + 1, F.col("k")), " "))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    score = F.expr("cast(a as decimal(20,0)) * 2000000 div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "j", "l", "r")).alias("c"))
    best = best.select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    if first is not None:  # each of some tasks chooses, so that one task gets SALTS * first rows of a language
        salted = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
        salted = salted.withColumn("place", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order)))
        best = salted.where(F.col("place") <= first).drop("salt", "place")
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long"))
    if first is not None:
        ranked = ranked.where(F.col("rank") <= first)
    return ranked.join(F.broadcast(totals) if first is not None else totals, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score")
    )


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
  FROM documents),
words AS (SELECT lang, row_number() OVER () AS id, list_filter(string_split_regex(p, '[ \t]+'), lambda x: x <> '') AS w FROM piece),
word AS (SELECT lang, id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM words),
four AS (
  SELECT lang, x, lead(x, 1) OVER o AS x2, lead(x, 2) OVER o AS x3, lead(x, 3) OVER o AS x4
  FROM word WINDOW o AS (PARTITION BY id ORDER BY i)),
gram AS (
  SELECT lang, 1 AS k, x AS phrase FROM four
  UNION ALL SELECT lang, 2, x || ' ' || x2 FROM four WHERE x2 IS NOT NULL
  UNION ALL SELECT lang, 3, x || ' ' || x2 || ' ' || x3 FROM four WHERE x3 IS NOT NULL
  UNION ALL SELECT lang, 4, x || ' ' || x2 || ' ' || x3 || ' ' || x4 FROM four WHERE x4 IS NOT NULL),
f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM gram GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
inner_part AS (
  SELECT lang, phrase, max(a) AS most FROM (
    SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase FROM cand WHERE k = 3
    UNION ALL
    SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3], w[3] || ' ' || w[4],
                            w[1] || ' ' || w[2] || ' ' || w[3], w[2] || ' ' || w[3] || ' ' || w[4]]) FROM cand WHERE k = 4)
  GROUP BY ALL),
kept AS (
  SELECT c.* FROM cand c LEFT JOIN inner_part i USING (lang, phrase) WHERE i.most IS NULL OR 100 * i.most < 80 * c.a),
cuts AS (
  SELECT lang, phrase, a, j, array_to_string(w[1:j], ' ') AS x, array_to_string(w[j + 1:k], ' ') AS y
  FROM kept, (SELECT unnest([1, 2, 3]) AS j) WHERE j < k),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.j, p.f AS l, q.f AS r, (2000000 * c.a) // (p.f + q.f) AS score
  FROM cuts c JOIN f p ON p.lang = c.lang AND p.phrase = c.x JOIN f q ON q.lang = c.lang AND q.phrase = c.y),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
