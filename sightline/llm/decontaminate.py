"""Benchmark decontamination: a prefix-filtered set join on word shingles.

Every benchmark window (``window`` consecutive words of an item, or a whole shorter item) is a
sequence of shingles.  A document can contain the window only if it contains the window's rarest
shingle, so with exact containment a prefix of one shingle is enough:

1. All shingles of all documents meet the benchmark's shingles, as text, not as hashes, in one pass
   of generated code.  What matches is written once: one row for each matching place.
2. Rarity is the number of documents with a shingle, counted over all documents from those rows.
3. Each window's rarest shingle is joined with the places; shingle position minus the shingle's
   offset in the window is the only place where the window can start, and it must lie in the
   document (length and positional bounds).
4. The window is there exactly if the shingles that tile it stand at their places, looked up
   among the matching places.

Only the benchmark side is ever broadcast, and only after its rows and bytes were counted against
``BROADCAST_ROWS`` and ``BROADCAST_BYTES``; a larger benchmark is joined by shuffle.  Nothing of the corpus is gathered.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline.llm.words import plain_words
from sightline.sources.work import cut

#: Benchmark shingles or windows that may be broadcast, and bytes of their words.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 200_000_000


def _shingles(base: DataFrame, k: int, first: int) -> DataFrame:
    """``doc_id, x, n, pos, g``: runs of ``k`` words, joined by one space, and where they begin.  With -1
    as ``first``, every text has a row of that place and no shingle too."""
    n = F.col("n").cast("int")
    last = F.greatest(F.lit(min(first, 0)), n - k)
    at = base.withColumn("pos", F.explode(F.when((n >= k) | F.lit(first < 0), F.sequence(F.lit(first), last))))
    words = [F.get("w", F.col("pos") + i) for i in range(k)]
    return at.select("doc_id", "x", "n", "pos", F.when(F.col("pos") >= 0, F.concat_ws(" ", *words)).alias("g"))


def benchmark_windows(
    benchmark: DataFrame, window: int = 10, shingle: int = 5, item_col: str = "item_id", text_col: str = "text"
) -> DataFrame:
    """Distinct windows: ``win`` (its words joined by a space), ``len``, ``k`` (its shingle length),
    ``items`` (sorted ids as strings).  Items of several rows keep one id; items without words
    have no window."""
    w = benchmark.select(
        F.col(item_col).cast("string").alias("item"), plain_words(F.col(text_col)).alias("w")
    ).where(F.size("w") > 0)
    w = w.withColumn("len", F.least(F.size("w"), F.lit(window)))
    w = w.select(
        "item", "len", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)).alias("s")
    ).select("item", "len", F.array_join(F.slice("w", F.col("s"), F.col("len")), " ").alias("win"))
    return (
        w.groupBy("win", "len")
        .agg(F.array_sort(F.collect_set(F.coalesce("item", F.lit("")))).alias("items"))
        .withColumn("k", F.least("len", F.lit(shingle)))
    )


def contained_windows(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    shingle: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """(rows, occurrences).

    ``rows``: ``doc_id, x, n_words`` of every input row, where ``x`` tells apart rows of one id
    with different texts.  ``occurrences``: ``doc_id, x, start, len, items`` for every place at
    which a window stands in a document; words are counted from 0.
    """
    wins = cut(benchmark_windows(benchmark, window, shingle), "windows")
    size = wins.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("win")), F.lit(0)).alias("bytes")).first()
    each = max(1, window - shingle + 1)  # shingles of a window
    few = size["n"] * each <= BROADCAST_ROWS and size["bytes"] * each <= BROADCAST_BYTES
    small = F.broadcast if few else lambda df: df
    # the shingles of each window and their offsets
    grams = wins.select("win", "len", "k", F.split("win", " ").alias("w")).select(
        "win",
        "len",
        "k",
        F.posexplode(
            F.transform(
                F.sequence(F.lit(1), F.col("len") - F.col("k") + 1),
                lambda i: F.array_join(F.slice("w", i, F.col("k")), " "),
            )
        ).alias("off", "g"),
    )
    lengths = [r[0] for r in wins.select("k").distinct().collect()]  # at most `shingle` values
    wanted = grams.select("g").distinct()

    words = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("x"),
        plain_words(F.col(text_col)).alias("w"),
    )
    base = words.select("doc_id", "x", F.size("w").cast("long").alias("n"), "w")
    seen = F.col("wanted").isNotNull()
    wanted = wanted.withColumn("wanted", F.lit(True))
    if few and lengths:
        # the row of each text comes from the same pass
        each_length = [
            _shingles(base, k, -1 if i == 0 else 0).join(small(wanted), "g", "left").where(seen | (F.col("pos") < 0))
            for i, k in enumerate(sorted(lengths))
        ]
    else:
        each_length = [base.select("doc_id", "x", "n", F.lit(-1).alias("pos"), F.lit(None).cast("string").alias("g"))]
        each_length += [_shingles(base, k, 0).join(wanted, "g") for k in sorted(lengths)]
    met = functools.reduce(DataFrame.unionByName, [d.select("doc_id", "x", "n", "pos", "g") for d in each_length])
    met = cut(met, "places")
    rows = met.where("pos < 0").select("doc_id", "x", F.col("n").alias("n_words"))
    places = met.where("pos >= 0")

    # a struct is never null, so documents without id count too
    df = places.groupBy("g").agg(F.count_distinct(F.struct("doc_id", "x")).alias("df"))
    rarest = (
        grams.join(df, "g", "left")
        .groupBy("win", "len", "k")
        .agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "off", "g")).alias("r"))
        .where("r.df > 0")
        .select("win", "len", "k", F.col("r.off").alias("off"), F.col("r.g").alias("g"))
    )
    found = (
        places.join(small(rarest), "g")
        .withColumn("start", F.col("pos") - F.col("off"))
        .where((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n")))
        .select("doc_id", "x", "start", "win", "len", "k")
        .distinct()
    )
    # shingles that tile the window: every k-th one and the last
    tiles = F.array_distinct(
        F.concat(F.sequence(F.lit(0), F.col("len") - F.col("k"), F.col("k")), F.array(F.col("len") - F.col("k")))
    )
    needed = found.select("*", F.size(tiles).alias("need"), F.explode(tiles).alias("t")).select(
        "*",
        (F.col("start") + F.col("t")).alias("pos"),
        F.array_join(F.slice(F.split("win", " "), F.col("t") + 1, F.col("k")), " ").alias("g"),
    )
    there = places.select(F.col("doc_id").alias("d2"), F.col("x").alias("x2"), F.col("pos").alias("p2"), F.col("g").alias("g2")).distinct()
    held = (
        needed.join(
            there,
            F.col("doc_id").eqNullSafe(F.col("d2"))
            & (F.col("x") == F.col("x2"))
            & (F.col("pos") == F.col("p2"))
            & (F.col("g") == F.col("g2")),
        )
        .groupBy("doc_id", "x", "start", "win", "len", "need")
        .agg(F.count(F.lit(1)).alias("have"))
        .where("have = need")
    )
    items = small(wins.select("win", "items"))
    return rows, held.join(items, "win").select("doc_id", "x", "start", "len", "items")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 5, **cols) -> DataFrame:
    """One row for each document row: ``doc_id``, ``n_words``, ``n_hit`` (words inside any
    occurrence of a benchmark window), ``n_items``, ``items_sha256`` and ``contaminated``.

    Null or wordless texts have no words and are never contaminated; null or wordless items have
    no window.  Repeated rows each get their row.  Empty tables give no hits, or no rows.  A very long
    text is cut into words in its task, and its shingles go on one by one.  Of a window's shingles that
    are as rare, the first is joined.  Other columns are not looked at.
    """
    rows, occ = contained_windows(docs, benchmark, window, shingle, **cols)
    by = W.partitionBy("doc_id", "x").orderBy("start")
    spans = occ.groupBy("doc_id", "x", "start").agg(
        F.max("len").alias("len"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items")
    )
    # words that no earlier span of the document has covered
    prev = F.max(F.col("start") + F.col("len")).over(by.rowsBetween(W.unboundedPreceding, -1))
    spans = spans.withColumn(
        "new", F.greatest(F.lit(0), F.col("start") + F.col("len") - F.greatest("start", F.coalesce(prev, F.lit(0))))
    )
    per_doc = spans.groupBy("doc_id", "x").agg(
        F.sum("new").cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    per_doc = per_doc.select(F.col("doc_id").alias("d2"), F.col("x").alias("x2"), "n_hit", "items")
    none = F.array().cast("array<string>")
    out = rows.join(per_doc, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("x") == F.col("x2")), "left")
    items = F.coalesce("items", none)
    hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contamination(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)),
occ AS (SELECT doc_id, s, dw.n, item_id FROM dw JOIN bw USING (win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM occ) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
