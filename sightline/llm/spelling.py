"""Spelling variants: words that differ by one code point, found by Aho-Corasick over halves of words.

1. Words are counted over all texts.
2. One changed code point leaves one half of a word as it is, at the word's beginning or at its end.  Each word's
   two halves are its segments: the bar ``|`` and the first half, the second half and the bar.
3. Shards of automata hold the segments; a segment lies in the shard of its hash.  Every word is sent to the shards
   of the beginnings and ends that a word of its length, or of one code point more or less, would have as segments.
   The shard's automaton scans ``word|word``, in which a segment stands only at its proper offset (the bar), and
   what it finds is checked for length, then for the distance.
4. A segment of too many words (``heavy``) is not searched: for its words the rest is halved again, and the segment
   grows by the first part of the rest, or by the last part on the other side of the bar.  So no task meets all words
   of a frequent half; when the rest is one code point, all words of a segment are near each other.
5. A pair counts at the first segment, in the order of halving, that both words share, so that pairs need not be
   shuffled: each shard sums up its words' near words.

Chains of forms are followed by doubling: a form occurs ten times as often as its word, so that a chain is no longer
than the number of digits of the largest count.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.workers import bound_batches, enter
from sightline.llm.words import ascii_lower
from sightline.sources.work import cut, discard

#: The code points of words, and how often a code point is lost (one run in so many).
RUN, ONE_IN = "[A-Za-zÀ-ÿ]", 31
#: Least code points and occurrences of a word; a form occurs so many times as often.
SHORTEST, LEAST, TIMES = 7, 2, 10
#: Words of a segment beyond which it is split; at most so many segments are (they are broadcast).
HEAVY, HEAVIEST = 5_000, 20_000
#: Rows of a shard.
SHARD = 50_000
#: Candidates of a segment up to which its words are compared one by one, else by what one deletion leaves.
DIRECT = 400


def lossy_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """``word, n``: runs of letters, A-Z lower-cased, counted over all texts.

    A run whose crc32 with the document's id is divisible by 31 has lost the code point at crc32 modulo its
    length.  Only words of ``shortest`` code points remain.
    """
    runs = F.regexp_extract_all(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(f"{RUN}{{{shortest},}}"), F.lit(0))
    ids = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    run = F.when(F.col("run").rlike("[A-Z]"), ascii_lower(F.col("run"))).otherwise(F.col("run"))
    rows = docs.select(ids.alias("id"), F.explode(runs).alias("run")).select("id", run.alias("run"))
    rows = rows.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    lost = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    rows = rows.select(F.when(F.col("h") % ONE_IN == 0, lost).otherwise(F.col("run")).alias("word"))
    return rows.where(F.length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _segment(length: Column, p: Column, q: Column) -> Column:
    """Of a word of ``length`` (its own or one more or less): last ``p`` code points, bar, first ``q``."""
    return F.concat(F.substring(F.col("word"), F.length("word") - p + 1, p), F.lit("|"), F.substring(F.col("word"), F.lit(1), q))


def _halves(length, p, q):
    """The two segments that halve what ``p`` last and ``q`` first code points leave of a word."""
    rest = length - p - q
    half = (rest / 2).cast("int") if isinstance(rest, Column) else rest // 2
    return (p, q + half), (p + rest - half, q)


def _segments(words: DataFrame, heavy: int) -> DataFrame:
    """``word, n, length, p, q, segment`` for each segment by which a word is found (``length`` its own) or looks for
    words of ``length``."""
    size = F.length("word")
    rows = words.select("word", "n", F.explode(F.array(size - 1, size, size + 1)).alias("length")).where(F.col("length") >= 2)

    def split(rows: DataFrame, p: Column, q: Column) -> DataFrame:
        two = F.array(*[F.struct(a.alias("p"), b.alias("q")) for a, b in _halves(F.col("length"), p, q)])
        rows = rows.select("word", "n", "length", F.explode(two).alias("s")).select("word", "n", "length", "s.p", "s.q")
        # what looks for longer words may be too short to hold both sides
        rows = rows.where(F.col("p") + F.col("q") <= F.length("word"))
        return rows.select("word", "n", "length", "p", "q", _segment(F.col("length"), F.col("p"), F.col("q")).alias("segment"))

    found, rows = None, split(rows, F.lit(0), F.lit(0))
    while True:
        own = F.count_if(F.length("word") == F.col("length"))
        counts = rows.groupBy("length", "segment").agg(own.alias("own"), F.first(F.col("length") - F.col("p") - F.col("q")).alias("rest"))
        large = cut(counts.where((F.col("own") > heavy) & (F.col("rest") > 1)).select("length", "segment"), "heavy")
        if large.isEmpty():
            discard(large)
            return rows if found is None else found.unionByName(rows)
        light = rows.join(F.broadcast(large), ["length", "segment"], "left_anti")
        found = light if found is None else found.unionByName(light)
        rows = split(rows.join(F.broadcast(large), ["length", "segment"], "left_semi"), F.col("p"), F.col("q"))


def near(a: str, b: str) -> bool:
    """Exactly one code point inserted, deleted or replaced."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i, most = 0, min(len(a), len(b))
    while i < most and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i:]


def _earlier(length: int, p: int, q: int) -> list[tuple[int, int]]:
    """Segments before (p, q) in the order of halving, by any of which a pair would have been found."""
    out, a, b = [], 0, 0
    while (a, b) != (p, q):
        left, right = _halves(length, a, b)
        if q >= left[1]:
            a, b = left
        else:
            out.append(left)
            a, b = right
    return out


def _search(t: pa.Table) -> pa.Table:
    """Near words of a shard's words: ``word, n_near, near, near_n`` (the most frequent, of equal ones the first)."""
    import ahocorasick

    enter("spelling")
    holders: dict[tuple[str, int], tuple[int, int, list[str]]] = {}
    seekers: dict[str, tuple[int, set[int]]] = {}
    for word, n, length, p, q, segment in zip(*(t[c].to_pylist() for c in ("word", "n", "length", "p", "q", "segment"))):
        seekers.setdefault(word, (n, set()))[1].add(length)
        if len(word) == length:
            holders.setdefault((segment, length), (p, q, []))[2].append(word)
    lengths: dict[str, list[int]] = {}
    for segment, length in holders:
        lengths.setdefault(segment, []).append(length)
    automaton = ahocorasick.Automaton()
    for segment, some in lengths.items():
        automaton.add_word(segment, (segment, some))
    sought: dict[tuple[str, int], list[str]] = {}
    if lengths:
        automaton.make_automaton()
    for word, (_, wanted) in seekers.items() if lengths else ():
        for segment, some in {s: x for _, (s, x) in automaton.iter(f"{word}|{word}")}.items():
            for length in some:
                # the segment's sides must not overlap within the word
                if length in wanted and len(segment) - 1 <= len(word):
                    sought.setdefault((segment, length), []).append(word)
    count: dict[str, int] = {}
    best: dict[str, tuple[int, str]] = {}

    def meet(word: str, other: str) -> None:
        count[word] = count.get(word, 0) + 1
        this = (-seekers[other][0], other)
        if word not in best or this < best[word]:
            best[word] = this

    for key, others in sought.items():
        p, q, words = holders[key]
        before = _earlier(key[1], p, q)
        first = lambda w, x: not any(w[:b] == x[:b] and w[len(w) - a :] == x[len(x) - a :] and a + b <= len(x) for a, b in before)
        if len(words) * len(others) <= DIRECT:
            pairs = ((w, x) for w in words for x in others)
        else:
            # a deletion from either, or from one, makes near words equal
            left: dict[str, list[str]] = {}
            for x in others:
                for s in {x, *(x[:i] + x[i + 1 :] for i in range(q, len(x) - p))}:
                    left.setdefault(s, []).append(x)
            pairs = ((w, x) for w in words for x in {x for s in {w, *(w[:i] + w[i + 1 :] for i in range(q, len(w) - p))} for x in left.get(s, ())})
        for w, x in pairs:
            if near(w, x) and first(w, x):
                meet(w, x)
    found = list(count)
    return pa.table(
        {
            "word": pa.array(found, pa.string()),
            "n_near": pa.array([count[w] for w in found], pa.int64()),
            "near": pa.array([best[w][1] for w in found], pa.string()),
            "near_n": pa.array([-best[w][0] for w in found], pa.int64()),
        }
    )


def near_words(words: DataFrame, heavy: int = HEAVY, shard: int = SHARD) -> DataFrame:
    """``word, n_near, near, near_n`` of every word of ``words`` (``word, n``; stored) that has a near word."""
    total = words.count()
    if not total:
        return words.select("word", F.col("n").alias("n_near"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    bound_batches(words.sparkSession)
    # at most HEAVIEST segments have so many words, two for each word and round
    rows = _segments(words, max(heavy, 2 * total // HEAVIEST))
    shards = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), 6 * total // shard)
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("segment"), F.lit(shards)))
    some = dealt.groupBy("shard").applyInArrow(_search, "word string, n_near long, near string, near_n long")
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("near")))
    out = some.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return out.select("word", "n_near", F.col("b.near").alias("near"), (-F.col("b.m")).alias("near_n"))


def roots(forms: DataFrame, longest: int) -> DataFrame:
    """``word, root`` from ``word, form``, following at most ``longest`` forms."""
    at = forms.select("word", F.col("form").alias("root"))
    reach = 1
    while reach < longest:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        at = cut(at.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
        reach *= 2
    return at


def variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: int = LEAST,
    times: int = TIMES,
    heavy: int = HEAVY,
    shard: int = SHARD,
) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of 7 code points and ``least`` occurrences.

    Words are runs of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z lower-cased, some of which have lost a code point (see
    ``lossy_words``).  Near words differ by one code point.  ``form``: the near word of largest ``n`` (of
    equal ones the first in code-point order) if it has ``times`` the word's, else null; ``root``: the last
    of the word's forms, itself without any.

    Null and empty texts have no words; a null id counts as the empty string; repeated rows each count; a very long text
    is read whole; an empty table gives no rows.  Other columns are not looked at.
    """
    counts = lossy_words(docs, id_col, text_col).where(F.col("n") >= least)
    words = cut(counts, "words")
    close = near_words(words, heavy, shard)
    is_form = F.col("near_n") >= F.col("n") * times
    known = words.join(close, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n"),
    )
    known = cut(known, "forms")
    most = known.agg(F.max("n")).first()[0] or 1
    links = known.where("form is not null").select("word", "form")
    last = roots(links, max(1, math.ceil(math.log(most / least, times)) if times > 1 and most > least else 1))
    return known.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
