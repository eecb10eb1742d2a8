"""Substring dedup and the Jaccard join against plain Python."""

import random

import pytest
from helpers import awkward, blank_words, sha, table, words

from sightline.llm import jaccard_join, spread, substring_dedup
from sightline.llm.components import components
from sightline.llm.wordhash import Words, column


def brute_dedup(rows, window):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = blank_words(t)
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            if k in seen:
                gone[s : s + window] = [True] * window
            seen.add(k)
        out[i] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g)))
    return out


def random_rows(seed, n=40):
    r = random.Random(seed)
    passages = [[f"p{seed}_{j}_{i}" for i in range(r.randrange(10, 60))] for j in range(4)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(r.randrange(0, 6)):
            w += r.choice(passages)[r.randrange(5) :] if r.random() < 0.6 else [r.choice("abc") for _ in range(r.randrange(30))]
        rows.append((i * 3, " ".join(w)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("rows, window, chunk", [(awkward(), 20, 6_000_000), (random_rows(1), 20, 300), (random_rows(2), 20, 5000), (random_rows(3), 5, 500), (random_rows(4), 2, 400)])
def test_substring_dedup(spark, rows, window, chunk):
    got = substring_dedup.substring_dedup(table(spark, rows), window, chunk_bytes=chunk).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, sha(r.kept_text)) for r in got} == brute_dedup(rows, window)


def test_substring_dedup_of_repeated_and_null_ids(spark):
    rows = [(1, words(30)), (1, words(30)), (None, words(30)), (None, None)]
    got = sorted((str(r.doc_id), r.n_removed) for r in substring_dedup.substring_dedup(table(spark, rows)).collect())
    assert got == [("1", 0), ("1", 30), ("None", 0), ("None", 30)]


def test_empty(spark):
    docs = table(spark, []).where("false")
    assert substring_dedup.substring_dedup(docs).count() == 0
    assert jaccard_join.jaccard_components(docs).count() == 0
    nothing = table(spark, [(1, None), (2, "")])
    assert [r.n_words for r in substring_dedup.substring_dedup(nothing).collect()] == [0, 0]
    assert sorted(map(tuple, jaccard_join.jaccard_components(nothing).collect())) == [(1, 0, 1), (2, 0, 2)]


def brute_components(rows, k, percent):
    sets, low = {}, {}
    for n, (i, t) in enumerate(rows):
        w = blank_words(t, lower=True)
        sets[n] = {tuple(w[s : s + k]) for s in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
        low[n] = n
    def root(x):
        while low[x] != x:
            x = low[x]
        return x
    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                low[root(a)] = root(b)
    ids = {}
    for n, (i, _) in enumerate(rows):
        ids.setdefault(root(n), []).append(i)
    return sorted((i, len(sets[n]), min(ids[root(n)])) for n, (i, _) in enumerate(rows))


def thue_morse(n, a, b):
    s = a
    while len(s) < n:
        s += s.translate(str.maketrans({a: b, b: a}))
    return s


#: Two words of 1024 characters whose byte polynomials agree modulo 2**64, whatever odd factor they have.
LIKE, UNLIKE = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")


def test_words_with_equal_polynomials_are_told_apart(spark):
    rows = [(1, LIKE), (2, UNLIKE), (3, UNLIKE), (4, LIKE + "x")]
    assert sorted(map(tuple, jaccard_join.jaccard_components(table(spark, rows)).collect())) == [(1, 1, 1), (2, 1, 2), (3, 1, 2), (4, 1, 4)]
    rows = [(1, words(19) + " " + LIKE), (2, words(19) + " " + UNLIKE), (3, words(19) + " " + LIKE)]
    got = {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(table(spark, rows)).collect()}
    assert got == {1: 0, 2: 0, 3: 20}


def test_one_large_group_of_near_copies(spark):
    """Thousands of changed copies of one text, many of them too far from it, at the real limits."""
    r = random.Random(9)
    base = [f"v{r.randrange(400)}" for _ in range(120)]
    rows = []
    for i in range(2000):
        w = list(base)
        for _ in range(r.choice((0, 1, 2, 4, 9))):
            w[r.randrange(120)] = f"m{r.randrange(50)}"
        rows.append((i, " ".join(w)))
    got = jaccard_join.jaccard_components(table(spark, rows)).collect()
    assert sorted(map(tuple, got)) == fast_components(rows, 5, 80)


def fast_components(rows, k, percent):
    """As ``brute_components``, by a matrix of all intersections."""
    import numpy as np

    sets = [brute_set(t, k) for _, t in rows]
    number = {x: j for j, x in enumerate(sorted(set().union(*sets)))}
    m = np.zeros((len(rows), len(number)), np.float32)
    for a, s in enumerate(sets):
        m[a, [number[x] for x in s]] = 1
    both, n = m @ m.T, m.sum(1)
    linked = 100 * both >= percent * (n[:, None] + n[None, :] - both)
    low = np.arange(len(rows))
    while True:
        now = np.where(linked, low[None, :], len(rows)).min(1)
        if (now == low).all():
            return sorted((i, len(s), rows[c][0]) for (i, _), s, c in zip(rows, sets, low.tolist()))
        low = now


def brute_set(text, k):
    w = blank_words(text, lower=True)
    return {tuple(w[s : s + k]) for s in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


@pytest.mark.parametrize("rows_of_a_task", [3, 10_000])
def test_join_spread(spark, monkeypatch, rows_of_a_task):
    from pyspark.sql import functions as F

    monkeypatch.setattr(spread, "ROWS", rows_of_a_task)
    left = spark.range(100).select(F.when(F.col("id") < 60, 7).otherwise(F.col("id") % 5).alias("k"), "id")
    right = spark.range(1, 9).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = spread.join_spread(left, right, "k")
    assert got.columns == ["k", "id", "v"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, left.join(right, "k").collect()))


def near_copies(seed, groups=6, size=12, n=80):
    r = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [f"g{g}w{r.randrange(60)}" for _ in range(n)]
        for _ in range(size):
            w = list(base)
            for _ in range(r.randrange(0, 5)):
                w[r.randrange(n)] = f"m{r.randrange(1000)}"
            rows.append(" ".join(w))
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(
    "rows, k, percent, rare", [(awkward(), 3, 90, 20_000), (near_copies(1), 3, 90, 20_000), (near_copies(2), 3, 80, 1), (near_copies(3), 5, 80, 1), (near_copies(4, 2, 25), 2, 60, 5)]
)
def test_jaccard_components(spark, monkeypatch, rows, k, percent, rare):
    monkeypatch.setattr(jaccard_join, "RARE", rare)
    monkeypatch.setattr(spread, "ROWS", 10)
    rows = rows + [(rows[3][0], rows[3][1])]  # a repeated row
    got = jaccard_join.jaccard_components(table(spark, rows), k, percent, chunk_bytes=4000).collect()
    assert sorted(map(tuple, got)) == brute_components(rows, k, percent)


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (7, 7), (3, 4)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_word_hashes_see_text_ends():
    import pyarrow as pa

    texts = ["ab cd", "ef", "", None, "A", "a  "]
    w = Words(*column(pa.array(texts)), True)
    assert [w.text(i, j) for i, j in zip(w.first[:-1], w.first[1:])] == ["ab cd", "ef", "", "", "A", "a"]
    assert w.hash[-1] == w.hash[-2] and len(set(w.hash.tolist())) == 4
