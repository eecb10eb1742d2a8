"""Spelling variants against a plain version of the contract."""

import re
import zlib
from collections import Counter, defaultdict

import pytest
from helpers import UPPER, awkward, table

from sightline.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def lose(doc_id, run):
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    k = h % len(run)
    return run[:k] + run[k + 1 :] if h % 31 == 0 else run


def deletions(w):
    return {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}


def distance(a, b):
    """Plain edit distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(rows):
    n = Counter(lose(i, r.translate(UPPER)) for i, t in rows for r in RUN.findall(t or ""))
    words = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    by = defaultdict(set)
    for w in words:
        for d in deletions(w):
            by[d].add(w)
    out = {}
    for w, c in words.items():
        near = [x for x in set().union(*(by[d] for d in deletions(w))) if abs(len(x) - len(w)) < 2 and distance(w, x) == 1]
        m, best = min(((-words[x], x) for x in near), default=(0, None))
        form = best if -m >= 10 * c else None
        out[w] = (form, c, len(near), words[form] if form else None)

    def root(w):
        while out[w][0]:
            w = out[w][0]
        return w

    return {w: (f, root(w), c, k, m) for w, (f, c, k, m) in out.items()}


def got(df):
    rows = df.collect()
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"] and len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


@pytest.mark.parametrize("how", [{}, {"heavy": 5, "shard": 900}])
def test_equals_brute_force(spark, sf_dir, how):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert len(want) > 1000 and any(r[0] for r in want.values())
    assert got(spelling.variants(docs, **how)) == want


def test_chains_ties_and_awkward_rows(spark):
    # n of 2000, 200 and 20 in a chain; two forms of equal n; letters beyond ASCII; one heavy beginning
    text = " ".join(["wordone"] * 2000 + ["wordona"] * 150 + ["wardona"] * 12 + ["Éclairée"] * 40 + ["éclairée"] * 3 + ["éclairé"] * 2)
    many = " ".join(f"commonly{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(600))
    ties = " ".join(["tiedupab"] * 40 + ["tiedupac"] * 40 + ["tiedupad"] * 3)
    rows = [*awkward(), (None, text), (None, many), (70, many), (71, ties + " × ÷ over×under over÷under Over×under"), (71, ties)]
    want = brute(rows)
    assert want["wardona"][:2] == ("wordona", "wordone") and want["tiedupad"][0] == "tiedupab"
    for how in ({}, {"heavy": 20, "shard": 300}):
        assert got(spelling.variants(table(spark, rows), **how)) == want
    assert got(spelling.variants(table(spark, rows).where("false"))) == {}


def test_near():
    assert all(spelling.near(a, b) for a, b in (("abc", "abd"), ("abc", "ab"), ("abc", "xabc"), ("abc", "abbc")))
    assert not any(spelling.near(a, b) for a, b in (("abc", "abc"), ("abc", "acb"), ("abc", "a"), ("abc", "abcde"), ("abc", "xbcd")))
