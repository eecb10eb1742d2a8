"""Collocations against a plain version of the contract; the SQL is compared with the other queries'."""

import re
from collections import Counter

import pytest
from helpers import UPPER, awkward, table

from sightline.llm import collocations


def brute(rows, least, share=80, first=2000):
    count = {}
    for lang, text in rows:
        c = count.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(UPPER)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            for k in range(1, 5):
                c.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in count.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        most = Counter()
        for p, a in cand.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    most[p[i : i + m]] = max(most[p[i : i + m]], a)
        n = sum(a for p, a in c.items() if len(p) == 1)
        kept = []
        for p, a in cand.items():
            if p in most and 100 * most[p] >= share * a:
                continue
            score, _, l, r = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:first], 1)]
    return sorted(out)


def got(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("how", [{}, {"rows": 0}])
def test_equals_brute_force(spark, sf_dir, how):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute([(r.lang, r.text) for r in docs.select("lang", "text").collect()], 5)
    assert len(want) > 300 and len({r[0] for r in want}) == 4
    assert got(collocations.collocations(docs, least=5, **how)) == want


@pytest.mark.parametrize("how", [{}, {"rows": 0}, {"size": 0}])
def test_awkward_rows(spark, how):
    texts = [t for _, t in awkward()]
    texts += ["A a a a a. a\ta  a", "of the, of the of the!of the", "x\x00y z " * 3, "é É é É", "new york city new york", "New York City", "one\x0btwo\x0bone two"] * 2
    langs = [None, "", "de", "und", "a\x01b"]
    rows = [(i, t, langs[i % 5]) for i, t in enumerate(texts)] + [(None, "of the of the", "de")] * 3
    docs = table(spark, rows, "doc_id long, text string, lang string")
    for least, share, first in ((2, 80, 2000), (1, 100, 3)):
        want = brute([(r[2], r[1]) for r in rows], least, share, first)
        assert want and got(collocations.collocations(docs, least, share, first, **how)) == want
    assert got(collocations.collocations(docs.where("false"), 1, **how)) == []


def test_chunks_and_long_texts(spark, monkeypatch):
    """Phrases are neither lost nor counted twice where texts are put together or looked at in parts."""
    rows = [(i, " ".join(f"w{(i + j * j) % 7}" for j in range(n)), "en") for i, n in enumerate([1, 2, 3, 5, 40, 400, 3000, 7, 1, 2])]
    monkeypatch.setattr(collocations, "CHUNK", 50)
    monkeypatch.setattr(collocations, "COUNTED", 120)
    docs = table(spark, rows, "doc_id long, text string, lang string").coalesce(1)
    want = brute([(r[2], r[1]) for r in rows], 3)
    assert got(collocations.collocations(docs, 3)) == want
