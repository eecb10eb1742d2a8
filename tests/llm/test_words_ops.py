"""Exact dedup, decontamination and licence scan against plain Python."""

import math

import pytest
from helpers import awkward, plain_words, sha, table, words

from sightline.llm import decontaminate, exact_dedup, licenses


def test_exact_groups(spark):
    rows = awkward() + [(4, words(60)), (None, "a"), (None, None), (99, "a ")]
    got = exact_dedup.exact_groups(table(spark, rows)).collect()
    want = []
    for i, t in rows:
        ids = [j for j, u in rows if (u or "") == (t or "")]
        keep = max((j for j in ids if j is not None), default=None)
        want.append((i, keep, len(ids), i == keep, sha(t or "")))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_exact_dedup_keeps_columns(spark):
    df = table(spark, awkward() + [(4, words(60)), (5, words(60))])
    kept = exact_dedup.exact_dedup(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, *range(5, 19)]


def test_empty_tables(spark):
    docs = table(spark, []).where("false")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert exact_dedup.exact_groups(docs).count() == 0
    assert decontaminate.contamination(docs, bench).count() == 0
    assert decontaminate.contamination(table(spark, awkward()), bench).where("contaminated").count() == 0
    assert licenses.license_scan(docs).count() == 0


def brute_contamination(rows, items, window=10):
    wins = {}
    for i, t in items:
        w = plain_words(t)
        n = min(len(w), window)
        for s in range(len(w) - n + 1) if w else ():
            wins.setdefault(tuple(w[s : s + n]), set()).add(str(i))
    out = []
    for d, t in rows:
        w, hit, found = plain_words(t), set(), set()
        for n in {len(k) for k in wins}:
            for s in range(len(w) - n + 1):
                k = tuple(w[s : s + n])
                if k in wins:
                    hit.update(range(s, s + n))
                    found |= wins[k]
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


@pytest.mark.parametrize("limit", [1_000_000, 0])
@pytest.mark.parametrize("items", [[(1, words(30))], [(1, words(7)), (2, words(30))], [(1, "w3 w4")]])
def test_documents_shorter_than_a_shingle(spark, monkeypatch, limit, items):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", limit)
    rows = [(i, words(i)) for i in range(0, 13)] + [(None, None), (None, "w1"), (50, "w1 w1 w1 w1 w1 w1")]
    got = decontaminate.contamination(table(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(brute_contamination(rows, items), key=key)


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_contamination(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", limit)
    items = [(10, words(12, 20)), (9, words(12, 20)), (8, "a b"), (7, None), (6, "..."), (5, "Z"), (4, "w1 w2 w3 w4 w5 w6 w7"), (3, words(10, 505)), (2, "mit LICENSE")]
    rows = awkward() + [(4, words(60)), (4, "z Z z"), (None, "a b a b")]
    got = decontaminate.contamination(table(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(brute_contamination(rows, items), key=key)


def brute_licenses(rows, templates=licenses.TEMPLATES):
    texts = [plain_words(t) for _, t in rows]
    vocab = {w for t in templates for w in t.words.split()}
    idf = {v: math.log((len(texts) + 1) / (sum(v in w for w in texts) + 1)) + 1e-9 for v in vocab}
    out = []
    for (i, _), w in zip(rows, texts):
        base, base_labels, labels, score = [], set(), set(), 0.0
        for t in templates:
            tw, (first, n) = t.words.split(), t.key
            rare = sorted(range(len(tw)), key=lambda j: (-idf[tw[j]], j))[: licenses.RARE]
            for s in range(-first, len(w)):
                there = [0 <= s + j < len(w) and w[s + j] == x for j, x in enumerate(tw)]
                if all(there[first : first + n]) and sum(there[j] for j in rare) >= min(licenses.AGREE, len(tw)):
                    labels.add(t.label)
                    score = max(score, sum(idf[x] for x, y in zip(tw, there) if y) / sum(idf[x] for x in tw))
                    if t.base:
                        base.append(s)
                        base_labels.add(t.label)
        out.append((i, len(w), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), round(min(1.0, score), 9)))
    return out


def test_license_scan(spark):
    full = licenses.TEMPLATES[3].words
    texts = [
        "Permission is hereby granted, free of charge, to any person",
        "permission is hereby denied",
        "permission is hereby granted",
        "under the GNU Lesser General Public License or the Mozilla Public License",
        "general public general public license license mit mit license license",
        "MIT\nLicense" * 3,
        "apache license " * 400,
        "BSD-License creative commons attribution released into the public domain",
        "head " * 50 + full.upper() + ". " + full.replace("merge", "x") + " GNU general public license " + licenses.TEMPLATES[5].words,
        "license mit apache public general", *(t.words for t in licenses.TEMPLATES),
    ]
    rows = awkward() + [(100 + i, t) for i, t in enumerate(texts)] + [(100, "isc license"), (None, "mit license"), (7000, "mit " * 50_000 + "license"), (7001, ("mit license x " * 20_000))]
    got = [(*tuple(r)[:-1], round(r.score, 9)) for r in licenses.license_scan(table(spark, rows)).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(brute_licenses(rows), key=key)
    assert all((r[-1] > 0) == bool(r[-2]) for r in got)


def test_licenses_of_another_table(spark):
    own = (licenses.Template("a", "one", (0, 1), True), licenses.Template("b", "one two two one three", (1, 2)))
    rows = [(1, "one one two two one three"), (2, "two two"), (3, "x two two one three"), (4, None)]
    got = licenses.license_scan(table(spark, rows), licenses.template_table(spark, own)).collect()
    assert sorted((*tuple(r)[:-1], round(r.score, 9)) for r in got if r.doc_id < 4) == sorted(brute_licenses(rows, own)[:3])


def test_passage_that_only_rows_without_id_hold(spark):
    passage = words(12, 700)
    docs = table(spark, [(None, "before " + passage + " after"), (None, words(12)), (1, words(12))])
    benchmark = spark.createDataFrame([(9, passage)], "item_id long, text string")
    got = {(r.doc_id, r.n_words): (r.n_hit, r.n_items, r.contaminated) for r in decontaminate.contamination(docs, benchmark).collect()}
    assert got == {(None, 14): (12, 1, True), (None, 12): (0, 0, False), (1, 12): (0, 0, False)}


def test_exact_dedup_judges_rows_by_their_text(spark):
    rows = [(1, "a"), (2, "a"), (1, "b"), (3, None), (3, ""), (None, "c"), (None, "c"), (None, "d"), (4, "d"), (5, "x" * 3_000_000), (6, "x" * 3_000_000)]
    got = exact_dedup.exact_dedup(table(spark, rows))
    assert got.columns == table(spark, rows).columns
    want = [(2, "a"), (1, "b"), (3, ""), (None, "c"), (4, "d"), (6, "x" * 3_000_000)]
    assert sorted((str(r.doc_id), r.text or "") for r in got.collect()) == sorted((str(i), t) for i, t in want)
    assert exact_dedup.exact_dedup(table(spark, rows).where("false")).count() == 0
