"""Language identification and mixing: held-out accuracy, targets, and awkward rows."""

import numpy as np
import pyarrow as pa
import pytest
from helpers import awkward, table
from pyspark.sql import functions as F

from sightline.llm import language_id, mixing


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = language_id.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(got) > 20 and (got.lang == got.lang_pred).mean() >= 0.97 and got.score.between(0, 1).all()


def test_held_out_rows_teach_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = language_id.held_out(F.col("doc_id"))
    lied = docs.withColumn("lang", F.when(out, "xx").otherwise(F.col("lang")))
    assert language_id.language_id(lied).where("lang_pred = 'xx'").count() == 0


def test_language_of_awkward_rows(spark):
    rows = [(i, t, "en" if i % 2 else "de") for i, t in awkward()] + [(50, "1234 !!", "en"), (None, "words", None)]
    got = {r.doc_id: r for r in language_id.language_id(table(spark, rows, "doc_id long, text string, lang string")).collect()}
    assert len(got) == len(rows)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1, 2, 3, 50)) and got[4].lang_pred in ("en", "de")
    unlabelled = language_id.language_id(table(spark, [(1, "a", None)], "doc_id long, text string, lang string"))
    assert [r.lang_pred for r in unlabelled.collect()] == ["und"]
    assert language_id.language_id(table(spark, [], "doc_id long, text string, lang string").where("false")).count() == 0


def test_ngram_counts():
    one, two = (dict(zip(f.tolist(), c.tolist())) for f, c in language_id._grams(["Aba", "xy"]))
    assert sum(one.values()) == 5 + 4 + 3 and sum(two.values()) == 4 + 3 + 2
    alone = next(language_id._grams(["xy"]))
    assert two == dict(zip(alone[0].tolist(), alone[1].tolist()))


def test_ftrl_is_sparse_and_separates():
    r = np.random.default_rng(0)
    m = language_id.Ftrl(100, 2, l1=0.3)
    for _ in range(800):
        y = int(r.integers(2))
        m.step(np.array([y, 60 + int(r.integers(40))]), np.ones(2), y)
    w = m.weights(np.arange(101))
    assert w[0, 0] > 0 > w[0, 1] and (w[10:50] == 0).all()


def test_temperature_undoes_scaling():
    r = np.random.default_rng(1)
    logits = r.normal(size=(4000, 3))
    p = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
    y = np.array([r.choice(3, p=q) for q in p])
    assert language_id._temperature(logits * 4, y) == pytest.approx(4, rel=0.15)


def posterior_table(spark, n=400, seed=3):
    r = np.random.default_rng(seed)
    p = r.dirichlet([0.3, 0.3, 0.3], n)
    t = r.integers(1, 2000, n)
    return p, t, spark.createDataFrame([(i, int(t[i]), p[i].tolist()) for i in range(n)], "doc_id long, n_tokens long, p array<double>").repartition(3)


def test_rates_meet_targets_and_the_optimum(spark):
    p, t, table_ = posterior_table(spark)
    have = t @ p
    targets = have * np.array([1.2, 0.8, 0.9])
    got = {r.doc_id: r.rate for r in mixing.fit_rates(table_, targets).collect()}
    rate = np.array([got[i] for i in range(len(t))])
    assert (rate >= 0).all() and np.abs((rate * t) @ p - targets).max() <= 0.03 * t.sum()
    # at the optimum every rate is what the residuals ask for
    g = ((rate * t) @ p - targets) / t.sum()
    assert np.abs(rate - np.maximum(0, 1 - p @ g / mixing.RIDGE)).max() < 0.05


@pytest.mark.parametrize("toxic, pure", [(0.02, 0.99), (0.05, 0.8), (0.1, 0.99)])
def test_every_feasible_target_is_met(spark, toxic, pure):
    """Each domain within 0.5 % of its own target, for nearly pure posteriors and for mixed ones."""
    r = np.random.default_rng(7)
    kind = r.choice(3, 3000, p=[0.8 - toxic, 0.2, toxic])
    t = r.integers(1, 2000, 3000)
    p = pure * np.eye(3)[kind] + (1 - pure) * r.dirichlet([0.1, 0.1, 0.1], 3000)
    rows = [(i, int(t[i]), p[i].tolist()) for i in range(3000)]
    table_ = spark.createDataFrame(rows, "doc_id long, n_tokens long, p array<double>").repartition(3)
    targets = np.array([0.93, 0.06, 0.01]) / 0.93 * (t @ p)[0] * mixing.EPOCHS
    rate = np.array([x.rate for x in mixing.fit_rates(table_, targets).orderBy("doc_id").collect()])
    assert (rate >= 0).all() and np.abs((rate * t) @ p / targets - 1).max() <= 0.005


def test_unreachable_targets_stop_at_zero(spark):
    p, t, table_ = posterior_table(spark)
    rate = np.array([r.rate for r in mixing.fit_rates(table_, np.array([t.sum(), 0.0, 0.0]) * 0.3).orderBy("doc_id").collect()])
    assert (rate >= 0).all() and rate[p[:, 1] > 0.9].mean() < rate[p[:, 0] > 0.9].mean()


def test_mixing_of_documents(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rates = mixing.mixing_rates(docs, labels).toPandas()
    assert len(rates) == docs.count() and (rates.rate >= 0).all() and (rates.copies >= np.floor(rates.rate)).all()
    mixed = mixing.mix(docs, labels)
    assert mixed.columns == docs.columns and mixed.count() == rates.copies.sum()


def test_mixing_of_awkward_rows(spark):
    docs = table(spark, awkward() + [(4, "other"), (None, "a")])
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (6, 1, 1), (7, None, 1), (None, 1, 0), (7000, 1, 0)], "doc_id long, quality int, toxic int")
    got = mixing.mixing_rates(docs, labels).collect()
    assert len(got) == 20 and {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {0}
    none = mixing.mixing_rates(docs, labels.where("false")).collect()
    assert {(r.rate, r.copies) for r in none} == {(1.0, 1)}
    assert sorted(map(str, mixing.mix(docs, labels.where("false")).collect())) == sorted(map(str, docs.collect()))
    assert mixing.mixing_rates(docs.where("false"), labels).count() == 0


def test_sample_shares_are_corrected():
    texts = pa.array(["good words here"] * 40 + ["bad stuff there"] * 40)
    m = mixing.fit(texts, ["clean"] * 40 + ["toxic"] * 40, list(range(80)), {"clean": 900, "toxic": 100})
    assert m["names"] == ["clean", "toxic"] and m["prior"].tolist() == [0.9, 0.1]


def test_long_texts_in_pieces(monkeypatch):
    import random

    r = random.Random(4)
    texts = ["".join(r.choice("abc éß\u4f60") for _ in range(n)) for n in (1000, 0, 37, 999)]
    want = [(f.tolist(), c.tolist()) for f, c in language_id._grams(texts)]
    monkeypatch.setattr(language_id, "PIECE", 100)
    assert [(f.tolist(), c.tolist()) for f, c in language_id._grams(texts)] == want
