"""Toxicity: the kernel against a plain one, held-out accuracy, gapped insults, awkward rows."""

import numpy as np
import pyarrow as pa
import pytest
from helpers import awkward, table
from pyspark.sql import functions as F

from sightline.llm import toxicity
from sightline.llm.wordhash import column

WORDS = "the and of river stone window paper garden music letter table morning winter summer yellow purple travel".split()
BAD = ["blorgface", "snarfling", "grobnik"]


def symbols(word):
    return bytes(toxicity._TABLE[[ord(c) for c in word]])


def subsequences(s):
    """By brute force: every three letters over at most five slots, with their weight."""
    out, own = {}, 0.0
    for i in range(len(s)):
        for j in range(i + 1, len(s)):
            for k in range(j + 1, len(s)):
                skipped = k - i - 2
                if skipped <= toxicity.SKIPPED and s[i] and s[j] and s[k]:
                    key = (s[i], s[j], s[k])
                    out[key] = out.get(key, 0) + toxicity.GAP**skipped
                    own += toxicity.GAP ** (2 * skipped)
    return out, own


def test_kernel():
    strings = [symbols(w) for w in ("idiot", "idiots", "banana", "aaaaaaa", "at", "übergröße")] + [b"\1\0\2\0\3", b""]
    for i, a in enumerate(strings):
        for j, b in enumerate(strings):
            x, n = subsequences(a)
            y, m = subsequences(b)
            want = sum(v * y.get(k, 0) for k, v in x.items()) / np.sqrt(max(n, 1e-9) * max(m, 1e-9))
            assert toxicity.kernel([a], [b])[0, 0] == pytest.approx(want), (i, j)


def test_sums_are_the_kernel_and_passages_stand():
    texts = ["You are an idiot, o k?", "i d i o t", None, "", "...", "x", "don't id-iot", "ab" * 40, "last word"]
    p = toxicity.Passages(*column(pa.array(texts, pa.string())), sentences=True)
    inv = {int(v): chr(i) for i, v in reversed(list(enumerate(toxicity._TABLE))) if 0 < v < toxicity._SIDE}
    names = ["".join(inv.get(c, "_").lower() for c in p.string(i)) for i in range(len(p.first))]
    of = [{n for n, t in zip(names, p.text) if t == k} for k in range(len(texts))]
    assert {"you", "are", "an", "idiot", "o", "k", "idiot_o", "o_k"} <= of[0] and "you_are" not in of[0]
    assert "i_d_i_o_t" in of[1] and of[2] == of[3] == of[4] == set() and of[5] == {"x"} and "id_iot" in of[6]
    assert of[7] == {"ab" * 40} and of[8] == {"last", "word"}
    rng = np.random.default_rng(0)
    marks = [symbols("idiot"), symbols("window"), symbols("abab")]
    alpha = rng.normal(size=3)
    weight = np.zeros(toxicity._SIDE**3)
    r, c, v = toxicity._features(marks)
    np.add.at(weight, c, alpha[r] * v)
    want = toxicity.kernel([p.string(i) for i in range(len(p.first))], marks) @ alpha
    assert np.allclose(p.sums(weight.astype(np.float32)), want, atol=1e-4)


def corpus(n=400):
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = [str(w) for w in rng.choice(WORDS, 40)]
        if toxic:
            words.insert(int(rng.integers(40)), BAD[i // 4 % 3])
        words.insert(20, f"again{i}.")
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_and_gapped_insults(spark):
    rows, labels = corpus()
    # labels of held-out rows are lies: nothing may be learned from them
    out = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    lied = out.withColumn("toxic", F.when(toxicity.learnable(F.col("doc_id")), F.col("toxic")).otherwise(1 - F.col("toxic")))
    more = [(1000, "the s n a r f l i n g river"), (1001, "the blorg-face stone"), (1002, "winter blorgfface summer"), (1003, "garden grobniks"), (1004, "the river and the garden")]
    got = {r.doc_id: r for r in toxicity.toxicity(table(spark, rows + more), lied).collect()}
    truth = {i: t for i, _, t in labels}
    held = [i for i in truth if got[i].held_out]
    assert 80 < len(held) < 200 and all(got[i].predicted == truth[i] for i in held)
    assert all(got[i].score > got[1004].score + 0.1 for i in range(1000, 1004)) and all(got[i].predicted == 1 for i in (1001, 1002, 1003)) and got[1004].predicted == 0


def test_stand_in_table(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    df = toxicity.op12_toxicity(spark, sf_dir)
    assert df.columns == ["doc_id", "held_out", "score", "predicted"] and dict(df.dtypes)["predicted"] == "int"
    got = df.join(labels, "doc_id").join(docs, "doc_id").toPandas()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    clean = got[(got.toxic == 0)]
    assert clean.predicted.mean() < 0.02


def test_awkward_rows(spark):
    rows, labels = corpus()
    labels += [(0, 1, 0), (None, 0, 1), (3, None, None)]
    rows += [(2000 + i if i else None, t) for i, t in awkward()] + [(2500, "!!! 12 a b"), (2500, "!!! 12 a b"), (None, "grobnik"), (2600, "river " * 400_000 + "grobnik")]
    got = toxicity.toxicity(table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[2001].score == by[2002].score == by[2003].score and by[2001].predicted == 0 and by[2600].predicted == 1
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    assert toxicity.toxicity(table(spark, rows).where("false"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0
    none = toxicity.toxicity(table(spark, rows[:5]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").where("toxic = 0"))
    assert [r.score for r in none.collect()] == [0.0] * 5
