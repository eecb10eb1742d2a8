"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

1. Document frequencies of hashed character n-grams are summed over all documents that may be
   learned from, as one vector of ``FEATURES`` numbers.
2. The weights are fitted on a sample of labelled rows of bounded size (at most ``PER_LABEL`` rows
   for each label in expectation, texts up to ``LONGEST`` characters), by follow-the-regularised-leader with
   elastic-net penalties.  A fifth of the sample is set aside to fit the temperature.
3. Every whole text is scored in its own task; nothing is shuffled.

The model (weights and document frequencies) is of fixed size and all that is broadcast.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from sightline.llm.workers import bound_batches, enter

#: Hashed n-gram features; a power of two.
FEATURES = 1 << 15
#: Lengths of the character n-grams.
ORDERS = (1, 2, 3)
#: Bounds of the sample that the weights are fitted on.
PER_LABEL, LONGEST = 1500, 20_000
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_K = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


#: Characters of a text that are hashed at once; longer ones are taken in pieces.
PIECE = 2_000_000


def _hashed(codes: np.ndarray, n: int) -> np.ndarray:
    """Feature of every n-gram, by its first character."""
    shift = np.uint32(32 - FEATURES.bit_length() + 1)
    h = np.full(max(0, len(codes) - n + 1), n, np.uint32)
    for i in range(n):
        h *= _K[0]
        h ^= codes[i : len(codes) - n + 1 + i] * _K[1]
        h ^= h >> np.uint32(15)
    return ((h * _K[2]) >> shift).astype(np.int32)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(texts: list[str]):
    """(features, counts) of each text, features ascending."""
    padded = [f" {t.lower()} " for t in texts]
    if sum(map(len, padded)) > PIECE + max(map(len, padded)):
        for t in texts:
            yield from _grams([t])
        return
    if len(padded) == 1 and len(padded[0]) > PIECE:
        c = np.zeros(FEATURES, np.int64)
        for a in range(0, len(padded[0]), PIECE):
            for n in ORDERS:  # n-grams that begin in this piece
                c += np.bincount(_hashed(_codes(padded[0][a : a + PIECE + n - 1]), n), minlength=FEATURES)
        f = np.flatnonzero(c)
        yield f, c[f]
        return
    ends = np.cumsum([len(t) for t in padded])
    codes = _codes("".join(padded))
    by_order = [_hashed(codes, n) for n in ORDERS]
    a = 0
    for b in ends.tolist():
        c = np.bincount(np.concatenate([x[a : max(a, b - n + 1)] for n, x in zip(ORDERS, by_order)]), minlength=FEATURES)
        f = np.flatnonzero(c)
        yield f, c[f]
        a = b


def _slices(column, most: int = 1_000_000):
    """Texts of a column in lists of about ``most`` characters, null as empty."""
    held, size = [], 0
    for t in column:
        t = t.as_py() or ""
        held.append(t)
        size += len(t)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _tfidf(f: np.ndarray, c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (1.0 + np.log(c)) * idf[f]
    return v / max(1e-12, math.sqrt(float(v @ v)))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """(number of texts with each feature, number of texts) over all rows of ``texts`` (one column)."""

    def run(it):
        enter("language")
        df, n = np.zeros(FEATURES, np.int64), 0
        for batch in it:
            for some in _slices(batch.column(0)):
                for f, _ in _grams(some):
                    df[f] += 1
                    n += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([0], pa.int32()), pa.array([n], pa.int64()), pa.array([zlib.compress(df.tobytes(), 1)], pa.binary())],
            names=["one", "n", "df"],
        )

    def add(t: pa.Table) -> pa.Table:
        df = sum(np.frombuffer(zlib.decompress(x), np.int64) for x in t["df"].to_pylist())
        return pa.table({"one": pa.array(t["one"].to_pylist()[:1], pa.int32()), "n": pa.array([sum(t["n"].to_pylist())], pa.int64()), "df": pa.array([zlib.compress(df.tobytes(), 1)], pa.binary())})

    bound_batches(texts.sparkSession)
    ddl = "one int, n long, df binary"
    parts = texts.mapInArrow(run, ddl)
    # first among a few hundred groups, then those sums
    some = parts.select(F.pmod(F.spark_partition_id(), F.lit(256)).alias("one"), "n", "df").groupBy("one").applyInArrow(add, ddl)
    total = some.select(F.lit(0).alias("one"), "n", "df").groupBy("one").applyInArrow(add, ddl).collect()
    if not total:
        return np.zeros(FEATURES, np.int64), 0
    return np.frombuffer(zlib.decompress(total[0]["df"]), np.int64), total[0]["n"]


class Ftrl:
    """Multinomial FTRL-proximal with elastic-net penalties (``l1``, ``l2``)."""

    def __init__(self, features: int, labels: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((features + 1, labels))  # the last row is the bias
        self.n = np.zeros((features + 1, labels))

    def weights(self, rows) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def step(self, rows: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(rows)
        g = _softmax(values @ w)
        g[label] -= 1.0
        g = values[:, None] * g[None, :]
        n = self.n[rows]
        self.z[rows] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[rows] = n + g * g


def _temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """Minimises the log loss of softmax(logits / T) by golden-section search over log T."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        x = logits / math.exp(log_t)
        x = x - x.max(1, keepdims=True)
        return float((np.log(np.exp(x).sum(1)) - x[np.arange(len(labels)), labels]).mean())

    a, b, r = -3.0, 3.0, (math.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return math.exp((a + b) / 2)


def fit_rows(rows: list[tuple[str, str, int]], idf: np.ndarray, epochs: int = 4) -> dict | None:
    """Model from (text, label, hash) rows; the hash sets the order and the calibration part."""
    rows = sorted(rows, key=lambda r: (r[2], r[1], r[0]))
    labels = sorted({r[1] for r in rows})
    if not labels:
        return None
    grams = list(_grams([r[0] for r in rows]))
    x = [(np.append(f, FEATURES), np.append(_tfidf(f, c, idf), 0.1)) for f, c in grams]
    y = [labels.index(r[1]) for r in rows]
    aside = [i for i in range(len(rows)) if i % 5 == 4]
    fit = [i for i in range(len(rows)) if i % 5 != 4]
    m = Ftrl(FEATURES, len(labels))
    for e in range(epochs):
        for i in np.random.default_rng(e).permutation(fit):
            m.step(*x[i], y[i])
    w = m.weights(np.arange(FEATURES + 1))
    logits = np.array([v @ w[f] for f, v in (x[i] for i in aside)]).reshape(len(aside), len(labels))
    t = _temperature(logits, np.array([y[i] for i in aside], int))
    return {"labels": labels, "weights": w.astype(np.float32), "idf": idf.astype(np.float32), "temperature": t}


def train(learnable: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict | None:
    """Model from all rows of ``learnable``; rows without text or label teach nothing.

    None if there is no labelled row.
    """
    rows = learnable.select(
        F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l"), F.xxhash64(F.col(id_col)).alias("h")
    ).where("t is not null and l is not null")
    df, n = document_frequencies(rows.select("t"))
    idf = np.log((n + 1) / (df + 1)) + 1
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}  # one for each label
    if not counts:
        return None
    unit = 1 << 30
    share = F.create_map(*[F.lit(x) for k, v in counts.items() for x in (k, min(unit, unit * PER_LABEL // v))])
    sample = rows.where((F.pmod("h", F.lit(unit)) < F.element_at(share, F.col("l"))) & (F.length("t") <= LONGEST))

    def fit(it):
        held = [r for b in it for r in zip(*(c.to_pylist() for c in b.columns))]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit_rows(held, idf))], pa.binary())], names=["model"])

    got = sample.repartition(1).mapInArrow(fit, "model binary").collect()  # one row of fixed size
    return pickle.loads(got[0]["model"]) if got else None


def predict(
    docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, str] | None = None
) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row.  ``und`` with score 0 if the text is null or has
    no letter, or if there is no model; else the likeliest label and its calibrated probability.

    ``keep``: names of two new columns for label and score beside all columns of ``docs``, in place of that.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    bound_batches(docs.sparkSession)
    names = list(keep or ("lang_pred", "score"))

    def run(it):
        enter("language")
        m = shared.value
        for batch in it:
            at = 0
            for some in _slices(batch.column(text_col if keep else "t")):
                lang, score = [UNKNOWN] * len(some), [0.0] * len(some)
                todo = [i for i, t in enumerate(some) if m is not None and _LETTER.search(t)]
                for i, (f, c) in zip(todo, _grams([some[i] for i in todo])):
                    w = m["weights"]
                    p = _softmax((_tfidf(f, c, m["idf"]) @ w[f] + 0.1 * w[-1]) / m["temperature"])
                    k = int(p.argmax())
                    lang[i], score[i] = m["labels"][k], float(p[k])
                columns = batch.slice(at, len(some)).columns if keep else [batch.column(0).slice(at, len(some))]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                    names=[*(batch.schema.names if keep else ["doc_id"]), *names],
                )
                at += len(some)

    if keep:
        schema = StructType([*docs.schema.fields, StructField(keep[0], StringType()), StructField(keep[1], DoubleType())])
        return docs.mapInArrow(run, schema)
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    return picked.mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row for each document row: ``doc_id, held_out, lang_pred, score``; learned from the rows
    that are not held out.  A null id is not held out.

    Texts that are null or have no letter, empty ones among them, are ``und`` with score 0; of equally
    likely labels the first in order is taken.  Repeated rows each keep theirs and, if learnable, count
    each in the document frequencies.  A very long text is read whole, in pieces whose counts are added.
    An empty table gives no rows; without any label to learn all are ``und``.  Other columns than the
    three named are not looked at.
    """
    model = train(docs.where(~held_out(F.col(id_col))), id_col, text_col, lang_col)
    out = predict(docs, model, id_col, text_col)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    return language_id(spark.read.parquet(f"{sf_dir}/documents.parquet"))
