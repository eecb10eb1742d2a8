"""Mixing with soft membership: document rates whose expected domain token totals match targets.

1. A classifier is fitted on a bounded sample of the labelled table (at most ``PER_DOMAIN`` documents
   of each domain in expectation, of at most ``LONGEST`` characters) and gives every document a
   posterior over domains.
2. Rates start at 1 and minimise half the squared distance of the expected domain token totals from
   their targets (as shares of all tokens), plus a ridge / 2 times the token-weighted mean square of
   the rates' change; no rate is negative.  Steps are projected gradient steps scaled by the second
   moments of the documents whose rate isn't zero.  The ridge falls from ``SOFT`` to ``RIDGE``, at
   which feasible targets are met.  If they are not met within ``MET``, no rates near 1 can give
   them, and the rates of ``SOFT`` hold, which approach them without a few documents taking
   all of the mix.  A step needs totals over all documents, which the tasks sum; only those few
   numbers pass through the driver.  Posteriors stay in a stored table.
3. A rate is turned into whole copies by a hash of the document, so that the expected number of
   copies is the rate.
"""

from __future__ import annotations

import pickle
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.language_id import Ftrl, _softmax, _temperature
from sightline.llm.wordhash import Words, column, slices
from sightline.llm.workers import bound_batches, enter
from sightline.sources.work import cut

#: Bounds of the sample that the classifier is fitted on.
PER_DOMAIN, LONGEST = 2000, 50_000
#: Hashed word features; 256 byte features and one for repetition come on top.
WORDS = 1 << 16
SOFT, RIDGE = 5e-3, 1e-8
#: Steps for each ridge, gradient (share of all tokens) at which they end, step sizes tried in each.
STEPS, TOLERANCE, SIZES = 40, 1e-11, tuple(0.25**i for i in range(10))
#: Relative distance from its target at which a domain's total counts as met.
MET = 5e-3
#: Share of the tokens that each domain gets.
TARGETS = {"clean": 0.93, "low": 0.06, "toxic": 0.01}
#: Expected clean tokens in the mix, over those in the corpus.
EPOCHS = 1.02
#: Value of the constant feature.
BIAS = 0.1
_SOLID = np.array([chr(b).isalnum() or b >= 128 for b in range(256)])


def domain_of(quality: Column, toxic: Column) -> Column:
    """``toxic``, else ``clean`` or ``low`` by quality; null without both labels."""
    return F.when(quality.isNull() | toxic.isNull(), None).when(toxic == 1, "toxic").when(quality == 1, "clean").otherwise("low")


def _features(data: np.ndarray, offsets: np.ndarray):
    """(features, values, words) of each text."""
    for i, j in slices(offsets, 2_000_000):
        w = Words(data, offsets[i : j + 1], True, _SOLID)
        index = (w.hash >> np.uint64(48)).astype(np.int64)
        for k in range(j - i):
            f, c = np.unique(index[w.first[k] : w.first[k + 1]], return_counts=True)
            raw = w.data[w.offsets[k] : w.offsets[k + 1]]
            b = np.bincount(raw, minlength=256)
            used = np.flatnonzero(b)
            v = 1.0 + np.log(c)
            v /= max(4.0, np.sqrt(v @ v))
            style = np.log1p(1000.0 * b[used] / max(1, len(raw))) * 0.15
            n = int(c.sum())
            rows = np.concatenate([f, WORDS + used, [WORDS + 256, WORDS + 257]])
            yield rows, np.concatenate([v, style, [0.3 * np.log(max(1, n) / max(1, len(f))), BIAS]]), n


def fit(texts: pa.Array, labels: list[str], order: list[int], counts: dict[str, int], epochs: int = 8) -> dict | None:
    """Classifier from texts and their domains; ``order`` (hashes) fixes the order of the steps.

    ``counts``: labelled documents of each domain; the sample's own shares are corrected to theirs.
    """
    names = sorted(set(labels))
    if not names:
        return None
    x = [(f, v) for f, v, _ in _features(*column(texts))]
    rows = sorted(range(len(x)), key=lambda i: (order[i], labels[i]))
    aside = [r for i, r in enumerate(rows) if i % 5 == 4]
    use = [r for i, r in enumerate(rows) if i % 5 != 4]
    m = Ftrl(WORDS + 257, len(names), alpha=1.0, l1=0.6, l2=0.05)
    y = [names.index(d) for d in labels]
    for e in range(epochs):
        for i in np.random.default_rng(e).permutation(use):
            m.step(*x[i], y[i])
    w = m.weights(np.arange(WORDS + 258))
    logits = np.array([x[i][1] @ w[x[i][0]] for i in aside]).reshape(len(aside), len(names))
    t = _temperature(logits, np.array([y[i] for i in aside], int))
    w = w / t
    prior = np.array([counts[n] for n in names], float) / sum(counts[n] for n in names)
    w[-1] += np.log(prior * len(y) / np.bincount(y, minlength=len(names))) / BIAS
    return {"names": names, "weights": w.astype(np.float32), "prior": prior}


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> dict | None:
    """Classifier of the domains of ``labels`` (``doc_id, quality, toxic``); None without any row."""
    known = labels.select(
        F.col("doc_id").cast("long").alias("__id"), domain_of(F.col("quality"), F.col("toxic")).alias("domain")
    ).where("__id is not null and domain is not null")
    counts = {r["domain"]: r["n"] for r in known.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    unit = 1 << 30
    share = F.create_map(*[F.lit(x) for k, v in counts.items() for x in (k, min(unit, unit * PER_DOMAIN // v))])
    picked = known.where(F.pmod(F.xxhash64("__id"), F.lit(unit)) < F.element_at(share, F.col("domain")))
    sample = (
        docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("t"))
        .where(F.length("t") <= LONGEST)
        .join(F.broadcast(picked), "__id")  # a few thousand ids, by the sample's bound
        .select("t", "domain", F.xxhash64("__id", "t").alias("h"))
    )

    def run(it):
        held = list(it)
        texts, domains, order = (pa.chunked_array([b.column(i) for b in held], kind).combine_chunks() for i, kind in enumerate((pa.string(), pa.string(), pa.int64())))
        model = fit(texts, domains.to_pylist(), order.to_pylist(), counts)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    got = sample.repartition(1).mapInArrow(run, "model binary").collect()  # one row of fixed size
    return pickle.loads(got[0]["model"]) if got else None


def posteriors(docs: DataFrame, model: dict, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n_tokens, p`` (posterior of each domain, in the model's order) for every row, and
    ``x``, which tells apart rows of one id.  Texts without words get the priors."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.float64())

    def run(it):
        enter("mixing")
        m = shared.value
        w = m["weights"]
        for batch in it:
            n, p = [], []
            for f, v, words in _features(*column(batch.column(2))):
                n.append(words)
                p.append(_softmax((v @ w[f]).astype(float)) if words else m["prior"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array([x.tolist() for x in p], kind)],
                names=["doc_id", "x", "n_tokens", "p"],
            )

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("x"),
        F.col(text_col).alias("t"),
    )
    return rows.mapInArrow(run, "doc_id long, x long, n_tokens long, p array<double>")


def _arrays(batch, names: list[str], k: int):
    p = batch.column("p").flatten().to_numpy().reshape(-1, k)
    return [batch.column(n).to_numpy(zero_copy_only=False) for n in names] + [p]


def _sums(table: DataFrame, size: int, of) -> np.ndarray:
    """Sum over all rows of ``of(batch)``, vectors of ``size`` numbers."""

    def run(it):
        total = np.zeros(size)
        for batch in it:
            total += of(batch)
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total)], names=["i", "v"])

    out = np.zeros(size)
    for r in table.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r["i"]] = r["v"]
    return out


def _moments(table: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(expected tokens of each domain, token-weighted second moments of the posteriors)"""

    def of(batch):
        t, p = _arrays(batch, ["n_tokens"], k)
        return np.concatenate([t @ p, ((p * t[:, None]).T @ p).ravel()])

    got = _sums(table.select("n_tokens", "p"), k + k * k, of)
    return got[:k], got[k:].reshape(k, k)


def _tried(table: DataFrame, pulls: list[np.ndarray]) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """For the rates ``max(0, 1 - p @ pull)`` of each pull: half the token-weighted sum of their
    squares, expected tokens of each domain, second moments of the posteriors where they aren't 0."""
    k = len(pulls[0])
    size = 1 + k + k * k

    def of(batch):
        t, p = _arrays(batch, ["n_tokens"], k)
        out = []
        for pull in pulls:
            rate = np.maximum(0.0, 1.0 - p @ pull)
            held = p[rate > 0]
            out += [[t @ rate**2 / 2], (rate * t) @ p, ((held * t[rate > 0][:, None]).T @ held).ravel()]
        return np.concatenate(out)

    got = _sums(table.select("n_tokens", "p"), size * len(pulls), of).reshape(len(pulls), size)
    return [(float(x[0]), x[1 : 1 + k], x[1 + k :].reshape(k, k)) for x in got]


def fit_rates(table: DataFrame, targets: np.ndarray) -> DataFrame:
    """``table`` (``n_tokens, p`` and other columns) with ``rate``, nonnegative, for which the sums of
    ``rate * n_tokens * p`` meet ``targets`` with rates as near 1 as can be, or, if no rates meet
    them, come as close as rates near 1 can."""
    k = len(targets)
    tokens = max(1.0, float(_moments(table, k)[0].sum()))
    want = np.asarray(targets, float) / tokens

    def solve(ridge: float, pull: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pull of each domain on the rates, its expected tokens as shares of all)

        At the optimum the pulls are the distances from the targets over the ridge: the rates'
        optimum has its dual in these few numbers, with a convex piecewise quadratic to minimise."""

        def state(pull, got):
            square, have, second = got[0] / tokens, got[1] / tokens, got[2] / tokens
            slope = want + ridge * pull - have
            return square + pull @ want + ridge / 2 * pull @ pull, slope, pull, have, second

        best = state(pull, _tried(table, [pull])[0])
        for _ in range(STEPS):
            value, slope, pull, have, second = best
            if np.abs(slope).max() <= TOLERANCE:
                break
            step = np.linalg.solve(second + ridge * np.eye(k), slope)
            pulls = [pull - size * step for size in SIZES]
            best = min(map(state, pulls, _tried(table, pulls)), key=lambda x: (x[0], np.abs(x[1]).max()))
            if best[0] >= value - 1e-15 and np.abs(best[1]).max() >= np.abs(slope).max() / 2:  # as exact as sums of floats are
                best = (value, slope, pull, have, second)
                break
        return best[2], best[3]

    pull = soft = solve(SOFT, np.zeros(k))[0]
    for ridge in np.geomspace(SOFT, RIDGE, 5)[1:]:
        pull, have = solve(float(ridge), pull)
    if (np.abs(have - want) > MET * np.maximum(want, MET)).any():
        pull = soft
    drawn = sum((F.get("p", F.lit(d)) * F.lit(float(x)) for d, x in enumerate(pull)), F.lit(0.0))
    return table.withColumn("rate", F.greatest(F.lit(0.0), F.lit(1.0) - drawn))


def mixing_rates(
    docs: DataFrame,
    labels: DataFrame,
    weights: dict[str, float] | None = None,
    epochs: float = EPOCHS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row for each document row: ``doc_id, x, n_tokens``, ``posterior`` (map from domain),
    ``rate`` and ``copies`` (whole copies in the mix).

    ``weights``: share of the mix's tokens for each domain; the mix is as large as it takes for the
    heaviest domain to keep ``epochs`` times its expected tokens.  Tokens are words here.  Null texts
    have no tokens and the prior as posterior.  Without labels, or for domains that no label names,
    nothing is learned: every rate is 1.  Repeated rows are rated alike; an empty table gives no rows.  A very long text is read
    whole; only the classifier's sample leaves it out.  Ties between domains do not matter, as posteriors
    are not rounded.  Other columns are not looked at.
    """
    weights = weights or TARGETS
    model = train(docs, labels, id_col, text_col)
    names = model["names"] if model else ["all"]
    if model is None:
        model = {"names": names, "weights": np.zeros((WORDS + 258, 1), np.float32), "prior": np.ones(1)}
    table = cut(posteriors(docs, model, id_col, text_col), "posteriors")
    share = np.array([weights.get(n, 0.0) for n in names])
    if share.sum() > 0:
        have, _ = _moments(table, len(names))
        top = int(share.argmax())
        table = fit_rates(table, share / share[top] * have[top] * epochs)
    else:
        table = table.withColumn("rate", F.lit(1.0))
    unit = 1 << 30
    chance = F.pmod(F.xxhash64("doc_id", "x", F.lit(7)), F.lit(unit)) / F.lit(float(unit))
    copies = F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("long")
    posterior = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.col("p"))
    return table.select("doc_id", "x", "n_tokens", posterior.alias("posterior"), "rate", copies.alias("copies"))


def mix(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as its copies say, with the columns of ``docs``."""
    id_col, text_col = kw.get("id_col", "doc_id"), kw.get("text_col", "text")
    rates = mixing_rates(docs, labels, **kw).where("copies > 0").select("doc_id", "x", "copies").distinct()
    same = docs[id_col].cast("long").eqNullSafe(rates["doc_id"]) & (
        F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == rates["x"]
    )
    number = f"copy_{uuid.uuid4().hex}"  # no column of the input has this name
    copies = F.explode(F.sequence(F.lit(1).cast("long"), rates["copies"])).alias(number)
    return docs.join(rates, same).select(*[docs[c] for c in docs.columns], copies).drop(number)


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    rates = mixing_rates(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    )
    p = lambda n: F.coalesce(F.element_at("posterior", F.lit(n)), F.lit(0.0)).alias(f"p_{n}")
    return rates.select("doc_id", "n_tokens", *map(p, TARGETS), "rate", "copies")
