"""Toxicity: a support vector machine with a gapped subsequence kernel and Nyström landmarks.

1. A text is a row of letters (a-z, those of Latin-1, 5 for all others), in which a run of anything else is one slot
   without a letter.  Sentences end at ``.!?`` and line feeds.
2. An example is a passage: one word, or words that follow each other, without blanks or beside a single letter, with
   at most ``JOINED`` letters together, so that ``id-iot`` and ``i d i o t`` are passages too.  Its features are all subsequences of three letters over at most five slots,
   each weighted by ``GAP`` for a skipped slot: 63 ** 3 of them, exact and without hashing.  The kernel is their
   product, over the weight of all subsequences of both passages.
3. Labelled sentences bear their document's label; copies of a sentence count once.  Of a toxic sentence only the
   passage that speaks most for it is an example, and none if nothing does; others give their worst and an arbitrary
   passage.  First passages are judged by how often they are found in toxic sentences, then by the machine itself
   (``ROUNDS``).
4. ``LANDMARKS`` passages span the kernel's feature space (Nyström); a linear machine is fitted in it.  As the
   kernel's features are explicit, its sum over landmarks is one table of 63 ** 3 weights, and a passage is judged by
   adding them up: whole texts are scanned once, whatever the number of landmarks.
5. A document has the value of its worst passage; a logistic curve fitted on documents set aside makes it a score.

The model is fitted in one task, on a sample of at most ``PER_LABEL`` documents a label; it is of fixed size and all
that is broadcast.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.wordhash import column, slices
from sightline.llm.workers import bound_batches, enter

#: Weight of a skipped slot, slots skipped at most, letters of joined words.
GAP, SKIPPED, JOINED = 0.6, 2, 12
#: Bounds of the sample: documents of each label in expectation, bytes of a text.
PER_LABEL, LONGEST = 1500, 20_000
LANDMARKS, ROUNDS, COST, EXAMPLES, ODDS = 512, 3, 10.0, 4000, 9.0
#: From this score on a document is toxic.
TOXIC = 0.7
#: Bytes of texts that are looked at together.
SLICE = 1_000_000
_BITS = 6
_SIDE = 1 << _BITS
_STEPS = [(a, b) for a in range(SKIPPED + 1) for b in range(SKIPPED + 1 - a)]


def _letters() -> np.ndarray:
    """Symbol of each code point below 0x250: 1 and more for the lower-case letters up to 0xFF and their upper-case
    ones, the last 5 for further letters, 0 for no letter, ``_SIDE`` for the end of a sentence."""
    out = np.zeros(0x250, np.uint8)
    known: dict[str, int] = {}
    for c in range(len(out)):
        if chr(c).isalpha():
            low = chr(c).lower()
            if len(low) == 1 and ord(low) < 0x100:
                out[c] = min(known.setdefault(low, len(known) + 1), _SIDE - 6)
            else:
                out[c] = _SIDE - 5 + c % 5
    for c in b".!?\n\r":
        out[c] = _SIDE
    return out


_TABLE = _letters()


class Passages:
    """Passages of many texts: slots ``first`` to ``last`` - 1 of ``slots``; ``text`` and ``sentence`` of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, sentences: bool = False):
        raw = data[offsets[0] : offsets[-1]].tobytes().decode("utf-8", "replace")
        code = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), np.uint32)
        # texts begin at these code points
        lead = np.concatenate([[0], np.cumsum((data[offsets[0] : offsets[-1]] & 0xC0) != 0x80)])
        begin = lead[offsets - offsets[0]]
        s = np.where(code < len(_TABLE), _TABLE[np.minimum(code, len(_TABLE) - 1)], 0)
        far = np.flatnonzero(code >= len(_TABLE))
        if len(far):
            kinds, back = np.unique(code[far], return_inverse=True)
            s[far] = np.array([_SIDE - 5 + int(c) % 5 if chr(c).isalpha() else 0 for c in kinds], np.uint8)[back]
        text = np.zeros(len(s), np.int32)
        np.add.at(text, begin[1:-1][begin[1:-1] < len(s)], 1)
        text = np.cumsum(text)
        stop = s == _SIDE
        solid = (s > 0) & ~stop
        new = np.ones(len(s), bool)
        new[1:] = text[1:] != text[:-1]
        # one slot for each run without letters; a text's last such run does not join the next text's first
        keep = solid.copy()
        keep[1:] |= ~solid[1:] & (solid[:-1] | new[1:])
        if len(keep):
            keep[0] = True
        run = np.cumsum(keep) - 1
        at = np.flatnonzero(keep)
        slots = np.where(solid[at], s[at], 0).astype(np.int64)
        ended = np.zeros(len(at), bool)
        ended[run[stop]] = True
        blank = np.zeros(len(at), bool)
        blank[run[(code == 32) | ((code >= 9) & (code <= 13)) | (code == 0xA0)]] = True
        self.texts = len(offsets) - 1
        of = text[at]
        # a text that begins with a letter has no slot before it: put one
        joint = np.flatnonzero((slots[1:] > 0) & (slots[:-1] > 0) & (of[1:] != of[:-1])) + 1
        slots, of, ended, blank = np.insert(slots, joint, 0), np.insert(of, joint, of[joint]), np.insert(ended, joint, True), np.insert(blank, joint, True)
        self.slots = slots
        full = slots > 0
        edge = np.diff(np.concatenate([[False], full, [False]]).astype(np.int8))
        a, z = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.words = len(a)
        word_text = of[a] if len(a) else np.zeros(0, np.int64)
        breaks = np.cumsum(ended | np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
        size = np.concatenate([[0], np.cumsum(z - a)])
        first, last, which = [a], [z], [np.arange(len(a))]
        # words apart by blanks are joined only if one of them is a single letter
        single = z - a == 1
        apart = np.cumsum(np.concatenate([[0], blank[z[:-1]] & ~single[:-1] & ~single[1:]])) if len(a) else a
        i = np.arange(len(a))
        for more in range(1, JOINED):
            i = i[i + more < len(a)]
            i = i[(size[i + more + 1] - size[i] <= JOINED) & (apart[i] == apart[i + more]) & (word_text[i] == word_text[i + more])]
            if not len(i):
                break
            first.append(a[i])
            last.append(z[i + more])
            which.append(i)
        self.first, self.last = np.concatenate(first), np.concatenate(last)
        which = np.concatenate(which)
        self.text = word_text[which]
        self.sentence = breaks[a][which] if sentences else None

    def sums(self, weight: np.ndarray) -> np.ndarray:
        """For each passage, ``weight`` (by subsequence; 0 where a letter is missing) of its subsequences, over the
        square root of their own weight."""
        s = self.slots.astype(np.int32)
        high, middle, solid = s << 2 * _BITS, s << _BITS, (s > 0).astype(np.uint8)
        total, own = np.zeros(len(self.first)), np.zeros(len(self.first))
        for skipped in range(SKIPPED + 1):
            n = len(s) - skipped - 2
            if n <= 0:
                break
            value, mass = np.zeros(n, np.float32), np.zeros(n, np.uint8)
            z = slice(2 + skipped, 2 + skipped + n)
            for a in range(skipped + 1):
                y = slice(1 + a, 1 + a + n)
                value += weight[high[:n] | middle[y] | s[z]]
                mass += solid[:n] & solid[y] & solid[z]
            value = np.concatenate([[0.0], np.cumsum(value, dtype=np.float64)])
            mass = np.concatenate([[0], np.cumsum(mass, dtype=np.int64)])
            start = np.minimum(self.first, n)
            end = np.minimum(np.maximum(self.last - skipped - 2, self.first), n)
            total += GAP**skipped * (value[end] - value[start])
            own += GAP ** (2 * skipped) * (mass[end] - mass[start])
        return total / np.sqrt(np.maximum(own, 1e-9))

    def string(self, i: int) -> bytes:
        return self.slots[self.first[i] : self.last[i]].astype(np.uint8).tobytes()


def _features(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, subsequence, value) of the kernel's features of some passages."""
    rows, cols, values = [], [], []
    for r, text in enumerate(strings):
        s, own, got = np.frombuffer(text, np.uint8).astype(np.int64), 0.0, {}
        for a, b in _STEPS:
            for i in range(len(s) - a - b - 2):
                x, y, z = s[i], s[i + 1 + a], s[i + 2 + a + b]
                if x and y and z:
                    key = int((x << 2 * _BITS) | (y << _BITS) | z)
                    got[key] = got.get(key, 0.0) + GAP ** (a + b)
                    own += GAP ** (2 * (a + b))
        rows += [r] * len(got)
        cols += got
        values += [v / math.sqrt(own) for v in got.values()]
    return np.array(rows, np.int64), np.array(cols, np.int64), np.array(values, float)


def kernel(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Values of the kernel between passages."""
    r, c, v = _features(right)
    known, c = np.unique(c, return_inverse=True)
    dense = np.zeros((len(known) + 1, len(right)))  # the last row is of features that no passage at the right has
    dense[c, r] = v
    out = np.zeros((len(left), len(right)))
    r, c, v = _features(left)
    at = np.minimum(np.searchsorted(known, c), max(0, len(known) - 1))
    c = np.where(known[at] == c, at, len(known)) if len(known) else np.zeros(len(c), np.int64)
    cut_at = np.searchsorted(r, np.arange(len(left) + 1))
    for i, (a, z) in enumerate(zip(cut_at.tolist(), cut_at[1:].tolist())):
        out[i] = v[a:z] @ dense[c[a:z]]
    return out


def svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int = 30, seed: int = 0) -> np.ndarray:
    """Weights of a linear machine with hinge loss, by coordinate ascent in its dual."""
    w, alpha, square = np.zeros(x.shape[1]), np.zeros(len(x)), (x * x).sum(1)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(x)):
            if square[i] > 0:
                a = min(max(alpha[i] - (y[i] * (w @ x[i]) - 1) / square[i], 0.0), cost[i])
                if a != alpha[i]:
                    w += (a - alpha[i]) * y[i] * x[i]
                    moved = max(moved, abs(a - alpha[i]))
                    alpha[i] = a
        if moved < 1e-3:
            break
    return w


def _logistic(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the curve 1 / (1 + exp(-(a f + b))) of largest likelihood, by Newton's method; targets are
    pulled in so that separable data have one."""
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0

    def loss(a, b):
        z = a * f + b
        return float((np.logaddexp(0, z) - t * z).sum())

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * f + b, -40, 40)))
        g = np.array([((p - t) * f).sum(), (p - t).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * f * f).sum() + 1e-6, (v * f).sum()], [(v * f).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        size = 1.0
        while size > 1e-6 and loss(a - size * step[0], b - size * step[1]) > loss(a, b):
            size /= 2
        a, b = a - size * step[0], b - size * step[1]
        if abs(size * step).max() < 1e-9:
            break
    return float(max(a, 0.0)), float(b)


class _Sample:
    """Distinct passages of labelled sentences: ``name`` of each passage (into ``strings``), its ``sentence`` and
    that one's ``label``.  Sentences with the same passages count once, so that copies teach nothing twice."""

    def __init__(self, p: Passages, label: np.ndarray):
        names: dict[bytes, int] = {}
        name = np.array([names.setdefault(p.string(i), len(names)) for i in range(len(p.first))], np.int64)
        order = np.lexsort((name, p.sentence))
        name, sentence, text = name[order], p.sentence[order], p.text[order]
        starts = np.flatnonzero(np.concatenate([[True], sentence[1:] != sentence[:-1]]))
        seen: dict[bytes, int] = {}
        keep = np.zeros(len(name), bool)
        for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(name)]):
            x = name[a:z].tobytes()
            if x not in seen:  # of copies with both labels the first counts
                seen[x] = a
                keep[a:z] = True
        self.strings, self.order = list(names), order[keep]
        self.name, self.sentence, self.label = name[keep], sentence[keep], label[text[keep]]

    @staticmethod
    def _distinct(names: np.ndarray, without: np.ndarray) -> np.ndarray:
        """Each name once, in the order of first places, without some."""
        x, first = np.unique(names, return_index=True)
        x = names[np.sort(first)]
        return x[~np.isin(x, without)]

    def first_values(self) -> np.ndarray:
        """How much each passage speaks for toxicity by the sentences it is found in: the number of toxic ones over
        what chance gives, in standard deviations, less 4.  Sets ``mostly``: passages by name whose odds are ``ODDS``
        times those of all sentences; only they can be examples of toxicity."""
        pair = np.unique(np.stack([self.name, self.sentence, self.label]), axis=1)
        n = np.bincount(pair[0], minlength=len(self.strings))
        toxic = np.bincount(pair[0], pair[2], minlength=len(self.strings))
        share = np.unique(pair[1:], axis=1)[1].mean()
        self.mostly = toxic * (1 - share) > ODDS * (n - toxic) * share
        return ((toxic - n * share) / np.sqrt(n * share * (1 - share) + 1) - 4)[self.name]

    def examples(self, value: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Passages, their labels and in how many sentences they were chosen."""
        rng = np.random.default_rng(seed)
        order = np.lexsort((rng.permutation(len(value)), -value, self.sentence))
        sentence = self.sentence[order]
        worst = order[np.concatenate([[True], sentence[1:] != sentence[:-1]])]
        toxic = self.label == 1
        can = toxic & self.mostly[self.name] & (value > 0)
        up = np.where(can, value, -np.inf)
        order = np.lexsort((rng.permutation(len(up)), -up, self.sentence))
        up = order[np.concatenate([[True], sentence[1:] != sentence[:-1]])]
        yes, times = np.unique(self.name[up[can[up]]], return_counts=True)
        # most often chosen first
        pick = np.lexsort((rng.permutation(len(yes)), -times))[:EXAMPLES]
        down = self.name[worst[~toxic[worst]]]
        worst_down = worst[~toxic[worst]]
        hard = self.name[worst_down[np.argsort(-value[worst_down], kind="stable")[: 2 * EXAMPLES]]]
        other = self.name[rng.permutation(np.flatnonzero(~toxic))[: len(down)]]
        no = np.concatenate([self._distinct(hard, yes)[: EXAMPLES // 2], rng.permutation(self._distinct(np.concatenate([down, other]), yes))[:EXAMPLES]])
        no = np.unique(no)
        return np.concatenate([yes[pick], no]), np.repeat([1.0, -1.0], [len(pick), len(no)]), np.concatenate([times[pick], np.ones(len(no), int)])


def _landmarks(names: np.ndarray, y: np.ndarray, seed: int) -> np.ndarray:
    """A quarter is the most frequent toxic passages, a quarter others of them, the rest of the other label."""
    rng = np.random.default_rng(seed)
    yes, no = names[y > 0], names[y < 0]
    a = np.concatenate([yes[: LANDMARKS // 4], rng.permutation(yes[LANDMARKS // 4 :])[: LANDMARKS // 4]])
    return np.concatenate([a, rng.permutation(no)[: LANDMARKS - len(a)]])


def fit(texts: pa.Array, label: np.ndarray) -> dict | None:
    """Model from texts and labels; every fifth row is set aside for the curve.  None unless both labels are there."""
    label = np.asarray(label)
    aside = np.arange(len(label)) % 5 == 4
    data, offsets = column(texts)

    def part(pick: np.ndarray) -> Passages:
        d, o = column(texts.filter(pa.array(pick)))
        return Passages(d, o, sentences=True)

    if len(set(label[~aside].tolist())) < 2:
        return None
    p = part(~aside)
    sample = _Sample(p, label[~aside])
    value, model = sample.first_values(), None
    for r in range(ROUNDS + 1):
        names, y, times = sample.examples(value, r)
        if len(set(y.tolist())) < 2:
            break
        marks = [sample.strings[i] for i in _landmarks(names, y, r)]
        e, u = np.linalg.eigh(kernel(marks, marks))
        ok = e > 1e-6 * e.max()
        root = u[:, ok] / np.sqrt(e[ok])
        x = np.hstack([kernel([sample.strings[i] for i in names], marks) @ root, np.ones((len(names), 1))])
        w = svm(x, y, COST * (1 + np.log(times)), seed=r)
        weight = np.zeros(_SIDE**3)
        rows, cols, v = _features(marks)
        np.add.at(weight, cols, (root @ w[:-1])[rows] * v)
        model = {"weight": weight.astype(np.float32), "bias": float(w[-1])}
        value = (p.sums(model["weight"]) + model["bias"])[sample.order]
    if model is None:
        return None
    q = Passages(data, offsets)
    f = document_values(q, model)
    a, b = _logistic(f[aside], label[aside]) if len(set(label[aside].tolist())) == 2 else (1.0, 0.0)
    return model | {"slope": a, "shift": b}


def document_values(p: Passages, model: dict) -> np.ndarray:
    """Value of the worst passage of each text; without any passage, that of a passage without subsequences."""
    out = np.full(p.texts, model["bias"])
    if len(p.first):
        value = p.sums(model["weight"]) + model["bias"]
        some = np.full(p.texts, -np.inf)
        np.maximum.at(some, p.text, value)
        out = np.where(some > -np.inf, some, out)
    return out


def learnable(doc_id: Column) -> Column:
    """Labels are never taken from rows whose id's crc32, as text, leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict | None:
    """Model from the labelled rows that may be learned from; None if not both labels are among them."""
    bound_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col(label_col).cast("int").alias("y"))
    known = known.where(F.col("__id").isNotNull() & F.col("y").isin(0, 1) & learnable(F.col("__id")))
    known = known.groupBy("__id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two at most
    if len(counts) < 2:
        return None
    unit = 1 << 30
    share = F.create_map(*[F.lit(x) for k, v in counts.items() for x in (k, min(unit, unit * PER_LABEL // v))])
    picked = known.where(F.pmod(F.xxhash64("__id"), F.lit(unit)) < F.element_at(share, F.col("y")))
    sample = (
        docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("t"))
        .where(F.octet_length("t") <= LONGEST)
        .join(F.broadcast(picked), "__id")  # a few thousand ids, by the sample's bound
        .select("t", "y", F.xxhash64("__id", "t").alias("h"))
    )

    def run(it):
        enter("toxicity")
        t = pa.Table.from_batches(list(it)).sort_by([("h", "ascending"), ("y", "ascending")]).combine_chunks()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(t["t"].combine_chunks(), t["y"].to_numpy()))], pa.binary())], names=["model"])

    got = sample.repartition(1).mapInArrow(run, "model binary").collect()  # one row of fixed size
    return pickle.loads(got[0]["model"]) if got else None


def predict(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` for every row; 0 if there is no model."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(it):
        enter("toxicity")
        m = shared.value
        for batch in it:
            score = np.zeros(batch.num_rows)
            if m is not None:
                data, offsets = column(batch.column(1))
                for i, j in slices(offsets, SLICE):
                    f = document_values(Passages(data, offsets[i : j + 1]), m)
                    score[i:j] = 1 / (1 + np.exp(-np.clip(m["slope"] * f + m["shift"], -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    return picked.mapInArrow(run, "doc_id long, score double")


def toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> DataFrame:
    """One row for each document row: ``doc_id, held_out, score, predicted``.

    ``labels``: ``doc_id`` and ``label_col`` (0, 1); several rows of one id count as toxic if one does, other values
    and null ids do not count.  Rows whose id's crc32 as text leaves 1 when divided by 3 are held out; a null id is
    not.  Null and empty texts, and those without three letters in a row, have the score of a passage that says
    nothing.  Repeated rows each keep theirs.  A very long text is scanned whole, in its row.  Without both labels to
    learn from, all scores are 0; an empty table gives no rows.  Other columns are not looked at.
    """
    out = predict(docs, train(docs, labels, id_col, text_col, label_col), id_col, text_col)
    return out.select("doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op12_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
