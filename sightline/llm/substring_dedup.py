"""Removal of long word sequences that also stand earlier in the corpus, by fixed-block anchors.

A sequence of ``window`` words that occurs twice holds, in its earlier occurrence, a whole block of
``window // 2`` words that begins at a multiple of that length.  So it is enough to index the
non-overlapping blocks of every document, probe them with every rolling run of that length, and
extend the hits:

1. ``chunks``: documents are packed, sorted by id, into stored rows of about ``CHUNK_BYTES`` text.
2. Anchors: every chunk sends each distinct run of its texts once to the bucket of the run's hash,
   noting whether it is a block there.  A bucket answers with one bit for each: does the run stand
   in two places, one of them a block?  These are the hits.
3. Extension: windows that hold a hit are compared in full width.  Every chunk sends each distinct
   window once, with its first place; the bucket answers with one bit: is that the first place of
   all?  Neighbouring windows together make up the maximal repeats.

What a chunk sends for a run or window does not depend on how often it stands there, so a passage
that fills a third of the corpus is one entry for each chunk: no bucket grows hot, and no pairs are
ever made.  Windows are compared by 80 bits of two hashes beside the bucket number; the two are independent
from the bytes of the words on.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.wordhash import Words, column, runs, slices
from sightline.llm.workers import bound_batches, enter
from sightline.sources.work import cut

#: Least bytes of text in a chunk, and keys that a message carries on average at least.
CHUNK_BYTES, KEYS = 6_000_000, 64
_U = np.uint64
_LAST = np.iinfo(np.int64).max


def pack_chunks(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int | None = None) -> DataFrame:
    """Stored rows ``chunk, ids, z``: ids of some documents, ascending, and their texts, compressed.

    Every chunk sends a message to every bucket, and there are as many buckets as chunks.  So that the
    messages do not outgrow the text, chunks grow with its square root: a message then carries
    ``KEYS`` keys (words, about) or more.  That is 6 MB up to 100 GB of text, 20 MB for 1 TB and 200 MB
    for 100 TB, of which a task needs some 25 times as much memory.  ``chunk_bytes`` overrides it.
    """
    import zstandard

    if chunk_bytes is None:
        total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
        chunk_bytes = max(CHUNK_BYTES, math.isqrt(6 * KEYS * total))

    def row(part, seq, held):
        ids = np.concatenate([h[0] for h in held])
        known = np.concatenate([h[1] for h in held])
        data = np.concatenate([h[2] for h in held])
        sizes = np.concatenate([h[3] for h in held])
        begin = np.cumsum(sizes) - sizes
        order = np.lexsort((np.arange(len(ids)), np.where(known, ids, _LAST)))
        texts = [data[begin[i] : begin[i] + sizes[i]] for i in order]
        z = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([(part << 32) + seq], pa.int64()),
                pa.array([pa.array(ids[order], mask=~known[order]).to_pylist()], pa.list_(pa.int64())),
                pa.array([sizes[order]], pa.list_(pa.int64())),
                pa.array([z], pa.binary()),
            ],
            names=["chunk", "ids", "sizes", "z"],
        )

    def run(it):
        from pyspark import TaskContext

        enter("chunks")
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0
        for b in it:
            data, offsets = column(b.column(1))
            known = np.asarray(b.column(0).is_valid())
            ids = b.column(0).fill_null(0).to_numpy()
            for i, j in slices(offsets, chunk_bytes):
                o = offsets[i : j + 1]
                if held and size + o[-1] - o[0] > chunk_bytes:
                    yield row(part, seq, held)
                    seq, held, size = seq + 1, [], 0
                held.append((ids[i:j].copy(), known[i:j].copy(), data[o[0] : o[-1]].copy(), np.diff(o)))
                size += int(o[-1] - o[0])
        if held:
            yield row(part, seq, held)

    bound_batches(docs.sparkSession)
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    return cut(picked.mapInArrow(run, "chunk long, ids array<long>, sizes array<long>, z binary"), "chunks")


class _Chunk:
    """Words and probes of one stored chunk."""

    def __init__(self, ids, sizes, z: bytes, window: int, buckets: int):
        import zstandard

        self.window, self.block, self.buckets = window, window // 2, buckets
        self.ids = ids
        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(z), np.uint8)
        self.words = w = Words(data, np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64))]), False)
        self.doc = np.repeat(np.arange(len(ids)), np.diff(w.first))  # of each word
        n = np.diff(w.first)
        at = np.arange(len(w.hash)) - np.repeat(w.first[:-1], n)  # place of each word in its text
        left = np.repeat(n, n) - at  # words from this one to the end of its text
        usable = np.repeat(n >= window, n)
        self.whole = left >= window  # a window begins here
        self.probe = np.flatnonzero(usable & (left >= self.block))
        self.anchor = at[self.probe] % self.block == 0

    def runs(self):
        """(distinct hashes ascending, number of each probe's hash among them)."""
        return np.unique(runs(self.words.hash, self.block)[self.probe], return_inverse=True) if len(self.probe) else (
            np.zeros(0, _U),
            np.zeros(0, np.int64),
        )

    def bucket(self, h: np.ndarray) -> np.ndarray:
        return (((h >> _U(40)) * _U(self.buckets)) >> _U(24)).astype(np.int64)

    def windows(self, hit: np.ndarray):
        """Windows that hold a hit: (their first words, groups in ascending order of hash, and the
        group of each).  ``hit``: of each probe.  A group is (hash, hash, first window's number)."""
        mark = np.zeros(len(self.words.hash) + self.window + 1, np.int32)
        mark[self.probe[hit] + 1] = 1
        mark = np.cumsum(mark)
        n = len(self.words.hash)
        some = mark[np.arange(n) + self.window - self.block + 1] > mark[:n]
        first = np.flatnonzero(self.whole & some)
        a = runs(self.words.hash, self.window, 0)[first] if len(first) else np.zeros(0, _U)
        b = runs(self.words.hashes(1), self.window, 1)[first] if len(first) else np.zeros(0, _U)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        group = np.empty(len(a), np.int64)
        group[order] = np.cumsum(new) - 1
        return first, a[new], b[new], order[new], group

    def order_of(self, windows_first_word: np.ndarray) -> np.ndarray:
        ids = np.array([_LAST if i is None else i for i in self.ids], np.int64)
        return ids[self.doc[windows_first_word]]


def _ranges(bucket: np.ndarray):
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    return zip(bucket[np.concatenate([[0], cuts])].tolist(), [0, *cuts.tolist()], [*cuts.tolist(), len(bucket)]) if len(bucket) else ()


def _low(h: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _wide(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


#: Bytes of a run's hash, and of either hash of a window, that travel beside the bucket number.
RUN_BYTES, WINDOW_BYTES = 4, 5


def _bits(answers, which: int, n: int) -> np.ndarray:
    """Answers of one round for a chunk, as one flag for each thing asked, in order of bucket."""
    got = sorted((b, raw, k) for r, b, raw, k in answers if r == which)
    out = [np.unpackbits(np.frombuffer(raw, np.uint8), count=k).astype(bool) for _, raw, k in got]
    flags = np.concatenate(out) if out else np.zeros(0, bool)
    if len(flags) != n:
        raise ValueError(f"{len(flags)} answers for {n} questions")
    return flags


_ASK = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("n", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])
_ASK_DDL = "bucket long, chunk long, n long, a binary, b binary"
_ANSWER = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("n", pa.int64()), ("bits", pa.binary()), ("round", pa.int32())])
_ANSWER_DDL = "chunk long, bucket long, n long, bits binary, round int"


def _asked_runs(window: int, buckets: int):
    def run(it):
        for batch in it:
            for chunk, ids, sizes, z in zip(*(batch.column(i) for i in range(4))):
                c = _Chunk(ids.as_py(), sizes.as_py(), z.as_py(), window, buckets)
                u, inverse = c.runs()
                twice = np.bincount(inverse, minlength=len(u)) > 1
                anchor = np.zeros(len(u), bool)
                anchor[inverse[c.anchor]] = True
                rows = [
                    (k, chunk.as_py(), j - i, _low(u[i:j], RUN_BYTES), np.packbits(np.concatenate([twice[i:j], anchor[i:j]])).tobytes())
                    for k, i, j in _ranges(c.bucket(u))
                ]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _ASK)], schema=_ASK)

    return run


def _answer_table(rows, round_: int) -> pa.Table:
    rows = [(*r, round_) for r in rows]
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _ANSWER)], schema=_ANSWER)


def _answer_runs(t: pa.Table) -> pa.Table:
    t = t.combine_chunks()
    n = t["n"].to_numpy()
    h = np.concatenate([_wide(x, RUN_BYTES) for x in t["a"].to_pylist()])
    flags = [np.unpackbits(np.frombuffer(x, np.uint8), count=2 * k).astype(bool) for x, k in zip(t["b"].to_pylist(), n)]
    twice = np.concatenate([f[: len(f) // 2] for f in flags])
    anchor = np.concatenate([f[len(f) // 2 :] for f in flags])
    u, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
    again, block = count > 1, np.zeros(len(u), bool)
    again[inverse[twice]] = True
    block[inverse[anchor]] = True
    hit = (again & block)[inverse]
    return _answer_table(
        zip(t["chunk"].to_pylist(), t["bucket"].to_pylist(), n.tolist(), (np.packbits(x).tobytes() for x in np.split(hit, np.cumsum(n)[:-1]))), 1
    )


def _load(left: pa.Table, right: pa.Table, window: int, buckets: int):
    row = left.to_pylist()[0]
    c = _Chunk(row["ids"], row["sizes"], row["z"], window, buckets)
    answers = list(zip(right["round"].to_pylist(), right["bucket"].to_pylist(), right["bits"].to_pylist(), right["n"].to_pylist()))
    u, inverse = c.runs()
    hit = _bits(answers, 1, len(u))[inverse]
    return row["chunk"], c, answers, c.windows(hit)


def _asked_windows(window: int, buckets: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return _ASK.empty_table()
        chunk, c, _, (first, a, b, earliest, _) = _load(left, right, window, buckets)
        ids = c.order_of(first[earliest])
        rows = [
            (k, chunk, j - i, _low(a[i:j], WINDOW_BYTES) + _low(b[i:j], WINDOW_BYTES), _squeeze(ids[i:j]))
            for k, i, j in _ranges(c.bucket(a))
        ]
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _ASK)], schema=_ASK) if rows else _ASK.empty_table()

    return run


def _squeeze(ids: np.ndarray) -> bytes:
    """Ids as the smallest one and the rest above it, in as few bytes as they need."""
    low = ids.min()
    above = (ids.astype(_U) - low.astype(_U)).astype(_U)
    width = max(1, (int(above.max()).bit_length() + 7) // 8)
    return int(low).to_bytes(8, "little", signed=True) + bytes([width]) + _low(above, width)


def _unsqueeze(raw: bytes) -> np.ndarray:
    low, width = int.from_bytes(raw[:8], "little", signed=True), raw[8]
    return (_wide(raw[9:], width) + np.array(low, np.int64).astype(_U)).astype(np.int64)


def _answer_windows(t: pa.Table) -> pa.Table:
    n = t["n"].to_numpy()
    raw = t["a"].to_pylist()
    a = np.concatenate([_wide(x[: len(x) // 2], WINDOW_BYTES) for x in raw])
    b = np.concatenate([_wide(x[len(x) // 2 :], WINDOW_BYTES) for x in raw])
    ids = np.concatenate([_unsqueeze(x) for x in t["b"].to_pylist()])
    chunk = np.repeat(t["chunk"].to_numpy(), n)
    order = np.lexsort((chunk, ids, b, a))
    new = np.ones(len(a), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    first = np.zeros(len(a), bool)
    first[order[new]] = True
    return _answer_table(
        zip(t["chunk"].to_pylist(), t["bucket"].to_pylist(), n.tolist(), (np.packbits(x).tobytes() for x in np.split(first, np.cumsum(n)[:-1]))), 2
    )


def _kept(window: int, buckets: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return schema.empty_table()
        _, c, answers, (first, a, _, earliest, group) = _load(left, right, window, buckets)
        is_first = _bits(answers, 2, len(a))
        again = np.ones(len(first), bool)
        again[earliest[is_first]] = False
        w, n = c.words, len(c.words.hash)
        cover = np.zeros(n + 1, np.int64)
        np.add.at(cover, first[again], 1)
        np.subtract.at(cover, first[again] + window, 1)
        stays = np.cumsum(cover[:n]) == 0
        # one byte behind each word that stays is its separator, but for the last of a text
        kept = np.flatnonzero(stays)
        doc = c.doc[kept]
        sep = np.ones(len(kept), bool)
        sep[:-1] = doc[:-1] == doc[1:]
        if len(kept):
            sep[-1] = False
        data = np.append(w.data, np.uint8(32))
        edge = np.zeros(len(data) + 2, np.int32)
        edge[w.start[kept]] += 1
        np.subtract.at(edge, w.end[kept] + sep, 1)
        inside = np.cumsum(edge)[: len(data)] > 0
        data[w.end[kept[sep]]] = 32
        size = np.concatenate([[0], np.cumsum(inside)])[w.offsets]
        out = pa.Array.from_buffers(
            pa.string(), len(c.ids), [None, pa.py_buffer(size.astype(np.int32)), pa.py_buffer(data[inside].tobytes())]
        )
        total = np.diff(w.first)
        removed = total - np.bincount(doc, minlength=len(c.ids))
        return pa.Table.from_arrays(
            [pa.array(c.ids, pa.int64()), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), out], schema=schema
        )

    return run


def substring_dedup(
    docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int | None = None
) -> DataFrame:
    """One row for each document row: ``doc_id``, ``n_words``, ``n_removed``, ``kept_text`` (the
    words that stay, joined by one space).

    A word goes if a run of ``window`` words around it also begins earlier: in a document of
    smaller id, or earlier in the same document.  Everything is judged on the input texts.  Words are
    runs of other characters than space and 9 to 13.  Null and empty texts have none; a null id counts as
    larger than any other.  Rows of one id, repeated rows among them, count as one after another, in an
    arbitrary order.  A very long text is read whole, in a chunk of its own.  An empty table gives no
    rows.  Other columns are not looked at.  ``chunk_bytes``: see ``pack_chunks``.
    """
    if window < 2:
        raise ValueError("a window has two words at least")
    spark = docs.sparkSession
    chunks = pack_chunks(docs, id_col, text_col, chunk_bytes)
    # a bucket gets about as much as a chunk sends
    buckets = min(1 << 20, max(int(spark.conf.get("spark.sql.shuffle.partitions")), chunks.select("chunk").count()))
    asked = chunks.mapInArrow(_asked_runs(window, buckets), _ASK_DDL)
    hits = cut(asked.groupBy("bucket").applyInArrow(_answer_runs, _ANSWER_DDL), "hits")
    by_chunk = chunks.groupBy("chunk")
    windows = by_chunk.cogroup(hits.groupBy("chunk")).applyInArrow(_asked_windows(window, buckets), _ASK_DDL)
    firsts = windows.groupBy("bucket").applyInArrow(_answer_windows, _ANSWER_DDL)
    return by_chunk.cogroup(hits.unionByName(firsts).groupBy("chunk")).applyInArrow(
        _kept(window, buckets), "doc_id long, n_words long, n_removed long, kept_text string"
    )


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
