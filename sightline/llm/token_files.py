"""Token files: ids of every document as zstandard frames that share one dictionary.

Layout under the target folder, all of it Parquet so that any Spark reader can open it:

``dictionary``  one row: ``dict_hash``, ``dictionary`` (bytes), ``id_bytes`` (bytes of one id), ``end_id``
``shards``      one row for each shard: ``part, seq, dict_hash, payload`` (frames on end), the offset
                index, one entry for each document: ``doc_ids, offsets, sizes``, and the least and
                greatest id, ``min_id`` and ``max_id``, by which Parquet skips row groups of one or two shards
``starts``      one row for each shard: ``part, seq, start`` (ids before the shard), ``n_tokens``

Shards in order of (part, seq), and documents within them, ascend by document id.  A frame is one
document, compressed by itself: its ids with the end id, little-endian, 2 bytes each if every id
fits, else 4.  To read one document, take its slice of the payload by the offset index and
decompress that alone with the dictionary named by ``dict_hash``.

Ids and texts never pass through the driver.  The dictionary is trained on a bounded sample: ids of
at most ``SAMPLE_DOCS`` documents of at most ``SAMPLE_CHARS`` characters, those with the smallest
hashes of id and text among a share of the corpus that holds some four times as many.  The sample touches only how small frames get, never what they hold.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline.llm.tokens import batches, encoder
from sightline.llm.workers import bound_batches
from sightline.sources.work import cut, discard, work_dir

SAMPLE_DOCS, SAMPLE_CHARS = 1000, 16_384
DICT_BYTES = 65_536
SHARD_BYTES = 4_000_000
_HEAD = "dict_hash string, dictionary binary, id_bytes int, end_id long"
_SHARD = (
    "part int, seq int, dict_hash string, n_tokens long, min_id long, max_id long, doc_ids array<long>, offsets array<long>, sizes array<long>, "
    "payload binary"
)


def _train(it, tokenizer_path: str, end_id: int):
    import zstandard

    samples = []
    dtype = _dtype(tokenizer_path, end_id)
    for b in it:
        texts = [t or "" for t in b.column(0).to_pylist()]
        ids, n = encoder(tokenizer_path).encode(texts)
        for part in np.split(ids, np.cumsum(n)[:-1]):
            samples.append(np.append(part, end_id).astype(dtype).tobytes())
    content = b""
    if sum(map(len, samples)) > 8 * 1024:
        try:
            content = zstandard.train_dictionary(min(DICT_BYTES, sum(map(len, samples)) // 8), samples).as_bytes()
        except zstandard.ZstdError:  # too few or too uniform samples: frames go without a dictionary
            content = b""
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([hashlib.sha256(content).hexdigest()]),
            pa.array([content], pa.binary()),
            pa.array([np.dtype(dtype).itemsize], pa.int32()),
            pa.array([end_id], pa.int64()),
        ],
        names=["dict_hash", "dictionary", "id_bytes", "end_id"],
    )


def _dtype(tokenizer_path: str, end_id: int) -> str:
    return "<u2" if max(encoder(tokenizer_path).top, end_id) < 65_536 else "<u4"


def _zdict(content: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(content) if content else None


def write_token_files(
    docs: DataFrame,
    tokenizer_path: str,
    out: str,
    end_id: int = 2,
    parts: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Encode every whole text, append ``end_id``, and write the files described above to ``out``.

    Null and empty texts are a document of the end id alone.  Null ids come first.  Repeated ids
    each keep their frame, in order of size and content.  An empty table writes empty tables.  A very
    long text is encoded whole, in a batch of its own, and fills a shard alone.  Other columns are not
    looked at.
    """
    import zstandard

    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    # a share by hash first, so that what the tasks hand on for sorting does not grow with their number
    share = min(1.0, 4 * SAMPLE_DOCS / max(1, docs.count()))
    h = F.xxhash64("doc_id", "t")
    drawn = rows.where((F.length("t") <= SAMPLE_CHARS) & (F.pmod(h, F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))))
    sample = drawn.orderBy(h, "doc_id").limit(SAMPLE_DOCS).select("t")
    trained = sample.coalesce(1).mapInArrow(lambda it: _train(it, tokenizer_path, end_id), _HEAD)
    trained.write.parquet(f"{out}/dictionary")
    head = spark.read.schema(_HEAD).parquet(f"{out}/dictionary").first()  # at most DICT_BYTES
    if head is None:  # no document, so no task to train in
        nothing = (hashlib.sha256(b"").hexdigest(), b"", np.dtype(_dtype(tokenizer_path, end_id)).itemsize, end_id)
        spark.createDataFrame([nothing], _HEAD).write.mode("append").parquet(f"{out}/dictionary")
        head = spark.read.schema(_HEAD).parquet(f"{out}/dictionary").first()
    dtype = "<u2" if head["id_bytes"] == 2 else "<u4"
    content, dict_hash = bytes(head["dictionary"]), head["dict_hash"]

    def compress(it):
        c = zstandard.ZstdCompressor(level=3, dict_data=_zdict(content), write_content_size=True)
        enc = encoder(tokenizer_path)
        for b in it:
            lengths = pa.compute.binary_length(b.column(1)).to_pylist()
            for i, j in batches(lengths, 4_000_000):
                ids, n = enc.encode(b.column(1).slice(i, j - i).to_pylist())
                ends = np.cumsum(n + 1)
                flat = np.full(len(ids) + len(n), end_id, dtype)
                inside = np.ones(len(flat), bool)
                inside[ends - 1] = False
                flat[inside] = ids
                view = memoryview(flat.tobytes())
                w = flat.itemsize
                frames = [c.compress(view[(e - k) * w : e * w]) for e, k in zip(ends.tolist(), (n + 1).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(n + 1, pa.int64()), pa.array(frames, pa.binary())],
                    names=["doc_id", "n_tokens", "frame"],
                )

    import pyarrow.compute  # noqa: F401

    frames = cut(rows.mapInArrow(compress, "doc_id long, n_tokens long, frame binary"), "frames")
    n_parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = frames.repartitionByRange(n_parts, "doc_id").sortWithinPartitions("doc_id", "n_tokens", "frame")

    def shard(it):
        from pyspark import TaskContext

        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def row():
            ids, n, payload = zip(*held)
            sizes = np.fromiter(map(len, payload), np.int64, len(payload))
            offsets = np.cumsum(sizes) - sizes
            kind = pa.list_(pa.int64())
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([seq], pa.int32()),
                    pa.array([dict_hash]),
                    pa.array([sum(n)], pa.int64()),
                    pa.array([min((i for i in ids if i is not None), default=None)], pa.int64()),
                    pa.array([max((i for i in ids if i is not None), default=None)], pa.int64()),
                    pa.array([list(ids)], kind),
                    pa.array([offsets.tolist()], kind),
                    pa.array([sizes.tolist()], kind),
                    pa.array([b"".join(payload)], pa.binary()),
                ],
                names=[f.split()[0] for f in _SHARD.split(", ")],
            )

        for b in it:
            for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                held.append(r)
                size += len(r[2])
                if size >= SHARD_BYTES:
                    yield row()
                    seq, held, size = seq + 1, [], 0
        if held:
            yield row()

    # frames are compressed; row groups of one or two shards, so that readers can skip the others
    stored = ordered.mapInArrow(shard, _SHARD).write.option("compression", "uncompressed")
    stored.option("parquet.block.size", SHARD_BYTES).parquet(f"{out}/shards")
    discard(frames)
    shards = spark.read.schema(_SHARD).parquet(f"{out}/shards").select("part", "seq", "n_tokens")
    # ids before each part: one row for each part; ids before each shard: within its part
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = totals.select(
        "part",
        F.coalesce(F.sum("total").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"),
    )
    inside = F.sum("n_tokens").over(W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1))
    (
        shards.withColumn("inside", F.coalesce(inside, F.lit(0)))
        .join(before, "part")
        .select("part", "seq", (F.col("base") + F.col("inside")).alias("start"), "n_tokens")
        .write.parquet(f"{out}/starts")
    )


def _decoder(content: bytes, dict_hash: str):
    import zstandard

    if hashlib.sha256(content).hexdigest() != dict_hash:
        raise ValueError("the dictionary is not the one that wrote these frames")
    return zstandard.ZstdDecompressor(dict_data=_zdict(content))


def read_token_files(spark: SparkSession, out: str) -> DataFrame:
    """Every document from the files: ``doc_id``, ``start`` (ids of all documents before it),
    ``n_tokens`` (with the end id) and ``ids`` (array), decompressed frame by frame."""
    return _read(spark, out, "ids array<long>", lambda ids: ids.tolist(), pa.list_(pa.int64()))


def token_checksums(spark: SparkSession, out: str) -> DataFrame:
    """As ``read_token_files``, with ``ids_crc32`` in place of the ids: crc32 of the ids as
    little-endian unsigned 32-bit integers."""
    return _read(spark, out, "ids_crc32 long", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), pa.int64())


def _read(spark: SparkSession, out: str, column: str, of, kind: pa.DataType) -> DataFrame:
    head = spark.read.schema(_HEAD).parquet(f"{out}/dictionary").first()
    content, dtype = bytes(head["dictionary"]), "<u2" if head["id_bytes"] == 2 else "<u4"
    name = column.split()[0]

    def run(it):
        d = seen = None
        for b in it:
            for part, seq, h, ids, offsets, sizes, payload in zip(*(c.to_pylist() for c in b.columns)):
                if seen != h:
                    d, seen = _decoder(content, h), h
                view, n, values, at, inside = memoryview(payload), [], [], 0, []
                for o, s in zip(offsets, sizes):
                    got = np.frombuffer(d.decompress(view[o : o + s]), dtype)
                    inside.append(at)
                    at += len(got)
                    n.append(len(got))
                    values.append(of(got))
                for i in range(0, len(ids), 2000):
                    s = slice(i, i + 2000)
                    k = len(ids[s])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([part] * k, pa.int32()),
                            pa.array([seq] * k, pa.int32()),
                            pa.array(ids[s], pa.int64()),
                            pa.array(inside[s], pa.int64()),
                            pa.array(n[s], pa.int64()),
                            pa.array(values[s], kind),
                        ],
                        names=["part", "seq", "doc_id", "inside", "n_tokens", name],
                    )

    shards = spark.read.schema(_SHARD).parquet(f"{out}/shards").select(
        "part", "seq", "dict_hash", "doc_ids", "offsets", "sizes", "payload"
    )
    docs = shards.mapInArrow(run, f"part int, seq int, doc_id long, inside long, n_tokens long, {column}")
    starts = spark.read.parquet(f"{out}/starts").select("part", "seq", "start")
    return docs.join(starts, ["part", "seq"]).select(
        "doc_id", (F.col("start") + F.col("inside")).alias("start"), "n_tokens", name
    )


def read_document(spark: SparkSession, out: str, doc_id: int) -> list[list[int]]:
    """The ids of one document (a list for each of its rows): row groups whose ids lie elsewhere are
    skipped by their statistics, and only the document's own frames are decompressed."""
    head = spark.read.schema(_HEAD).parquet(f"{out}/dictionary").first()
    d = _decoder(bytes(head["dictionary"]), head["dict_hash"])
    dtype = "<u2" if head["id_bytes"] == 2 else "<u4"
    hit = (
        spark.read.schema(_SHARD).parquet(f"{out}/shards")
        .where((F.col("min_id") <= doc_id) & (F.col("max_id") >= doc_id))
        .select("payload", F.explode(F.arrays_zip("doc_ids", "offsets", "sizes")).alias("e"))
        .where(F.col("e.doc_ids") == doc_id)
        .select(F.expr("substring(payload, cast(e.offsets + 1 as int), cast(e.sizes as int))").alias("frame"))
    )
    return [np.frombuffer(d.decompress(bytes(r["frame"])), dtype).tolist() for r in hit.collect()]


def op5_token_files(spark, sf_dir: str) -> DataFrame:
    import uuid

    import public_tokenizers

    out = f"{work_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), out
    )
    return token_checksums(spark, out)
