"""Similarity join on word shingles with token-combination prefixes.

Every text is a set of shingles.  Shingles are put in one order for all texts, rare ones first, and
of each set only a prefix is indexed: two sets that reach the threshold share a shingle in their
prefixes, and k shingles in prefixes that are k - 1 longer.

1. ``chunks``: texts are packed into stored rows (see ``substring_dedup``).
2. Order: chunks ask, once for each distinct shingle, in how many sets it stands; the answer is 0
   for those that stand in one set only, else a class of the logarithm of the count.
3. Index: sets too few of whose shingles stand anywhere else link with nothing and end here.  Of the
   others, the prefix in that order is kept.  Texts with the same words go on as one node, named by a
   128-bit digest of the words.
4. Hubs: in each bucket of the index, members are paired with the one that has the fewest rarer
   shingles (an original rather than a changed copy).  That is one pair for each member, and joins
   large groups of near copies.  Buckets that could still make more than ``RARE`` pairs get further
   rounds with other hubs.
5. Rest: in buckets that still hold several components, members outside the largest one are paired
   with all others that they are not joined with.  Where that would be more than ``RARE`` pairs even
   now, the bucket's shingle is frequent: the prefixes are extended by one, then by two, and pairs
   must share a combination of two, then three shingles.
6. Pairs whose sizes, places of the first common shingle, parities or shared prefix shingles rule the
   threshold out go; the others are verified word by word on their whole texts, and the links'
   connected components taken.  Parities: bit i tells whether an odd number of a set's shingles falls
   to i, so two sets differ in at least as many shingles as their bits do.

Pairs inside a component that is already known are not verified again, so links are complete as
far as components go.  No bucket, candidate or partner is ever dropped for size.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.components import components
from sightline.llm.spread import join_spread
from sightline.llm.substring_dedup import _low, _ranges, _wide, pack_chunks
from sightline.llm.wordhash import Words, mix, runs
from sightline.llm.workers import enter
from sightline.sources.work import cut, discard, remove, work_dir

#: Pairs up to which a bucket's shingle counts as rare, and rounds of hubs for those beyond.
RARE, HUB_ROUNDS = 4_000_000, 3
#: Shingles before its own that an entry remembers, to see that a pair was met before.
MEMORY = 8
#: Combinations have up to so many shingles.
MOST = 3
KEY_BYTES = 4
#: Longs of 64 parities.
PARITIES = 4
_U = np.uint64
_WORD = re.compile("[^\x20\x09-\x0d]+")
_UPPER = str.maketrans({c: c + 32 for c in range(65, 91)})


def text_shingles(text: str, k: int) -> set[tuple[str, ...]]:
    """The set of a text, as words: the definition that pairs are verified by."""
    w = _WORD.findall(text.translate(_UPPER))
    if len(w) < k:
        return {tuple(w)} if w else set()
    return set(zip(*(w[i:] for i in range(k))))


def _unpack(z: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(z), np.uint8)


def _sets(w: Words, k: int):
    """Sorted distinct shingle hashes of each text."""
    h = runs(w.hash, k)
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= k:
            yield np.unique(h[a : b - k + 1])
        elif b > a:
            yield mix(runs(w.hash[a:b], b - a) + _U(b - a))
        else:
            yield h[:0]


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (((h >> _U(40)) * _U(buckets)) >> _U(24)).astype(np.int64)


_ASK = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("n", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])
_ASK_DDL = "bucket long, chunk long, n long, a binary, b binary"
_ANSWER = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("n", pa.int64()), ("bits", pa.binary()), ("levels", pa.binary())])
_ANSWER_DDL = "chunk long, bucket long, n long, bits binary, levels binary"
_SET = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n", pa.int64()),
        ("sig", pa.binary()),
        ("p", pa.int32()),
        ("pos", pa.list_(pa.int32())),
        ("keys", pa.list_(pa.int64())),
        ("odd", pa.list_(pa.int64())),
        ("z", pa.binary()),
    ]
)
_SET_DDL = "doc_id long, n long, sig binary, p int, pos array<int>, keys array<long>, odd array<long>, z binary"


def _rows(rows, schema):
    return [pa.array(x, f.type) for x, f in zip(zip(*rows), schema)]


def _chunk_sets(sizes, data, k):
    """Words and sets of a chunk; its distinct shingles, each one's place among them, and in how many sets they stand."""
    w = Words(data, np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64))]), True)
    sets = list(_sets(w, k))
    flat = np.concatenate(sets) if sets else np.zeros(0, _U)
    return w, sets, *np.unique(flat, return_inverse=True, return_counts=True)


def _ask(k, buckets):
    def run(it):
        enter("jaccard")
        for batch in it:
            for chunk, sizes, z in zip(*(batch.column(i) for i in range(3))):
                _, _, u, _, count = _chunk_sets(sizes.as_py(), _unpack(z.as_py()), k)
                some = np.minimum(count, 255).astype(np.uint8)  # beyond that, only the class is less exact
                rows = [
                    (b, chunk.as_py(), j - i, _low(u[i:j], KEY_BYTES), some[i:j].tobytes())
                    for b, i, j in _ranges(_bucket(u, buckets))
                ]
                if rows:
                    yield pa.RecordBatch.from_arrays(_rows(rows, _ASK), schema=_ASK)

    return run


def _answer(t: pa.Table) -> pa.Table:
    n = t["n"].to_pylist()
    h = np.concatenate([_wide(x, KEY_BYTES).astype(np.uint32) for x in t["a"].to_pylist()])
    some = np.concatenate([np.frombuffer(x, np.uint8) for x in t["b"].to_pylist()])
    u, inverse = np.unique(h, return_inverse=True)
    count = np.bincount(inverse, some, len(u))
    level = np.where(count > 1, np.minimum(255, 1 + np.floor(4 * np.log2(np.maximum(count, 1)))), 0).astype(np.uint8)[inverse]
    rows = [
        (c, b, i, np.packbits(x > 0).tobytes(), x[x > 0].tobytes())
        for c, b, i, x in zip(t["chunk"].to_pylist(), t["bucket"].to_pylist(), n, np.split(level, np.cumsum(n)[:-1]))
    ]
    return pa.Table.from_arrays(_rows(rows, _ANSWER), schema=_ANSWER)


def _indexed(k, percent):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        import zstandard

        enter("jaccard")
        if not len(left):
            return _SET.empty_table()
        row = left.to_pylist()[0]
        data = _unpack(row["z"])
        w, sets, u, inverse, _ = _chunk_sets(row["sizes"], data, k)
        level = np.zeros(len(u), np.uint8)
        got = sorted(zip(*(right[c].to_pylist() for c in ("bucket", "bits", "n", "levels"))))
        if got:
            shared = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=m) for _, x, m, _ in got]).astype(bool)
            level[shared] = np.frombuffer(b"".join(x for *_, x in got), np.uint8)
        level = level[inverse]
        c = zstandard.ZstdCompressor(level=3)
        out, at, begin = [], 0, 0
        for d, (i, size, s) in enumerate(zip(row["ids"], row["sizes"], sets)):
            n = len(s)
            mine = level[at : at + n]
            if n and 100 * np.count_nonzero(mine) >= percent * n:
                p = n - -(-percent * n // 100) + 1
                order = np.lexsort((s, mine))[: min(n, p + MOST - 1)]
                pos = np.flatnonzero(mine[order])
                x = s[order[pos]]
                odd = np.packbits(np.bincount((s >> _U(8)).astype(np.int64) & (64 * PARITIES - 1), minlength=64 * PARITIES) & 1)
                words = w.text(int(w.first[d]), int(w.first[d + 1])).translate(_UPPER)
                sig = hashlib.blake2b(words.encode(), digest_size=16).digest()
                z = c.compress(data[begin : begin + size].tobytes())
                out.append((i, n, sig, p, pos.tolist(), x.view(np.int64).tolist(), odd.astype(np.uint8).view(np.int64).tolist(), z))
            else:
                out.append((i, n, None, None, None, None, None, None))
            at, begin = at + n, begin + size
        return pa.Table.from_arrays(_rows(out, _SET), schema=_SET) if out else _SET.empty_table()

    return run


def _plausible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` that share enough of their prefixes.

    Of the two prefixes, the one that ends first in the common order holds all shared shingles up to
    its end, and those are in the other prefix too; so the overlap is at most the shared prefix
    shingles plus what lies behind one of the prefixes.
    """
    of = lambda side: sets.select(
        F.col("sig").alias(side), F.col("keys").alias(f"k_{side}"), F.col("n").alias(f"n_{side}"),
        (F.col("n") - F.least("n", F.col("p") + (MOST - 1))).alias(f"rest_{side}"),
    )
    most = F.size(F.array_intersect("k_a", "k_b")) + F.greatest("rest_a", "rest_b")
    enough = most * (100 + percent) >= percent * (F.col("n_a") + F.col("n_b"))
    return join_spread(pairs, of("a"), "a", then=lambda x: x.join(of("b"), "b")).where(enough).select("a", "b")


def _verify(pairs: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose whole texts reach the threshold."""
    of = lambda side: sets.select(F.col("sig").alias(side), F.col("z").alias(f"z_{side}"))

    def run(it):
        last, words = None, set()
        for batch in it:
            keep = []
            for a, za, zb in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if a != last:
                    last, words = a, text_shingles(_unpack(za).tobytes().decode(), k)
                other = text_shingles(_unpack(zb).tobytes().decode(), k)
                both = len(words & other)
                keep.append(100 * both >= percent * (len(words) + len(other) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = cut(pairs, "pairs")
    likely = cut(_plausible(pairs, sets, percent), "likely")
    joined = join_spread(likely, of("a"), "a", then=lambda x: x.join(of("b"), "b")).select("a", "b", "z_a", "z_b")
    links = cut(joined.mapInArrow(run, "a binary, b binary"), "links")
    discard(pairs)
    discard(likely)
    return links


def _fits(na: str, pa: str, nb: str, pb: str, percent: int):
    """Two sets of ``na`` and ``nb`` shingles can link if their first common one stands at ``pa`` and
    ``pb`` in the order: what lies before is not common.  (A pair that fails this at a later common
    shingle passes it at the first, if it can link.)"""
    size = 100 * F.least(na, nb) >= percent * F.greatest(na, nb)
    left = F.least(F.col(na) - F.col(pa), F.col(nb) - F.col(pb))
    return size & (left * (100 + percent) >= percent * (F.col(na) + F.col(nb)))


def _open(entries: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Entries of keys that hold several components, with their component ``c``, ``minor`` (it is not the
    key's largest one) and ``work``, the pairs that the key would make.  Entries that are too much
    larger than all others of their key for what they still can share are not among them."""
    c = known.select(F.col("node").alias("sig"), F.col("component").alias("c0"))
    entries = entries.drop("c").join(c, "sig", "left").withColumn("c", F.coalesce("c0", "sig")).drop("c0")
    entries = cut(entries.withColumn("hi", (F.col("n") - F.col("at")) * (100 + percent) / percent - F.col("n")), "entries")
    sizes = entries.groupBy("key", "c").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("low"))
    keys = (
        sizes.groupBy("key")
        .agg(F.sum("m").alias("all"), F.max(F.struct("m", "c")).alias("top"), F.min("low").alias("low"))
        .where("top.m < all")
        .select("key", "low", "all", F.col("top.c").alias("main"), ((F.col("all") - F.col("top.m")) * F.col("all")).alias("work"))
    )
    keys = cut(keys, "keys")
    left = join_spread(entries, keys.drop("all"), "key", keys.select("key", F.col("all").alias("rows")))
    left = left.where("hi >= low").withColumn("minor", F.col("c") != F.col("main")).drop("main", "hi", "low")
    left = cut(left, "open")
    discard(entries)
    discard(keys)
    return left


def _remember(entries: DataFrame, sets: DataFrame) -> DataFrame:
    """Adds the set's parities, and ``memory``: the last shared shingles before the first of the key, and
    between each two of it."""
    place = lambda i: F.when(i >= 1, F.array_position("keys", F.get("key", i - 1)).cast("int")).otherwise(0)
    before = lambda i: F.slice(
        "keys",
        F.greatest(place(i - 1) + 1, place(i) - MEMORY),
        F.least(place(i) - place(i - 1) - 1, F.lit(MEMORY)),
    )
    memory = F.flatten(F.transform(F.sequence(F.lit(1), F.size("key")), before))
    odd = [F.get("odd", F.lit(i)).alias(f"o{i}") for i in range(PARITIES)]
    return entries.join(sets.select("sig", "keys", *odd), "sig").withColumn("memory", memory).drop("keys")


def _pairs(entries: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of one key in different components, of sizes and parities that can reach the threshold.

    A pair whose members remember a common earlier shingle is met at that shingle's key too, and is
    left to it.  A key of many pairs is dealt over tasks: its minor entries are parted, the others
    copied to each part.
    """
    entries = _remember(entries, sets).withColumn("parts", F.ceil(F.col("work") / RARE).cast("int"))
    side = lambda x, more: entries.select(
        "key", F.col("sig").alias(x), F.col("n").alias(f"n{x}"), F.col("at").alias(f"p{x}"), F.col("c").alias(f"c{x}"), F.col("memory").alias(f"m{x}"),
        *[F.col(f"o{i}").alias(f"o{i}{x}") for i in range(PARITIES)], more,
    )
    bits = [F.bit_count(F.col(f"o{i}a").bitwiseXOR(F.col(f"o{i}b"))) for i in range(PARITIES)]
    # sets that link differ in at most (100 - percent) / (100 + percent) of their sizes' sum
    close = sum(bits[1:], bits[0]) * (100 + percent) <= (100 - percent) * (F.col("na") + F.col("nb"))
    met = (F.col("ca") != F.col("cb")) & _fits("na", "pa", "nb", "pb", percent) & close & ~F.arrays_overlap("ma", "mb")
    some = side("a", F.when(F.col("minor"), F.pmod(F.xxhash64("sig"), "parts").cast("int")).alias("part")).where("part is not null")
    every = side("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    joined = some.join(every, ["key", "part"]).where(met)
    return joined.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _links(sets: DataFrame, k: int, percent: int) -> DataFrame:
    """``node, component`` of every set that links with another."""
    shared = sets.select("sig", "n", "p", F.explode(F.arrays_zip("pos", "keys")).alias("e")).where("e.pos < p")
    entries = shared.select(F.array("e.keys").alias("key"), "sig", "n", F.col("e.pos").alias("at"))
    hubs = entries.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("at", "sig", "n")).alias("hub"))
    hubs = cut(hubs.where("m > 1"), "hubs")
    members = cut(join_spread(entries, hubs, "key", hubs.select("key", F.col("m").alias("rows"))), "members")
    star = (
        members.where((F.col("sig") != F.col("hub.sig")) & _fits("n", "at", "hub.n", "hub.at", percent))
        .select(F.col("hub.sig").alias("a"), F.col("sig").alias("b"))
        .distinct()
    )
    links = _verify(star, sets, k, percent)
    known = components(links)
    # buckets of two are done: their pair was verified
    left = _open(members.where("m > 2").select("key", "sig", "n", "at"), known, percent)
    for again in range(HUB_ROUNDS):
        heavy = left.where(F.col("work") > RARE)
        if heavy.isEmpty():
            break
        # another hub of each bucket's largest component, paired with all members outside it
        of_main = heavy.where("not minor").groupBy("key").agg(F.min(F.struct(F.xxhash64("sig", F.lit(again)), "sig", "n", "at")).alias("hub"))
        star = (
            join_spread(heavy.where("minor"), of_main, "key")
            .where(_fits("n", "at", "hub.n", "hub.at", percent))
            .select(F.col("hub.sig").alias("a"), F.col("sig").alias("b"))
            .distinct()
        )
        links = links.unionByName(_verify(star, sets, k, percent))
        known = components(links)
        later = _open(left.select("key", "sig", "n", "at"), known, percent)
        discard(left)
        left = later
    # sets so small that they need not share MOST shingles, and what can link with them
    tiny = (MOST - 1) * 10_000 // percent**2
    pairs = _pairs(left.where((F.col("work") <= RARE) | (F.col("n") <= tiny)), sets, percent)
    opened = [left]
    hot = left.where(F.col("work") > RARE).select("sig", "key", "at")
    for size in range(2, MOST + 1):
        if hot.isEmpty():
            break
        # frequent combinations, each extended by a later shared shingle of the longer prefix
        last = F.array_position("keys", F.element_at("key", -1))
        grown = (
            hot.join(sets.select("sig", "n", "p", "pos", "keys"), "sig")
            .select("sig", "n", "p", "pos", "key", "at", last.alias("last"), F.posexplode("keys").alias("i", "y"))
            .where((F.col("i") >= F.col("last")) & (F.get("pos", "i") < F.col("p") + (size - 1)))
            .select(F.concat("key", F.array("y")).alias("key"), "sig", "n", "at")
        )
        grown = _open(grown, known, percent)
        opened.append(grown)
        rest = grown if size == MOST else grown.where(F.col("work") <= RARE)
        pairs = pairs.unionByName(_pairs(rest, sets, percent))
        hot = grown.where(F.col("work") > RARE).select("sig", "key", "at")
    more = _verify(pairs.distinct(), sets, k, percent)
    for done in (hubs, members, *opened):
        discard(done)
    return components(links.unionByName(more))


def jaccard_components(
    docs: DataFrame,
    k: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_bytes: int | None = None,
) -> DataFrame:
    """One row for each document row: ``doc_id``, ``n_shingles``, ``component_id``.

    A text's set holds its distinct runs of ``k`` words (A-Z lower-cased, words being runs of other
    characters than space and 9 to 13), or, with fewer words, its whole sequence.  Two documents
    link when the Jaccard similarity of their sets is ``percent`` / 100 or more;
    ``component_id`` is the smallest id reachable by links.  Texts without words, null among them,
    link with nothing: their component is their own id.  A null id names a component only if no
    other id is in it.  Repeated rows are equal sets, so they share a component.  A very long text is
    read whole, in a chunk of its own, by one task.  An empty table gives no rows.  Other columns are
    not looked at.  ``chunk_bytes``: see ``pack_chunks``.
    """
    spark = docs.sparkSession
    chunks = pack_chunks(docs, id_col, text_col, chunk_bytes)
    buckets = min(1 << 20, max(int(spark.conf.get("spark.sql.shuffle.partitions")), chunks.select("chunk").count()))
    asked = chunks.select("chunk", "sizes", "z").mapInArrow(_ask(k, buckets), _ASK_DDL)
    answers = asked.groupBy("bucket").applyInArrow(_answer, _ANSWER_DDL)
    table = cut(chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_indexed(k, percent), _SET_DDL), "sets")
    discard(chunks)
    # one row for each node, stored in buckets of `sig` so that the joins below don't shuffle the texts
    name = f"jaccard_sets_{uuid.uuid4().hex}"
    try:
        (
            table.where("sig is not null")
            .groupBy("sig")
            .agg(*[F.first(c).alias(c) for c in ("n", "p", "pos", "keys", "odd", "z")])
            .write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "sig")
            .sortBy("sig")
            .option("path", f"{work_dir(spark)}/{name}")
            .saveAsTable(name)
        )
        # what documents still need of it is narrow
        narrow = cut(table.select("doc_id", "n", "sig"), "documents")
        discard(table)
        joined = _links(spark.table(name), k, percent)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(spark, f"{work_dir(spark)}/{name}")
    # back to documents
    ids = narrow.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("low"))
    named = ids.join(joined.withColumnRenamed("node", "sig"), "sig", "left").withColumn("c", F.coalesce("component", "sig"))
    named = cut(named.select("sig", "c", "low"), "named")
    lowest = named.groupBy("c").agg(F.min("low").alias("component_id"))
    names = cut(join_spread(named, lowest, "c").select("sig", "component_id"), "names")
    discard(named)
    cold = narrow.where("sig is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    found = join_spread(narrow.where("sig is not null"), names, "sig").select("doc_id", "n", "component_id")
    return cold.unionByName(found).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def op4_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, percent=90)
