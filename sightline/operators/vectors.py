"""Embedding calls and filtered cosine top-k for many queries in one scan of the index.

Points and queries are both packed into blocks, rows that hold some thousand of them.  Blocks meet by a join on a
key, and a task multiplies two blocks as matrices.  No vector passes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline.sources.work import cut

#: Points of a block, and queries whose scores are made at once: 8 MB of doubles.
POINTS, QUERIES = 2048, 512
#: Bytes of the query vectors of a block; bytes of all query vectors up to which their blocks are broadcast.
QUERY_BYTES, BROADCAST_BYTES = 4_000_000, 8_000_000
#: Hits that a task keeps for a block of queries (for each window state), hits of all queries up to which their blocks
#: are broadcast, and blocks of one key that a task keeps at once.
HITS, BROADCAST_HITS, HELD = 200_000, 200_000, 4
#: Partitions from which on the best rows of tasks are merged in two steps.
MERGE = 256
#: Seconds of a time cell of a stored index, cells whose names are broadcast to skip files.
CELL_S, BROADCAST_CELLS = 3600, 100_000


def embed(rows: DataFrame, column: str, make: Callable[[], Callable], batch: int = 16, out: str = "vector") -> DataFrame:
    """Adds the vector of ``column`` by a user's model.

    ``make`` is called once in each Python worker and gives ``encode(list) -> 2-d array``; rows go to
    it in batches of ``batch``.  Vectors come back with length 1.
    """
    schema = f"{_ddl(rows)}, {out} array<float>"

    def run(it: Iterator[pa.RecordBatch]):
        encode = make()
        for b in it:
            for i in range(0, b.num_rows, batch):
                part = b.slice(i, batch)
                v = unit_rows(np.asarray(encode(part.column(column).to_pylist()), np.float32))
                yield part.append_column(out, pa.array(list(v), pa.list_(pa.float32())))

    return rows.mapInArrow(run, schema)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def unit_rows(v: np.ndarray) -> np.ndarray:
    """Rows of length 1; a zero row stays zero."""
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def l2_normalize(vector: Column) -> Column:
    """The same for an array column, in double."""
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: x / F.greatest(norm, F.lit(1e-12)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two array columns, for few rows; ``top_k`` is the way for many."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)
    return dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(1e-12))


_WINDOW = (("ts_from", "double"), ("ts_to", "double"), ("camera_id", "string"))


def _asked(queries: DataFrame) -> DataFrame:
    for c, kind in _WINDOW:
        if c not in queries.columns:
            queries = queries.withColumn(c, F.lit(None).cast(kind))
    picked = queries.where("vector is not null")
    return picked.select("query_id", F.col("vector").cast("array<double>").alias("vector"), *[F.col(c).cast(kind).alias(c) for c, kind in _WINDOW])


def top_k(
    points: DataFrame,
    queries: DataFrame,
    k: int,
    variants: tuple[str, ...] = ("all",),
    payload: tuple[str, ...] = ("video_id", "frame_idx", "offset_s", "ts", "source", "yolo_class"),
    digits: int = 6,
) -> DataFrame:
    """The ``k`` best points of each query and variant by cosine (rounded to ``digits``, ties by id).

    ``points``: ``id, vector, ts, camera_id, source`` and the payload.  ``queries``: ``query_id, vector``
    and, all nullable, ``ts_from, ts_to`` (both ends count) and ``camera_id``.  Variants: ``all``,
    ``frame`` or ``crop`` (that source alone).  Where a query has a time window that holds no point,
    its best points without the window come back, with ``time_dropped`` true: both are kept in one
    scan.  Result: ``query_id, variant, id, score, pos, time_dropped`` and the payload.

    Points and queries without vector take no part.  A point without ``ts`` is outside every window, and
    inside for queries that have none.

    The index is read once, whatever the number of queries.  Few queries are broadcast in blocks; beyond
    ``BROADCAST_BYTES`` or ``BROADCAST_HITS`` pairs of blocks are dealt by a key, for which each block of points is sent once
    for each block of queries.  A task keeps at most ``k`` hits for each query of a block, variant and window state, and
    the payload of the points among them once, so neither its memory nor the rows that are merged grow with the points of
    a task; a block has so few queries that these are ``HITS`` for each window state.
    """
    spark = points.sparkSession
    asked = _asked(queries)
    n, width = asked.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    block = _block(width, k, variants)
    few = n * 8 * (width or 1) <= BROADCAST_BYTES and n * k * len(variants) <= BROADCAST_HITS
    blocks = max(1, -(-n // block))
    # every share of the points gives its own k hits, so there are no more shares than keep all cores busy
    cores = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    shares = 1 if few else max(1, -(-2 * cores // blocks))
    numbered = asked.withColumn("key", F.pmod(F.xxhash64("query_id", "vector", "ts_from"), F.lit(blocks)).cast("string"))
    sought = _query_blocks(numbered, block).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    packed = _point_blocks(_picked(points, payload, F.lit("").alias("key")), shares)
    packed = packed.withColumn("key", F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda i: i.cast("string"))))
    pairs = packed.join(F.broadcast(sought) if few else _dealt(sought), ["key", "share"])
    return _ranked(_meet(pairs, points, k, variants, payload, digits, few), k, payload)


def _block(width: int | None, k: int, variants: tuple[str, ...]) -> int:
    """Queries of a block."""
    return max(1, min(max(16, QUERY_BYTES // (8 * max(1, width or 1))), HITS // (k * len(variants))))


def _dealt(blocks: DataFrame) -> DataFrame:
    """Blocks that a join shuffles.  Spark takes a block for 100 bytes and would broadcast any number of them through
    the driver."""
    return blocks.hint("merge")


def _picked(points: DataFrame, payload: tuple[str, ...], *more: Column) -> DataFrame:
    extra = [c for c in payload if c not in ("ts", "source", "camera_id")]
    return points.where("vector is not null").select("id", "vector", "ts", "source", "camera_id", *extra, *more)


def _ranked(hits: DataFrame, k: int, payload: tuple[str, ...]) -> DataFrame:
    """The best of the best rows of tasks; points outside the window only where none is inside."""
    by = ("query_id", "variant", "in_window")
    order = (F.desc("score"), "id")
    parts = int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if parts >= MERGE:
        salted = hits.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(int(parts**0.5))))
        some = F.row_number().over(W.partitionBy(*by, "salt").orderBy(*order))
        hits = salted.withColumn("pos", some).where(F.col("pos") <= k).drop("salt", "pos")
    ranked = hits.withColumn("pos", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("pos") <= k)
    any_inside = F.max("in_window").over(W.partitionBy("query_id", "variant"))
    picked = ranked.withColumn("any", any_inside).where(F.col("in_window") == F.col("any"))
    return picked.select("id", *payload, "query_id", "variant", "score", "pos", (~F.col("any")).alias("time_dropped"))


def _bytes(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def _table(held: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(held.as_buffer()).read_all()


def _query_blocks(queries: DataFrame, most: int) -> DataFrame:
    """``key, queries``: the queries of a key in blocks of at most ``most``."""

    def run(rows: pa.Table) -> pa.Table:
        key, rows = rows["key"][0], rows.drop_columns(["key"])
        blocks = [_bytes(rows.slice(i, most)) for i in range(0, len(rows), most)]
        return pa.table({"key": pa.array([key.as_py()] * len(blocks), pa.string()), "queries": pa.array(blocks, pa.binary())})

    return queries.groupBy("key").applyInArrow(run, "key string, queries binary")


def _point_blocks(points: DataFrame, shares: int) -> DataFrame:
    """``key, share, points``: the points of a task and key in blocks of about ``POINTS``."""

    def run(it: Iterator[pa.RecordBatch]):
        held: dict[str, list[pa.Table]] = {}
        number = 0

        def block(key: str):
            nonlocal number
            number += 1
            rows = pa.concat_tables(held.pop(key)).sort_by("id").combine_chunks()
            return pa.RecordBatch.from_arrays(
                [pa.array([key], pa.string()), pa.array([number % shares], pa.int32()), pa.array([_bytes(rows)], pa.binary())], names=["key", "share", "points"]
            )

        for batch in it:
            rows = pa.Table.from_batches([batch])
            for key in pa.compute.unique(rows["key"]).to_pylist():
                mine = rows.filter(pa.compute.equal(rows["key"], key)).drop_columns(["key"])
                for i in range(0, len(mine), POINTS):
                    held.setdefault(key, []).append(mine.slice(i, POINTS))
                    if sum(map(len, held[key])) >= POINTS:
                        yield block(key)
            while sum(len(t) for ts in held.values() for t in ts) > 16 * POINTS:  # many keys at once
                yield block(max(held, key=lambda key: sum(map(len, held[key]))))
        for key in list(held):
            yield block(key)

    import pyarrow.compute  # noqa: F401  (pa.compute)

    return points.mapInArrow(run, "key string, share int, points binary")


def _matrix(vectors: pa.ChunkedArray, rows: int) -> np.ndarray:
    """Vectors of one length as unit rows."""
    flat = vectors.combine_chunks()
    flat = flat.flatten() if not isinstance(flat, pa.ChunkedArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return unit_rows(flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1))


class _Queries:
    """A block of queries, as arrays, and their best hits so far.

    A hit is a group (variant, window state and query), a score and the place of its point in a table of all points
    among the hits."""

    def __init__(self, held: pa.Scalar, k: int, variants: tuple[str, ...]):
        t = _table(held)
        self.ids = t["query_id"].combine_chunks()
        self.vectors = _matrix(t["vector"], len(t))
        self.camera = t["camera_id"].to_pylist()
        ends = [t[c].to_pylist() for c in ("ts_from", "ts_to")]
        self.bounded = np.array([a is not None or z is not None for a, z in zip(*ends)], bool)
        self.start = np.array([-np.inf if a is None else a for a in ends[0]])
        self.end = np.array([np.inf if z is None else z for z in ends[1]])
        self.k, self.variants = k, variants
        #: Least score that can be among the best, by variant, window state (1 is inside) and query.
        self.least = np.full((len(variants), 2, len(t)), -np.inf)
        self.hits: list[tuple[np.ndarray, ...]] = []
        self.points: list[pa.Table] = []
        self.n_hits = self.n_points = 0

    def add(self, part: pa.Table, found: list[tuple[np.ndarray, ...]]) -> None:
        """``found``: groups, scores and rows of ``part``."""
        group, score, row = map(np.concatenate, zip(*found))
        used, place = np.unique(row, return_inverse=True)
        self.points.append(part.take(pa.array(used)))
        self.hits.append((group, score, self.n_points + place))
        self.n_hits, self.n_points = self.n_hits + len(group), self.n_points + len(used)
        if self.n_hits > 4 * self.k * len(self.ids) * len(self.variants):
            self.settle()

    def settle(self) -> None:
        """Keeps the first ``k`` hits of each group, in order."""
        group, score, place = map(np.concatenate, zip(*self.hits))
        points = pa.concat_tables(self.points).combine_chunks()
        rank = np.empty(len(points), np.int64)
        rank[points.select(["id"]).add_column(0, "n", pa.array(np.arange(len(points)))).sort_by("id")["n"].to_numpy()] = np.arange(len(points))
        order = np.lexsort((rank[place], -score, group))
        group, score, place = group[order], score[order], place[order]
        start = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        pos = np.arange(len(group)) - np.repeat(start, np.diff(np.append(start, len(group))))
        last, kept = pos == self.k - 1, pos < self.k
        self.least.flat[group[last]] = score[last]
        used, place = np.unique(place[kept], return_inverse=True)
        self.points = [points.take(pa.array(used))]
        self.hits = [(group[kept], score[kept], place)]
        self.n_hits, self.n_points = len(place), len(used)

    def given(self) -> Iterator[pa.RecordBatch]:
        """The hits with their points, without those outside the window of queries that have some inside."""
        if not self.hits:
            return
        self.settle()
        group, score, place = self.hits[0]
        v, inside, q = np.unravel_index(group, self.least.shape)
        some = np.zeros((len(self.variants), len(self.ids)), bool)
        some[v[inside == 1], q[inside == 1]] = True
        names, points = pa.array(self.variants, pa.string()), self.points[0]
        shown = np.flatnonzero((inside == 1) | ~some[v, q])
        for i in range(0, len(shown), 10_000):
            s = shown[i : i + 10_000]
            rows = points.take(pa.array(place[s]))
            for name, column in (
                ("in_window", pa.array(inside[s] == 1)), ("score", pa.array(score[s])),
                ("query_id", self.ids.take(pa.array(q[s]))), ("variant", names.take(pa.array(v[s]))),
            ):
                rows = rows.append_column(name, column)
            yield from rows.combine_chunks().to_batches()


def _first(hit: np.ndarray, raw: np.ndarray, k: int, digits: int, least: np.ndarray) -> None:
    """Leaves at most ``k`` hits in each row, the best ones, of equal scores the first; raises ``least`` to the score of the
    last of them."""
    many = np.flatnonzero(np.count_nonzero(hit, axis=1) > k)
    if len(many):
        s = np.where(hit[many], np.round(raw[many], digits), -np.inf)
        kth = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        above, level = s > kth[:, None], s == kth[:, None]
        room = k - np.count_nonzero(above, axis=1)
        hit[many] = above | (level & (np.cumsum(level, axis=1) <= room[:, None]))
        least[many] = np.maximum(least[many], kth)


def _meet(pairs: DataFrame, points: DataFrame, k: int, variants: tuple[str, ...], payload: tuple[str, ...], digits: int, hold: bool) -> DataFrame:
    """Best rows of each task for every query and variant, inside the window and, for queries that have one and
    nothing inside it in this task, outside it, from pairs of blocks.  A query without a window has every point inside.

    ``hold``: the blocks of queries are few, and all are kept until the task ends; else those of one key.
    """
    hit = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in _picked(points, payload).drop("vector").schema.fields)

    def scores(q: _Queries, part: pa.Table, x: np.ndarray, a: int, z: int):
        """Best hits of a block of points for queries a to z - 1."""
        raw = q.vectors[a:z] @ x.T
        ts = np.asarray(part["ts"].to_numpy(), float)
        cameras = np.array(part["camera_id"].to_pylist(), object)
        of_camera = {c: np.ones(len(part), bool) if c is None else cameras == c for c in set(q.camera[a:z])}
        fits = None if [*of_camera] == [None] else np.array([of_camera[c] for c in q.camera[a:z]])
        sources = np.array(part["source"].to_pylist(), object)
        bounded, row = q.bounded[a:z], np.arange(z - a)
        # queries whose window may hold some of the points; points without time are in none
        timed = ts[~np.isnan(ts)]
        touched = np.flatnonzero(bounded & (len(timed) > 0) & (q.start[a:z] <= timed.max(initial=-np.inf)) & (q.end[a:z] >= timed.min(initial=np.inf)))
        inside = (ts >= q.start[a:z][touched, None]) & (ts <= q.end[a:z][touched, None])
        slack = 10.0**-digits
        for v, variant in enumerate(variants):
            least = q.least[v, :, a:z]
            of = None if variant == "all" else sources == variant

            def best(state: np.ndarray, rows: np.ndarray, raw: np.ndarray, fit: np.ndarray | None):
                """Of all rows with their window states."""
                bound = least[state, rows]
                hit = raw >= (bound - slack)[:, None]
                for mask in (fit, of, None if fits is None else fits[rows]):
                    if mask is not None:
                        hit &= mask
                _first(hit, raw, k, digits, bound)
                least[state, rows] = bound
                i, j = np.divmod(np.flatnonzero(hit), hit.shape[1])
                score = np.round(raw[i, j], digits)
                good = (score >= bound[i]) & (score > -np.inf)
                i, j = i[good], j[good]
                return np.ravel_multi_index((np.full(len(i), v), state[i], a + rows[i]), q.least.shape), score[good], j

            if len(touched):
                yield best(np.ones(len(touched), int), touched, raw[touched], inside)
            outer = None
            if inside.any():
                outer = np.ones(raw.shape, bool)
                outer[touched] = ~inside
            yield best(1 - bounded.astype(int), row, raw, outer)

    def run(it):
        held: dict[bytes, _Queries] = {}
        of = None
        for batch in it:
            for key, asked, packed in zip(batch["key"], batch["queries"], batch["points"]):
                name = asked.as_py()
                if not hold and (key != of or name not in held and len(held) >= HELD):
                    for q in held.values():
                        yield from q.given()
                    held.clear()
                of = key
                if name not in held:
                    held[name] = _Queries(asked, k, variants)
                q, part = held[name], _table(packed)
                x, part = _matrix(part["vector"], len(part)), part.drop_columns(["vector"])
                found = [f for a in range(0, len(q.ids), QUERIES) for f in scores(q, part, x, a, min(a + QUERIES, len(q.ids))) if len(f[0])]
                if found:
                    q.add(part, found)
        for q in held.values():
            yield from q.given()

    # a batch that goes to Python holds few blocks
    pairs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    return pairs.select("key", "queries", "points").mapInArrow(run, f"{hit}, in_window boolean, score double, query_id string, variant string")


def write_cells(points: DataFrame, path: str, cell_s: float = CELL_S) -> None:
    """Stores an index by camera and time cell of ``cell_s`` seconds, a folder for each, for ``cell_top_k``.

    Beside the points, ``_cells`` has a row for each cell: ``cell, camera_id, number, ts_min, ts_max, n``.  Points
    without ``ts`` are in cells without number.  A cell of many points is written by several tasks.
    """
    number = F.floor(F.col("ts") / cell_s)
    name = F.concat(F.coalesce("camera_id", F.lit("")), F.lit("@"), F.coalesce(number.cast("string"), F.lit("none")))
    named = points.withColumn("cell", name)
    named.repartitionByRange(F.col("cell"), F.col("ts"), F.col("id")).sortWithinPartitions("cell", "ts").write.partitionBy("cell").parquet(path)
    cells = points.sparkSession.read.parquet(path).groupBy("cell", "camera_id", F.floor(F.col("ts") / cell_s).alias("number"))
    cells = cells.agg(F.min("ts").alias("ts_min"), F.max("ts").alias("ts_max"), F.count(F.lit(1)).alias("n"), F.lit(float(cell_s)).alias("cell_s"))
    cells.write.parquet(f"{path}/_cells")


def touched_cells(spark: SparkSession, path: str, queries: DataFrame) -> DataFrame:
    """``cell`` and the columns of ``queries`` for every cell of a stored index that a query's window and camera touch."""
    cells = spark.read.parquet(f"{path}/_cells").where("number is not null")
    first, last, cell_s = cells.agg(F.min("number"), F.max("number"), F.max("cell_s")).first()
    if first is None:
        return queries.withColumn("cell", F.lit("")).where(F.lit(False))
    a = F.greatest(F.coalesce(F.floor(F.col("ts_from") / cell_s), F.lit(first)), F.lit(first))
    z = F.least(F.coalesce(F.floor(F.col("ts_to") / cell_s), F.lit(last)), F.lit(last))
    spread = queries.withColumn("number", F.explode(F.when(a <= z, F.sequence(a, z))))
    named = cells.select("cell", F.col("camera_id").alias("of"), "number", "ts_min", "ts_max")
    met = spread.join(named, "number").where(F.col("camera_id").isNull() | (F.col("camera_id") == F.col("of")))
    met = met.where((F.col("ts_min") <= F.coalesce("ts_to", "ts_min")) & (F.col("ts_max") >= F.coalesce("ts_from", "ts_max")))
    return met.select("cell", *queries.columns)


def cell_points(spark: SparkSession, path: str, cells: DataFrame) -> DataFrame:
    """The points of a stored index in ``cells`` (``cell``, distinct), of which no other folder is read."""
    names = [r["cell"] for r in cells.limit(BROADCAST_CELLS + 1).collect()]  # names of folders, which the driver lists anyway
    stored = spark.read.parquet(path)
    if len(names) > BROADCAST_CELLS:
        return stored.join(cells, "cell", "left_semi")
    return stored.where(F.col("cell").isin(names)) if names else stored.where(F.lit(False))


def cell_top_k(
    spark: SparkSession,
    path: str,
    queries: DataFrame,
    k: int,
    variants: tuple[str, ...] = ("all",),
    payload: tuple[str, ...] = ("video_id", "frame_idx", "offset_s", "ts", "source", "yolo_class"),
    digits: int = 6,
) -> DataFrame:
    """``top_k`` over an index that ``write_cells`` stored: the same rows, but a query with a time window meets only
    points of the cells that its window and camera touch, and other cells' files are not read.

    Queries without a window, and those for whose window a variant has no point, are answered by a scan of all points, if
    there are any.
    """
    asked = cut(_asked(queries), "queries")
    bounded = F.col("ts_from").isNotNull() | F.col("ts_to").isNotNull()
    met = cut(touched_cells(spark, path, asked.where(bounded)), "cells")
    stored = cell_points(spark, path, met.select("cell").distinct())
    width = asked.agg(F.max(F.size("vector"))).first()[0]
    sought = _query_blocks(met.select(*asked.columns, F.col("cell").alias("key")), _block(width, k, variants))
    packed = _point_blocks(_picked(stored, payload, F.col("cell").alias("key")), 1)
    inside = _meet(packed.join(_dealt(sought), "key"), stored, k, variants, payload, digits, hold=False).where("in_window")
    inside = cut(_ranked(inside, k, payload), "inside")
    answered = inside.select("query_id", "variant").distinct()
    pairs = asked.where(bounded).select("query_id").distinct().withColumn("variant", F.explode(F.array(*[F.lit(v) for v in variants])))
    empty = cut(pairs.join(answered, ["query_id", "variant"], "left_anti"), "empty")
    without = asked.join(empty.select("query_id").distinct(), "query_id", "left_semi")
    without = without.withColumns({c: F.lit(None).cast("double") for c in ("ts_from", "ts_to")})
    rest = asked.where(~bounded).unionByName(without.where(F.lit(not empty.isEmpty())))
    if rest.isEmpty():
        return inside
    over_all = top_k(spark.read.parquet(path), rest, k, variants, payload, digits)
    dropped = over_all.join(empty.withColumn("dropped", F.lit(True)), ["query_id", "variant"], "left")
    windowed = asked.where(bounded).select("query_id").distinct().withColumn("windowed", F.lit(True))
    dropped = dropped.join(windowed, "query_id", "left").where(F.col("windowed").isNull() | F.col("dropped"))
    return inside.unionByName(dropped.withColumn("time_dropped", F.coalesce("dropped", F.lit(False))).select(*inside.columns))
