"""Exact deduplication by skew-safe combining of full texts.

Three combining stages, each grouping by digest *and* whole text, so that no decision rests on a
digest alone:

1. local: every map task reduces its own rows of one text to one row (partial aggregation);
2. salted: those rows meet by (digest, salt, text), where the salt is the map task's number, so a
   text that fills a third of the table is spread over ``salts`` reducers;
3. global: the few salt winners of a text meet by (digest, text).

Every row then looks its winner up by digest.  The winners are a stored table without texts, so
this last join is plain and Spark may split a hot digest over many tasks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline.llm.spread import join_spread
from sightline.sources.work import cut


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32
) -> DataFrame:
    """Groups of identical texts.

    Result: one row for each input row: ``doc_id``, ``keep_id`` (largest id of the group),
    ``group_size`` (rows of the group), ``kept`` and ``text_sha256`` (lowercase hex).

    Null texts count as empty; they form one group with empty texts.  A null id loses against any
    other id; a group of null ids only keeps a null id.  Of repeated rows with the winning id all
    are marked kept, since they cannot be told apart.  An empty table gives an empty result.  A very
    long text is hashed and compared whole, as one value.  Other columns are ignored, whatever their
    names.  Rows of a large group find their winner in several tasks.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")
    )
    digest = F.unhex(F.sha2(F.col("t"), 256))
    salted = (
        rows.withColumns({"d": digest, "salt": F.pmod(F.spark_partition_id(), F.lit(salts))})
        .groupBy("d", "salt", "t")
        .agg(F.max("doc_id").alias("k"), F.count(F.lit(1)).alias("n"))
    )
    winners = salted.groupBy("d", "t").agg(F.max("k").alias("keep_id"), F.sum("n").alias("group_size"))
    # Two texts of one digest would both be winners of it; the length and a second hash go along
    # so that a row still finds its own.
    winners = cut(
        winners.select(
            F.struct("d", F.octet_length("t").alias("len"), F.xxhash64("t").alias("x")).alias("key"), "keep_id", "group_size"
        ),
        "exact_winners",
    )
    looked = rows.select(
        "doc_id", F.struct(digest.alias("d"), F.octet_length("t").alias("len"), F.xxhash64("t").alias("x")).alias("key")
    )
    looked = join_spread(looked, winners, "key", winners.select("key", F.col("group_size").alias("rows")))
    return looked.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("key.d")).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one for each distinct text.

    Of repeated rows with the winning id and text one stays, chosen by a hash of its columns.  Rows are looked up by
    id and text, so those of one id, or of none, with different texts are judged by their own texts; null and empty
    texts are one text.  A very long text is compared by its digests and length.  An empty table gives none.
    """
    # none of the input's columns has these names
    one, of, digest = (f"{n}_{uuid.uuid4().hex}" for n in ("one", "of", "digest"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    keep = exact_groups(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias(of), F.unhex("text_sha256").alias(digest)).distinct()
    named = docs.withColumn(one, F.unhex(F.sha2(text, 256)))
    same = F.col(one).eqNullSafe(F.col(digest)) & named[id_col].cast("long").eqNullSafe(F.col(of))
    winners = named.join(keep, same, "left_semi")
    # a hash of each row tells repeated rows apart, whatever their columns' types
    order = F.hash(*[F.col(c) for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind])
    row = F.row_number().over(W.partitionBy(one, F.col(id_col).cast("long")).orderBy(F.col(text_col).isNull(), order))
    return winners.withColumn(of, row).where(F.col(of) == 1).drop(one, of)


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
