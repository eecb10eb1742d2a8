"""A corpus from raw documents to token files, one stored stage after another.

Every stage takes ``(spark, docs, sf_dir)``.  All but the last return documents with the columns of
``documents``; the last returns the index of the token files.

In every stage: an empty table gives an empty one; very long texts are read whole; nulls in columns that
a stage does not decide by are kept as they are; further columns stay, whatever their names.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import decontaminate, jaccard_join, language_id, mixing, token_files
from sightline.sources.work import remove, work_dir

#: Documents whose most likely language is less likely than this are rejected.
LEAST_SCORE = 0.4


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that the classifier knows; texts that are null, have no letters or
    resemble no language go.  ``lang`` becomes the prediction where it was null.  Every row is judged by its own text,
    whatever its id; repeated rows share their fate."""
    learned = language_id.train(docs.where(~language_id.held_out(docs["doc_id"])))
    pred, score = (f"{n}_{uuid.uuid4().hex}" for n in ("pred", "score"))  # no column of the input has these names
    judged = language_id.predict(docs, learned, keep=(pred, score))
    kept = judged.where((F.col(pred) != language_id.UNKNOWN) & (F.col(score) >= LEAST_SCORE) & F.col("text").rlike(r"\p{L}"))
    return kept.select(*[F.coalesce("lang", F.col(pred)).alias("lang") if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8): that with the group's
    smallest id, and of its texts under that id any fixed one.  A null id comes last.

    Rows are told apart by id and text (a 64-bit hash of both), so rows of one id, or of none, with
    different texts are in the groups of their texts.  Of rows that repeat both, one stays, chosen
    by a hash of its columns."""
    row, number, group = (f"{n}_{uuid.uuid4().hex}" for n in ("row", "id", "group"))  # no column of the input has these names
    hashed = F.xxhash64(docs["doc_id"].cast("long"), docs["text"])
    groups = jaccard_join.jaccard_components(docs.withColumn(row, hashed), k=5, percent=80, id_col=row).select(
        F.col("doc_id").alias(row), F.col("component_id").alias(group)
    )
    ids = docs.select(hashed.alias(row), docs["doc_id"].cast("long").alias(number)).distinct()
    first = ids.join(groups.distinct(), row).groupBy(group).agg(
        F.min(F.struct(F.col(number).isNull(), number, row))[row].alias(row)
    )
    kept = docs.join(first.select(F.col(row).alias(group)).distinct(), hashed == F.col(group), "left_semi")
    # of repeated rows that with the smallest hash of all columns; columns that have no order are left out of it
    plain = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    picked = kept.groupBy(hashed.alias(row)).agg(F.min_by(F.struct(*[docs[c] for c in docs.columns]), F.xxhash64(*plain)).alias(group))
    return picked.select(f"{group}.*")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item.  Null and empty texts hold none and stay; repeated
    rows share their fate; rows of one id, or of none, are judged by their own texts."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    _, occurrences = decontaminate.contained_windows(docs, benchmark)
    hit = occurrences.select("doc_id", "x").distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(hit["doc_id"]) & (
        F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == hit["x"]
    )
    return docs.join(hit, same, "left_anti")


def to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its rate in the mix says.  Null and empty texts have no tokens and the
    rate of an average document; repeated rows are each rated alike."""
    return mixing.mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def to_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the documents, and their index as read back: ``doc_id, start, n_tokens, ids_crc32``.
    Null and empty texts are the end id alone; rows without id come first; repeated rows each have their
    frame."""
    out = f"{work_dir(spark)}/pipeline-tokens-{uuid.uuid4().hex}"
    token_files.write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), out)
    return token_files.token_checksums(spark, out)


STAGES = [
    ("language_id", keep_known_languages),
    ("jaccard_join", one_of_each_group),
    ("decontaminate", without_benchmark),
    ("mixing", to_target_weights),
    ("token_files", to_token_files),
]

#: The classifiers and similarity groups can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = f"{work_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                remove(spark, before)  # nothing reads it any more
            before = path
    return docs
