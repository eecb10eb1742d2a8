import compare
import corpus_pipeline
import pytest
from helpers import table, words
from pyspark.sql import functions as F

from sightline.llm import queries as llm


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_matches_sql(spark, sf_dir, name):
    compare.same(llm.queries()[name], llm.oracle_sql()[name], spark, sf_dir)


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in llm.queries()) == list(range(1, 14))


def test_stages(spark, tmp_path):
    """What each stage keeps and drops, on planted rows."""
    english = "the quick brown fox and the lazy dog are in this house with all of their friends and family {} "
    german = "der schnelle braune fuchs und der faule hund sind mit allen ihren freunden in diesem haus {} "
    rows = [(i, (english if i % 2 else german).format(i) + words(30, 1000 * i), "en" if i % 2 else "de", "s") for i in range(60)]
    near = rows[7][1] + " once more"
    leaked = english.format("x") + words(12, 900_000)
    rows += [(100, None, None, "s"), (101, "123 456", None, "s"), (102, near, None, "s"), (103, leaked, "en", "s"), (104, rows[8][1], "de", "s")]
    docs = table(spark, rows, "doc_id long, text string, lang string, source string")
    columns = docs.columns
    sf = str(tmp_path)
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, words(12, 900_000)), (2, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 3)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    want = set(range(60)) | {102, 103, 104}
    for (name, stage), gone in zip(corpus_pipeline.STAGES[:4], [set(), {102, 104}, {103}, set()]):
        docs = stage(spark, docs, sf)
        docs.write.parquet(f"{sf}/{name}")
        docs = spark.read.parquet(f"{sf}/{name}")
        want -= gone
        assert docs.columns == columns
        assert {r.doc_id for r in docs.collect()} == want, name
    assert {r.lang for r in docs.collect()} == {"en", "de"}
    last = corpus_pipeline.STAGES[4][1](spark, docs, sf)
    assert last.count() == docs.count()


def test_different_texts_of_one_id_or_none_stay(spark):
    a, b, c, d = (words(40, 1000 * i) for i in range(4))
    rows = [(5, a), (5, b), (None, c), (None, d), (None, c), (7, a + " more"), (None, b), (5, a), (None, None), (8, None), (8, "")]
    docs = table(spark, rows)
    got = corpus_pipeline.one_of_each_group(spark, docs, "")
    want = {(5, a), (5, b), (None, c), (None, d), (None, None), (8, None), (8, "")}
    assert got.columns == docs.columns and sorted(map(str, [(r.doc_id, r.text) for r in got.collect()])) == sorted(map(str, want))


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 100


def test_stages_take_nothing(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0



def test_rows_without_id_keep_their_own_language(spark):
    """Also with a map column and a text of ten million characters."""
    english = "the quick brown fox and the lazy dog are in this house with all of their friends and family "
    german = "der schnelle braune fuchs und der faule hund sind mit allen ihren freunden in diesem haus "
    rows = [(i, english if i % 2 else german, "en" if i % 2 else "de", {"a": i}) for i in range(40)]
    rows += [(None, "12 34", None, {}), (None, "", None, None), (None, german, None, {"b": 1}), (None, english, None, None), (99, german * 110_000, None, {})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, more map<string, int>")
    kept = corpus_pipeline.keep_known_languages(spark, docs, "")
    assert kept.columns == docs.columns
    got = kept.where("doc_id is null or doc_id = 99").select("doc_id", F.length("text").alias("n"), "lang", "more").collect()
    assert sorted((str(r.doc_id), r.n, r.lang) for r in got) == [("99", len(german) * 110_000, "de"), ("None", len(german), "de"), ("None", len(english), "en")]
    once = corpus_pipeline.one_of_each_group(spark, kept.where("doc_id is null").unionByName(kept.where("doc_id is null")), "")
    assert sorted(r.lang for r in once.collect()) == ["de", "en"] and {str(r.more) for r in once.collect()} == {"{'b': 1}", "None"}
