"""Every operator on texts of ten million characters."""

import public_tokenizers
import pytest
from helpers import table, words

from sightline.llm import decontaminate, exact_dedup, jaccard_join, language_id, licenses, mixing, substring_dedup, token_counts, token_files

N = 1_100_000


@pytest.fixture(scope="module")
def docs(spark):
    long = " ".join(f"x{i % 977}y{i}" for i in range(N))
    rows = [(1, long, "en"), (2, long + " mit license", "en"), (3, None, "de"), (4, words(30), "en")]
    df = table(spark, rows, "doc_id long, text string, lang string")
    return df, {i: t for i, t, _ in rows}


def test_exact_groups(docs):
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_groups(docs[0]).collect()}
    assert got == {i: (i, 1) for i in range(1, 5)}


def test_jaccard_and_substrings(docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs[0]).collect()}
    assert got == {1: (N - 4, 1), 2: (N - 2, 1), 3: (0, 3), 4: (26, 4)}
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(docs[0]).select("doc_id", "n_words", "n_removed").collect()}
    assert got == {1: (N, 0), 2: (N + 2, N), 3: (0, 0), 4: (30, 0)}


def test_licenses_and_benchmark(spark, docs):
    got = {r.doc_id: (r.n_words, r.first_word, r.labels) for r in licenses.license_scan(docs[0]).collect()}
    assert got == {1: (N, None, ""), 2: (N + 2, N, "mit"), 3: (0, None, ""), 4: (30, None, "")}
    item = " ".join(docs[1][1].split()[-12:])
    got = {r.doc_id: (r.n_words, r.n_hit) for r in decontaminate.contamination(docs[0], spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {1: (N, 12), 2: (N + 2, 12), 3: (0, 0), 4: (30, 0)}


def test_tokens(spark, docs, tmp_path):
    from sightline.llm.tokens import Encoder

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Encoder(path).t
    want = {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in docs[1].items()}
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs[0], path).collect()} == want
    out = str(tmp_path / "files")
    token_files.write_token_files(docs[0], path, out, end_id=50256)
    assert {r.doc_id: r.n_tokens - 1 for r in token_files.token_checksums(spark, out).collect()} == want


def test_models(spark, docs):
    assert {r.doc_id for r in language_id.language_id(docs[0]).collect()} == {1, 2, 3, 4}
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.n_tokens for r in mixing.mixing_rates(docs[0], labels).collect()} == {1: N, 2: N + 2, 3: 0, 4: 30}
