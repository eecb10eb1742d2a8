"""Token counts and token files against the tokenizer library."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import awkward, table

from sightline.llm import token_counts, token_files
from sightline.llm.tokens import Encoder

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
TEXTS = [
    "", "  ", " a", "a  b", "x   y", "a\n\n b  ", "it's  we're\tI'LL", "<|endoftext|> a <|endoftext|>b", "é́ ÀB ΣΑΣ İx",
    "\x1c a\x1cb", "12 345  6789", "a  \n  b\r\n", "x  y   z", "Word, word... (word)!?   q", "<|STARTOFTEXT|>A",
]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_ids_are_the_library_s(path):
    e = Encoder(path)
    ids, n = e.encode(TEXTS)
    want = [e.t.encode(t, add_special_tokens=False).ids for t in TEXTS]
    assert n.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


def test_every_prefix():
    e = Encoder(BYTES)
    texts = TEXTS + ["\u4f60\u597d\u4e16\u754c\u3002" * 30 + " end", "x" * 300 + " y", "a\xa0b" * 60, "'s" * 50, "\U0001f600\U0001f601 \ud7ff z"]
    for text, c in zip(texts, token_counts.prefix_counts(texts, e)):
        want = [len(e.t.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
        assert [c.at(i) for i in range(len(want))] == want and c.total == want[-1]
        assert all(want[i] == t for t, i in enumerate(c.ends.tolist()) if i >= 0)
        for budget in range(c.total + 2):
            assert want[c.longest(budget)] <= budget
        assert c.longest(c.total) == len(text)


def test_memory_is_bounded_by_bytes(monkeypatch):
    from sightline.llm import tokens

    monkeypatch.setattr(tokens, "REMEMBERED", 10_000)
    e = Encoder(BYTES)
    for i in range(5):
        text = " ".join(f"w{i}x{j}" for j in range(50)) + " " + "\u4f60" * 3000
        assert e.encode([text])[0].tolist() == e.t.encode(text, add_special_tokens=False).ids
        assert e.bytes <= 10_000 + 20_000


def test_token_counts(spark):
    rows = awkward() + [(4, "x"), (None, "y z"), (30, "a\xa0b " * 40)]
    t = Encoder(BYTES).t
    got = token_counts.token_counts(table(spark, rows), BYTES, limit=30, tables=True).collect()
    count = lambda x: len(t.encode(x or "", add_special_tokens=False).ids)
    want = sorted((str(i), len((x or "").encode()), count(x)) for i, x in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 30) and len(r.prefix_ends) == r.n_tokens + 1 for r in got)
    cut = {r.doc_id: r.cut_chars for r in token_counts.token_counts(table(spark, rows), BYTES, limit=30).collect()}
    assert cut == {r.doc_id: r.cut_chars for r in got}
    words = token_counts.token_counts(table(spark, rows), WORDS, limit=3).collect()
    assert all(r.cut_chars is None and r.over_limit == (r.n_tokens > 3) for r in words)
    for i, x in rows:
        if i not in (4, 9):
            x = x or ""
            assert count(x[: cut[i]]) == min(30, count(x))


def test_token_files_round_trip(spark, tmp_path):
    rows = awkward() + [(i, f"text number {i} of many " * 20) for i in range(100, 160)]
    out = str(tmp_path / "files")
    token_files.write_token_files(table(spark, rows), WORDS, out, parts=3)
    t, at, want = Encoder(WORDS).t, 0, {}
    for i, x in sorted(rows):
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        want[i] = (at, len(ids), ids)
        at += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids) for r in token_files.read_token_files(spark, out).collect()}
    assert got == want
    sums = {r.doc_id: r.ids_crc32 for r in token_files.token_checksums(spark, out).collect()}
    assert sums == {i: zlib.crc32(np.array(w[2], "<u4").tobytes()) for i, w in want.items()}
    assert token_files.read_document(spark, out, 110) == [want[110][2]] and token_files.read_document(spark, out, 5000) == []


def test_token_files_of_repeats_and_nothing(spark, tmp_path):
    out = str(tmp_path / "repeats")
    token_files.write_token_files(table(spark, [(1, "a"), (1, "a"), (None, None)]), WORDS, out)
    assert sorted((str(r.doc_id), r.n_tokens) for r in token_files.read_token_files(spark, out).collect()) == [("1", 2), ("1", 2), ("None", 1)]
    out = str(tmp_path / "nothing")
    token_files.write_token_files(table(spark, []).where("false"), WORDS, out)
    assert token_files.read_token_files(spark, out).count() == 0


def test_other_dictionary_is_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        token_files._decoder(b"x", "0" * 64)


def test_every_prefix_of_odd_strings():
    """With blank runs, line feeds and contractions: the table against the library at every prefix."""
    import random

    e, r = Encoder(public_tokenizers.path("byte_bpe_50k.json")), random.Random(1)
    bits = ["hello", "world", "\n\n", "\n", " ", "  ", "   ", "\t", "\r\n", "don't", "we're", "'s", "'", "I'll", "1234", "é", "ß𝄞", "…", "!!", "\u2003", "end of one.", "Next part"]
    for _ in range(1000):
        text = "".join(r.choice(bits) for _ in range(r.randrange(1, 9))) + (" " * 70 if r.random() < 0.05 else "") + r.choice(bits)
        p = next(token_counts.prefix_counts([text], e))
        for chars in range(len(text) + 1):
            assert p.at(chars) == len(e.t.encode(text[:chars], add_special_tokens=False).ids), (text, chars)
