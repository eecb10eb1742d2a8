"""Exact token counts at every prefix of a text, from one encoding of it.

The table of a text is filled left to right: entry t + 1 is entry t and the characters of token t.  A
prefix of whole tokens has as many tokens as the table says, as no merge is made across its end, unless it
ends with several blanks: what follows them decides how they are parted, so these are counted as they are
at the end of a text, from the run of blanks alone.  Questions about truncation and budgets are answered from the
table; only a prefix that ends inside a token or with several blanks costs a short encoding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sightline.llm.tokens import SAFE, Encoder, batches, encoder
from sightline.llm.workers import bound_batches


#: Characters at a prefix's end that are looked at first for blanks.
BLANKS = 64


@dataclass
class PrefixCounts:
    """``ends[t]``: characters of the first t tokens, or -1 if token t ends inside a character."""

    text: str
    ends: np.ndarray
    encoder: Encoder

    @property
    def total(self) -> int:
        return len(self.ends) - 1

    def _blanks(self, run: str) -> int:
        return len(self.encoder.t.encode(run, add_special_tokens=False).ids)

    def longest(self, budget: int) -> int:
        """Characters of the first ``budget`` tokens of the text, up to the last that ends between two characters: a
        prefix with at most ``budget`` tokens."""
        return int(self.ends[: max(0, min(budget, self.total)) + 1].max())

    def at(self, chars: int) -> int:
        """Tokens of ``text[:chars]``.  Only a prefix that ends inside a token costs an encoding, of what
        lies behind the last blank between two whole tokens, or one that ends with several blanks, of these."""
        chars = max(0, min(chars, len(self.text)))
        solid = len(self.text[max(0, chars - BLANKS) : chars].rstrip())
        run = min(chars, BLANKS) - solid
        if run > 1 and chars < len(self.text):
            begin = chars - run
            while begin and self.text[begin - 1].isspace():
                begin -= 1
            return self.at(begin) + self._blanks(self.text[begin:chars])
        whole = np.flatnonzero((self.ends >= 0) & (self.ends <= chars))
        if self.ends[whole[-1]] == chars:
            return int(whole[-1])
        for t in whole[::-1].tolist():
            b = int(self.ends[t])
            if b == 0 or SAFE.match(self.text, b):
                return t + len(self.encoder.t.encode(self.text[b:chars], add_special_tokens=False).ids)
        raise AssertionError("the empty prefix has an entry")


def prefix_counts(texts: list[str], encoder: Encoder) -> Iterator[PrefixCounts]:
    ends, n = encoder.prefix_ends(texts)
    for text, e in zip(texts, np.split(ends, np.cumsum(n)[:-1])):
        yield PrefixCounts(text, e, encoder)


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    limit: int = 1024,
    tables: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row for each document row: ``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens``,
    ``over_limit`` (more than ``limit`` tokens) and ``cut_chars``: characters of the longest prefix
    of whole tokens that has at most ``limit`` of them (null for vocabularies that drop white space).

    With ``tables`` also the prefix table itself: ``prefix_ends`` (array: characters of the first 0,
    1, 2, ... tokens, -1 where a token ends inside a character).  Null and empty texts have no bytes and no tokens.  Rows are independent of each other
    and nothing is shuffled: repeated rows each keep theirs, an empty table gives none, and a very
    long text is read whole, in a batch of its own.  Other columns are not looked at.
    """
    fields = [
        ("doc_id", pa.int64()),
        ("n_bytes", pa.int64()),
        ("n_tokens", pa.int64()),
        ("over_limit", pa.bool_()),
        ("cut_chars", pa.int64()),
    ]
    ddl = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, cut_chars long"
    if tables:
        fields.append(("prefix_ends", pa.list_(pa.int64())))
        ddl += ", prefix_ends array<long>"
    schema = pa.schema(fields)

    def run(it):
        enc = encoder(tokenizer_path)
        for b in it:
            lengths = pa.compute.binary_length(b.column(1)).fill_null(0)
            for i, j in batches(lengths.to_pylist(), 4_000_000):
                texts = [t or "" for t in b.column(1).slice(i, j - i).to_pylist()]
                if enc.ends:
                    n = enc.encode(texts)[1]
                    none = [pa.nulls(j - i, t) for _, t in fields[4:]]
                    columns = [b.column(0).slice(i, j - i), lengths.slice(i, j - i).cast(pa.int64()), pa.array(n), pa.array(n > limit), *none]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)
                    continue
                ends, n = enc.prefix_ends(texts)
                begin = np.cumsum(n) - n
                tokens = np.arange(len(ends)) - np.repeat(begin, n)
                cut = np.maximum.reduceat(np.where(tokens <= limit, ends, 0), begin)
                columns = [b.column(0).slice(i, j - i), lengths.slice(i, j - i).cast(pa.int64()), n - 1, n - 1 > limit, cut]
                if tables:
                    offsets = pa.array(np.append(begin, len(ends)), pa.int32())
                    columns.append(pa.ListArray.from_arrays(offsets, pa.array(ends, pa.int64())))
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, (_, t) in zip(columns, fields)], schema=schema)

    import pyarrow.compute  # noqa: F401  (pa.compute)

    bound_batches(docs.sparkSession)
    picked = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as t")
    return picked.mapInArrow(run, ddl)


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json")
    )
