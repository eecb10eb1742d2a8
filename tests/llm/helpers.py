"""Small document tables with every awkward case, and plain versions of the word rules."""

from __future__ import annotations

import hashlib
import re

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PLAIN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
BLANK = re.compile("[^\x20\x09-\x0d]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plain_words(text):
    return PLAIN.findall((text or "").translate(UPPER))


def blank_words(text, lower=False):
    text = text or ""
    return BLANK.findall(text.translate(UPPER) if lower else text)


def words(n: int, start: int = 0) -> str:
    return " ".join(f"w{i}" for i in range(start, start + n))


def awkward() -> list[tuple]:
    """(doc_id, text): nulls, empty and blank texts, repeats, copies, one long text, odd characters."""
    long = " ".join(f"x{i % 977}y{i}" for i in range(30_000))
    base = words(60)
    rows = [
        (1, None),
        (2, ""),
        (3, " \n\t "),
        (4, base),
        (5, base),
        (6, base + " tail"),
        (7, base.replace("w30", "other")),
        (8, "Ünïcode ÄÖ é́   ‚x‘ \x1c z"),
        (9, long),
        (10, "intro " + base + " outro"),
        (11, words(25) + "\n" + words(25)),
        (12, "a"),
        (13, "A"),
        (14, "a b"),
        (15, "MIT License, and the GNU General Public License; mit license."),
        (16, words(20, 500)),
        (17, words(19, 500)),
        (18, words(20, 500) + " " + words(20, 500)),
    ]
    return rows


def table(spark, rows, schema="doc_id long, text string"):
    """With columns that clash with names the operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, schema).repartition(3)
    return df.withColumns({c: F.lit(c) for c in ("t", "w", "x", "d", "n", "key", "sig", "chunk", "__id")})
