"""Word and shingle columns that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes that end a word, after A-Z became a-z.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z become a-z, every other character stays as it is."""
    return F.translate(text, _UPPER, _LOWER)


def plain_words(text: Column) -> Column:
    """Array of the words of ``text``: runs of digits, letters and all non-ASCII characters,
    A-Z lower-cased.  A null text has no words."""
    words = F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAKS)
    # only the ends can be empty, where the text begins or ends with breaks
    n = F.size(words)
    lead = F.when(words[0] == "", 2).otherwise(1)
    trail = F.when(F.element_at(words, -1) == "", 1).otherwise(0)
    return F.slice(words, lead, F.greatest(F.lit(0), n - lead + 1 - trail))
