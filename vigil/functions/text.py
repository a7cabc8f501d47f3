"""Row-local string features: entropy and character n-grams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def entropy(text: Column) -> Column:
    """Shannon entropy (bits) of the characters of ``text``; 0 when empty.

    Counted inside the row, one ``replace`` per different character, so it needs
    neither an exploded row per character nor a shuffle.
    """
    size = F.length(text)

    def share(char: Column) -> Column:
        return (size - F.length(F.replace(text, char, F.lit("")))) / size

    shares = F.transform(F.array_distinct(F.split(text, "")), share)
    bits = F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))
    return F.when(size == 0, F.lit(0.0)).when(size > 0, bits)


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def char_ngrams(text: Column, lo: int = 3, hi: int = 5) -> Column:
    """All ``lo``- to ``hi``-character pieces, lower-cased, runs of blanks as one.

    The text is cut into characters once, so the work is linear in its length.
    """
    clean = F.regexp_replace(F.lower(text), r"\s\s+", " ")

    def pieces(chars: Column, n: int) -> Column:
        starts = F.when(F.size(chars) >= n, F.sequence(F.lit(0), F.size(chars) - n))
        return F.transform(
            F.coalesce(starts, F.array().cast("array<int>")),
            lambda at: F.concat(*[F.get(chars, at + k) for k in range(n)]),
        )

    return F.when(
        text.isNotNull(),
        let(F.split(clean, ""), lambda chars: F.concat(*[pieces(chars, n) for n in range(lo, hi + 1)])),
    )
