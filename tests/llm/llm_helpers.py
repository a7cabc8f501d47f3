"""Plain versions of the operators, and the rows every one of them has to stand."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(LOWER))


def documents(spark: SparkSession, *rows: tuple, more: str = "") -> DataFrame:
    """Rows of ``(doc_id, text)`` with null in all other columns."""
    frame = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCUMENT)
    return frame.selectExpr("*", *([more] if more else []))


def shingles(text: str | None, n: int) -> frozenset:
    found = words(text)
    size = min(n, len(found))
    return frozenset(tuple(found[i : i + size]) for i in range(len(found) - size + 1)) if size else frozenset()


def plain_groups(rows: list[tuple], n: int, percent: int) -> dict:
    """By id: (set size, smallest id its links lead to), from all pairs."""
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    low: dict[int, int] = {}
    for i, (doc, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), doc), doc)
    return {doc: (len(sets[i]), low[find(i)]) for i, (doc, _) in enumerate(rows)}


AWKWARD = [(1, None), (2, ""), (3, " \n\t"), (None, "one two three four"), (4, "x" * 50_000), (5, "word " * 30_000), (6, "a b"), (7, "a b"), (7, "a b")]
