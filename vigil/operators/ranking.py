"""Counts by key and top/bottom reports with a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_by(df: DataFrame, *keys: str, name: str = "hits") -> DataFrame:
    """Rows per key; combined map-side, so a hot key costs one row per task."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def top(df: DataFrame, k: int, *ties: str, by: str = "hits", least: bool = False) -> DataFrame:
    """The ``k`` rows highest (or lowest) in ``by``; equal ones in order of ``ties``."""
    first: Column = F.asc(by) if least else F.desc(by)
    return df.orderBy(first, *ties).limit(k)


def ranked(df: DataFrame, *ties: str, by: str = "hits") -> DataFrame:
    """All rows, highest ``by`` first: a sort of the whole result, for showing it, not for writing."""
    return df.orderBy(F.desc(by), *ties)
