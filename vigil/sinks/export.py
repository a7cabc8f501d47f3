"""Results as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_json_rows(df: DataFrame) -> DataFrame:
    """One JSON document per row, in ``value``."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def write_gzip_json(df: DataFrame, path: str) -> None:
    """Gzip JSON lines, written by the executors."""
    df.write.mode("overwrite").option("compression", "gzip").json(path)
