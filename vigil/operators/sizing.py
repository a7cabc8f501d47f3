"""Broadcast only what has been measured, and what to do otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_ROWS = 1_000_000
MAX_BYTES = 64 * 1024 * 1024


def measure(df: DataFrame, rows_of: Column | None = None) -> tuple[int, int]:
    """(rows, estimated bytes in memory) of ``df``, by one distributed aggregate.

    ``rows_of`` gives the number of rows each row will become.
    """
    width = sum(
        (F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 24 for c in df.columns),
        F.lit(32),
    ).cast("bigint")
    each = F.lit(1) if rows_of is None else rows_of
    found = df.agg(F.sum(each).alias("n"), F.sum(width * each).alias("b")).first()
    return int(found["n"] or 0), int(found["b"] or 0)


def fits_broadcast(
    df: DataFrame,
    rows_of: Column | None = None,
    max_rows: int | None = None,
    max_bytes: int | None = None,
) -> bool:
    """Whether ``df`` is small enough to copy to every executor."""
    rows, size = measure(df, rows_of)
    return rows <= (MAX_ROWS if max_rows is None else max_rows) and size <= (
        MAX_BYTES if max_bytes is None else max_bytes
    )


def spread(df: DataFrame, *unique: str) -> DataFrame:
    """Rows over all shuffle partitions, ahead of a step that makes many rows of each.

    AQE sizes tasks by the short rows it sees and would leave that step to a few of
    them.  With ``unique`` columns, which no two rows share, a later aggregate by them
    needs no shuffle.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *unique)


def training_rows(df: DataFrame, *unique: str, rows_per_task: int = 50_000) -> DataFrame:
    """A settled table in partitions big enough to pay for a task.

    Training runs a job per iteration, so tiny partitions cost more than they
    compute.  No two rows share the ``unique`` columns, so partitions hold the same
    rows in the same order each time, and training can be repeated.
    """
    parts = max(1, -(-df.count() // rows_per_task))
    return df.repartition(parts, *unique).sortWithinPartitions(*unique)


def small(df: DataFrame) -> DataFrame:
    """``df`` hinted for broadcast when it fits.

    Beyond the bound it comes back unhinted and the join shuffles; AQE then
    splits hot keys of the other side (``SETTINGS`` in ``session``).
    """
    return F.broadcast(df) if fits_broadcast(df) else df
