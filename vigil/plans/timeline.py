"""Questions about a file-system timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.operators.ranking import count_by, top


def deleted_per_day(timeline: DataFrame, k: int = 15) -> DataFrame:
    """The ``k`` days with the most deleted entries."""
    gone = timeline.filter(F.col("short").contains("DELETED"))
    return top(count_by(gone, "date"), k, "date")


def file_types(timeline: DataFrame, exts: tuple[str, ...] = ("zip", "pdf", "exe")) -> DataFrame:
    """(filetype, hits) per ending, all counted in one pass."""
    counted = timeline.agg(*[F.count_if(F.col("short").endswith(e)).alias(e) for e in exts])
    rows = F.array(
        *[F.struct(F.lit(e).alias("filetype"), F.col(e).alias("hits")) for e in exts]
    )
    return counted.select(F.inline(rows))
