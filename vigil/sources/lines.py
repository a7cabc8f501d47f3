"""Raw text lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str | list[str], recursive: bool = True) -> DataFrame:
    """``value`` per line of the text files under ``path`` (folder, file or glob)."""
    return spark.read.option("recursiveFileLookup", recursive).text(path)


def read_hosted_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Landed ``host<TAB>line`` files as (host, arrived_at, value).

    ``arrived_at`` is the modification time of the file a line came in.
    """
    return hosted(
        spark.read.option("recursiveFileLookup", True)
        .text(path)
        .withColumn("arrived_at", F.col("_metadata.file_modification_time"))
    )


def hosted(lines: DataFrame) -> DataFrame:
    """Cut ``host<TAB>line`` values; works on batches and on streams."""
    return lines.select(
        F.substring_index("value", "\t", 1).alias("host"),
        *[F.col("arrived_at")] if "arrived_at" in lines.columns else [],
        F.expr("substring(value, instr(value, '\t') + 1)").alias("value"),
    )


def prefixed(lines: DataFrame) -> DataFrame:
    """(host, arrived_at, value) as plain lines that start with time and host."""
    return lines.select(
        F.concat_ws(" ", F.col("arrived_at").cast("string"), "host", "value").alias("value")
    )
