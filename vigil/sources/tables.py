"""Date-partitioned event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from vigil import schemas


def read_table(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """A Parquet table by its root folder; a declared schema skips inference."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def read_events(spark: SparkSession, root: str, table: str) -> DataFrame:
    """An event table below ``root``, whatever runs and streams have filled it."""
    schema = StructType([*schemas.EVENT_TABLES[table].fields, StructField("batch", StringType())])
    return spark.read.schema(schema).parquet(f"{root}/{table}").drop("batch")


def date_slice(df: DataFrame, start: str, end: str) -> DataFrame:
    """Rows from ``start`` to ``end``, both days included.

    On a table partitioned by ``date`` this prunes folders; missing days are
    simply not there, and a slice without any day is an empty table.
    """
    return df.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def date_prefix(df: DataFrame, prefix: str) -> DataFrame:
    """Rows whose date text starts with ``prefix``, such as ``2015-12-``.

    A text test on the partition column alone, hence still partition pruning.
    """
    return df.filter(F.date_format("date", "yyyy-MM-dd").startswith(prefix))
