"""Catalog tables partitioned by year, month and day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTITIONS = ("year", "month", "day")


def _name(table: str) -> str:
    return ".".join(f"`{part.replace('`', '``')}`" for part in table.split("."))


def _text(value: str) -> str:
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def create_like(spark: SparkSession, parquet: str, table: str, location: str) -> None:
    """External table with the columns of a Parquet file, partitioned by day."""
    fields = [f for f in spark.read.parquet(parquet).schema.fields if f.name not in PARTITIONS]
    columns = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in fields]
    columns += [f"{name} smallint" for name in PARTITIONS]
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {_name(table)} ({', '.join(columns)}) USING parquet "
        f"PARTITIONED BY ({', '.join(PARTITIONS)}) LOCATION {_text(location)}"
    )


def add_partition(spark: SparkSession, table: str, year: int, month: int, day: int) -> None:
    """Register a day, e.g. one whose files another job wrote."""
    spark.sql(
        f"ALTER TABLE {_name(table)} ADD IF NOT EXISTS "
        f"PARTITION (year={int(year)}, month={int(month)}, day={int(day)})"
    )


def load_partition(df: DataFrame, table: str, year: int, month: int, day: int) -> None:
    """Add rows to one day of the table."""
    spark = df.sparkSession
    values = dict(zip(PARTITIONS, (year, month, day)))
    rows = df.withColumns({n: F.lit(int(v)).cast("smallint") for n, v in values.items()})
    rows.select(*spark.table(table).columns).write.mode("append").insertInto(table)


def load_days(df: DataFrame, table: str) -> None:
    """Add rows with a ``date`` to the days they belong to, in one write."""
    day = F.col("date").cast("date")
    rows = df.withColumns(
        {
            "year": F.year(day).cast("smallint"),
            "month": F.month(day).cast("smallint"),
            "day": F.dayofmonth(day).cast("smallint"),
        }
    )
    laid_out = rows.select(*df.sparkSession.table(table).columns).hint("rebalance", *PARTITIONS)
    laid_out.write.mode("append").insertInto(table)
