"""Writing date-partitioned tables and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# The innermost partition of a stored table: which run wrote a file.
BATCH = "batch"


def by_date(df: DataFrame) -> DataFrame:
    """``df`` laid out for a write partitioned by ``date``.

    A rebalance, not a repartition: few files per day, while AQE cuts a day that
    holds much of the data into several tasks.
    """
    return df.hint("rebalance", F.col("date"))


def append(df: DataFrame, table: str, path: str | None = None, by_day: bool = False) -> None:
    """Append to a catalog table partitioned by date, made on first use.

    ``by_day`` says that each input file already belongs to one day: rows are then
    written where they were read, without a shuffle.
    """
    writer = (df if by_day else by_date(df)).write.format("parquet").mode("append").partitionBy("date")
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


def append_path(df: DataFrame, path: str, by_day: bool = False) -> None:
    """``append`` to a table given by its folder."""
    (df if by_day else by_date(df)).write.mode("append").partitionBy("date").parquet(path)


def replace_dates(df: DataFrame, path: str) -> None:
    """Replace exactly the days present in ``df``; running it again changes nothing."""
    (
        by_date(df)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("date")
        .parquet(path)
    )


def snapshot(df: DataFrame, path: str) -> None:
    """Replace a whole unpartitioned table, such as a feed."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)


def store(df: DataFrame, path: str, run: str, by_day: bool = False) -> None:
    """Add the rows of one run (a micro-batch, a batch job) to a date-partitioned table.

    Rows land below ``date=<day>/batch=<run>``, so a date filter prunes first, runs add
    up, and a run that is done again replaces exactly what it wrote before.
    """
    (
        (df if by_day else by_date(df))
        .withColumn(BATCH, F.lit(run))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("date", BATCH)
        .parquet(path)
    )


def store_run(df: DataFrame, path: str, run: str) -> None:
    """``store`` without days: the rows of one run below ``batch=<run>``.

    For small rows that span many days.  Streams run without AQE, which leaves out the
    rebalance of ``store``, so each of their tasks would write a file into every day.
    """
    (
        df.withColumn(BATCH, F.lit(run))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(BATCH)
        .parquet(path)
    )


def store_rejects(rejected: DataFrame, path: str, run: str) -> None:
    """Unread lines of one run as gzip text, a folder per kind; a repeated run replaces its own."""
    (
        rejected.select("kind", F.lit(run).alias(BATCH), "value")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "gzip")
        .partitionBy("kind", BATCH)
        .text(path)
    )


def compact(spark: SparkSession, path: str, schema: StructType, days: tuple[str, str], run: str) -> None:
    """Rewrite the stored runs of some closed days as one run each, in few files.

    The new run is written before the old ones are dropped; a reader in between sees
    rows twice, so compact days that no report reads meanwhile.
    """
    whole = StructType([*schema.fields, StructField(BATCH, StringType())])
    stored = spark.read.schema(whole).parquet(path).where(F.col("date").between(*[F.lit(d).cast("date") for d in days]))
    # At most as many rows as the days have folders.
    old = [r for r in stored.select("date", BATCH).distinct().collect() if r[BATCH] != run]
    store(stored.drop(BATCH), path, run)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for row in old:
        place = hadoop(f"{path}/date={row['date']}/{BATCH}={row[BATCH]}")
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
