"""Tables that are replaced as a whole under readers: a folder a version.

A version is whole once Spark has put its ``_SUCCESS`` file there, so a reader sees the old
one or the new one and nothing in between.  One job at a time publishes a table; old
versions stay until ``drop_old``, for readers that have begun.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_PREFIX = "version="


def _folder(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[int]:
    """The whole versions below ``root``, oldest first."""
    place, files = _folder(spark, root)
    if not files.exists(place):
        return []
    found = []
    for status in files.listStatus(place):
        name = status.getPath().getName()
        if name.startswith(_PREFIX) and files.exists(_folder(spark, f"{root}/{name}/_SUCCESS")[0]):
            found.append(int(name[len(_PREFIX) :]))
    return sorted(found)


def _path(root: str, version: int) -> str:
    return f"{root}/{_PREFIX}{version:010d}"


def publish(df: DataFrame, root: str) -> int:
    """Write ``df`` as the next version and return its number.

    What a failed job has left of that number is written over.
    """
    known = versions(df.sparkSession, root)
    version = known[-1] + 1 if known else 1
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(_path(root, version))
    return version


def newest(spark: SparkSession, root: str) -> tuple[int, DataFrame] | None:
    """Number and rows of the newest whole version; None before there is one."""
    known = versions(spark, root)
    return (known[-1], spark.read.parquet(_path(root, known[-1]))) if known else None


def drop_old(spark: SparkSession, root: str, keep: int = 2) -> list[int]:
    """Delete all but the newest ``keep`` versions; returns what went."""
    old = versions(spark, root)[: -keep if keep else None]
    for version in old:
        place, files = _folder(spark, _path(root, version))
        files.delete(place, True)
    return old
