"""Session settings the jobs rely on, and the shared folder for intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Everything here is a default of current Spark or a correctness pin.  Cluster
# sizing (executors, memory, shuffle partitions) belongs to spark-submit.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.compression.codec": "snappy",
}


# Scratch folders by application, in the order they were named.
_made: dict[str, list[str]] = {}


def build_session(app: str = "vigil", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the library's settings; ``extra`` uses ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one in the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    return (root or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch").rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder below ``scratch_root`` for data one job writes and a later one reads."""
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def drop_scratch(spark: SparkSession, since: int = 0, but: tuple[DataFrame, ...] = ()) -> None:
    """Delete what this application has kept in scratch folders, from the ``since``-th on.

    Call it after the last write that reads a result; ``scratch`` does so for a block.
    The kept tables ``but`` stay.
    """
    made = _made.get(spark.sparkContext.applicationId, [])
    stay = {path for path in made if any(path.rsplit("/", 1)[1] in file for df in but for file in df.inputFiles())}
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in made[since:]:
        if path not in stay:
            place = hadoop(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    made[since:] = [path for path in made[since:] if path in stay]


def scratch_mark(spark: SparkSession) -> int:
    """How many scratch folders there are by now, for ``drop_scratch``."""
    return len(_made.get(spark.sparkContext.applicationId, []))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables kept inside the block live until its end; write results inside it."""
    since = scratch_mark(spark)
    try:
        yield
    finally:
        drop_scratch(spark, since)


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside the block, what a write has shuffled is deleted when the write ends.

    Otherwise it stays until the driver happens to collect garbage, so the shuffles of all
    tables and batches would lie side by side.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def settle(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back.

    For results that are costly to compute and used more than once, such as being
    measured before they are joined.  A lost executor does not lose them.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
