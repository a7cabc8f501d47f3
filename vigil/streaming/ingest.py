"""Structured Streaming ingest of mixed raw lines."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vigil.operators import parse
from vigil.session import scratch_root, short_shuffles
from vigil.sinks import tables
from vigil.sinks.ingest import _staged
from vigil.sources.lines import hosted, prefixed

ROUTED = ("proxysg", "fw", "ciscovpn", "bash")

# Batch cadence for landed files and for pushed lines.
FILE_CADENCE = "300 seconds"
PUSH_CADENCE = "600 seconds"


def stream_lines(spark: SparkSession, glob: str, max_files: int | None = None) -> DataFrame:
    """Lines of text files as they land.

    ``glob`` may cover day folders (``.../dt=*``): a folder made after the start is
    picked up, so nothing restarts at midnight.
    """
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.schema("value string").text(glob)


def stream_hosted_lines(spark: SparkSession, glob: str, max_files: int | None = None) -> DataFrame:
    """(host, arrived_at, value) of landed ``host<TAB>line`` files."""
    lines = stream_lines(spark, glob, max_files)
    return hosted(lines.withColumn("arrived_at", F.col("_metadata.file_modification_time")))


def kafka_hosted_lines(spark: SparkSession, servers: str, topics: str) -> DataFrame:
    """The same from Kafka topics keyed by host (needs the Kafka package)."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
    return keyed_lines(reader.option("subscribe", topics).load())


def keyed_lines(records: DataFrame) -> DataFrame:
    """(host, arrived_at, value) of records with binary ``key`` and ``value`` and a ``timestamp``."""
    return records.select(
        F.col("key").cast("string").alias("host"),
        F.col("timestamp").alias("arrived_at"),
        F.col("value").cast("string").alias("value"),
    )


def with_prefix(lines: DataFrame) -> DataFrame:
    """Pushed lines as one text with arrival time and host in front, for routing."""
    return prefixed(lines)


def _start(writer, trigger: str | None):
    if trigger is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=trigger).start()


def run_of(batch: DataFrame, batch_id: int) -> str:
    """Names a micro-batch by its query and number.

    The query's id is kept in its checkpoint: it stays the same over restarts, and a
    new checkpoint, whose batches count from 0 again, has another one.
    """
    query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    return f"{query or 'unnamed'}-{batch_id}"


def save_batch(
    root: str, asof: Column | None = None, year: int | Column | None = None
) -> Callable[[DataFrame, int], None]:
    """Write one micro-batch: a table per kind, rejects as text.

    A batch that is run again after a failure replaces its own output, and nobody
    else's: every line lands exactly once, however many streams fill a table.  The cut
    lines of a batch are a table until it is stored, as a backlog is no cache's size.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        run, spark = run_of(batch, batch_id), batch.sparkSession
        # Not in the list of scratch folders, of which a job beside the stream drops the newest.
        kept = f"{scratch_root(spark)}/micro-batch-{uuid.uuid4().hex}"
        try:
            with short_shuffles(spark):
                split = _staged(parse.split_routed(batch, asof, year), kept)
                # At most five kinds, each read or not: the names of the folders.
                kinds = split.select("kind", "read").distinct().collect()
                for table in {r["kind"] for r in kinds if r["read"]}:
                    tables.store(parse.events_of(split, table), f"{root}/{table}", run)
                if not all(r["read"] for r in kinds):
                    tables.store_rejects(parse.rejects(split), f"{root}/rejects", run)
        finally:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(kept)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)

    return save


def start_ingest(
    lines: DataFrame,
    root: str,
    checkpoint: str,
    trigger: str | None = FILE_CADENCE,
    asof: Column | None = None,
    year: int | Column | None = None,
) -> StreamingQuery:
    """Route, parse and store a stream of mixed lines.

    ``trigger`` None reads what is there and ends.
    """
    writer = lines.writeStream.foreachBatch(save_batch(root, asof, year)).option(
        "checkpointLocation", checkpoint
    )
    return _start(writer, trigger)


def start_file_sink(
    events: DataFrame, path: str, checkpoint: str, trigger: str | None = PUSH_CADENCE
) -> StreamingQuery:
    """Add one parsed stream to a date-partitioned table, exactly once.

    The layout is that of ``tables.store``, so batch jobs and other streams may fill the
    same table.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        tables.store(batch, path, run_of(batch, batch_id))

    return _start(events.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint), trigger)
