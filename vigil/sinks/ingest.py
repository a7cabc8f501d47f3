"""Batch ingest of raw logs and feeds into tables below one root folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vigil.operators import parse
from vigil.session import scratch, scratch_path, short_shuffles
from vigil.sinks import tables
from vigil.sources import feeds
from vigil.sources.lines import read_lines

# What can be ingested, and the table it fills.
LOG_KINDS = {
    "proxysg": "proxysg",
    "iptables": "fw",
    "bashlog": "bash",
    "ciscovpn": "ciscovpn",
    "apacheAccessLog": "apache",
}
ROUTED = ("proxysg", "fw", "ciscovpn", "bash")
FEED_KINDS = {"alienvault_otx": "otx", "c2": "c2", "openphish": "openphish"}
ALL = "all"


def ingest_logs(
    spark: SparkSession,
    kind: str,
    path: str | list[str],
    root: str,
    asof: Column | None = None,
    year: int | Column | None = None,
    rejects: str | None = None,
    by_day: bool = False,
    run: str | None = None,
) -> None:
    """Parse the files below ``path`` and add them to the tables below ``root``.

    ``all`` routes mixed files by their marks.  Lines no format fits go to ``rejects``,
    by default below ``root``.  Each line is matched once.  Files that hold a day each
    (``by_day``) are written without a shuffle.  ``run`` names what is written: doing a
    run again replaces it, and without a name each call adds up.
    """
    run = run or f"run-{uuid.uuid4().hex}"
    lines = read_lines(spark, path)
    chosen = ROUTED if kind == ALL else (LOG_KINDS[kind],)
    split = parse.split_routed(lines, asof, year) if kind == ALL else parse.split_as(lines, chosen[0], asof, year)
    with scratch(spark), short_shuffles(spark):
        split = _staged(split)
        for table in chosen:
            tables.store(parse.events_of(split, table), f"{root}/{table}", run, by_day)
        tables.store_rejects(parse.rejects(split), rejects or f"{root}/rejects", run)


def _staged(split: DataFrame, path: str | None = None) -> DataFrame:
    """Routed lines cut once and kept by kind, so each table reads its own part only.

    A written table rather than a cache: it is a fraction of the raw text, does not
    need the cluster's memory and outlives lost executors.
    """
    spark = split.sparkSession
    path = path or scratch_path(spark, "routed")
    kept = split.select(
        "kind",
        F.col("date").isNotNull().alias("read"),
        "date",
        "fields",
        F.when(F.col("date").isNull(), F.col("value")).alias("value"),
    )
    # Read once or twice and dropped, so the smaller codec pays.
    kept.write.option("compression", "zstd").partitionBy("kind", "read").parquet(path)
    schema = StructType([f for f in kept.schema if f.name not in ("kind", "read")])
    schema = schema.add("kind", "string").add("read", "boolean")
    return spark.read.schema(schema).parquet(path)


def feed_table(lines: DataFrame, kind: str) -> DataFrame:
    """The table of a landed feed."""
    if kind == "alienvault_otx":
        return feeds.parse_otx(lines)
    if kind == "openphish":
        return feeds.parse_openphish(lines)
    if kind == "c2":
        return feeds.parse_c2(feeds.union_indicators(feeds.feed_rules(lines)))
    raise ValueError(f"unknown feed {kind}")


def ingest_feed(spark: SparkSession, kind: str, path: str | list[str], root: str) -> None:
    """Replace the table of a feed with what landed below ``path``."""
    tables.snapshot(feed_table(read_lines(spark, path), kind), f"{root}/{FEED_KINDS[kind]}")
