"""Matches of events against threat-intelligence indicators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions.network import cidr_parts, ip_to_long, network_of
from vigil.operators.ranking import count_by
from vigil.operators.sizing import fits_broadcast
from vigil.session import settle


def feed_weights(feeds: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(indicator, copies, distinct_feeds) over named feeds, given with their column.

    Blank indicators are dropped.  ``copies`` counts rows of all feeds, so weighting
    by it equals joining every feed and keeping all matches.
    """
    named = [
        df.select(F.col(column).alias("indicator"), F.lit(name).alias("feed"))
        for name, (df, column) in feeds.items()
    ]
    per_feed = (
        reduce(DataFrame.unionByName, named)
        .filter(F.col("indicator") != "")
        .groupBy("indicator", "feed")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return per_feed.groupBy("indicator").agg(
        F.sum("n").alias("copies"), F.count(F.lit(1)).alias("distinct_feeds")
    )


def ioc_hits(events: DataFrame, key: str, feeds: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(key, hits, distinct_feeds) of events whose ``key`` is an indicator.

    ``hits`` counts matching pairs over all feeds, duplicates included.  Indicators
    of measured small size filter the scan before anything is shuffled.  Beyond
    that, events are first counted per key, so both join sides hold a key once and
    a hot key is one row.
    """
    weights = settle(feed_weights(feeds), "weights")
    if fits_broadcast(weights):
        matched = events.join(F.broadcast(weights), events[key] == weights["indicator"])
        return matched.groupBy(key).agg(
            F.sum("copies").alias("hits"), F.max("distinct_feeds").alias("distinct_feeds")
        )
    counted = count_by(events, key, name="n")
    return counted.join(weights, counted[key] == weights["indicator"]).select(
        key, (F.col("n") * F.col("copies")).alias("hits"), "distinct_feeds"
    )


def ioc_groups(events: DataFrame, key: str, feed: tuple[DataFrame, str], *keys: str) -> DataFrame:
    """(keys, hits) of events whose ``key``, one of ``keys``, is an indicator."""
    weights = settle(feed_weights({"feed": feed}), "weights")
    if fits_broadcast(weights):
        matched = events.join(F.broadcast(weights), events[key] == weights["indicator"])
        return matched.groupBy(*keys).agg(F.sum("copies").alias("hits"))
    counted = count_by(events, *keys, name="n")
    return counted.join(weights, counted[key] == weights["indicator"]).select(
        *keys, (F.col("n") * F.col("copies")).alias("hits")
    )


def cidr_ranges(indicators: DataFrame, column: str) -> DataFrame:
    """(network, prefix, lo, hi) of address and CIDR indicators, others dropped."""
    network, prefix = cidr_parts(F.col(column))
    cut = indicators.select(network.alias("network"), prefix.alias("prefix"))
    return cut.filter(F.col("network").isNotNull() & F.col("prefix").isNotNull()).select(
        "network",
        "prefix",
        F.col("network").alias("lo"),
        (F.col("network") + F.pow(F.lit(2.0), 32 - F.col("prefix")).cast("bigint") - 1).alias("hi"),
    )


def ioc_cidr_hits(events: DataFrame, key: str, indicators: DataFrame, column: str) -> DataFrame:
    """(key, hits, matched_ranges) of events whose address lies in an indicator range.

    CIDR ranges need no range test: an address is looked up once per prefix length
    in use (at most 33) by the network it would belong to, an equi-join.  Events are
    counted per address first.
    """
    ranges = settle(
        cidr_ranges(indicators, column)
        .groupBy("network", "prefix")
        .agg(F.count(F.lit(1)).alias("copies")),
        "ranges",
    )
    # At most 33 rows: prefix lengths run from 0 to 32.
    prefixes = sorted(r["prefix"] for r in ranges.select("prefix").distinct().collect())
    counted = count_by(events.filter(F.col(key).isNotNull()), key, name="n")
    # Malformed addresses get null networks, which join nothing.  A filter here would
    # be pushed below the count and read every event's address instead.
    address = counted.withColumn("_ip", ip_to_long(F.col(key)))
    candidates = address.select(
        key,
        "n",
        F.explode(
            F.array(
                *[
                    F.struct(
                        network_of(F.col("_ip"), F.lit(p)).alias("network"),
                        F.lit(p).alias("prefix"),
                    )
                    for p in prefixes
                ]
            ).cast("array<struct<network:bigint,prefix:int>>")
        ).alias("_net"),
    ).select(key, "n", "_net.network", "_net.prefix")
    side = F.broadcast(ranges) if fits_broadcast(ranges) else ranges
    return (
        candidates.join(side, ["network", "prefix"])
        .groupBy(key)
        .agg(
            F.sum(F.col("n") * F.col("copies")).alias("hits"),
            F.count(F.lit(1)).alias("matched_ranges"),
        )
    )
