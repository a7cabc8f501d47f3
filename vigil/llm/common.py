"""What several of the operators share: hot-key joins, connected components, gapless ranks."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.session import settle

# A key is hot when it holds more than one in HOT_SHARE rows, so at most HOT_SHARE keys are.
HOT_SHARE = 1000
WHITE = r"[\x20\x09-\x0D]"


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """``rows`` with the columns of their group; ``groups`` holds each key once.

    Keys with over a thousandth of all rows are at most HOT_SHARE: those groups are
    broadcast, so their rows stay where they are.  The others shuffle on the key.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = groups.where(F.col(size) * HOT_SHARE > F.lit(total))
    cold = groups.where(F.col(size) * HOT_SHARE <= F.lit(total))
    return rows.join(F.broadcast(hot), key).unionByName(
        rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    )


def components(links: DataFrame, label: str) -> DataFrame:
    """Each node of the links ``(a, b)`` with the smallest node it reaches: ``(node, root)``.

    Every round points each node's larger neighbours, then its smaller ones, at the
    smallest node next to it, until nothing changes: O(log n) rounds of shuffles.  The
    links are kept in the shared folder between rounds.  A node with very many links
    costs one partial minimum for each task, as the joins split on the other end.
    """
    links = settle(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), label
    )
    while True:
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.where("a <> b").distinct()
        # Links now point downwards; hang each node's other parents below its smallest one.
        parent = large.groupBy("a").agg(F.min("b").alias("low"))
        small = (
            large.join(parent, "a")
            .select(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b"))
            .where("a <> b")
            .distinct()
        )
        after = settle(small, label)
        same = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first() == after.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))
        ).first()
        links = after
        if same:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
                links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )


def ranked(rows: DataFrame, by: str, uid: str, shards: int = 64) -> DataFrame:
    """A gapless ``rank`` from 0 within each value of ``by`` (a bounded set of classes).

    Rows of a class are numbered inside ``shards`` hash shares of it, and the sizes of
    the shares are added up, so that a class with a third of the rows is still split.
    ``rows`` has to be a kept table, as it is read twice.
    """
    rows = rows.withColumn("__shard", F.pmod(F.xxhash64(uid), F.lit(shards)).cast("int"))
    sizes = rows.groupBy(by, "__shard").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(by).orderBy("__shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(by, "__shard", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy(by, "__shard").orderBy(uid)) - 1
    # starts has at most (number of classes) x shards rows, whatever the input.
    return (
        rows.withColumn("__inside", inside)
        .join(F.broadcast(starts), [by, "__shard"])
        .withColumn("rank", F.col("__start") + F.col("__inside"))
        .drop("__start", "__inside", "__shard")
    )


# Counters that travel as one row.
_PART = 1 << 15


def counters(texts: DataFrame, size: int, count: Callable[[np.ndarray, str], None]) -> np.ndarray:
    """``size`` counters over the whole column ``text``; ``count`` adds one text to an array of them.

    Each task counts by itself and gives what is not zero in parts; the parts are added
    up by a shuffle, and the driver gets ``size`` numbers whatever the input.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.uint32)
        for batch in batches:
            for text in batch["text"].to_pylist():
                count(counts, text)
        for i in range(0, size, _PART):
            if counts[i : i + _PART].any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i // _PART], pa.int32()), pa.array([counts[i : i + _PART].tobytes()], pa.binary())], ["part", "counts"]
                )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = None, None
        for batch in batches:
            for part, counts in zip(batch["part"].to_pylist(), batch["counts"].to_pylist()):
                more = np.frombuffer(counts, np.uint32).astype(np.uint64)
                total = more if total is None else total + more
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "counts"])

    out = np.zeros(size, np.uint64)
    for row in texts.mapInArrow(run, "part int, counts binary").groupBy("part").applyInArrow(add, "part int, counts binary").collect():
        found = np.frombuffer(row["counts"], np.uint64)
        out[row["part"] * _PART : row["part"] * _PART + len(found)] = found
    return out


BLOOM_BITS = 1 << 24


def bloom(rows: DataFrame, column: str) -> np.ndarray:
    """BLOOM_BITS bits in 32-bit words, set for the values of a column of 64-bit hashes."""
    bits = rows.select(F.pmod(F.col(column), F.lit(BLOOM_BITS)).alias("bit"))
    words = bits.groupBy(F.expr("int(bit div 32)").alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, int(bit % 32)))").alias("bits")
    )
    out = np.zeros(BLOOM_BITS // 32, np.uint32)
    # At most BLOOM_BITS / 32 rows, whatever the input.
    found = words.toArrow()
    out[found["word"].to_numpy().astype(np.int64)] = found["bits"].to_numpy().astype(np.int64).astype(np.uint32)
    return out


def may_hold(spark: SparkSession, bits: np.ndarray, column: Column) -> Column:
    """Whether a hash may be among those ``bits`` were made of; never false for one that is."""
    shared = spark.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def test(hashes: pd.Series) -> pd.Series:
        bit = hashes.to_numpy(dtype=np.int64) % BLOOM_BITS
        return pd.Series((shared.value[bit >> 5] >> (bit & 31).astype(np.uint32) & 1).astype(bool))

    return test(column)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit integers (the finaliser of splitmix64)."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


# Longer words are digested one by one.
_LONG = 256
_IS_WORD = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def word_places(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes."""
    inside = _IS_WORD[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edges = np.concatenate([[0], edges])
    if len(inside) and inside[-1]:
        edges = np.append(edges, len(inside))
    return edges[0::2], edges[1::2]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of ``word_places``, their starts and ends.

    Words are read eight bytes at a time, all at once.
    """
    starts, ends = word_places(data)
    lengths = ends - starts
    hashes = mix(lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    # The eight bytes from every place on; behind the end there are zeros.
    eight = np.ndarray((len(data) + 1,), "<u8", data + bytes(9), strides=(1,))
    active, at = np.flatnonzero(lengths <= _LONG), 0
    while len(active):
        part = eight[starts[active] + at] & _MASKS[np.minimum(lengths[active] - at, 8)]
        hashes[active] = mix(hashes[active] * np.uint64(0xC2B2AE3D27D4EB4F) + part)
        at += 8
        active = active[lengths[active] > at]
    for i in np.flatnonzero(lengths > _LONG):
        hashes[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return hashes, starts, ends


# A-Z in lower case, all other bytes as they are.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
