"""Command vectors and clusters that come out the same on every run.

Words get vectors from how often they stand near each other, by whole numbers only: counts,
weights, directions and the sums of two rounds of random projection.  Sums of whole numbers
do not depend on their order, so file layout, partitions, cores and lost executors change
nothing.  ``commands`` has the trainer of Spark, whose vectors differ from run to run.

Null commands have no vector.  An empty command is one empty word.  Words are hashed into
``buckets``, so no table of words has more rows than that; a word that stands alone keeps its
own direction.  A command without any known word has a vector of zeros.  Repeated commands
count as often as they occur.  Sums stay exact up to 2^53, some 10^11 commands a cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators import sizing
from vigil.plans.commands import BUCKETS, CLUSTERS, INIT_STEPS, MAX_ITERATIONS, SEED, TRAINERS, VECTOR_SIZE
from vigil.session import settle

# Words up to this many places apart are near each other.
WINDOW = 5
# A weight is a logarithm in thousandths; the largest entry of a direction is UNIT.
WEIGHT = 1_000
UNIT = 10_000
# Numbers of a group that are added up side by side with all vectors.
CELLS = 1 << 22
# Rows a partition of training, where there are more than TRAINERS times as many.
TRAINING_ROWS = 20_000


def bucket(word: Column, buckets: int = BUCKETS) -> Column:
    """Where a word goes: the first 52 bits of its MD5 digest, modulo ``buckets``."""
    return F.pmod(F.conv(F.substring(F.md5(word), 1, 13), 16, 10).cast("bigint"), F.lit(buckets))


def _key(command: Column) -> Column:
    """A command by its digest, so that exploded words do not carry the text along."""
    return F.md5(command)


def tokens_of(bash: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(key, hits, tokens) of each different command, its words as buckets."""
    held = bash.filter(F.col("command").isNotNull()).groupBy("command").agg(F.count(F.lit(1)).alias("hits"))
    words = F.transform(F.split("command", " "), lambda word: bucket(word, buckets))
    return held.select(_key(F.col("command")).alias("key"), "hits", words.alias("tokens"))


def pair_counts(rows: DataFrame, tokens: str = "tokens", hits: str = "hits", window: int = WINDOW) -> DataFrame:
    """(word, near, n): how often two words stand within ``window`` places of each other.

    Counted both ways round, so a word near itself counts twice.  A row makes ``window``
    pairs a word, which combine before the one shuffle.
    """
    words = F.col(tokens)

    def apart(places: int) -> Column:
        length = F.greatest(F.size(words) - places, F.lit(0))
        return F.zip_with(
            F.slice(words, 1, length),
            F.slice(words, F.lit(places + 1), length),
            lambda a, b: F.struct(F.least(a, b).alias("word"), F.greatest(a, b).alias("near")),
        )

    pairs = rows.filter(words.isNotNull()).select(
        F.col(hits).alias("hits"), F.explode(F.flatten(F.array(*[apart(d) for d in range(1, window + 1)]))).alias("pair")
    )
    once = pairs.groupBy("pair.word", "pair.near").agg(F.sum("hits").alias("n"))
    same = F.col("word") == F.col("near")
    there = F.struct("word", "near", F.when(same, 2 * F.col("n")).otherwise(F.col("n")).alias("n"))
    back = F.struct(F.col("near").alias("word"), F.col("word").alias("near"), "n")
    return once.select(F.explode(F.when(same, F.array(there)).otherwise(F.array(there, back))).alias("p")).select("p.*")


def pair_weights(pairs: DataFrame) -> DataFrame:
    """(word, near, weight): thousandths of the logarithm by which pairs exceed chance; above 0 only."""
    sums = settle(pairs.groupBy("word").agg(F.sum("n").alias("total")), "totals")
    total = float(sums.agg(F.sum("total")).first()[0] or 0)
    # A row a bucket at most, whatever the data.
    totals = sizing.small(sums)
    held = pairs.join(totals, "word").join(
        totals.select(F.col("word").alias("near"), F.col("total").alias("near_total")), "near"
    )
    chance = F.col("n").cast("double") * F.lit(total) / (
        F.col("total").cast("double") * F.col("near_total").cast("double")
    )
    return held.select("word", "near", F.floor(F.log(chance) * WEIGHT).cast("int").alias("weight")).filter("weight > 0")


def _directions(words: DataFrame, size: int) -> DataFrame:
    """(word, packed): a direction of its own for each word, by the digests of its bucket and places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signs = [
                [UNIT if md5(b"%d:%d" % (word, i)).digest()[0] < 128 else -UNIT for i in range(size)]
                for word in batch["word"].to_pylist()
            ]
            yield _packed(batch["word"], np.array(signs, np.int64).reshape(-1, size))

    return sizing.spread(words.select("word")).mapInArrow(run, _PACKED)


# Vectors travel as 16-bit numbers: entries of one are at most UNIT, of a sum of three 3 * UNIT.
_PACKED = "word long, packed binary"


def _packed(words: pa.Array, found: np.ndarray) -> pa.RecordBatch:
    if found.size and np.abs(found).max() > np.iinfo(np.int16).max:
        raise ValueError("an entry of a word's vector does not fit 16 bits")
    return pa.RecordBatch.from_arrays(
        [words, pa.array([row.tobytes() for row in found.astype("<i2")], pa.binary())], ["word", "packed"]
    )


def _unpacked(packed: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    """A row a vector; null stands for zeros."""
    none = bytes(2 * size)
    return np.frombuffer(b"".join(none if p is None else p for p in packed.to_pylist()), "<i2").reshape(-1, size)


class _Vectors:
    """Vectors of words, a column an entry, to add up by."""

    def __init__(self, table: pa.Table, size: int):
        words = table["word"].to_numpy()
        order = np.argsort(words)
        self.words, self.columns = words[order], np.ascontiguousarray(_unpacked(table["packed"], size)[order].T)

    def places(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words stand, and which of them do."""
        at = np.searchsorted(self.words, words)
        there = at < len(self.words)
        there[there] = self.words[at[there]] == words[there]
        return at, there

    def sums(self, rows: np.ndarray, places: np.ndarray, times: np.ndarray | None, count: int) -> np.ndarray:
        """For each of ``count`` rows the sum of its vectors; doubles are exact up to 2^53."""
        found = np.empty((count, len(self.columns)), np.int64)
        for i, column in enumerate(self.columns):
            taken = column[places]
            found[:, i] = np.bincount(rows, taken if times is None else taken * times, count)
        return found


def _with_vectors(cells: DataFrame, key: str, n: int, packed: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``run`` over groups of some ``CELLS`` of the ``n`` cells, whole by ``key``, each beside all vectors.

    There is a vector a bucket at most, so a copy of them is no larger than a group's cells
    and all copies grow with the cells.
    """
    cores = cells.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-n // CELLS), min(cores, n // (CELLS >> 5)))
    part = F.pmod(F.xxhash64(key), F.lit(parts)).alias("part")
    copies = packed.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))).alias("part"))
    return cells.select(part, "*").groupBy("part").cogroup(copies.groupBy("part")).applyInArrow(run, schema)


def _projected(weights: DataFrame, n: int, packed: DataFrame, size: int) -> DataFrame:
    """Each word's weighted sum of the vectors near it, scaled to ``UNIT``."""

    def run(cells: pa.Table, copies: pa.Table) -> pa.Table:
        vectors = _Vectors(copies, size)
        at, there = vectors.places(cells["near"].to_numpy())
        words, rows = np.unique(cells["word"].to_numpy()[there], return_inverse=True)
        sums = vectors.sums(rows, at[there], cells["weight"].to_numpy()[there].astype(np.float64), len(words))
        # Division goes towards zero.
        most = np.maximum(np.abs(sums).max(axis=1, initial=0), 1)
        scaled = np.sign(sums) * (np.abs(sums) * UNIT // most[:, None])
        return pa.Table.from_batches([_packed(pa.array(words, pa.int64()), scaled)])

    return _with_vectors(weights, "word", n, packed, run, _PACKED)


def learn(
    bash: DataFrame, size: int = VECTOR_SIZE, window: int = WINDOW, buckets: int = BUCKETS
) -> DataFrame:
    """(word, vector of whole numbers) for each bucket in use.

    A vector adds up the word's own direction, the directions of the words near it and of
    those near these, which is a random projection of the weights and of their square.
    """
    rows = settle(sizing.spread(tokens_of(bash, buckets)), "tokens")
    weights = settle(pair_weights(settle(pair_counts(rows, window=window), "pairs")), "weights")
    n = weights.count()
    words = rows.select(F.explode("tokens").alias("word")).distinct()
    own = settle(_directions(words, size), "directions")
    first = settle(_projected(weights, n, own, size), "projected")
    second = _projected(weights, n, first, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sum(_unpacked(batch[c], size).astype(np.int64) for c in ("own", "first", "second"))
            vectors = pa.ListArray.from_arrays(np.arange(0, found.size + 1, size, dtype=np.int32), found.ravel())
            yield pa.RecordBatch.from_arrays([batch["word"], vectors], ["word", "vector"])

    held = [df.withColumnRenamed("packed", name) for df, name in ((own, "own"), (first, "first"), (second, "second"))]
    every = reduce(lambda a, b: a.join(b, "word", "left"), held)
    return settle(every.mapInArrow(run, "word long, vector array<long>"), "words")


def vectors(words: DataFrame, bash: DataFrame, size: int = VECTOR_SIZE, buckets: int = BUCKETS) -> DataFrame:
    """(key, hits, features): the mean vector of each different command's known words."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _packed(batch["word"], np.asarray(batch["vector"].flatten()).reshape(-1, size))

    def run(cells: pa.Table, copies: pa.Table) -> pa.Table:
        vectors = _Vectors(copies, size)
        tokens = cells["tokens"].combine_chunks()
        rows = np.repeat(np.arange(len(cells)), np.diff(tokens.offsets.to_numpy()))
        at, there = vectors.places(tokens.flatten().to_numpy())
        rows = rows[there]
        sums = vectors.sums(rows, at[there], None, len(cells))
        known = np.maximum(np.bincount(rows, minlength=len(cells)), 1)
        means = (np.sign(sums) * (np.abs(sums) // known[:, None])).astype(np.float64)
        lists = pa.ListArray.from_arrays(np.arange(0, means.size + 1, size, dtype=np.int32), means.ravel())
        return pa.table([cells["key"], cells["hits"], lists], ["key", "hits", "mean"])

    rows = settle(sizing.spread(tokens_of(bash, buckets)), "tokens")
    n = rows.agg(F.sum(F.size("tokens").cast("long"))).first()[0] or 0
    packed = words.select("word", "vector").mapInArrow(pack, _PACKED)
    held = _with_vectors(rows, "key", n, packed, run, "key string, hits long, mean array<double>")
    return held.select("key", "hits", array_to_vector("mean").alias("features"))


def train(
    words: DataFrame,
    bash: DataFrame,
    k: int = CLUSTERS,
    size: int = VECTOR_SIZE,
    buckets: int = BUCKETS,
    seed: int = SEED,
    trainers: int = TRAINERS,
    points: DataFrame | None = None,
) -> KMeansModel:
    """K-means over the different commands, weighted by how often they occur.

    ``points`` are the ``vectors`` of ``bash``, where they are kept already.

    Partitions hold the same commands in the same order each time, and cluster sums are
    sums of whole numbers, so centres do not depend on the order in which tasks end.
    """
    rows = settle(vectors(words, bash, size, buckets), "training") if points is None else points
    # By the rows alone, not the cores, as the first centres depend on the partitions.
    trainers = max(trainers, -(-rows.count() // TRAINING_ROWS))
    # Training passes over the rows many times; lost blocks are read again.
    rows = rows.repartition(trainers, "key").sortWithinPartitions("key").persist()
    try:
        return KMeans(
            k=k, seed=seed, maxIter=MAX_ITERATIONS, initSteps=INIT_STEPS, weightCol="hits", solver="row",
            featuresCol="features", predictionCol="prediction",
        ).fit(rows)
    finally:
        rows.unpersist()


def assign(
    words: DataFrame,
    model: KMeansModel,
    bash: DataFrame,
    size: int = VECTOR_SIZE,
    buckets: int = BUCKETS,
    points: DataFrame | None = None,
) -> DataFrame:
    """``bash`` with its cluster (``prediction``), without null commands; ``points`` as in ``train``."""
    points = vectors(words, bash, size, buckets) if points is None else points
    found = settle(model.transform(points).select("key", "prediction"), "clusters")
    rows = bash.drop("prediction").filter(F.col("command").isNotNull())
    # A name that no column of the rows has.
    digest = max(rows.columns, key=len) + "_digest"
    found = found.withColumnRenamed("key", digest)
    return rows.withColumn(digest, _key(F.col("command"))).join(sizing.small(found), digest).drop(digest)


def save(words: DataFrame, model: KMeansModel, path: str) -> None:
    """Words and centres side by side, for ``load``."""
    words.write.mode("overwrite").parquet(f"{path}/words")
    model.write().overwrite().save(f"{path}/centres")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, KMeansModel]:
    return spark.read.parquet(f"{path}/words"), KMeansModel.load(f"{path}/centres")
