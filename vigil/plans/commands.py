"""Clustering shell commands to find unusual ones."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import SQLTransformer, Word2Vec
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.operators.groups import largest_groups, rare_groups, rows_in
from vigil.session import settle

# Model sizes and cluster-size thresholds.
CLUSTERS = 650
VECTOR_SIZE = 100
MAX_ITERATIONS = 10
INIT_STEPS = 3
SEED = 42
RARE_TRAINING = 10
RARE_SERVING = 20
LINE_VECTOR_SIZE = 2
LINE_CLUSTERS = 70

# Words are hashed into this many buckets whatever the data, as the trainer keeps a
# vector for each on the driver.
BUCKETS = 1 << 18
# Training partitions; each trains a copy of the vectors, and the copies are merged.  Many
# rows take as many as there are cores, no more: each copy is shuffled whole.
TRAINERS = 4
ROWS_PER_TRAINER = 5_000


def _word_stages(separator: str, size: int, seed: int, buckets: int, trainers: int) -> list:
    """``command`` cut into hashed ``tokens``, and word vectors over them.

    A SQL stage, so a saved pipeline carries the buckets along.
    """
    hashed = f"concat('#', cast(pmod(xxhash64(w), {buckets}) as string))"
    tokens = f"transform(split(command, '{separator}'), w -> {hashed})"
    return [
        SQLTransformer(statement=f"SELECT *, {tokens} AS tokens FROM __THIS__"),
        Word2Vec(vectorSize=size, minCount=1, seed=seed, inputCol="tokens", outputCol="features", numPartitions=trainers),
    ]


def _fit(stages: list, df: DataFrame, trainers: int) -> PipelineModel:
    """Fit on the rows in an order of their own.

    Word vectors are still not the same each time: their trainer shuffles the sentences
    again and meets them in the order in which blocks arrive.
    """
    # Training passes over the rows many times; lost blocks are read again.
    rows = settle(df, "training")
    cores = df.sparkSession.sparkContext.defaultParallelism
    trainers = max(trainers, min(cores, -(-rows.count() // ROWS_PER_TRAINER)))
    stages = [s.copy({s.numPartitions: trainers}) if isinstance(s, Word2Vec) else s for s in stages]
    rows = rows.repartition(trainers, "command").sortWithinPartitions("command").persist()
    try:
        return Pipeline(stages=stages).fit(rows)
    finally:
        rows.unpersist()


def train(
    bash: DataFrame,
    k: int = CLUSTERS,
    vector_size: int = VECTOR_SIZE,
    seed: int = SEED,
    buckets: int = BUCKETS,
    trainers: int = TRAINERS,
) -> PipelineModel:
    """Word vectors over blank-separated words, then k-means on their means."""
    commands = bash.filter(F.col("command").isNotNull())
    stages = _word_stages(" ", vector_size, seed, buckets, trainers)
    # Rows, as blocks fail where there are fewer different commands than clusters.
    clusters = KMeans(
        k=k, seed=seed, maxIter=MAX_ITERATIONS, initSteps=INIT_STEPS, solver="row",
        featuresCol="features", predictionCol="prediction",
    )
    return _fit([*stages, clusters], commands.select("command"), trainers)


def vectors(model: PipelineModel, bash: DataFrame) -> DataFrame:
    """``bash`` with ``tokens`` and their mean vector in ``features``."""
    rows = bash.filter(F.col("command").isNotNull())
    for stage in model.stages[:-1]:
        rows = stage.transform(rows)
    return rows


def score(model: PipelineModel, bash: DataFrame) -> DataFrame:
    """``bash`` with tokens, vector and cluster (``prediction``)."""
    return model.transform(bash.filter(F.col("command").isNotNull()))


def score_new(model: PipelineModel, known: DataFrame, fresh: DataFrame) -> DataFrame:
    """``fresh`` commands with their cluster and how many ``known`` rows it has, 0 for none."""
    # At most as many rows as there are clusters.
    sizes = F.broadcast(known.groupBy("prediction").agg(F.count(F.lit(1)).alias("cluster_size")))
    found = score(model, fresh).select("command", "prediction").join(sizes, "prediction", "left")
    return found.withColumn("cluster_size", F.coalesce("cluster_size", F.lit(0)))


def cluster(
    bash: DataFrame, k: int = CLUSTERS, vector_size: int = VECTOR_SIZE, seed: int = SEED
) -> tuple[PipelineModel, DataFrame]:
    """Train on ``bash`` and assign its rows to clusters."""
    model = train(bash, k, vector_size, seed)
    return model, score(model, bash)


def save(model: PipelineModel, clustered: DataFrame, path: str) -> None:
    """Model and clustered rows side by side, for ``load``."""
    model.write().overwrite().save(f"{path}/model")
    clustered.write.mode("overwrite").parquet(f"{path}/rows")


def load(spark, path: str) -> tuple[PipelineModel, DataFrame]:
    return PipelineModel.load(f"{path}/model"), spark.read.parquet(f"{path}/rows")


def outliers(clustered: DataFrame, max_size: int = RARE_SERVING, cluster_col: str = "prediction") -> DataFrame:
    """Different rows of clusters with fewer than ``max_size`` rows."""
    # Tokens and vector follow from the command, so they cannot tell rows apart.
    rows = clustered.drop("tokens", "features")
    rare = rare_groups(rows, cluster_col, below=max_size)
    return rows_in(rows, rare, cluster_col).distinct()


def outlier_lines(found: DataFrame) -> DataFrame:
    """Outliers as ``command -> Seen on: date`` text."""
    return found.select(
        F.concat("command", F.lit(" -> Seen on: "), F.col("date").cast("string")).alias("line")
    )


def largest(clustered: DataFrame, n: int = 10, cluster_col: str = "prediction") -> DataFrame:
    """Different commands of the ``n`` largest clusters."""
    groups = largest_groups(clustered, cluster_col, k=n)
    return rows_in(clustered, groups, cluster_col).select("command").distinct()


def cluster_lines(
    bash: DataFrame, k: int = LINE_CLUSTERS, seed: int = SEED, buckets: int = BUCKETS, trainers: int = TRAINERS
) -> tuple[PipelineModel, DataFrame]:
    """The variant where a whole command line is one word.

    Two-dimensional vectors and a random start; every line is clustered.
    """
    lines = bash.filter(F.col("command").isNotNull()).select(
        F.explode(F.split("command", "\n")).alias("command")
    )
    clusters = KMeans(
        k=k, seed=seed, maxIter=MAX_ITERATIONS, initMode="random",
        featuresCol="features", predictionCol="prediction",
    )
    model = _fit([*_word_stages("\n", LINE_VECTOR_SIZE, seed, buckets, trainers), clusters], lines, trainers)
    return model, model.transform(lines)


def members(clustered: DataFrame, cluster_col: str = "prediction") -> DataFrame:
    """(cluster, command, hits): what each cluster holds.

    Long form on purpose: a list per cluster would put a hot cluster into one task.
    """
    return clustered.groupBy(F.col(cluster_col).alias("cluster"), "command").agg(
        F.count(F.lit(1)).alias("hits")
    )
