"""Finding algorithmically generated domains."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import (
    BinaryClassificationEvaluator,
    Evaluator,
    MulticlassClassificationEvaluator,
    RegressionEvaluator,
)
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.network import IPV4
from vigil.functions.text import entropy
from vigil.operators.ngrams import ngram_score
from vigil.operators.sizing import small, training_rows
from vigil.session import settle

FEATURES = ("length", "entropy", "high_entropy", "high_length", "legit_grams", "word_grams")

# Feature thresholds, vocabulary cuts, model grids, folds and split.
HIGH_ENTROPY = 3.5
HIGH_LENGTH = 30
MIN_DF_LEGIT = 1e-4
MIN_DF_WORDS = 1e-5
MLP_GRID = {"layers": [[6, 10, 2], [6, 3, 2], [6, 50, 2], [6, 100, 2]], "maxIter": [10, 50, 100]}
FOREST_GRID = {"numTrees": [5, 15, 25, 35], "maxDepth": [2, 5, 15, 20]}
LOGISTIC_GRID = {
    "regParam": [0.2, 0.5, 0.05],
    "elasticNetParam": [0.0, 0.5, 1.0],
    "maxIter": [100, 10, 50],
}
FOLDS = 10
TRAIN_SHARE = 0.7


def labelled(names: DataFrame, col: str, category: str) -> DataFrame:
    """Different (domain, category, length, entropy) of one list of names."""
    domain = F.col(col)
    return (
        names.filter(domain.isNotNull())
        .select(domain.alias("domain"))
        .distinct()
        .select(
            "domain",
            F.lit(category).alias("category"),
            F.length("domain").cast("double").alias("length"),
            entropy(F.col("domain")).alias("entropy"),
        )
    )


def corpus(lists: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Labelled corpus of several lists, given as category to (names, column)."""
    return reduce(
        DataFrame.unionByName, [labelled(df, col, name) for name, (df, col) in lists.items()]
    )


def host_candidates(px: DataFrame) -> DataFrame:
    """Different proxy hosts worth scoring, as (domain, length, entropy).

    The different hosts are kept as a table: filters on scores would otherwise be
    pushed below the distinct and score every request.
    """
    host = F.col("host")
    wanted = px.filter(
        host.isNotNull()
        & ~host.like("www.%")
        & host.like("%.%")
        & ~host.rlike(IPV4)
        & (F.length(host) > 6)
    )
    names = settle(wanted.select(host.alias("domain")).distinct(), "candidates")
    return names.select(
        "domain",
        F.length("domain").cast("double").alias("length"),
        entropy(F.col("domain")).alias("entropy"),
    )


def features(df: DataFrame, legit_vocab: DataFrame, word_vocab: DataFrame) -> DataFrame:
    """Add the feature columns to rows with (domain, length, entropy)."""
    scored = ngram_score(df, "domain", {"legit": legit_vocab, "word": word_vocab})
    return scored.withColumns(
        {
            "high_entropy": F.when(F.col("entropy") > HIGH_ENTROPY, 1.0).otherwise(0.0),
            "high_length": F.when(F.col("length") > HIGH_LENGTH, 1.0).otherwise(0.0),
        }
    )


def _share_of(seed: int, parts: int) -> Column:
    """A part number per domain: fixed by its text, so a recomputed task and SQL agree."""
    digest = F.md5(F.concat(F.col("domain"), F.lit(f":{seed}")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(parts)).cast("int")


def split(df: DataFrame, seed: int = 42, train: float = TRAIN_SHARE) -> tuple[DataFrame, DataFrame]:
    """Training and hold-out rows."""
    part = _share_of(seed, 1000)
    edge = round(train * 1000)
    return df.filter(part < edge), df.filter(part >= edge)


def _classifier(kind: str, seed: int):
    columns = {"featuresCol": "features", "labelCol": "label"}
    if kind == "mlp":
        return MultilayerPerceptronClassifier(layers=[6, 10, 2], seed=seed, **columns), MLP_GRID
    if kind == "forest":
        return RandomForestClassifier(seed=seed, **columns), FOREST_GRID
    if kind == "logistic":
        return LogisticRegression(weightCol="weight", **columns), LOGISTIC_GRID
    raise ValueError(f"unknown classifier {kind}")


def _balanced(df: DataFrame) -> DataFrame:
    """Rows with a ``weight`` by which all categories weigh the same in total.

    Generated names grow with the logs and hosts hardly do: where one in a hundred names is
    legitimate, a regularised model without weights calls them all generated.
    """
    # A row a category.
    counts = df.groupBy("category").agg(F.count(F.lit(1)).alias("n")).collect()
    whole = sum(r["n"] for r in counts)
    weight = F.lit(1.0)
    for row in counts:
        share = whole / (len(counts) * row["n"])
        weight = F.when(F.col("category").eqNullSafe(F.lit(row["category"])), F.lit(share)).otherwise(weight)
    return df.withColumn("weight", weight)


def _evaluator(metric: str) -> Evaluator:
    if metric == "areaUnderROC":
        return BinaryClassificationEvaluator(metricName=metric, labelCol="label")
    if metric in ("rmse", "mse", "mae", "r2"):
        return RegressionEvaluator(metricName=metric, labelCol="label")
    return MulticlassClassificationEvaluator(metricName=metric, labelCol="label")


def fit(
    df: DataFrame,
    kind: str = "mlp",
    grid: dict[str, list] | None = None,
    folds: int = FOLDS,
    seed: int = 42,
    metric: str = "rmse",
    parallelism: int = 4,
) -> CrossValidatorModel:
    """Cross-validated model over the feature columns.

    Labels are indexed by name, so 0 is ``dga`` whatever its frequency.  The logistic model
    weighs rows so that each category counts as much as the other.
    """
    classifier, default_grid = _classifier(kind, seed)
    builder = ParamGridBuilder()
    for param, values in (default_grid if grid is None else grid).items():
        builder = builder.addGrid(classifier.getParam(param), values)
    indexer = StringIndexer(inputCol="category", outputCol="label", stringOrderType="alphabetAsc")
    pipeline = Pipeline(
        stages=[
            indexer,
            VectorAssembler(inputCols=list(FEATURES), outputCol="features"),
            classifier,
        ]
    )
    search = CrossValidator(
        estimator=pipeline,
        estimatorParamMaps=builder.build(),
        evaluator=_evaluator(metric),
        numFolds=folds,
        foldCol="fold",
        seed=seed,
        parallelism=parallelism,
    )
    # Read once per grid point, fold and iteration; lost blocks are read again.
    kept = settle(df.withColumn("fold", _share_of(seed + 1, folds)), "training")
    ready = training_rows(_balanced(kept) if kind == "logistic" else kept, "domain", "category").persist()
    try:
        return search.fit(ready)
    finally:
        ready.unpersist()


def evaluate(model: CrossValidatorModel | PipelineModel, held_out: DataFrame) -> DataFrame:
    """(category, predicted, hits): the hold-out confusion counts."""
    return (
        predict(model, held_out)
        .groupBy("category", "predicted")
        .agg(F.count(F.lit(1)).alias("hits"))
    )


def predict(model: CrossValidatorModel | PipelineModel, df: DataFrame) -> DataFrame:
    """``df`` with the predicted category by name."""
    best = model.bestModel if isinstance(model, CrossValidatorModel) else model
    indexer = best.stages[0]
    # Unlabelled rows have no category to index; the later stages do not need it.
    scored = df
    for stage in best.stages[1:]:
        scored = stage.transform(scored)
    named = IndexToString(inputCol="prediction", outputCol="predicted", labels=indexer.labels)
    return named.transform(scored)


def flag_hosts(model: CrossValidatorModel | PipelineModel, hosts: DataFrame) -> DataFrame:
    """Candidate hosts the model calls generated."""
    return (
        predict(model, hosts)
        .filter((F.col("predicted") == "dga") & F.col("domain").contains("."))
        .select("domain")
        .distinct()
    )


def clients_of(hosts: DataFrame, px: DataFrame) -> DataFrame:
    """Different (host, clientip, proxyip, username) that visited the given ``domain``s.

    Small host lists are broadcast and filter the scan.  Otherwise visits are made
    distinct first, so a hot host brings its different clients only, and AQE splits it.
    """
    # The hosts come out of a scan and a model: computed once, then measured.
    wanted = small(settle(hosts.select(F.col("domain").alias("host")).distinct(), "hosts"))
    return px.select("host", "clientip", "proxyip", "username").distinct().join(wanted, "host", "left_semi")
