"""Character n-gram vocabularies and scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.text import char_ngrams, let
from vigil.operators.sizing import fits_broadcast, spread
from vigil.session import settle

_SALTS = 64


def _with_first(grams: Column) -> Column:
    """Grams as (gram, first), ``first`` being 1 once for each different gram of the row.

    In sorted order equal grams are neighbours, so each is compared with one other.
    """

    def mark(ordered: Column) -> Column:
        return F.transform(
            ordered,
            lambda g, i: F.struct(
                g.alias("gram"), ((i == 0) | (g != F.get(ordered, i - 1))).cast("int").alias("first")
            ),
        )

    return let(F.sort_array(grams), mark)


def ngram_vocab(df: DataFrame, col: str, min_df: float, lo: int = 3, hi: int = 5) -> DataFrame:
    """(gram, docs, total, weight) of grams in at least ``min_df`` of the rows.

    ``docs`` counts rows holding the gram, ``total`` its occurrences, ``weight`` is
    log10(total).  The first occurrence within a row is marked before exploding, so
    both counts come from one aggregate by gram, combined map-side.
    """
    texts = df.filter(F.col(col).isNotNull()).select(col)
    grams = spread(texts).select(char_ngrams(F.col(col), lo, hi).alias("grams"))
    marked = grams.select(F.explode(_with_first(F.col("grams"))).alias("m"))
    least = min_df * texts.count()
    return (
        marked.groupBy(F.col("m.gram").alias("gram"))
        .agg(F.sum("m.first").cast("bigint").alias("docs"), F.count(F.lit(1)).alias("total"))
        .filter(F.col("docs") >= least)
        .withColumn("weight", F.log10("total"))
    )


def ngram_score(
    df: DataFrame, col: str, vocabularies: dict[str, DataFrame], lo: int = 3, hi: int = 5
) -> DataFrame:
    """The different rows of ``df`` plus a score column per named vocabulary.

    A score adds the weight of every occurrence of every known gram; 0 when none is
    known.  The ``min_df`` cut bounds a vocabulary to (mean grams per row / min_df)
    entries; measured small, all of them are broadcast as one table.  Otherwise
    occurrences are first counted per row and hot grams spread over salts.
    """
    names = list(vocabularies)
    tagged = [
        vocabularies[name].select("gram", "weight", F.lit(name).alias("vocab")) for name in names
    ]
    weights = settle(
        reduce(DataFrame.unionByName, tagged)
        .groupBy("gram")
        .agg(*[F.max(F.when(F.col("vocab") == n, F.col("weight"))).alias(f"_w_{n}") for n in names]),
        "weights",
    )
    keys = df.columns
    rows = spread(df.distinct(), *keys)
    grams = rows.select(
        *keys, F.explode_outer(char_ngrams(F.col(col), lo, hi)).alias("gram")
    )
    if fits_broadcast(weights):
        scored = grams.withColumn("tf", F.lit(1)).join(F.broadcast(weights), "gram", "left")
    else:
        tf = grams.groupBy(*keys, "gram").agg(F.count(F.lit(1)).alias("tf"))
        salted = tf.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(_SALTS)))
        copies = weights.withColumn(
            "_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(_SALTS - 1).cast("bigint")))
        )
        scored = salted.join(copies, ["gram", "_salt"], "left")
    return scored.groupBy(*keys).agg(
        *[
            F.coalesce(F.sum(F.col("tf") * F.col(f"_w_{n}")), F.lit(0.0)).alias(f"{n}_grams")
            for n in names
        ]
    )
