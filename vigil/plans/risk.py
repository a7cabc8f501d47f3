"""What is known of each user, from four sides, and a model over it."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.operators.enrich import with_country
from vigil.operators.ranking import count_by
from vigil.operators.sizing import small, training_rows
from vigil.session import settle

FEATURES = (
    "requests", "denied_requests", "malware_requests", "sites", "logins", "addresses", "foreign_logins",
    "commands", "shell_hosts", "denied_packets",
)


def account(name: Column) -> Column:
    """``user`` of ``user`` or ``user@domain``."""
    return F.substring_index(name, "@", 1)


def proxy_side(px: DataFrame) -> DataFrame:
    """Requests, denied and malware ones and different sites by user."""
    by_site = px.groupBy("username", "host").agg(
        F.count("*").alias("n"), F.count_if(F.col("action") == "DENIED").alias("denied"),
        F.count_if(F.col("categories").contains("Mal")).alias("malware"),
    )
    return by_site.groupBy(account(F.col("username")).alias("user")).agg(
        F.sum("n").alias("requests"), F.sum("denied").alias("denied_requests"),
        F.sum("malware").alias("malware_requests"), F.count_distinct("host").alias("sites"),
    )


def vpn_side(vpn: DataFrame, directory: DataFrame, ranges: DataFrame) -> DataFrame:
    """Sessions, different addresses and sessions from outside the user's country."""
    pairs = count_by(vpn, "username", "remoteip", name="n")
    located = with_country(pairs, "remoteip", ranges, "cc")
    # Everybody stays, with or without an entry in the directory.
    home = small(directory.groupBy("emailaddress").agg(F.min("c").alias("c")))
    abroad = located.join(home, located["username"] == home["emailaddress"], "left")
    return abroad.groupBy(account(F.col("username")).alias("user")).agg(
        F.sum("n").alias("logins"), F.count_distinct("remoteip").alias("addresses"),
        F.sum(F.when(F.col("cc") != F.col("c"), F.col("n")).otherwise(0)).alias("foreign_logins"),
    )


def shell_side(bash: DataFrame) -> DataFrame:
    """Commands and different hosts by user."""
    by_host = bash.groupBy("username", "source").agg(F.count("*").alias("n"))
    return by_host.groupBy(account(F.col("username")).alias("user")).agg(
        F.sum("n").alias("commands"), F.count_distinct("source").alias("shell_hosts")
    )


def firewall_side(fw: DataFrame, px: DataFrame) -> DataFrame:
    """Denied packets from the addresses of a user, as the proxy saw them.

    An address of several users counts for each of them.
    """
    denied = count_by(fw.where(F.col("action") == "DENY"), "srcip", name="n")
    owners = px.where("clientip is not null").select("clientip", account(F.col("username")).alias("user")).distinct()
    return owners.join(denied, owners["clientip"] == denied["srcip"]).groupBy("user").agg(F.sum("n").alias("denied_packets"))


def user_features(px: DataFrame, vpn: DataFrame, bash: DataFrame, fw: DataFrame, directory: DataFrame, ranges: DataFrame) -> DataFrame:
    """One row a user that any side knows: ``user`` and FEATURES, 0 where a side does not know it.

    Each side is one row a user before the full outer joins, so no join has a hot key;
    events without a user are the user null.
    """
    sides = [proxy_side(px), vpn_side(vpn, directory, ranges), shell_side(bash), firewall_side(fw, px)]
    whole = None
    for side in sides:
        if whole is None:
            whole = side
            continue
        right = side.withColumnRenamed("user", "_user")
        joined = whole.join(right, F.col("user").eqNullSafe(F.col("_user")), "full_outer")
        whole = joined.withColumn("user", F.coalesce("user", "_user")).drop("_user")
    return whole.select("user", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in FEATURES])


def split(features: DataFrame, held_out_percent: int = 30) -> tuple[DataFrame, DataFrame]:
    """Training and held-out users, by a checksum of the user."""
    place = F.pmod(F.crc32(F.coalesce("user", F.lit("")).cast("binary")), F.lit(100))
    return features.where(place >= held_out_percent), features.where(place < held_out_percent)


def fit(labelled: DataFrame, regularisation: float = 0.01, iterations: int = 100) -> PipelineModel:
    """Logistic regression of ``risky`` (0 or 1) over the logarithms of FEATURES."""
    logs = [f"log_{c}" for c in FEATURES]
    rows = training_rows(settle(_logged(labelled).select("user", *logs, F.col("risky").cast("double").alias("label")), "risk"), "user")
    stages = [
        VectorAssembler(inputCols=logs, outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True),
        LogisticRegression(featuresCol="features", labelCol="label", regParam=regularisation, maxIter=iterations),
    ]
    return Pipeline(stages=stages).fit(rows)


def _logged(features: DataFrame) -> DataFrame:
    return features.withColumns({f"log_{c}": F.log1p(F.col(c).cast("double")) for c in FEATURES})


def score(model: PipelineModel, features: DataFrame) -> DataFrame:
    """``(user, risk)``: the probability of each user."""
    return model.transform(_logged(features)).select("user", vector_to_array("probability")[1].alias("risk"))
