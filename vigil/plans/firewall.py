"""Questions about firewall traffic (``fw``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.operators import trailing
from vigil.operators.indicators import ioc_hits
from vigil.operators.ranking import count_by, top


def denied(fw: DataFrame) -> DataFrame:
    return fw.filter(F.col("action") == "DENY")


def tcp_only(fw: DataFrame) -> DataFrame:
    return fw.filter(F.col("proto") == "TCP")


def port_label(*before: str):
    """``[address ]port/proto`` text."""
    port = F.concat(F.col("dstport").cast("string"), F.lit("/"), F.col("proto"))
    return F.concat_ws(" ", *before, port) if before else port


def denied_ports(fw: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most denied (port, protocol)."""
    keys = ("dstport", "proto")
    return top(count_by(denied(fw), *keys), k, *keys).withColumn("port", port_label())


def denied_by(fw: DataFrame, side: str, k: int = 10) -> DataFrame:
    """The ``k`` most denied (``srcip`` or ``dstip``, port, protocol)."""
    keys = (side, "dstport", "proto")
    return top(count_by(denied(fw), *keys), k, *keys).withColumn("label", port_label(side))


def top_talkers(fw: DataFrame, k: int = 25) -> DataFrame:
    """The ``k`` (source, destination) pairs denied most."""
    return top(count_by(denied(fw), "srcip", "dstip"), k, "srcip", "dstip")


def malware_connections(fw: DataFrame, otx: DataFrame, c2: DataFrame) -> DataFrame:
    """Indicator matches per destination; order them with ``ranking.ranked`` or ``top``."""
    return ioc_hits(fw, "dstip", {"otx": (otx, "ip"), "c2": (c2, "host")})


def dashboard_rows(fw: DataFrame, k: int = 10) -> DataFrame:
    """The three denied top-``k`` panels as (panel, label, hits), from one scan.

    Grouping sets count all three at once; ranking keeps ``k`` rows of each panel
    per task before it gathers a panel.
    """
    sets = denied(fw).groupingSets(
        [
            [F.col("dstport"), F.col("proto")],
            [F.col("dstip"), F.col("dstport"), F.col("proto")],
            [F.col("srcip"), F.col("dstport"), F.col("proto")],
        ],
        "srcip", "dstip", "dstport", "proto",
    )
    counted = sets.agg(
        F.count(F.lit(1)).alias("hits"),
        F.grouping("srcip").alias("_no_src"),
        F.grouping("dstip").alias("_no_dst"),
    )
    panel = (
        F.when(F.col("_no_src") == 0, "srcip").when(F.col("_no_dst") == 0, "dstip").otherwise("port")
    )
    place = Window.partitionBy("panel").orderBy(
        F.desc("hits"), "srcip", "dstip", "dstport", "proto"
    )
    best = (
        counted.withColumn("panel", panel)
        .withColumn("_place", F.row_number().over(place))
        .filter(F.col("_place") <= k)
    )
    address = F.when(F.col("panel") == "srcip", F.col("srcip")).when(
        F.col("panel") == "dstip", F.col("dstip")
    )
    port = port_label()
    return best.select(
        "panel",
        F.when(F.col("panel") == "port", port).otherwise(F.concat_ws(" ", address, port)).alias("label"),
        "hits",
    )


def dashboard(fw: DataFrame, k: int = 10) -> dict[str, DataFrame]:
    """The panels of the firewall dashboard, each on its own."""
    return {
        "port": denied_ports(fw, k),
        "dstip": denied_by(fw, "dstip", k),
        "srcip": denied_by(fw, "srcip", k),
    }


def packet_deviation(fw: DataFrame, by: str = "srcip", days: int = 7) -> DataFrame:
    """Mean packet length of each source and day against its trailing window."""
    return trailing.moment_deviation(trailing.daily_moments(fw, by, "len"), by, days)
