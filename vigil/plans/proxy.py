"""Questions about web-proxy traffic (``proxysg``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.operators.indicators import ioc_groups, ioc_hits
from vigil.operators.ranking import count_by, top

MALWARE = "%Mal%"


def user_malware(px: DataFrame, user_like: str) -> DataFrame:
    """Requests of matching users to malware categories, counted."""
    keys = ("clientip", "username", "host", "port", "path", "query")
    hit = px.filter(F.col("username").like(user_like) & F.col("categories").like(MALWARE))
    return count_by(hit, *keys)


def top_transfers(px: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` largest different (client, host, bytes) transfers.

    The k-th largest byte count is found first, from that one column; only rows at
    or above it can be in the answer, so the distinct never shuffles the table and
    the second scan can skip row groups.  Requests without a byte count are left out.
    """
    sizes = px.select("csbytes").filter("csbytes is not null").distinct()
    kth = top(sizes, k, by="csbytes").agg(F.min("csbytes").alias("least"))
    large = px.select("clientip", "host", "csbytes").filter(F.col("csbytes") >= kth.scalar())
    transfers = large.distinct().select(
        "clientip", "host", F.col("csbytes").cast("double").alias("bytes")
    )
    return top(transfers, k, "clientip", "host", by="bytes")


def top_transfer_totals(px: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` (client, host) pairs with the most bytes sent in total."""
    totals = px.groupBy("clientip", "host").agg(F.sum("csbytes").alias("bytes"))
    return top(totals, k, "clientip", "host", by="bytes")


def rare_agents(px: DataFrame, k: int = 500) -> DataFrame:
    """The ``k`` least common user agents."""
    return top(count_by(px, "agent"), k, "agent", least=True)


def top_hosts(px: DataFrame, k: int = 15, category_like: str | None = None) -> DataFrame:
    """The ``k`` most visited hosts, of all or of matching categories."""
    seen = px if category_like is None else px.filter(F.col("categories").like(category_like))
    return top(count_by(seen, "host"), k, "host")


def outdated_clients(px: DataFrame, marker: str = "NT 5.1") -> DataFrame:
    """Different (client, agent) whose agent names an outdated system."""
    return px.filter(F.col("agent").contains(marker)).select("clientip", "agent").distinct()


def intel_hits(px: DataFrame, otx: DataFrame, c2: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` hosts with the most indicator matches over both feeds."""
    return top(ioc_hits(px, "host", {"otx": (otx, "ip"), "c2": (c2, "host")}), k, "host")


def intel_users(px: DataFrame, otx: DataFrame) -> DataFrame:
    """Who visited indicator hosts, counted by client, user, host and category."""
    keys = ("clientip", "username", "host", "categories")
    return ioc_groups(px, "host", (otx, "ip"), *keys)
