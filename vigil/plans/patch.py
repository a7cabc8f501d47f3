"""Questions about the software inventory (``sccm_vuln``)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.versions import version_key
from vigil.operators.ranking import count_by, top
from vigil.operators.sizing import small
from vigil.schemas import SITE_PRODUCTS, SITE_REGIONS
from vigil.session import settle


def _software() -> Column:
    return F.concat(F.col("displayname0"), F.lit(" "), F.col("version0"))


def _matching(
    inventory: DataFrame, severity: str | None, region: str | None, zone: str | None
) -> DataFrame:
    wanted = {"crit_x_cat": severity, "region_x": region, "zone_x": zone}
    tests = [F.col(c) == v for c, v in wanted.items() if v is not None]
    return inventory.filter(reduce(Column.__and__, tests)) if tests else inventory


def top_software(
    inventory: DataFrame,
    severity: str | None = "High",
    region: str | None = None,
    zone: str | None = None,
    k: int = 10,
) -> DataFrame:
    """The ``k`` (software, hits) with the most findings."""
    keys = ("displayname0", "version0")
    best = top(count_by(_matching(inventory, severity, region, zone), *keys), k, *keys)
    return best.select(_software().alias("software"), "hits")


def top_functions(inventory: DataFrame, severity: str | None = "High", k: int = 10) -> DataFrame:
    """The ``k`` host functions with the most findings."""
    return top(count_by(_matching(inventory, severity, None, None), "hostfn_x"), k, "hostfn_x")


# Software panels of the dashboard: (region, zone), None for any.
PANELS = {
    "all": (None, None),
    "ncsa": ("NCSA", "Corp"),
    "emea": ("EMEA", "Corp"),
    "apac": ("APAC", "Corp"),
    "onbe": (None, "ONBE"),
    "corp": (None, "Corp"),
}


def dashboard_rows(inventory: DataFrame, severity: str = "High", k: int = 10) -> DataFrame:
    """All software panels as (panel, software, hits), from one scan.

    The inventory is reduced to counts per software, region and zone before rows are
    repeated for the panels they belong to.
    """
    keys = ("displayname0", "version0")
    counted = count_by(
        _matching(inventory, severity, None, None), *keys, "region_x", "zone_x", name="n"
    )

    def member(name: str) -> Column:
        region, zone = PANELS[name]
        tests = [F.col("region_x") == region] if region else []
        tests += [F.col("zone_x") == zone] if zone else []
        return F.when(reduce(Column.__and__, tests, F.lit(True)), F.lit(name))

    panels = F.array_compact(F.array(*[member(name) for name in PANELS]))
    hits = (
        counted.withColumn("panel", F.explode(panels))
        .groupBy("panel", *keys)
        .agg(F.sum("n").alias("hits"))
    )
    place = Window.partitionBy("panel").orderBy(F.desc("hits"), *keys)
    best = hits.withColumn("_place", F.row_number().over(place)).filter(F.col("_place") <= k)
    return best.select("panel", _software().alias("software"), "hits")


def region_matrix(sites: DataFrame) -> DataFrame:
    """Nested per-product region counts as one row per region, a column per product."""
    rows = F.array(
        *[
            F.struct(
                F.lit(region).alias("region"),
                *[
                    F.col(f"`{product}`.`{region}`").cast("bigint").alias(product.replace("-", "_"))
                    for product in SITE_PRODUCTS
                ],
            )
            for region in SITE_REGIONS
        ]
    )
    return sites.select(F.inline(rows))


def hosts_with(inventory: DataFrame, region: str, software: str) -> DataFrame:
    """Names of hosts in a region, not excluded, with matching software."""
    return inventory.filter(
        (F.col("region_x") == region.upper())
        & F.col("exclude_x").isNull()
        & F.col("displayname0").like(f"%{software.capitalize()}%")
    ).select(F.col("name0").alias("host"))


def applications(inventory: DataFrame) -> DataFrame:
    """How many hosts have each application, and in how many versions."""
    pairs = inventory.where("displayname0 is not null").select("displayname0", "version0", "name0").distinct()
    return pairs.groupBy("displayname0").agg(
        F.count_distinct("name0").alias("hosts"), F.count_distinct("version0").alias("versions")
    )


def outdated(inventory: DataFrame) -> DataFrame:
    """``(host, application, version, newest)`` of hosts behind the newest version anywhere.

    A host counts with its own newest version of an application.  Versions that sort
    alike (``1.0`` and ``1-0``) are the same, and the least text names them; rows without
    host, application or version say nothing.
    """
    known = inventory.select(
        F.col("name0").alias("host"), F.col("displayname0").alias("application"), F.col("version0").alias("version")
    ).where("host is not null and application is not null and version is not null")
    # Versions are compared once each, not once a host: a number tells their order, another one equal ones.
    versions = known.select("application", "version").distinct().withColumn("key", version_key(F.col("version")))
    order, whole = Window.partitionBy("application").orderBy("key"), Window.partitionBy("application")
    places = versions.select(
        "application", "version",
        F.row_number().over(Window.partitionBy("application").orderBy("key", "version")).alias("place"),
        F.dense_rank().over(order).alias("rank"),
    )
    top = F.max("rank").over(whole)
    places = places.select("*", top.alias("best")).withColumn(
        "newest", F.min(F.when(F.col("rank") == F.col("best"), F.col("version"))).over(whole)
    )
    places = small(settle(places, "versions"))
    mine = (
        known.join(places.select("application", "version", "place"), ["application", "version"])
        .groupBy("host", "application").agg(F.max("place").alias("place"))
    )
    behind = mine.join(places, ["application", "place"]).where("rank < best")
    return behind.select("host", "application", "version", "newest")
