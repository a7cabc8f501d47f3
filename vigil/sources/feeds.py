"""Threat-intelligence feeds, from landed text lines (``value``)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.patterns import C2_HOST, REASON_C2, REASON_OPENPHISH, RULE_ADDRESS

_BLANKS = " \t\r\n\f\u000b"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda word: word != "")


def parse_otx(lines: DataFrame) -> DataFrame:
    """(ip, reason) from ``ip#..#..#reason#..``; shorter lines yield nothing."""
    fields = F.split("value", "#")
    return lines.filter(F.size(fields) >= 4).select(
        F.get(fields, F.lit(0)).alias("ip"), F.get(fields, F.lit(3)).alias("reason")
    )


def parse_c2(lines: DataFrame) -> DataFrame:
    """(host, reason): the whole line when it holds a dotted name, else two blanks."""
    is_host = F.col("value").rlike(C2_HOST)
    return lines.select(
        F.when(is_host, F.col("value")).otherwise("").alias("host"),
        F.when(is_host, F.lit(REASON_C2)).otherwise("").alias("reason"),
    )


def parse_openphish(lines: DataFrame) -> DataFrame:
    """(url, reason) per line."""
    return lines.select(
        F.btrim("value", F.lit(_BLANKS)).alias("url"), F.lit(REASON_OPENPHISH).alias("reason")
    )


def feed_rules(lines: DataFrame) -> DataFrame:
    """Firewall rules: the sixth of exactly eight words, when an address or CIDR."""
    words = lines.select(_words(F.col("value")).alias("w")).filter(F.size("w") == 8)
    return words.select(F.get("w", F.lit(5)).alias("value")).filter(F.col("value").rlike(RULE_ADDRESS))


def feed_hostsfile(lines: DataFrame) -> DataFrame:
    """Hosts file: second tab field; lines with a lone ``#`` field are comments."""
    fields = lines.select(F.split("value", "\t").alias("f"))
    return fields.filter((F.size("f") >= 2) & ~F.array_contains("f", "#")).select(
        F.get("f", F.lit(1)).alias("value")
    )


def feed_domains(lines: DataFrame) -> DataFrame:
    """Domain list: third of at least six tab fields."""
    fields = lines.select(F.split("value", "\t").alias("f"))
    return fields.filter(F.size("f") >= 6).select(F.get("f", F.lit(2)).alias("value"))


def feed_csvlist(lines: DataFrame) -> DataFrame:
    """CSV list: first field."""
    return lines.select(
        F.btrim(F.substring_index("value", ",", 1), F.lit(_BLANKS)).alias("value")
    )


def feed_urllist(lines: DataFrame) -> DataFrame:
    """URL block list: host part of every word."""
    words = lines.select(F.explode(_words(F.col("value"))).alias("word"))
    return words.select(F.substring_index("word", "/", 1).alias("value"))


def union_indicators(*feeds: DataFrame) -> DataFrame:
    """The different values of several ``value`` feeds, ready for ``parse_c2``."""
    return reduce(DataFrame.unionByName, feeds).distinct()
