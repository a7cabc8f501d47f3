"""Dates of syslog lines, VPN durations and day lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"


def syslog_date(stamp: Column, asof: Column | None = None, year: int | Column | None = None) -> Column:
    """Date of a ``Mon d`` stamp, which carries no year.

    With ``year`` that year is used as given.  Otherwise the line belongs to the
    last such day up to ``asof`` (its arrival, today by default) plus one day of
    clock drift, so a December line read in January falls into the old year.
    An impossible stamp gives null.
    """
    # Casts of ISO text are several times faster than a pattern-based date parser.
    name = F.substring(stamp, 1, 3)
    place = F.position(name, F.lit(_MONTHS))
    month = F.when((F.length(name) == 3) & (place % 3 == 1), F.floor((place + 2) / 3))
    day_of_month = F.ltrim(F.translate(F.substring(stamp, 4, 20), "\t\r\f\u000b", "    "))

    def candidate(in_year: Column) -> Column:
        return F.concat(in_year, F.lit("-"), month, F.lit("-"), day_of_month).try_cast("date")

    if year is not None:
        return candidate(year if isinstance(year, Column) else F.lit(year))
    day = F.current_date() if asof is None else asof.cast("date")
    this_year = candidate(F.year(day))
    return F.coalesce(
        F.when(this_year <= F.date_add(day, 1), this_year), candidate(F.year(day) - 1)
    )


def clock_time(day: Column, time: Column) -> Column:
    """Timestamp of ``time`` (HH:MM:SS text) on ``day``; null when malformed."""
    return F.try_to_timestamp(F.concat_ws(" ", day.cast("string"), time))


def vpn_duration_seconds(duration: Column) -> Column:
    """Seconds of ``[Dd ]Hh:MMm:SSs``; null for any other text."""
    shape = r"^(?:(\d{1,3})d )?(\d{1,3})h:(\d{1,2})m:(\d{1,2})s$"
    factors = (86400, 3600, 60, 1)
    total = sum(
        (
            F.coalesce(F.regexp_extract(duration, shape, i + 1).try_cast("bigint"), F.lit(0)) * factor
            for i, factor in enumerate(factors)
        ),
        F.lit(0).cast("bigint"),
    )
    return F.when(duration.rlike(shape), total)


def date_spine(spark: SparkSession, start: str, end: str) -> DataFrame:
    """One row per day from ``start`` to ``end``, both included; none if reversed."""
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    days = F.when(first <= last, F.sequence(first, last))
    return spark.range(1).select(F.explode(days).alias("date"))
