"""Raw lines to typed events, by column expressions only.

Every function takes lines (``value``) and yields rows of a table in
``schemas.EVENT_TABLES``.  Raw fields and date leave a generator (``inline``) so that
the regular expression runs once per line: a plain filter on the outcome would be
pushed below the projection and match every line again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil import schemas
from vigil.functions import dates
from vigil.functions.patterns import (
    MARK_FW,
    MARK_PROXY,
    MARK_SHELL,
    MARK_VPN,
    RAW_FIELDS,
    line_fields,
)

UNKNOWN = "unknown"


def route(lines: DataFrame) -> DataFrame:
    """Add ``kind``: the table a line belongs to, or ``unknown``.

    Program marks come first: host names carry the other two, and a shell line
    from a host named like a firewall is still a shell line.
    """
    value = F.col("value")
    return lines.withColumn(
        "kind",
        F.when(value.contains(MARK_SHELL), "bash")
        .when(value.contains(MARK_VPN), "ciscovpn")
        .when(value.contains(MARK_FW), "fw")
        .when(value.contains(MARK_PROXY), "proxysg")
        .otherwise(UNKNOWN),
    )


def fields_by_kind(kind: Column, value: Column) -> Column:
    """Raw fields of a routed line; null when it fits no format of its kind."""
    chosen = None
    for table in ("bash", "ciscovpn", "fw", "proxysg"):
        fields = line_fields(value, table)
        test = kind == table
        chosen = F.when(test, fields) if chosen is None else chosen.when(test, fields)
    return chosen


def event_date(fields: Column, table: str, asof: Column | None, year: int | Column | None) -> Column:
    """Date of an event from its raw fields; null when impossible."""
    if table == "proxysg":
        return F.get(fields, F.lit(0)).try_cast("date")
    if table == "apache":
        return F.try_to_timestamp(F.substring(F.get(fields, F.lit(3)), 1, 11), F.lit("dd/MMM/yyyy")).cast("date")
    return dates.syslog_date(F.get(fields, F.lit(0)), asof, year)


def _dated(fields: Column, date_of: Callable[[Column], Column]) -> Column:
    """One (fields, date) in an array, for ``inline``: each worked out once per line."""
    return F.transform(
        F.array(fields), lambda f: F.struct(f.alias("fields"), date_of(f).alias("date"))
    )


def _typed(exploded: DataFrame, table: str) -> DataFrame:
    """(fields, date) to the declared columns of ``table``."""
    raw = {name: F.get("fields", F.lit(i)) for i, name in enumerate(RAW_FIELDS[table])}
    derived = {"date": F.col("date")}
    if "time" in raw:
        derived["event_ts"] = dates.clock_time(F.col("date"), raw["time"])
    if table == "apache":
        derived["event_ts"] = F.try_to_timestamp(raw["date_time"], F.lit("dd/MMM/yyyy:HH:mm:ss Z"))
    if table == "ciscovpn":
        derived["duration_sec"] = dates.vpn_duration_seconds(raw["duration"])
    columns = []
    for field in schemas.EVENT_TABLES[table].fields:
        column = derived.get(field.name, raw.get(field.name))
        if field.dataType.typeName() == "long":
            column = column.try_cast("bigint")
        columns.append(column.alias(field.name))
    return exploded.select(*columns)


def parse(
    lines: DataFrame,
    table: str,
    asof: Column | None = None,
    year: int | Column | None = None,
) -> DataFrame:
    """Events of ``table`` in ``lines``; lines that do not fit are left out.

    ``asof`` (a column of ``lines``) or ``year`` dates the year-less syslog stamps.
    """
    read = _dated(line_fields(F.col("value"), table), lambda f: event_date(f, table, asof, year))
    return _typed(lines.select(F.inline(F.filter(read, lambda r: r["date"].isNotNull()))), table)


def parse_proxy(lines: DataFrame) -> DataFrame:
    return parse(lines, "proxysg")


def parse_fw(lines: DataFrame, asof: Column | None = None, year: int | Column | None = None) -> DataFrame:
    return parse(lines, "fw", asof, year)


def parse_vpn(lines: DataFrame, asof: Column | None = None, year: int | Column | None = None) -> DataFrame:
    return parse(lines, "ciscovpn", asof, year)


def parse_bash(lines: DataFrame, asof: Column | None = None, year: int | Column | None = None) -> DataFrame:
    return parse(lines, "bash", asof, year)


def parse_apache(lines: DataFrame) -> DataFrame:
    return parse(lines, "apache")


def split_routed(
    lines: DataFrame, asof: Column | None = None, year: int | Column | None = None
) -> DataFrame:
    """One pass over mixed lines: (value, kind, fields, date).

    ``date`` is null exactly for lines that could not be read, so the parsed
    tables (``events_of``) and the rejects are both plain filters of the result.
    """
    kind, value = F.col("kind"), F.col("value")
    dated = _dated(
        fields_by_kind(kind, value),
        lambda f: F.when(kind == "proxysg", event_date(f, "proxysg", None, None)).when(
            kind != UNKNOWN, event_date(f, "bash", asof, year)
        ),
    )
    return route(lines).select("value", "kind", F.inline(dated))


def split_as(
    lines: DataFrame, table: str, asof: Column | None = None, year: int | Column | None = None
) -> DataFrame:
    """``split_routed`` for lines that are all taken for one table."""
    read = _dated(line_fields(F.col("value"), table), lambda f: event_date(f, table, asof, year))
    return lines.select("value", F.lit(table).alias("kind"), F.inline(read))


def events_of(split: DataFrame, table: str) -> DataFrame:
    """Typed rows of one table out of ``split_routed``."""
    return _typed(split.filter((F.col("kind") == table) & F.col("date").isNotNull()), table)


def rejects(split: DataFrame) -> DataFrame:
    """Lines out of ``split_routed`` that no format fits, with their kind."""
    return split.filter(F.col("date").isNull()).select("kind", "value")


def rejects_of(
    lines: DataFrame, table: str, asof: Column | None = None, year: int | Column | None = None
) -> DataFrame:
    """Lines that ``parse(lines, table)`` leaves out."""
    read = _dated(line_fields(F.col("value"), table), lambda f: event_date(f, table, asof, year))
    return lines.select("value", F.inline(read)).filter(F.col("date").isNull()).select("value")
