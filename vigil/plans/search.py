"""Ad-hoc SQL over event tables."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from vigil.sources.tables import date_slice


def sql_over(
    spark: SparkSession,
    tables: dict[str, DataFrame],
    query: str,
    args: dict[str, Any] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Run the caller's SQL over named tables; values go in as ``:name`` parameters.

    The tables are common table expressions of this one query, so searches of a session
    do not see each other's tables.
    """
    text = query.strip().replace("{", "{{").replace("}", "}}")
    named = ", ".join(f"`{name}` AS (SELECT * FROM {{table_{i}}})" for i, name in enumerate(tables))
    if text[:4].lower() == "with" and not text[4:5].isalnum():
        text = f"WITH {named}, {text[4:]}"
    elif named:
        text = f"WITH {named} {text}"
    found = spark.sql(text, args=args or None, **{f"table_{i}": df for i, df in enumerate(tables.values())})
    return found if limit is None else found.limit(limit)


def search(
    spark: SparkSession,
    tables: dict[str, DataFrame],
    start: str,
    end: str,
    query: str,
    args: dict[str, Any] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """``sql_over`` on a range of days; tables without a ``date`` stay whole."""
    sliced = {
        name: date_slice(df, start, end) if "date" in df.columns else df
        for name, df in tables.items()
    }
    return sql_over(spark, sliced, query, args, limit)
