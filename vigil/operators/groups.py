"""Groups picked by their size, and the rows in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.operators.ranking import count_by, top
from vigil.operators.sizing import small
from vigil.session import settle


def rare_groups(df: DataFrame, *keys: str, below: int) -> DataFrame:
    """(keys, hits) of groups with fewer than ``below`` rows."""
    return count_by(df, *keys).filter(F.col("hits") < below)


def big_groups(df: DataFrame, *keys: str, above: int) -> DataFrame:
    """(keys, hits) of groups with more than ``above`` rows."""
    return count_by(df, *keys).filter(F.col("hits") > above)


def largest_groups(df: DataFrame, *keys: str, k: int = 10) -> DataFrame:
    """(keys, hits) of the ``k`` largest groups."""
    return top(count_by(df, *keys), k, *keys)


def rows_in(df: DataFrame, groups: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``df`` whose group was picked.

    A count and a join rather than a window count: a window would gather a hot group
    in one task.  The groups are counted once and kept, then broadcast when measured
    small; otherwise AQE splits the hot keys of ``df``.
    """
    picked = settle(groups.select(*keys), "groups")
    return df.join(small(picked), list(keys), "left_semi")
