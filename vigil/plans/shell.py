"""Questions about shell commands (``bash``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ("source", "username", "exec_as", "srcip", "command")


def search(bash: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose ``command`` or ``username`` is LIKE ``pattern`` (caller sets %)."""
    if column not in ("command", "username"):
        raise ValueError("search in command or username")
    return bash.filter(F.col(column).like(pattern)).select(*COLUMNS)
