"""An order of version texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def version_key(version: Column) -> Column:
    """An array that sorts like the version: numbers by value, words before the end of a version.

    ``9.11`` < ``10.2``, ``1.0rc1`` < ``1.0`` < ``1.0.1``, and ``1.0`` equals ``1-0``; case does
    not matter.  Null stays null, and a version without letters and digits comes
    before any that begins with a number and after those that begin with a word.
    """
    parts = F.regexp_extract_all(F.lower(version), F.lit(r"([0-9]+|[^\W\d_]+)"), 1)

    def part(text: Column) -> Column:
        # Leading zeros go; equally long numbers then sort as texts, whatever their size.
        digits = F.regexp_replace(text, "^0+(?=[0-9])", "")
        is_number = text.rlike("^[0-9]")
        return F.struct(
            F.when(is_number, 2).otherwise(0).alias("kind"),
            F.when(is_number, F.length(digits)).otherwise(0).alias("size"),
            F.when(is_number, digits).otherwise(text).alias("text"),
        )

    end = F.array(F.struct(F.lit(1).alias("kind"), F.lit(0).alias("size"), F.lit("").alias("text")))
    return F.when(version.isNotNull(), F.concat(F.transform(parts, part), end))
