"""Text reports of memory-image tools, as (image, value) lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions.patterns import IMAGE_KDBG, IMAGE_PROFILE, PROCESS_ROW


def parse_imageinfo(lines: DataFrame) -> DataFrame:
    """(image, profile, kdbg) per image; of several matching lines the last by text."""
    value = F.col("value")
    profile = F.rtrim(F.regexp_extract(value, IMAGE_PROFILE, 8), F.lit(","))
    return lines.groupBy("image").agg(
        F.max(F.when(value.contains("Profile") & value.rlike(IMAGE_PROFILE), profile)).alias("profile"),
        F.max(F.when(value.rlike(IMAGE_KDBG), F.regexp_extract(value, IMAGE_KDBG, 3))).alias("kdbg"),
    )


def parse_pslist(lines: DataFrame) -> DataFrame:
    """(image, process), a row per listed process.

    Long form on purpose: a list per image would put a whole image into one task.
    """
    value = F.col("value")
    return lines.filter(value.rlike(PROCESS_ROW)).select(
        "image", F.trim(F.regexp_extract(value, PROCESS_ROW, 3)).alias("process")
    )
