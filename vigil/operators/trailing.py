"""A day against the days before it: moments and distributions that merge.

Events are reduced to one row a key and day (moments) or a key, day and value
(histograms) before any window is seen, so a key with a third of all events is a few
rows a day, and a window holds days, not events.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, LongType, StructField, StructType

from vigil.operators import sizing

_WHOLE = "decimal(38,0)"


def daily_moments(events: DataFrame, key: str, value: str, day: str = "date") -> DataFrame:
    """``(key, day, n, total, squares)`` of the integer ``value``; sums are exact.

    Events without a day or value are left out; a null key is a key of its own.
    """
    whole = F.col(value).cast("decimal(18,0)")
    known = events.where(F.col(day).isNotNull() & F.col(value).isNotNull())
    return known.groupBy(key, day).agg(
        F.count("*").alias("n"), F.sum(whole).cast(_WHOLE).alias("total"), F.sum(whole * whole).cast(_WHOLE).alias("squares")
    )


def _deviation(n: Column, total: Column, squares: Column) -> Column:
    """Standard deviation of a sample from exact sums; null for fewer than two values."""
    spread = (n.cast(_WHOLE) * squares - total * total).cast("double")
    return F.when(n > 1, F.sqrt(spread / (n.cast("double") * (n - 1).cast("double"))))


def moment_deviation(moments: DataFrame, key: str, days: int = 7, day: str = "date") -> DataFrame:
    """Each key and day with its mean and those of the ``days`` days before it.

    ``(key, day, n, mean, trailing_n, trailing_mean, trailing_sd, deviation)``: the window
    is a range of calendar days without the day itself, so days without events count as
    passed.  The deviation is in standard deviations of single values; it is null without
    a window, or where the window does not vary.
    """
    place = F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))
    before = Window.partitionBy(key).orderBy("_day").rangeBetween(-days, -1)
    seen = moments.withColumn("_day", place).withColumns(
        {f"_{c}": F.sum(c).over(before) for c in ("n", "total", "squares")}
    )
    mean = F.col("total").cast("double") / F.col("n")
    trailing_mean = F.col("_total").cast("double") / F.col("_n")
    sd = _deviation(F.col("_n"), F.col("_total").cast(_WHOLE), F.col("_squares").cast(_WHOLE))
    return seen.select(
        key, day, "n", mean.alias("mean"), F.coalesce("_n", F.lit(0)).alias("trailing_n"),
        trailing_mean.alias("trailing_mean"), sd.alias("trailing_sd"),
        F.when(sd > 0, (mean - trailing_mean) / sd).alias("deviation"),
    )


def daily_histogram(events: DataFrame, key: str, value: str, day: str = "date") -> DataFrame:
    """``(key, day, value, n)``: how often each value occurs on a day; nulls are left out."""
    known = events.where(F.col(day).isNotNull() & F.col(value).isNotNull() & F.col(key).isNotNull())
    return known.groupBy(key, day, value).agg(F.count("*").alias("n"))


# Rows that are looked at together, and values of windows that are sorted together.
_ROWS, _VALUES = 100_000, 1_000_000


def _medians(of: np.ndarray, values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many values each window has, and their median; ``of`` numbers the windows from 0, ascending."""
    order = np.lexsort((values, of))
    values, upto = values[order], np.cumsum(counts[order])
    first = np.flatnonzero(np.diff(of, prepend=-1))
    before = upto[first] - counts[order][first]
    every = np.append(upto[first[1:] - 1], upto[-1]) - before
    # The two in the middle.
    low, high = (np.searchsorted(upto, before + place) for place in ((every + 1) // 2, every // 2 + 1))
    return every, (values[low] + values[high]) / 2


def _windows(group: np.ndarray, span: np.ndarray, day: np.ndarray, value: np.ndarray, n: np.ndarray, days: int):
    """(row of a day, values before it, median, deviation) of rows in order of group and day."""
    place = group * (1 << 32) + day + (1 << 31)
    rows = np.flatnonzero(np.diff(place, prepend=-1))
    rows = rows[day[rows] // days == span[rows]]
    low, high = np.searchsorted(place, place[rows] - days), np.searchsorted(place, place[rows])
    rows, low, high = (a[high > low] for a in (rows, low, high))
    ends = np.cumsum(high - low)
    begin = 0
    while begin < len(rows):
        done = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + _VALUES, side="right")))
        size = (high - low)[begin:end]
        of = np.repeat(np.arange(end - begin), size)
        at = np.repeat(low[begin:end] - (ends[begin:end] - size - done), size) + np.arange(len(of))
        every, median = _medians(of, value[at], n[at])
        yield rows[begin:end], every, median, _medians(of, np.abs(value[at] - median[of]), n[at])[1]
        begin = end


def trailing_medians(histogram: DataFrame, key: str, value: str, days: int = 30, day: str = "date") -> DataFrame:
    """``(key, day, trailing_n, median, deviation)`` over the ``days`` days before each day.

    The deviation is the median distance from the median; values are taken as doubles.
    Days are cut into spans as long as a window.  A key's rows of a span go to it and to
    the next one, so each travels twice, and a task holds two spans of a key at most.
    """
    names = [key, day, "trailing_n", "median", "deviation"]
    schema = StructType([
        histogram.schema[key], StructField(day, DateType()), StructField("trailing_n", LongType()),
        StructField("median", DoubleType()), StructField("deviation", DoubleType()),
    ])

    def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
        columns = [table[c].to_numpy() for c in ("span", "day", "value", "n")]
        for rows, every, median, spread in _windows(_numbers(table), *columns, days):
            held = pa.table(
                [table["key"].take(rows), table["day"].take(rows).cast(pa.int32()).cast(pa.date32()), every, median, spread], names
            )
            yield from held.combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, wanted = 0, _ROWS
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= wanted:
                # The last group may go on.
                table = pa.Table.from_batches(held)
                numbers = _numbers(table)
                cut = int(np.searchsorted(numbers, numbers[-1]))
                if cut:
                    yield from found(table.slice(0, cut))
                held, size = table.slice(cut).to_batches(), size - cut
                wanted = max(_ROWS, 2 * size)
        if size:
            yield from found(pa.Table.from_batches(held))

    number = F.datediff(F.col(day), F.lit("1970-01-01").cast("date")).cast("long")
    span = F.floor(number / days)
    rows = histogram.select(
        F.col(key).alias("key"), F.explode(F.array(span, span + 1)).alias("span"), number.alias("day"),
        F.col(value).cast("double").alias("value"), "n",
    )
    rows = sizing.spread(rows, "key", "span").sortWithinPartitions("key", "span", "day")
    return rows.mapInArrow(run, schema)


def _numbers(table: pa.Table) -> np.ndarray:
    """The groups (key, span) of a table in their order, numbered."""
    keys = table["key"].combine_chunks().dictionary_encode().indices.to_numpy()
    other = (np.diff(keys, prepend=keys[:1]) != 0) | (np.diff(table["span"].to_numpy(), prepend=table["span"][0].as_py()) != 0)
    return np.cumsum(other)
