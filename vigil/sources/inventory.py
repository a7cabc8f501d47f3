"""CSV and JSON side tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vigil import schemas
from vigil.operators.sizing import small
from vigil.session import settle


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """CSV with a header; types are inferred only when no schema is given."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def read_inventory_csv(
    spark: SparkSession,
    path: str,
    schema: StructType | None = None,
    encoding: str = "UTF-16",
    sep: str = "|",
) -> DataFrame:
    """Wide-character CSV exports.

    ``multiLine`` reads each file in one task, and so allows line breaks inside quotes;
    ``read_wide_csv`` reads large files without them in many tasks.
    """
    reader = spark.read.options(
        header=True, sep=sep, encoding=encoding, multiLine=True, mode="PERMISSIVE"
    )
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def read_directory(spark: SparkSession, path: str, drop_blank: bool = False) -> DataFrame:
    """Staff directory (address, home country); optionally only known countries."""
    people = read_csv(spark, path, schemas.DIRECTORY)
    return people.filter(~F.col("c").like("")) if drop_blank else people


def read_timeline_csv(spark: SparkSession, path: str) -> DataFrame:
    """File-system timeline; columns are found by their header names."""
    return (
        spark.read.option("header", True)
        .csv(path)
        .select(*[F.col(name).cast("string") for name in schemas.TIMELINE.names])
    )


def read_rank_list(spark: SparkSession, path: str) -> DataFrame:
    """Headerless ``rank,domain`` list."""
    return spark.read.schema(schemas.RANK_LIST).csv(path)


def read_inventory_json(spark: SparkSession, path: str, schema: StructType = schemas.SCCM_VULN) -> DataFrame:
    """JSON-lines inventory."""
    return spark.read.schema(schema).json(path)


def read_site_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Per-site JSON: a struct of region counts per product."""
    return spark.read.schema(schemas.SITE_MATRIX).json(path)


# What each byte order mark says.
_ORDERS = {b"\xff\xfe": "UTF-16LE", b"\xfe\xff": "UTF-16BE"}


# What ``_cut`` yields: whole lines, and what is left at both ends of a split.
_LINES = "value string"
_EDGES = "place bigint, part int, closes boolean, bytes binary"


def _cut(encoding: str, edges: bool):
    """Lines inside of splits, or (``edges``) the bytes in front of their first and behind their last line feed.

    For ``mapInArrow`` on (place, above, bytes) in the order of the file, ``place`` naming a
    split and ``above`` being the bytes in front of it.  A split begins behind a byte 0A, so
    half a letter in front of it is that byte.
    """
    unit = "<u2" if encoding == "UTF-16LE" else ">u2"

    def found(batches):
        import numpy as np
        import pyarrow as pa

        def joined(pieces):
            pieces = pieces.cast(pa.large_binary())
            _, ends, data = pieces.buffers()
            ends = np.frombuffer(ends, np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
            data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.empty(0, np.uint8)
            return np.insert(data, ends[1:] - ends[0], 10).tobytes()

        def out(rows):
            if not edges:
                return pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], ["value"])
            types = (pa.int64(), pa.int32(), pa.bool_(), pa.binary())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
            return pa.RecordBatch.from_arrays(columns, ["place", "part", "closes", "bytes"])

        def tail():
            # What is no whole letter belongs to the next split, or is behind the file.
            return place, 1, False, held[: len(held) - len(held) % 2]

        place, held, opened = None, b"", False
        for batch in batches:
            places, above = (batch.column(i).to_numpy() for i in range(2))
            if not len(places):
                continue
            rows, cuts = [], [0, *(np.flatnonzero(np.diff(places)) + 1).tolist(), len(places)]
            for first, end in zip(cuts, cuts[1:]):
                if place != places[first]:
                    if place is not None and edges:
                        rows.append(tail())
                    place, opened, held = int(places[first]), above[first] == 0, b"\n" if above[first] % 2 else b""
                held += joined(batch.column(2).slice(first, end - first))
                feeds = np.flatnonzero(np.frombuffer(held, unit, len(held) // 2) == 10)
                if not len(feeds):
                    continue
                begin, last = 0, 2 * int(feeds[-1])
                if not opened:
                    begin = 2 * int(feeds[0]) + 2
                    opened = True
                    if edges:
                        rows.append((place, 0, True, held[: begin - 2]))
                if not edges and begin <= last:
                    rows += held[begin:last].decode(encoding, "replace").split("\n")
                held = held[last + 2 :]
            if rows:
                yield out(rows)
        if place is not None and edges:
            yield out([tail()])

    return found


def wide_lines(spark: SparkSession, path: str, mark: bytes) -> DataFrame:
    """Lines of UTF-16 files that begin with ``mark``, from splits of any size: ``(value)``.

    Spark cuts at every byte 0A, which is half a line feed, or half of another letter.  In
    little-endian files a cut ends a line if it has an even offset and a zero follows, in
    big-endian ones if its offset is odd and a zero is in front.  Where all pieces of a
    file have the length and the zero that whole lines have, they are the lines, and
    nothing is shuffled.  The pieces of other files are put together split by split, from the
    sums of the bytes in front of each; only what crosses the end of a split is shuffled.
    """
    encoding, little = _ORDERS[mark], mark == b"\xff\xfe"
    pieces = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("row"), F.col("value").cast("binary").alias("bytes"),
    )
    size = F.octet_length("bytes")
    zero, first = F.lit(b"\0"), (F.col("split") == 0) & F.startswith("bytes", F.lit(mark))
    if little:
        half = F.startswith("bytes", zero)
        regular = F.when(first, size % 2 == 0).otherwise(half & (size % 2 == 1))
        text = F.when(first, F.col("bytes")).otherwise(F.substring("bytes", F.lit(2), size))
    else:
        half = F.endswith("bytes", zero)
        regular = half & (size % 2 == 1)
        text = F.substring("bytes", F.lit(1), size - 1)
    # At most one row a file.
    torn = small(settle(pieces.where(~regular).select("file").distinct().withColumn("torn", F.lit(True)), "torn_files"))
    # The text depends on the join, or filters on it would decode pieces of torn lines as well.
    sound = F.col("torn").isNull()
    whole = pieces.join(torn, "file", "left").where(sound).select(F.when(sound, F.decode(text, encoding)).alias("value"))
    if not torn.take(1):
        return whole
    # A row a split of 128 MB, with what lies in front of it.
    sums = pieces.join(torn.drop("torn"), "file").groupBy("file", "split").agg(F.sum(size.cast("bigint") + 1).alias("n"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("n").over(before), F.lit(0)).alias("above")
    above = settle(sums.select("file", "split", offset, F.monotonically_increasing_id().alias("place")), "splits")
    # Broadcast, so that pieces stay where and in the order they were read.
    placed = pieces.join(F.broadcast(above), ["file", "split"]).select("place", "above", "bytes")
    lines = placed.mapInArrow(_cut(encoding, False), _LINES)
    ends = settle(placed.mapInArrow(_cut(encoding, True), _EDGES), "split_ends").join(above.drop("above"), "place")
    # Lines over the end of a split: what follows a line feed up to the next one that closes.
    order = Window.partitionBy("file").orderBy("split", "part").rowsBetween(Window.unboundedPreceding, -1)
    line = F.coalesce(F.sum(F.col("closes").cast("int")).over(order), F.lit(0))
    glued = ends.withColumn("line", line).groupBy("file", "line").agg(
        F.array_sort(F.collect_list(F.struct("split", "part", "bytes"))).alias("parts"), F.max("closes").alias("closes")
    )
    joined = F.unhex(F.array_join(F.transform("parts", lambda part: F.hex(part["bytes"])), ""))
    crossing = glued.select("closes", joined.alias("bytes")).where("closes or octet_length(bytes) > 0")
    return whole.unionByName(lines).unionByName(crossing.select(F.decode("bytes", encoding).alias("value")))


def read_wide_csv(spark: SparkSession, path: str, schema: StructType, sep: str = "|") -> DataFrame:
    """UTF-16 CSV with a header, a large file in many tasks.

    ``schema`` names the columns in the order of the header.  Files begin with a byte
    order mark, all with the same; a line break always ends a row, also inside quotes.
    Rows with too few columns have nulls.
    """
    first = spark.read.option("lineSep", "\n").text(path).select(F.substring(F.col("value").cast("binary"), 1, 2).alias("mark")).first()
    if first is None:
        return spark.createDataFrame([], schema)
    mark = bytes(first["mark"])
    if mark not in _ORDERS:
        raise ValueError("the file does not begin with a UTF-16 byte order mark")
    text = F.regexp_replace("value", "\r$", "")
    # Only a header begins with the mark.
    rows = wide_lines(spark, path, mark).select(text.alias("value")).where(~F.col("value").startswith("\ufeff") & (F.col("value") != ""))
    columns = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in schema)
    parsed = F.from_csv("value", columns, {"sep": sep, "mode": "PERMISSIVE"})
    return rows.select(parsed.alias("row")).select("row.*")
