"""WARC archives: written with revisits, read back by boundary-chain verification.

Writing: pages whose payloads are equal and long enough become one response and revisits
of it.  Records are rows of text files whose line separator is the end of a record
(``\\r\\n\\r\\n``), so Spark writes them in parallel and commits them as any output.

Reading: files are split at the record magic, wherever it stands, by tasks that know
nothing of each other.  Each occurrence is a candidate record; its header gives the place
where its successor would have to start.  Sums of lengths (by split, then over the splits
of a file) turn candidates into offsets.  Pointer jumping from the start of each file
doubles the reachable chain in every round; candidates it never reaches are magic inside
payloads, and their bytes go back to the record they lie in.  A chain that does not end
at the end of its file is an error.

Digests of records that are whole in one candidate are taken by the task that reads them;
only records with magic inside their payload are put together again.

Defined cases: null html is an empty payload; a null URL is written as empty; line breaks
in a URL are percent-encoded; a null page id is smaller than any other; rows that repeat
the largest page id of a group are all responses, as nothing tells them apart; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.llm.common import bloom, may_hold
from vigil.session import scratch_path, settle

# Fixed values of the format.
MAGIC = "WARC/1.1\r\n"
BREAK = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8"
# Shorter payloads are always written whole.
SHORTEST_REVISITED = 1000


def _payload() -> Column:
    return F.coalesce(F.col("html").cast("string"), F.lit(""))


def _page() -> Column:
    return F.coalesce(F.col("page_id").cast("string"), F.lit("null"))


def with_types(pages: DataFrame, shortest: int = SHORTEST_REVISITED) -> DataFrame:
    """``(page_id, url, html, digest, n_bytes, refers_to)``; refers_to is null for responses."""
    digest = F.sha1(_payload().cast("binary"))
    told = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").select(
        "*", digest.alias("digest"), F.octet_length(_payload()).cast("long").alias("n_bytes")
    )
    long = told.where(F.col("n_bytes") >= shortest).select("page_id", "digest")
    groups = long.groupBy("digest").agg(F.max("page_id").alias("keep"), F.count("*").alias("copies")).where("copies > 1")
    # One row for each page that has a copy.  Pages of a group meet their response here as
    # ids only; the join splits groups that are large.
    revisits = (
        long.join(groups, "digest")
        .where(~F.col("page_id").eqNullSafe(F.col("keep")) & F.col("keep").isNotNull())
        .select("digest", F.coalesce(F.col("page_id").cast("string"), F.lit("null")).alias("page"), F.col("keep").alias("refers_to"))
        .distinct()
    )
    revisits = settle(revisits, "revisits")
    told = told.withColumn("page", _page())
    # Pages that surely are no revisit stay where they are; only the others meet the list.
    key = F.xxhash64("digest", "page")
    maybe = may_hold(pages.sparkSession, bloom(revisits.select(key.alias("key")), "key"), key)
    alone = told.where(~maybe).withColumn("refers_to", F.lit(None).cast("long"))
    return told.where(maybe).join(revisits, ["digest", "page"], "left").unionByName(alone).drop("page")


def write_archives(pages: DataFrame, path: str, shortest: int = SHORTEST_REVISITED) -> None:
    """Write a record for every page below ``path``, as ``.warc`` text parts."""
    url = F.regexp_replace(F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), "\r", "%0D"), "\n", "%0A")
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, F.lit(HTTP + BREAK)).otherwise(F.concat(F.lit(HTTP + BREAK), _payload()))
    fields = [
        (F.lit("WARC-Type"), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        (F.lit("WARC-Record-ID"), F.concat(F.lit("<urn:page:"), _page(), F.lit(">"))),
        (F.lit("WARC-Target-URI"), url),
        (F.lit("WARC-Payload-Digest"), F.concat(F.lit("sha1:"), F.col("digest"))),
        (F.lit("X-Payload-Length"), F.col("n_bytes").cast("string")),
        (F.lit("Content-Type"), F.lit("application/http; msgtype=response")),
    ]
    head = F.concat(F.lit(MAGIC), *[F.concat(name, F.lit(": "), value, F.lit("\r\n")) for name, value in fields])
    refers = F.when(
        revisit,
        F.concat(
            F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"),
            F.col("refers_to").cast("string"), F.lit(">\r\n"),
        ),
    ).otherwise(F.lit(""))
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(BREAK))
    record = F.concat(head, refers, length, block)
    with_types(pages, shortest).select(record.alias("value")).write.option("lineSep", BREAK).text(path)


def _field(name: str) -> Column:
    return F.regexp_extract("head", rf"(?md)^{name}: ([^\r\n]*)\r$", 1)


def _candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every occurrence of the magic, in file order within a split; value is what follows it."""
    return (
        spark.read.option("lineSep", MAGIC)
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("split"),
            F.col("_metadata.file_size").alias("file_size"),
            F.monotonically_increasing_id().alias("row"),
            F.col("value").cast("binary").alias("bytes"),
        )
    )


def _bytes_from(start: Column, length: Column) -> Column:
    return F.substring(F.col("bytes"), start, length)


def _offsets(read: DataFrame) -> DataFrame:
    """Candidates with the offset of their magic, from the lengths before them."""
    size = F.octet_length("bytes").cast("long")
    # The header ends at the first blank line; it is looked for in the candidate's own bytes.
    text = F.decode("bytes", "ISO-8859-1")
    end = F.locate(BREAK, F.concat(F.lit("\r\n"), text)).cast("long") - 3
    heads = read.select(
        "file", "split", "file_size", "row", "bytes", size.alias("size"), F.greatest(end, F.lit(0)).alias("head_end")
    ).withColumn("head", F.when(F.col("head_end") > 0, F.decode(_bytes_from(F.lit(1), F.col("head_end").cast("int") + 2), "UTF-8")).otherwise(F.lit("")))
    block = F.col("head_end") + 4
    content = _field("Content-Length")
    inner = F.decode(_bytes_from((block + 1).cast("int"), F.lit(len(HTTP + BREAK))), "ISO-8859-1") == F.lit(HTTP + BREAK)
    told = heads.select(
        "file", "split", "file_size", "row", "size", block.alias("block"),
        F.when(content.rlike(r"^\d{1,18}$"), content).cast("long").alias("content"),
        _field("WARC-Type").alias("record_type"),
        F.regexp_extract("head", r"(?md)^WARC-Record-ID: <urn:page:([^\r\n]*)>\r$", 1).alias("page"),
        F.regexp_extract("head", r"(?md)^WARC-Refers-To: <urn:page:([^\r\n]*)>\r$", 1).alias("refers"),
        F.regexp_extract("head", r"(?md)^WARC-Payload-Digest: sha1:([^\r\n]*)\r$", 1).alias("said"),
        _field("X-Payload-Length").alias("said_bytes"),
        inner.alias("http"),
        F.sha1(_bytes_from((block + 1 + len(HTTP + BREAK)).cast("int"), (F.col("size") - block - len(HTTP + BREAK) - 4).cast("int"))).alias("read_digest"),
    )
    return told


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of the real records."""
    told = settle(_offsets(_candidates(spark, path)), "candidates")
    # Offsets: inside a split by order, splits by their sums (a row for each split).
    size = F.col("size") + len(MAGIC)
    sums = told.groupBy("file", "split").agg(F.sum(size).alias("sum"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("file", "split", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file", "split").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = told.withColumn("within", F.coalesce(F.sum(size).over(inside), F.lit(0))).join(sums, ["file", "split"])
    # What stands before the first magic of a file is empty, so the first magic is at 0.
    placed = settle(placed.withColumn("at", F.col("base") + F.col("within") - len(MAGIC)).where("at >= 0").drop("base", "within", "split", "row"), "offsets")
    following = F.col("at") + len(MAGIC) + F.col("block") + F.col("content") + len(BREAK)
    chain = settle(placed.select("file", "at", following.alias("to"), "file_size"), "links")
    reached = reachable(chain)
    records = placed.join(reached, ["file", "at"])
    whole = F.col("size") == F.col("block") + F.col("content") + len(BREAK)
    records = settle(records.withColumn("whole", whole), "records")
    digest, n_bytes = F.col("read_digest"), F.col("content") - len(HTTP + BREAK)
    told_of = records.where("whole").select("page", "record_type", "refers", "said", "said_bytes", digest.alias("digest"), n_bytes.alias("n_bytes"), "http")
    if records.where("not whole").take(1):
        told_of = told_of.unionByName(_put_together(spark, path, placed, records))
    return _checked(told_of)


def reachable(chain: DataFrame) -> DataFrame:
    """The ``(file, at)`` that the links ``(file, at, to, file_size)`` lead to from at = 0."""
    real = chain.select("file", "at")
    jumps = chain.join(real.select("file", F.col("at").alias("to")), ["file", "to"], "left_semi").select("file", "at", "to")
    # The chain's ends: links to the end of the file.  Every file needs to reach one.
    ends = chain.where(F.col("to") == F.col("file_size")).select("file", "at")
    n_files = chain.where("at = 0").count()
    reached = settle(chain.where("at = 0").select("file", "at"), "reached")
    jumps = settle(jumps, "jumps")
    while True:
        more = reached.join(jumps, ["file", "at"]).select("file", F.col("to").alias("at"))
        longer = settle(reached.unionAll(more).distinct(), "reached")
        done = longer.count() == reached.count()
        reached = longer
        if done:
            break
        onward = jumps.select("file", F.col("at").alias("to"), F.col("to").alias("then"))
        jumps = settle(jumps.join(onward, ["file", "to"]).select("file", "at", F.col("then").alias("to")), "jumps")
    if reached.join(ends, ["file", "at"], "left_semi").count() != n_files:
        raise ValueError("an archive's records do not end where the file ends")
    return reached


def _put_together(spark: SparkSession, path: str, placed: DataFrame, records: DataFrame) -> DataFrame:
    """Records whose payload holds magic: joined again from the candidates they span."""
    broken = records.where("not whole").select(
        "file", "at", (F.col("at") + len(MAGIC) + F.col("block") + F.col("content")).alias("end"), "block", "page", "record_type", "refers", "said", "said_bytes", "http"
    )
    # Of each candidate its record: the nearest real one before it, by file.
    heads = records.select("file", "at", F.col("at").alias("owner"))
    order = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    owned = (
        placed.select("file", "at", "size").join(heads, ["file", "at"], "left").withColumn("owner", F.last("owner", True).over(order))
        .join(broken.select("file", F.col("at").alias("owner")), ["file", "owner"], "left_semi")
    )
    # The bytes are read again, only for the files that have such a record.
    again = _candidates(spark, path).join(broken.select("file").distinct(), "file", "left_semi")
    again = settle(again.withColumn("size", F.octet_length("bytes").cast("long")), "again")
    size = F.col("size") + len(MAGIC)
    sums = again.groupBy("file", "split").agg(F.sum(size).alias("sum"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("file", "split", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file", "split").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        again.withColumn("within", F.coalesce(F.sum(size).over(inside), F.lit(0))).join(sums, ["file", "split"])
        .select("file", (F.col("base") + F.col("within") - len(MAGIC)).alias("at"), "bytes")
        .join(owned.select("file", "at", "owner"), ["file", "at"])
    )
    joined = parts.groupBy("file", F.col("owner").alias("at")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("at").alias("place"), "bytes"))).alias("parts")
    )
    all_bytes = F.aggregate(
        "parts", F.unhex(F.lit("")), lambda so_far, part: F.concat(so_far, F.lit(MAGIC).cast("binary"), part["bytes"])
    )
    start = F.col("block") + len(MAGIC) + len(HTTP + BREAK)
    return (
        broken.join(joined.select("file", "at", all_bytes.alias("bytes")), ["file", "at"])
        .withColumn("n_bytes", F.col("end") - F.col("at") - start)
        .select(
            "page", "record_type", "refers", "said", "said_bytes",
            F.sha1(_bytes_from((start + 1).cast("int"), F.col("n_bytes").cast("int"))).alias("digest"), "n_bytes", "http",
        )
    )


def _checked(records: DataFrame) -> DataFrame:
    """Digests as read from the payload, or from the header where a revisit has none."""
    revisit = F.col("record_type") == "revisit"
    wrong = ~revisit & ((F.col("digest") != F.col("said")) | ~F.col("http"))
    number = lambda c: F.when(F.col(c).rlike(r"^-?\d+$"), F.col(c)).cast("long")
    return records.select(
        number("page").alias("page_id"),
        F.when(revisit, number("said_bytes")).otherwise(F.col("n_bytes")).alias("payload_bytes"),
        F.when(wrong, F.raise_error(F.lit("a payload does not have the digest its record names")))
        .otherwise(F.when(revisit, F.col("said")).otherwise(F.col("digest")))
        .alias("payload_digest"),
        "record_type",
        number("refers").alias("refers_to"),
    )


def archive_round_trip(pages: DataFrame, shortest: int = SHORTEST_REVISITED) -> DataFrame:
    """Write all pages into archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "archives")
    write_archives(pages, path, shortest)
    return read_archives(spark, path)
