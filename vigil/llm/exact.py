"""Exact duplicates by a persistent digest index, bucketed and sorted by digest.

A text's digest is the SHA-256 of its UTF-8 bytes without white space.  The index is a
table with one row for each digest ever seen, bucketed and sorted by the digest.  A new
batch is reduced to one row for each digest, compared with the index by a sort-merge
anti-join, and what is new is appended to the same buckets.  The index is not shuffled for
it; Spark sorts its buckets again for each batch, as a bucket has a file for each append.

A batch has a name, which its index rows carry.  Only digests that another batch brought
count as seen, and a batch that is given again adds what its earlier run did not get to
add, so a retry after a failure at any point gives the rows of an undisturbed run.

Defined cases: null text is empty text; empty texts equal each other; a null id is
larger than any other; of rows that repeat id and text one stays; an empty table gives
no rows; other columns are passed through by ``distinct_documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import WHITE, join_groups, text_of
from vigil.session import scratch_path, settle

BUCKETS = 64
INDEX_COLUMNS = "text_sha256 string, keep_id long, keep_chars long, group_size long, batch string"


def digests(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_chars, text_sha256)`` of every row."""
    return docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.char_length(text_of(text)).cast("long").alias("n_chars"),
        F.sha2(F.regexp_replace(text_of(text), WHITE, ""), 256).alias("text_sha256"),
    )


class DigestIndex:
    """The index table ``name`` below ``path`` (a folder all executors share)."""

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int = BUCKETS):
        self.spark, self.name, self.path, self.buckets = spark, name, path, buckets
        if not spark.catalog.tableExists(name):
            self._write(spark.createDataFrame([], INDEX_COLUMNS))

    def _write(self, rows: DataFrame) -> None:
        (
            rows.repartition(self.buckets, "text_sha256")
            .write.option("path", self.path)
            .bucketBy(self.buckets, "text_sha256")
            .sortBy("text_sha256")
            .mode("append")
            .saveAsTable(self.name)
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, batch: DataFrame, name: str) -> DataFrame:
        """Add the digests of ``batch`` (``digests`` plus a unique ``__row``) that no other batch has.

        Returns them, with the row that stays: the longest text, then the smallest id, then
        the smallest row.  A digest the index has from another batch keeps its earlier row.
        """
        best = F.max(F.struct("n_chars", F.bitwise_not(F.coalesce("doc_id", F.lit(2**63 - 1))).alias("id"), (-F.col("__row")).alias("row"), "doc_id"))
        groups = batch.groupBy("text_sha256").agg(best.alias("best"), F.count("*").alias("group_size"))
        groups = groups.select(
            "text_sha256", F.col("best.doc_id").alias("keep_id"), F.col("best.n_chars").alias("keep_chars"),
            "group_size", F.lit(name).alias("batch"), (-F.col("best.row")).alias("keep_row"),
        )
        others = self.read().where(F.col("batch") != name)
        fresh = settle(groups.join(others.hint("merge"), "text_sha256", "left_anti"), "fresh")
        new, mine = fresh, self.read().where(F.col("batch") == name).select("text_sha256")
        if mine.take(1):
            new = fresh.join(mine.hint("merge"), "text_sha256", "left_anti")
        self._write(new.select(*self.read().columns))
        return fresh

    def drop(self) -> None:
        """Forget the index; its folder is one of the kept tables, or the caller's."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def new_index(spark: SparkSession, buckets: int = BUCKETS) -> DigestIndex:
    """An empty index of its own name in the shared folder."""
    return DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", scratch_path(spark, "digest_index"), buckets)


def deduplicate(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """One row per document: ``(doc_id, keep_id, group_size, kept, text_sha256)``.

    Adds the documents to ``index`` (an empty one by default) under the name ``batch``, by
    which a retry is known; without one every call is a batch of its own.
    """
    index = index or new_index(docs.sparkSession)
    # The row numbers have to stay what they are, so the digests are kept.
    rows = settle(digests(docs).withColumn("__row", F.monotonically_increasing_id()), "digests")
    fresh = index.append(rows, batch or uuid.uuid4().hex)
    found = join_groups(rows, index.read(), "text_sha256", "group_size")
    stays = fresh.select(F.col("keep_row").alias("__row"), F.lit(True).alias("__stays"))
    found = found.join(stays, "__row", "left")
    return found.select("doc_id", "keep_id", "group_size", F.col("__stays").isNotNull().alias("kept"), "text_sha256")


def distinct_documents(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; ``batch`` as for ``deduplicate``."""
    index = index or new_index(docs.sparkSession)
    rows = settle(digests(docs).withColumn("__row", F.monotonically_increasing_id()), "digests")
    fresh = index.append(rows, batch or uuid.uuid4().hex)
    stays = fresh.select(_key(F.col("keep_id"), F.col("keep_chars"), F.col("text_sha256")))
    # The key has id and digest, so that many copies of a text are not one task.
    found = docs.withColumn("__key", _document_key()).join(stays, "__key", "left_semi")
    # Rows that repeat id and text: all of them are still there, and one has to stay.
    repeated = rows.groupBy("doc_id", "n_chars", "text_sha256").count().where("count > 1")
    repeated = settle(repeated.select(_key(F.col("doc_id"), F.col("n_chars"), F.col("text_sha256"))), "repeated")
    if repeated.take(1):
        more = found.join(repeated, "__key", "left_semi").dropDuplicates(["__key"])
        found = found.join(repeated, "__key", "left_anti").unionByName(more)
    return found.drop("__key")


def _key(id_column: Column, n_chars: Column, digest: Column) -> Column:
    return F.struct(id_column.alias("id"), n_chars.alias("chars"), digest.alias("sha")).alias("__key")


def _document_key() -> Column:
    text = text_of()
    return _key(
        F.col("doc_id").cast("long"), F.char_length(text).cast("long"), F.sha2(F.regexp_replace(text, WHITE, ""), 256)
    )
