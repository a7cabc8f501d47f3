"""Streams with memory, versioned tables and the splittable wide-character reader."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql.types import StringType, StructField, StructType

from conftest import rows_of
from vigil.sinks import versions
from vigil.sources import inventory
from vigil.streaming import ingest, stateful
from vigil.streaming.listener import BatchTable

PACKET = "action string, proto string, event_ts timestamp"


def _at(hour: float) -> dt.datetime:
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hour)


def _counts(spark, path, rows, watermark):
    spark.createDataFrame(rows, PACKET).coalesce(1).write.mode("append").parquet(f"{path}/in")
    landed = spark.readStream.schema(PACKET).parquet(f"{path}/in")
    query = stateful.start_counts(stateful.deny_counts(landed, watermark=watermark), f"{path}/out", f"{path}/check")
    query.awaitTermination()
    return query


def test_counts_over_a_restart_and_late_rows(spark, tmp_path):
    path = str(tmp_path)
    rng = random.Random(1)
    first = [(rng.choice(["DENY", "ACCEPT"]), rng.choice(["TCP", None]), _at(rng.random() * 6)) for _ in range(500)] + [("DENY", "TCP", None)]
    _counts(spark, path, first, "3 hours")
    # Within the watermark of the first start, and then behind it.
    second = [("DENY", "TCP", _at(4.5)), ("DENY", "TCP", _at(30))]
    _counts(spark, path, second, "3 hours")
    query = _counts(spark, path, [("DENY", "TCP", _at(5)), ("DENY", "UDP", _at(2)), ("DENY", "TCP", _at(29))], "3 hours")
    assert stateful.late_rows(query) == 2
    kept = [r for r in first + second + [("DENY", "TCP", _at(29))] if r[0] == "DENY" and r[2]]
    expected = Counter((ts.replace(minute=0, second=0, microsecond=0), proto) for _, proto, ts in kept)
    found = stateful.current_counts(spark, f"{path}/out")
    assert {(r.window_start, r.proto): r.n for r in found.collect()} == expected
    # The same counts from a table in one go.
    whole = stateful.deny_counts(spark.createDataFrame(kept, PACKET))
    assert rows_of(whole) == rows_of(found.select("window_start", "proto", "n"))


def test_counts_of_many_days_are_few_files(spark, tmp_path):
    path, days = str(tmp_path), 40
    _counts(spark, path, [("DENY", "TCP", _at(24 * day + hour)) for day in range(days) for hour in (1, 2)], "90 days")
    files = list(Path(path, "out").rglob("*.parquet"))
    # A file a task at most: with a folder a day there was one for each of 40 days and more.
    assert 0 < len(files) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert stateful.current_counts(spark, f"{path}/out").count() == 2 * days


def test_a_file_that_lands_twice_adds_nothing(spark, tmp_path):
    path = str(tmp_path)
    lines = ["h\tone", "h\ttwo", "g\tone", "h\t", "no tab", "h\tone"] + ["hot\tline"] * 200
    for again in range(3):
        spark.createDataFrame([(v,) for v in lines + ([f"h\tnew {again}"] if again else [])], "value string").write.mode("append").text(f"{path}/in")
        kept = stateful.without_repeats(ingest.stream_hosted_lines(spark, f"{path}/in"))
        ingest.start_file_sink(kept.selectExpr("*", "to_date(arrived_at) as date"), f"{path}/out", f"{path}/check", None).awaitTermination()
    found = rows_of(spark.read.parquet(f"{path}/out"), "host", "value")
    assert found == sorted(
        [("h", "one"), ("h", "two"), ("g", "one"), ("h", ""), ("no tab", "no tab"), ("hot", "line"), ("h", "new 1"), ("h", "new 2")], key=repr
    )


def test_a_replaced_feed_is_used_from_the_next_batch_on(spark, tmp_path):
    path = str(tmp_path)

    def land(*hosts):
        rows = spark.createDataFrame([(dt.date(2024, 1, 1), h) for h in hosts], "date date, host string")
        rows.write.mode("append").parquet(f"{path}/in")
        landed = spark.readStream.schema("date date, host string").parquet(f"{path}/in")
        stateful.start_ioc_hits(landed, "host", f"{path}/feed", "ioc", f"{path}/out", f"{path}/check").awaitTermination()

    def feed(*hosts):
        return versions.publish(spark.createDataFrame([(h,) for h in hosts], "ioc string"), f"{path}/feed")

    land("bad")
    assert not (tmp_path / "out").exists()
    assert feed("bad", "bad", None) == 1
    land("bad", "good", None, *["bad"] * 50)
    assert feed("good") == 2
    land("bad", "good")
    # A version that was never finished is not seen.
    (tmp_path / "feed" / "version=0000000003").mkdir()
    land("good")
    found = Counter(rows_of(spark.read.parquet(f"{path}/out"), "feed_version", "host"))
    assert found == {(1, "bad"): 51, (2, "good"): 2}


def test_versions(spark, tmp_path):
    root = str(tmp_path / "t")
    assert versions.newest(spark, root) is None and versions.versions(spark, root) == []
    for n in range(1, 4):
        versions.publish(spark.range(n), root)
    reader = versions.newest(spark, root)[1]
    assert versions.publish(spark.range(9), root) == 4 and reader.count() == 3
    assert versions.drop_old(spark, root) == [1, 2] and versions.versions(spark, root) == [3, 4]
    (tmp_path / "t" / "version=0000000005").mkdir()
    (tmp_path / "t" / "version=0000000005" / "part-0.parquet").write_text("left by a failed job")
    assert versions.newest(spark, root)[0] == 4
    assert versions.publish(spark.range(5), root) == 5 and versions.newest(spark, root)[1].count() == 5


def test_batch_table(spark, tmp_path):
    path = str(tmp_path)
    heard = BatchTable()
    spark.streams.addListener(heard)
    try:
        for n in (3, 1, 2):
            spark.range(n).selectExpr("date'2024-01-01' as date", "id").coalesce(1).write.mode("append").parquet(f"{path}/in")
        landed = spark.readStream.option("maxFilesPerTrigger", 1).schema("date date, id long").parquet(f"{path}/in")
        ingest.start_file_sink(landed, f"{path}/out", f"{path}/check", None).awaitTermination()
        assert heard.flush(spark, f"{path}/table") == 3 and heard.flush(spark, f"{path}/table") == 0
    finally:
        spark.streams.removeListener(heard)
    table = spark.read.schema(BatchTable.SCHEMA).parquet(f"{path}/table")
    assert sorted(r.rows for r in table.collect()) == [1, 2, 3]
    assert sorted(r.batch_id for r in table.collect()) == [0, 1, 2]


WIDE = StructType([StructField("a", StringType()), StructField("b", StringType())])


@pytest.mark.parametrize("order", ["utf-16-le", "utf-16-be"])
@pytest.mark.parametrize("size", [64, 1000, 10**6])
def test_wide_csv_in_many_tasks(spark, tmp_path, order, size):
    rng = random.Random(size)
    torn = ["ਊĀ", "Āਊ", "਀", "ĀĀ", "Āਊਊ", "plain", "a|b", "é日", "🎉", "say \"\"x\"\"", "ĊĊ"]
    rows = [(f"h{i}", "".join(rng.choice(torn) for _ in range(rng.randint(1, 5)))) for i in range(300)]
    lines = ["a|b"] + [f'{a}|"{b}"' for a, b in rows] + ["short", ""]
    mark = {"utf-16-le": b"\xff\xfe", "utf-16-be": b"\xfe\xff"}[order]
    for name, end, some in (("x.csv", "\r\n", lines), ("y.csv", "\n", ["a|b", "p|q"])):
        Path(tmp_path / name).write_bytes(mark + (end.join(some) + end * (name == "x.csv")).encode(order))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        found = inventory.read_wide_csv(spark, str(tmp_path), WIDE)
        pieces = inventory.wide_lines(spark, str(tmp_path / "x.csv"), mark)
        if size == 64:
            assert pieces.rdd.getNumPartitions() > 20
        expected = [(a, b.replace('""', '"')) for a, b in rows] + [("short", None), ("p", "q")]
        plain = [(a, b) for a, b in expected]
        # CSV keeps doubled quotes the way the plain reader does.
        same = inventory.read_inventory_csv(spark, str(tmp_path), WIDE)
        assert rows_of(found) == rows_of(same)
        assert [r for r in rows_of(found) if "say" not in (r[1] or "")] == sorted([r for r in plain if "say" not in (r[1] or "")], key=repr)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_wide_csv_needs_a_mark(spark, tmp_path):
    Path(tmp_path / "x.csv").write_bytes("a|b\n".encode("utf-16-le"))
    with pytest.raises(ValueError):
        inventory.read_wide_csv(spark, str(tmp_path), WIDE)
