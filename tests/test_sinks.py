from __future__ import annotations

import gzip
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from test_parse import FW, LOGIN, LOGOUT, PLAIN, SHELL, TLS, WEB
from vigil import cli, schemas
from vigil.operators import parse
from vigil.session import scratch, scratch_path, settle
from vigil.sinks import catalog, export, ingest, tables
from vigil.sources import tables as sources


@pytest.fixture
def dated(spark):
    def make(*rows):
        return spark.createDataFrame(rows, "v int, date string").withColumn("date", F.col("date").cast("date"))

    return make


def test_append_and_replace(spark, tmp_path, dated):
    path = str(tmp_path / "t")
    tables.append_path(dated((1, "2024-01-01"), (2, "2024-01-02")), path)
    tables.append_path(dated((3, "2024-01-02")), path)
    tables.replace_dates(dated((4, "2024-01-02")), path)
    read = sources.read_table(spark, path)
    assert rows_of(read.select("v", F.col("date").cast("string"))) == [(1, "2024-01-01"), (4, "2024-01-02")]


def test_files_by_day_need_no_shuffle(spark, tmp_path, dated):
    rows = dated((1, "2024-01-01"), (2, "2024-01-02"))
    tables.append_path(rows, str(tmp_path / "t"), by_day=True)
    assert sources.read_table(spark, str(tmp_path / "t")).count() == 2
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in tables.by_date(rows)._jdf.queryExecution().executedPlan().toString()


def test_append_to_catalog(spark, tmp_path, dated):
    for day in ("2024-01-01", "2024-01-02"):
        tables.append(dated((1, day)), "appended", str(tmp_path / "c"))
    assert spark.table("appended").count() == 2
    assert spark.sql("show partitions appended").count() == 2


def test_hot_day_is_written_by_several_tasks(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        rows = spark.range(200_000).select(
            F.md5(F.col("id").cast("string")).alias("v"),
            F.when(F.col("id") % 3 == 0, "2024-01-01").otherwise("2024-01-02").cast("date").alias("date"),
        )
        tables.append_path(rows, str(tmp_path / "hot"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = list((tmp_path / "hot" / "date=2024-01-02").glob("*.parquet"))
    assert len(files) > 3
    assert sources.read_table(spark, str(tmp_path / "hot")).count() == 200_000


def test_missing_days_give_an_empty_slice(spark, tmp_path, dated):
    path = str(tmp_path / "t")
    tables.append_path(dated((1, "2024-01-01"), (2, "2024-01-05")), path)
    read = sources.read_table(spark, path)
    assert sources.date_slice(read, "2024-01-01", "2024-01-04").count() == 1
    empty = sources.date_slice(read, "2023-01-01", "2023-01-04")
    assert empty.count() == 0 and empty.columns == ["v", "date"]


def test_snapshot_twice(spark, tmp_path):
    for n in (5, 2):
        tables.snapshot(spark.range(n), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2


def test_catalog(spark, tmp_path, dated):
    rows = dated((1, "2024-01-01"), (2, "2024-02-03"))
    rows.drop("date").write.parquet(str(tmp_path / "like"))
    for _ in range(2):
        catalog.create_like(spark, str(tmp_path / "like"), "by_day", str(tmp_path / "by_day"))
    assert spark.table("by_day").columns == ["v", "year", "month", "day"]
    catalog.load_days(rows, "by_day")
    catalog.load_partition(spark.createDataFrame([(9,)], "v int"), "by_day", 2024, 1, 1)
    for _ in range(2):
        catalog.add_partition(spark, "by_day", 2025, 12, 31)
    assert rows_of(spark.table("by_day")) == [(1, 2024, 1, 1), (2, 2024, 2, 3), (9, 2024, 1, 1)]
    assert spark.sql("show partitions by_day").count() == 3


def test_gzip_json(spark, tmp_path):
    export.write_gzip_json(spark.range(3), str(tmp_path / "j"))
    found = []
    for part in (tmp_path / "j").glob("*.gz"):
        found += [json.loads(line)["id"] for line in gzip.open(part, "rt")]
    assert sorted(found) == [0, 1, 2]


def test_json_rows(spark):
    df = spark.createDataFrame([(1, "a\"b")], "n int, t string")
    assert json.loads(export.to_json_rows(df).first()["value"]) == {"n": 1, "t": 'a"b'}


def write_lines(folder: Path, *lines: str) -> str:
    folder.mkdir(parents=True)
    (folder / "part.log").write_text("\n".join(lines) + "\n")
    return str(folder)


def test_ingest_of_mixed_lines(spark, tmp_path):
    fw = FW.replace("gw1", "dc1-fw1")
    write_lines(tmp_path / "raw" / "a" / "b", fw, SHELL, LOGIN, LOGOUT)
    write_lines(tmp_path / "raw" / "c", PLAIN, TLS, "noise", "bash: bad")
    root, rejects = str(tmp_path / "db"), str(tmp_path / "rejects")
    ingest.ingest_logs(spark, "all", str(tmp_path / "raw"), root, year=2024, rejects=rejects)
    counts = {
        t: sources.read_table(spark, f"{root}/{t}", schemas.EVENT_TABLES[t]).count()
        for t in ("fw", "bash", "ciscovpn", "proxysg")
    }
    assert counts == {"fw": 1, "bash": 1, "ciscovpn": 2, "proxysg": 2}
    left = spark.read.schema("value string, kind string").text(rejects)
    assert rows_of(left, "kind", "value") == [("bash", "bash: bad"), ("unknown", "noise")]


@pytest.mark.parametrize(
    "kind, line, table",
    [("iptables", FW, "fw"), ("bashlog", SHELL, "bash"), ("ciscovpn", LOGIN, "ciscovpn"),
     ("proxysg", PLAIN, "proxysg"), ("apacheAccessLog", WEB, "apache")],
)
def test_command_line(spark, tmp_path, kind, line, table):
    raw = write_lines(tmp_path / "raw", line, "noise")
    args = ["-i", kind, "-p", raw, "--root", str(tmp_path / "db"), "--rejects", str(tmp_path / "rej"), "--year", "2024"]
    args += ["--by-day"] if kind == "iptables" else []
    cli.main(args)
    stored = sources.read_table(spark, str(tmp_path / "db" / table), schemas.EVENT_TABLES[table])
    assert stored.count() == 1 and stored.filter("year(date) = 2024").count() == 1
    assert [r["value"] for r in spark.read.text(str(tmp_path / "rej")).collect()] == ["noise"]


def test_command_line_feeds(spark, tmp_path):
    otx = write_lines(tmp_path / "otx", "192.0.2.9#4#2#Scanning Host#US#City#1.0,2.0#11", "")
    rules = write_lines(tmp_path / "rules", "-A X -p ip -s 192.0.2.0/24 -j DROP", "# comment")
    phish = write_lines(tmp_path / "phish", " http://bad.example/x ")
    root = str(tmp_path / "db")
    for kind, raw in (("alienvault_otx", otx), ("c2", rules), ("openphish", phish), ("c2", rules)):
        cli.main(["-i", kind, "-p", raw, "--root", root])
    assert rows_of(sources.read_table(spark, f"{root}/otx")) == [("192.0.2.9", "Scanning Host")]
    assert rows_of(sources.read_table(spark, f"{root}/c2")) == [("192.0.2.0/24", "C2")]
    assert rows_of(sources.read_table(spark, f"{root}/openphish")) == [("http://bad.example/x", "OpenPhish")]


def test_staged_table_reads_own_part_only(spark, lines):
    staged = ingest._staged(parse.split_routed(lines(SHELL, LOGIN, "noise"), year=2024))
    plan = parse.events_of(staged, "bash")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(kind" in plan and "regexp" not in plan.lower()


def test_rejects_are_kept_by_default(spark, tmp_path):
    raw = write_lines(tmp_path / "raw", SHELL, "noise")
    for _ in range(2):
        ingest.ingest_logs(spark, "bashlog", raw, str(tmp_path / "db"), year=2024, run="r")
    left = spark.read.option("recursiveFileLookup", True).text(str(tmp_path / "db" / "rejects"))
    assert [r["value"] for r in left.collect()] == ["noise"]


def test_compacted_days_hold_the_same_rows(spark, tmp_path, dated):
    path, schema = str(tmp_path / "t"), schemas.BASH
    event = spark.createDataFrame([(None,) * len(schema.fields)], schema)
    for i in range(3):
        tables.store(event.withColumn("date", F.lit("2024-01-02").cast("date")).withColumn("command", F.lit(str(i))), path, f"run-{i}")
    tables.compact(spark, path, schema, ("2024-01-01", "2024-01-31"), "whole")
    assert [p.name for p in (tmp_path / "t" / "date=2024-01-02").iterdir()] == ["batch=whole"]
    assert rows_of(sources.read_table(spark, path), "command") == [("0",), ("1",), ("2",)]


def test_scratch_lives_for_its_block(spark):
    with scratch(spark):
        kept = settle(spark.range(3), "kept")
        place = Path(kept.inputFiles()[0].removeprefix("file:")).parent
        assert place.exists()
    assert not place.exists()


def test_scratch_follows_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    first, second = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert first != second
    assert first.startswith(f"{root.rstrip('/')}/x-")
