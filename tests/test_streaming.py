from __future__ import annotations

from pathlib import Path

from conftest import rows_of
from test_parse import FW, LOGIN, LOGOUT, PLAIN, SHELL
from vigil import schemas
from vigil.operators import parse
from vigil.session import scratch_root
from vigil.sinks import ingest as batch
from vigil.sinks import tables
from vigil.sources.lines import read_hosted_lines
from vigil.sources.tables import date_slice, read_events
from vigil.streaming import ingest
from vigil.streaming.listener import BatchInfo

FW = FW.replace("gw1", "dc1-fw1")


def land(root: Path, day: str, name: str, *lines: str) -> None:
    folder = root / f"dt={day}"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")


def run(spark, tmp_path, **options):
    stream = ingest.stream_lines(spark, str(tmp_path / "in" / "dt=*"), **options)
    out = str(tmp_path / "out")
    query = ingest.start_ingest(stream, out, str(tmp_path / "ck"), None, year=2024)
    query.awaitTermination()
    return {t: read_events(spark, out, t) if (tmp_path / "out" / t).exists() else None for t in ingest.ROUTED}


def test_stream_equals_batch(spark, tmp_path):
    land(tmp_path / "in", "20240101", "a.log", FW, SHELL, "noise")
    land(tmp_path / "in", "20240101", "b.log", LOGIN, PLAIN, SHELL)
    stored = run(spark, tmp_path, max_files=1)
    split = parse.split_routed(spark.read.text(str(tmp_path / "in" / "dt=*")).select("value"), year=2024)
    for table in ingest.ROUTED:
        assert rows_of(stored[table], *schemas.EVENT_TABLES[table].names) == rows_of(
            parse.events_of(split, table), *schemas.EVENT_TABLES[table].names
        )
    left = spark.read.option("recursiveFileLookup", True).text(str(tmp_path / "out" / "rejects"))
    assert [r["value"] for r in left.collect()] == ["noise"]


def test_restart_adds_nothing_and_finds_new_days(spark, tmp_path):
    land(tmp_path / "in", "20240101", "a.log", SHELL)
    assert run(spark, tmp_path)["bash"].count() == 1
    assert run(spark, tmp_path)["bash"].count() == 1
    land(tmp_path / "in", "20240102", "a.log", SHELL, LOGOUT)
    stored = run(spark, tmp_path)
    assert stored["bash"].count() == 2 and stored["ciscovpn"].count() == 1


def test_repeated_batch_replaces_itself(spark, tmp_path, lines):
    save = ingest.save_batch(str(tmp_path / "out"), year=2024)
    for _ in range(2):
        save(lines(SHELL, "noise"), 7)
    assert read_events(spark, str(tmp_path / "out"), "bash").count() == 1
    left = spark.read.option("recursiveFileLookup", True).text(str(tmp_path / "out" / "rejects"))
    assert left.count() == 1


def test_a_batch_is_no_cache(spark, tmp_path, lines, monkeypatch):
    held = []
    monkeypatch.setattr(tables, "store", lambda df, path, run: held.append(len(spark.sparkContext._jsc.getPersistentRDDs())))
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    ingest.save_batch(str(tmp_path / "out"), year=2024)(lines(SHELL, LOGIN, "noise"), 1)
    assert held == [before] * 2
    assert not list(Path(scratch_root(spark).removeprefix("file:")).glob("micro-batch-*"))


def test_hosted_lines(spark, tmp_path):
    land(tmp_path / "in", "x", "a.log", f"dc1-net-bc\t{PLAIN}", "no tab")
    stream = ingest.stream_hosted_lines(spark, str(tmp_path / "in" / "dt=*"))
    proxies = parse.parse_proxy(ingest.with_prefix(stream))
    ingest.start_file_sink(proxies, str(tmp_path / "px"), str(tmp_path / "ck"), None).awaitTermination()
    stored = spark.read.schema(schemas.PROXYSG).parquet(str(tmp_path / "px"))
    assert rows_of(stored, "source", "clientip") == [("dc1-net-bc", "10.1.0.7")]


def test_listener_sees_batches(spark, tmp_path):
    listener = BatchInfo()
    spark.streams.addListener(listener)
    try:
        land(tmp_path / "in", "20240101", "a.log", SHELL, LOGIN)
        run(spark, tmp_path)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    assert sum(rows for _, _, rows, _ in listener.batches) == 2


def test_processing_time_trigger(spark, tmp_path):
    land(tmp_path / "in", "20240101", "a.log", SHELL)
    stream = ingest.stream_lines(spark, str(tmp_path / "in" / "dt=*"))
    query = ingest.start_ingest(stream, str(tmp_path / "out"), str(tmp_path / "ck"), "1 second", year=2024)
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert read_events(spark, str(tmp_path / "out"), "bash").count() == 1


def test_landed_hosted_lines(spark, tmp_path):
    land(tmp_path / "in", "x", "a.log", f"dc1-net-bc\t{PLAIN}", "no tab")
    landed = read_hosted_lines(spark, str(tmp_path / "in"))
    assert rows_of(landed, "host", "value") == [("dc1-net-bc", PLAIN), ("no tab", "no tab")]
    assert landed.filter("arrived_at is null").count() == 0


def test_streams_add_up(spark, tmp_path):
    out = str(tmp_path / "out")
    for name, lines in (("a", [SHELL, SHELL, LOGIN]), ("b", [SHELL, "noise"])):
        land(tmp_path / name, "20240101", "x.log", *lines)
        stream = ingest.stream_lines(spark, str(tmp_path / name / "dt=*"))
        ingest.start_ingest(stream, out, str(tmp_path / f"ck-{name}"), None, year=2024).awaitTermination()
    assert read_events(spark, out, "bash").count() == 3 and read_events(spark, out, "ciscovpn").count() == 1


def test_new_checkpoint_at_the_same_place_adds_up(spark, tmp_path):
    land(tmp_path / "in", "20240101", "a.log", SHELL)
    assert run(spark, tmp_path)["bash"].count() == 1
    (tmp_path / "ck").rename(tmp_path / "old")
    land(tmp_path / "in", "20240101", "b.log", SHELL)
    assert run(spark, tmp_path)["bash"].count() == 3


def test_batch_and_stream_fill_one_table(spark, tmp_path):
    land(tmp_path / "in", "20240101", "a.log", SHELL)
    run(spark, tmp_path)
    for _ in range(2):
        batch.ingest_logs(spark, "bashlog", str(tmp_path / "in"), str(tmp_path / "out"), year=2024, run="r1")
    stored = read_events(spark, str(tmp_path / "out"), "bash")
    assert stored.count() == 2
    day = date_slice(stored, "2020-01-01", "2020-01-02")
    assert day.count() == 0
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "batch" not in day.columns


def test_sinks_into_one_folder_add_up(spark, tmp_path):
    for name in ("a", "b"):
        land(tmp_path / name, "20240101", "x.log", LOGIN)
        events = parse.parse_vpn(ingest.stream_lines(spark, str(tmp_path / name / "dt=*")), year=2024)
        ingest.start_file_sink(events, str(tmp_path / "out" / "ciscovpn"), str(tmp_path / f"ck{name}"), None).awaitTermination()
    assert read_events(spark, str(tmp_path / "out"), "ciscovpn").count() == 2


def test_keyed_records(spark):
    records = spark.createDataFrame([(b"gw", b"line", 1)], "key binary, value binary, n int").selectExpr(
        "key", "value", "timestamp'2024-01-05 10:00:00' AS timestamp"
    )
    assert [tuple(r)[:1] + tuple(r)[2:] for r in ingest.keyed_lines(records).collect()] == [("gw", "line")]


def test_routed_lines_land_packed(spark):
    from pathlib import Path

    from bindings.queries import QUERIES
    from conftest import SF
    from vigil.session import scratch_root

    root = Path(scratch_root(spark).removeprefix("file:"))
    before = set(root.glob("routed-*"))
    found = QUERIES["stream_route_parse"](spark, SF)
    assert found.count() == spark.read.parquet(f"{SF}/conversations.parquet").count()
    (made,) = set(root.glob("routed-*")) - before
    files = list((made / "raw").glob("part-*"))
    assert files and all(f.suffix == ".lz4" for f in files)


def test_logs_land_packed_and_batches_are_bounded(spark, monkeypatch):
    from bindings import queries
    from conftest import SF

    monkeypatch.setattr(queries, "_BATCH_FILES", 2)
    root = Path(scratch_root(spark).removeprefix("file:"))
    before = {name: set(root.glob(f"{name}-*")) for name in ("landed", "streamed")}
    found = queries.QUERIES["stream_ingest"](spark, SF).groupBy("kind").sum("n").collect()
    size = {t: spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("lineitem", "events", "conversations")}
    assert {tuple(r) for r in found} == {
        ("fw", size["lineitem"]), ("proxysg", size["events"]), ("ciscovpn", size["events"]), ("bash", size["conversations"])
    }
    (landed,), (stored,) = (set(root.glob(f"{name}-*")) - before[name] for name in ("landed", "streamed"))
    files = list(landed.glob("dt=*/part-*"))
    assert files and all(f.suffix == ".gz" for f in files)
    assert len({f.name for f in stored.glob("*/date=*/batch=*")}) == -(-len(files) // 2) > 1


def _shuffled(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def test_shuffles_go_with_the_write(spark, tmp_path, lines):
    import time

    before = _shuffled(spark)
    ingest.save_batch(str(tmp_path / "out"), year=2024)(lines(SHELL, LOGIN, FW, "noise"), 3)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text(f"{SHELL}\n{LOGIN}\n")
    batch.ingest_logs(spark, batch.ALL, str(tmp_path / "in"), str(tmp_path / "out"), year=2024)
    # Files are deleted behind the write; garbage would be collected much later.
    end = time.time() + 10
    while (left := _shuffled(spark) - before) and time.time() < end:
        time.sleep(0.1)
    assert not left
    assert read_events(spark, str(tmp_path / "out"), "bash").count() == 2
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    assert spark.conf.get(name, None) in (None, "false")
