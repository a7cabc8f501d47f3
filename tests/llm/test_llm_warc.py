from __future__ import annotations

import hashlib
from pathlib import Path

import pytest

from vigil.llm import warc

PAGE = "page_id long, url string, html string, digest string, refers_to int"
LONG = "<p>" + "é" * 900


def _pages(spark, rows):
    return spark.createDataFrame([(*r, None, 1) for r in rows], PAGE)


def _expected(rows, shortest=1000):
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        keep = max((p for p, _, h in rows if (h or "") == (html or "") and p is not None), default=None)
        revisit = len(data) >= shortest and keep is not None and page != keep
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", keep if revisit else None))
    return sorted(out, key=repr)


def _found(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


INSIDE = "a" + warc.MAGIC + "WARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc" + warc.BREAK
ROWS = [
    (1, "http://a/1", LONG), (2, "http://a/2", LONG), (2, "http://a/2", LONG), (None, None, LONG), (3, "u\r\nWARC-Type: x", "short"),
    (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "u", warc.MAGIC), (8, "u", INSIDE), (9, "u", INSIDE * 40), (10, "u", INSIDE * 40 + warc.BREAK),
    (11, "u", "x" * 2_000_000 + warc.MAGIC * 3 + "y"), (12, "u", warc.BREAK * 3), (13, "u", "Content-Length: 5\r\n\r\n"),
]


def test_magic_in_payloads_is_no_record(spark):
    assert _found(warc.archive_round_trip(_pages(spark, ROWS))) == _expected(ROWS)


def test_records_across_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = [(i, f"http://a/{i}", ("text %d " % (i % 7)) * (i % 200) + (INSIDE if i % 5 == 0 else "")) for i in range(120)]
        assert _found(warc.archive_round_trip(_pages(spark, rows))) == _expected(rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_chains_are_followed_from_the_start(spark):
    links = [("f", 0, 10, 40), ("f", 10, 30, 40), ("f", 15, 20, 40), ("f", 20, 30, 40), ("f", 30, 40, 40), ("g", 0, 5, 5)]
    chain = spark.createDataFrame(links, "file string, at long, to long, file_size long")
    assert sorted(tuple(r) for r in warc.reachable(chain).collect()) == [("f", 0), ("f", 10), ("f", 30), ("g", 0)]


def test_cut_archives_are_found(spark, tmp_path):
    path = str(tmp_path / "archive")
    warc.write_archives(_pages(spark, ROWS[:2]).coalesce(1), path)
    [part] = Path(path).glob("part-*")
    part.write_bytes(part.read_bytes()[:-20])
    (part.parent / f".{part.name}.crc").unlink()
    with pytest.raises(ValueError):
        warc.read_archives(spark, path)


def test_no_rows(spark):
    assert _found(warc.archive_round_trip(_pages(spark, []))) == []
