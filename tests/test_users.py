"""Trailing windows, user features, version order and nested ranges against plain Python."""

from __future__ import annotations

import datetime as dt
import ipaddress
import random
import statistics
from collections import Counter

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from conftest import rows_of
from vigil.functions.versions import version_key
from vigil.operators import enrich, trailing
from vigil.plans import firewall, patch, risk, vpn

DAY = dt.date(2024, 1, 1)


def _day(n: int) -> dt.date:
    return DAY + dt.timedelta(days=n)


def test_packet_deviation(spark):
    rng = random.Random(1)
    rows = [("hot", _day(rng.choice([0, 1, 2, 5, 9, 20])), rng.randint(40, 1500)) for _ in range(3000)]
    rows += [("one", _day(3), 60), ("flat", _day(1), 5), ("flat", _day(2), 5), ("flat", _day(3), 9), (None, _day(1), 7), ("hot", None, 9), ("hot", _day(1), None)]
    fw = spark.createDataFrame(rows, "srcip string, date date, len long")
    found = {(r.srcip, r.date): r for r in firewall.packet_deviation(fw).collect()}
    known = [(s, d, v) for s, d, v in rows if d is not None and v is not None]
    assert set(found) == {(s, d) for s, d, _ in known}
    for (source, day), row in found.items():
        mine = [v for s, d, v in known if s == source and d == day]
        before = [v for s, d, v in known if s == source and 1 <= (day - d).days <= 7]
        assert (row.n, row.trailing_n) == (len(mine), len(before))
        assert row.mean == pytest.approx(statistics.mean(mine))
        if len(before) < 2:
            assert row.deviation is None and row.trailing_sd is None
        else:
            assert row.trailing_mean == pytest.approx(statistics.mean(before))
            assert row.trailing_sd == pytest.approx(statistics.stdev(before))
            if row.trailing_sd:
                assert row.deviation == pytest.approx((row.mean - row.trailing_mean) / row.trailing_sd)
            else:
                assert row.deviation is None
    assert firewall.packet_deviation(fw.limit(0)).collect() == []


def test_moments_of_large_values_are_exact(spark):
    big = 10**9
    rows = [("a", _day(0), big + i % 3) for i in range(300)] + [("a", _day(1), big)]
    found = firewall.packet_deviation(spark.createDataFrame(rows, "srcip string, date date, len long")).where(f"date = '{_day(1)}'").first()
    assert found.trailing_sd == pytest.approx(statistics.stdev(i % 3 for i in range(300)))


def test_trailing_medians(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "b"]), _day(rng.randint(0, 50)), rng.choice([60, 60, 3600, rng.randint(1, 9000)])) for _ in range(800)]
    rows += [("single", _day(1), 5), ("single", _day(2), 6), (None, _day(1), 5), ("b", None, 5), ("b", _day(1), None)]
    frame = spark.createDataFrame(rows, "user string, date date, sec long")
    found = {(r.user, r.date): r for r in trailing.trailing_medians(trailing.daily_histogram(frame, "user", "sec"), "user", "sec").collect()}
    known = [(u, d, s) for u, d, s in rows if None not in (u, d, s)]
    for user, day in {(u, d) for u, d, _ in known}:
        before = [s for u, d, s in known if u == user and 1 <= (day - d).days <= 30]
        if not before:
            assert (user, day) not in found
            continue
        middle = statistics.median(before)
        row = found[user, day]
        assert (row.trailing_n, row.median) == (len(before), middle)
        assert row.deviation == statistics.median(abs(s - middle) for s in before)


@pytest.mark.parametrize("way", ["broadcast", "shuffled"])
def test_session_deviation(spark, way, request):
    if way == "shuffled":
        request.getfixturevalue("nothing_fits")
    rows = [(_day(i), "10:00:00", "u", f"0h:{10 + i % 3}m:00s") for i in range(8)]
    rows += [(_day(8), "10:00:00", "u", "0h:11m:30s"), (_day(8), "11:00:00", "u", "5d 0h:00m:00s"), (_day(8), "12:00:00", "u", ""), (_day(8), "12:00:00", "new", "9h:00m:00s")]
    seen = spark.createDataFrame(rows, "date date, time string, username string, duration string")
    assert rows_of(vpn.session_deviation(seen), "time", "username", "seconds", "trailing_n", "median") == [("11:00:00", "u", 432000, 8, 660.0)]
    assert rows_of(vpn.session_deviation(seen, least=9)) == []


def test_user_features_keep_users_of_one_side(spark):
    px = spark.createDataFrame(
        [("a", "h", "DENIED", "x Mal", "10.0.0.1")] * 50 + [("a", "g", "OK", None, "10.0.0.2"), (None, "g", "OK", "", None), ("b", "g", "OK", "", "10.0.0.1")],
        "username string, host string, action string, categories string, clientip string",
    )
    sessions = spark.createDataFrame([("a@x", "1.0.0.1"), ("c@x", "1.0.0.1"), ("c@x", "1.0.0.1"), ("d@x", None)], "username string, remoteip string")
    bash = spark.createDataFrame([("e", "s1"), ("e", "s1"), ("e", None), (None, "s1")], "username string, source string")
    fw = spark.createDataFrame([("DENY", "10.0.0.1")] * 3 + [("ACCEPT", "10.0.0.2"), ("DENY", None)], "action string, srcip string")
    people = spark.createDataFrame([("c@x", "Y"), ("a@x", "X")], "emailaddress string, c string")
    ranges = spark.createDataFrame([(1 << 24, (1 << 25) - 1, "X")], "lo long, hi long, cc string")
    found = {r.user: tuple(r)[1:] for r in risk.user_features(px, sessions, bash, fw, people, ranges).collect()}
    assert found == {
        "a": (51, 50, 50, 2, 1, 1, 0, 0, 0, 3), "b": (1, 0, 0, 1, 0, 0, 0, 0, 0, 3), "c": (0, 0, 0, 0, 2, 1, 2, 0, 0, 0),
        "d": (0, 0, 0, 0, 1, 0, 0, 0, 0, 0), "e": (0, 0, 0, 0, 0, 0, 0, 3, 1, 0), None: (1, 0, 0, 1, 0, 0, 0, 1, 1, 0),
    }
    none = [df.limit(0) for df in (px, sessions, bash, fw, people, ranges)]
    assert risk.user_features(*none).collect() == []


def test_risk_model_is_saved_and_learned_again(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"u{i}", *[rng.randint(0, 50) for _ in risk.FEATURES]) for i in range(400)]
    frame = spark.createDataFrame(rows, "user string, " + ", ".join(f"{c} long" for c in risk.FEATURES))
    train, held_out = risk.split(frame.withColumn("risky", F.expr("int(foreign_logins > 20)")))
    assert train.count() + held_out.count() == 400
    model = risk.fit(train)
    model.write().save(str(tmp_path / "m"))
    first, other = (rows_of(risk.score(m, held_out)) for m in (PipelineModel.load(str(tmp_path / "m")), risk.fit(train.repartition(5))))
    assert [(u, round(p, 9)) for u, p in first] == [(u, round(p, 9)) for u, p in other]
    truth = {r.user: r.risky for r in held_out.collect()}
    assert sum((p >= 0.5) == bool(truth[u]) for u, p in first) > 0.9 * len(first)


def test_version_order(spark):
    ordered = ["beta", "", "1.0alpha", "1.0rc1", "1.0RC2", "1.0", "1.0.1", "1.9", "1.10", "9.11", "10.2", "10.02.1", "2024.1", "123456789012345678901234567890"]
    shuffled = random.Random(1).sample(ordered, len(ordered))
    frame = spark.createDataFrame([(v,) for v in shuffled], "v string").select("v", version_key(F.col("v")).alias("k"))
    assert [r.v for r in frame.orderBy("k").collect()] == ordered
    same = spark.createDataFrame([("1.0", "1-0"), ("v1_2", "V1.2"), ("1.00", "1.0")], "a string, b string")
    assert same.where(version_key(F.col("a")) != version_key(F.col("b"))).count() == 0
    assert spark.createDataFrame([(None,)], "v string").select(version_key(F.col("v")).alias("k")).first().k is None


@pytest.mark.parametrize("way", ["broadcast", "shuffled"])
def test_outdated_applications(spark, way, request):
    if way == "shuffled":
        request.getfixturevalue("nothing_fits")
    rows = [("h1", "app", "9.11"), ("h2", "app", "10.2"), ("h3", "app", "9.11"), ("h3", "app", "10.2"), ("h4", "app", "10-2"), ("h1", "app", "9.2")]
    rows += [("h1", "solo", "1"), ("h1", None, "1"), (None, "app", "1"), ("h5", "app", None)] + [(f"x{i}", "app", "8") for i in range(200)]
    frame = spark.createDataFrame(rows, "name0 string, displayname0 string, version0 string")
    found = rows_of(patch.outdated(frame))
    assert found == sorted([("h1", "app", "9.11", "10-2")] + [(f"x{i}", "app", "8", "10-2") for i in range(200)], key=repr)
    assert patch.outdated(frame.limit(0)).collect() == []
    assert ("solo", 1, 1) in rows_of(patch.applications(frame))


def _plain_narrowest(ranges, ip):
    try:
        number = int(ipaddress.IPv4Address(ip))
    except ValueError:
        return None
    held = [(hi - lo, lo, cc) for lo, hi, cc in ranges if lo <= number <= hi]
    return min(held)[2] if held else None


@pytest.mark.parametrize("way", ["broadcast", "shuffled"])
def test_narrowest_range(spark, way, request):
    if way == "shuffled":
        request.getfixturevalue("nothing_fits")
    rng = random.Random(5)
    top = (1 << 32) - 1
    ranges = [(0, top, "all"), (1 << 24, (1 << 25) - 1, "A"), (1 << 24, (1 << 25) - 1, "B"), ((1 << 24) + 5, (1 << 24) + 5, "dot"), (9, 3, "never")]
    ranges += [((1 << 24) - 300, (1 << 24) + 70_000, "over"), (top, top, "last"), (256, 511, "net"), (300, 700, "cross")]
    for i in range(60):
        lo = rng.randrange(1 << 18)
        ranges.append((lo, lo + rng.choice([0, 1, 254, 255, 256, 65_535, 65_536, 100_000]), f"r{i}"))
    numbers = [rng.randrange(1 << 19) for _ in range(200)] + [n for lo, hi, _ in ranges for n in (lo, hi, hi + 1) if n <= top]
    ips = [str(ipaddress.IPv4Address(n)) for n in numbers] + [None, "", "x", "300.1.1.1", "1.0.0.5"] + ["1.2.3.4"] * 500
    frame = spark.createDataFrame([(i, ip) for i, ip in enumerate(ips)], "i long, addr string")
    table = spark.createDataFrame(ranges, "lo long, hi long, cc string")
    found = rows_of(enrich.with_narrowest_country(frame, "addr", table))
    kept = [r for r in ranges if r[0] <= r[1]]
    assert found == sorted([(i, ip, _plain_narrowest(kept, ip or "")) for i, ip in enumerate(ips)], key=repr)
    # One row a block, however many ranges cover it.
    blocks = Counter((r.level, r.block) for r in enrich.range_blocks(table).collect())
    assert max(blocks.values()) == 1
    nothing = enrich.with_narrowest_country(frame, "addr", table.limit(0))
    assert nothing.where("cc is not null").count() == 0 and nothing.count() == len(ips)


def test_blocks_are_kept_by_hash_in_many_tasks(spark):
    ranges = spark.range(500).selectExpr("id * 65536 as lo", "id * 65536 + 70000 as hi", "concat('c', id) as cc").coalesce(1)
    plan = enrich.range_blocks(ranges)._jdf.queryExecution().executedPlan().toString()
    # One task sorted all blocks where the least of a struct with a name was kept.
    assert "SortAggregate" not in plan and "REPARTITION_BY_NUM" in plan


def test_trailing_medians_in_small_pieces(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(rng.choice("abcdefgh"), _day(rng.randint(-40, 90)), rng.randint(1, 500)) for _ in range(3000)]
    frame = spark.createDataFrame(rows, "user string, date date, sec long")
    histogram = trailing.daily_histogram(frame, "user", "sec")
    whole = rows_of(trailing.trailing_medians(histogram, "user", "sec", 7))
    for user, day, n, median, deviation in whole:
        before = [s for u, d, s in rows if u == user and 1 <= (day - d).days <= 7]
        assert (n, median) == (len(before), statistics.median(before))
        assert deviation == statistics.median(abs(s - median) for s in before)
    monkeypatch.setattr(trailing, "_ROWS", 1)
    monkeypatch.setattr(trailing, "_VALUES", 20)
    assert rows_of(trailing.trailing_medians(histogram, "user", "sec", 7)) == whole
    # Two copies a row, not one for each day of a window.
    made = trailing.trailing_medians(histogram, "user", "sec", 7)._jdf.queryExecution().toString()
    assert "sequence(" not in made


def test_outdated_compares_each_version_once(spark):
    rows = [(f"h{i}", "app", f"{i % 3}.0") for i in range(600)] + [("h9", "app", "2-0")]
    frame = spark.createDataFrame(rows, "name0 string, displayname0 string, version0 string")
    found = patch.outdated(frame)
    assert len(found.collect()) == 399 and set(r.newest for r in found.collect()) == {"2-0"}
    # Hosts are reduced to a number, without the version's pattern or a sort.
    plan = found._jdf.queryExecution().toString()
    assert "regexp_extract_all" not in plan and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
