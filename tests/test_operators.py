"""Operators against brute force, in their broadcast and their shuffled form."""

from __future__ import annotations

import ipaddress
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from vigil.operators import enrich, groups, indicators, ngrams
from vigil.plans import firewall, proxy, vpn

WAYS = pytest.mark.parametrize("way", ["broadcast", "shuffled"])


@pytest.fixture
def take(way, request):
    if way == "shuffled":
        request.getfixturevalue("nothing_fits")


def hot(rng, n, common, others):
    """``n`` draws, a third of them the same."""
    return [common if i % 3 == 0 else rng.choice(others) for i in range(n)]


@WAYS
def test_country(spark, way, take):
    ranges = [(0, 255, "A"), (256, 70_000, "B"), (1 << 24, (1 << 25) - 1, "C"), ((1 << 25) + 5, (1 << 25) + 5, "D")]
    rng = random.Random(1)
    others = [str(ipaddress.ip_address(rng.randrange(1 << 26))) for _ in range(200)]
    others += ["0.0.0.255", "0.0.1.0", "0.1.17.112", "0.1.17.113", "2.0.0.5", "2.0.0.6", "junk", None]
    ips = hot(rng, 900, "1.2.3.4", others)

    def country(ip):
        if ip in (None, "junk"):
            return None
        number = int(ipaddress.ip_address(ip))
        return next((cc for lo, hi, cc in ranges if lo <= number <= hi), None)

    events = spark.createDataFrame(list(enumerate(ips)), "i int, ip string")
    found = enrich.with_country(events, "ip", spark.createDataFrame(ranges, "lo long, hi long, cc string"))
    assert rows_of(found) == sorted([(i, ip, country(ip)) for i, ip in enumerate(ips)], key=repr)


def test_country_plan_has_no_nested_loop(spark, tables):
    located = enrich.with_country(tables["v_vpn"], "remoteip", tables["v_geo"])
    plan = located._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


@WAYS
def test_indicator_hits(spark, way, take):
    rng = random.Random(2)
    hosts = hot(rng, 600, "hot.example", [f"h{i}.example" for i in range(40)] + ["", None])
    otx = ["hot.example", "hot.example", "h1.example", "", "absent.example"]
    c2 = ["hot.example", "h2.example", "h1.example"]
    events = spark.createDataFrame([(h, f"c{i % 3}") for i, h in enumerate(hosts)], "host string, clientip string")
    feeds = {
        "otx": (spark.createDataFrame([(x,) for x in otx], "ip string"), "ip"),
        "c2": (spark.createDataFrame([(x,) for x in c2], "host string"), "host"),
    }
    seen = Counter(hosts)
    expected = []
    for host in set(otx + c2) - {""}:
        if seen[host]:
            copies = otx.count(host) + c2.count(host)
            expected.append((host, seen[host] * copies, (host in otx) + (host in c2)))
    assert rows_of(indicators.ioc_hits(events, "host", feeds)) == sorted(expected, key=repr)
    per_client = Counter(zip(hosts, (f"c{i % 3}" for i in range(len(hosts)))))
    expected = [(c, h, n * otx.count(h)) for (h, c), n in per_client.items() if h and h in otx]
    found = indicators.ioc_groups(events, "host", feeds["otx"], "clientip", "host")
    assert rows_of(found) == sorted(expected, key=repr)


@WAYS
def test_cidr_hits(spark, way, take):
    rng = random.Random(3)
    texts = ["10.0.0.0/8", "10.1.0.0/16", "10.1.0.0/16", "192.0.2.7", "0.0.0.0/1", "junk", "10.0.0.0/40"]
    nets = [ipaddress.ip_network(t) for t in texts[:5]]
    others = [str(ipaddress.ip_address(rng.randrange(1 << 32))) for _ in range(100)]
    ips = hot(rng, 600, "10.1.2.3", others + ["192.0.2.7", "10.9.9.9", "junk", None])
    events = spark.createDataFrame([(ip,) for ip in ips], "dstip string")
    feed = spark.createDataFrame([(t,) for t in texts], "host string")
    expected = []
    for ip, n in Counter(ips).items():
        if ip in (None, "junk"):
            continue
        inside = [net for net in nets if ipaddress.ip_address(ip) in net]
        if inside:
            expected.append((ip, n * len(inside), len(set(inside))))
    assert rows_of(indicators.ioc_cidr_hits(events, "dstip", feed, "host")) == sorted(expected, key=repr)


def test_cidr_hits_without_indicators(spark):
    events = spark.createDataFrame([("10.0.0.1",)], "dstip string")
    feed = spark.createDataFrame([("junk",)], "host string")
    assert indicators.ioc_cidr_hits(events, "dstip", feed, "host").count() == 0


@WAYS
def test_groups(spark, way, take):
    rng = random.Random(4)
    keys = hot(rng, 900, "hot", [f"k{i}" for i in range(150)] + [None])
    df = spark.createDataFrame(list(enumerate(keys)), "i int, k string")
    sizes = Counter(keys)
    rare = groups.rare_groups(df, "k", below=4)
    assert rows_of(rare) == sorted([(k, n) for k, n in sizes.items() if n < 4], key=repr)
    expected = [(i, k) for i, k in enumerate(keys) if k is not None and sizes[k] < 4]
    assert rows_of(groups.rows_in(df, rare, "k"), "i", "k") == sorted(expected, key=repr)
    big = groups.big_groups(df, "k", above=100)
    assert rows_of(big) == [("hot", sizes["hot"])]
    assert groups.rows_in(df, big, "k").count() == sizes["hot"]


def grams(text):
    text = text.lower()
    return [text[i : i + n] for n in (3, 4, 5) for i in range(len(text) - n + 1)]


@WAYS
def test_ngrams(spark, way, take):
    names = ["www.example.com", "example.com", "aaaaaa", "ab", "WWW.Example.org", "q7x9"]
    other = ["example", "exam", "plea"]
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "domain string")

    def vocab(texts, min_df):
        total, docs = Counter(), Counter()
        for text in texts:
            total.update(grams(text))
            docs.update(set(grams(text)))
        return {g: (docs[g], total[g], math.log10(total[g])) for g in total if docs[g] >= min_df * len(texts)}

    legit, words = vocab(names, 0.3), vocab(other, 0.0)
    legit_df = ngrams.ngram_vocab(frame(names), "domain", 0.3)
    found = {r["gram"]: (r["docs"], r["total"], pytest.approx(r["weight"])) for r in legit_df.collect()}
    assert legit == found
    scored = ngrams.ngram_score(
        frame(names + names[:1]), "domain",
        {"legit": legit_df, "word": ngrams.ngram_vocab(frame(other), "domain", 0.0)},
    )
    got = {r["domain"]: (r["legit_grams"], r["word_grams"]) for r in scored.collect()}
    assert set(got) == set(names)
    for name in names:
        for value, known in zip(got[name], (legit, words)):
            assert value == pytest.approx(sum(known[g][2] for g in grams(name) if g in known))


@WAYS
def test_foreign_logins(spark, way, take):
    sessions = [("a", "1.0.0.1")] * 30 + [("a", "2.0.0.1")] * 5 + [("b", "2.0.0.1")] * 2 + [("c", "9.9.9.9"), ("d", "1.0.0.1")]
    seen = spark.createDataFrame(sessions, "username string, remoteip string")
    people = spark.createDataFrame([("a", "X"), ("b", "Y"), ("c", "X"), ("d", None)], "emailaddress string, c string")
    ranges = spark.createDataFrame(
        [(1 << 24, (1 << 25) - 1, "X"), (1 << 25, (1 << 25) + 255, "Z")], "lo long, hi long, cc string"
    )
    found = vpn.foreign_logins(seen, people, ranges)
    assert rows_of(found) == [("a", "2.0.0.1", "Z", "X", 5), ("b", "2.0.0.1", "Z", "Y", 2)]


def test_top_transfers_are_single_ones(spark):
    rows = [("c1", "h", 50)] * 300 + [(f"c{i}", "h", i) for i in range(40)] + [("c1", "g", 50), ("c9", "g", None)]
    px = spark.createDataFrame(rows, "clientip string, host string, csbytes long")
    expected = sorted({(c, h, float(b)) for c, h, b in rows if b is not None}, key=lambda r: (-r[2], r[0], r[1]))
    assert [tuple(r) for r in proxy.top_transfers(px).collect()] == expected[:10]
    few = px.limit(5)
    assert [tuple(r) for r in proxy.top_transfers(few).collect()] == [("c1", "h", 50.0)]


def test_dashboard_rows_equal_the_single_panels(tables):
    fw = tables["v_fw"]
    rows = firewall.dashboard_rows(fw).collect()
    for panel, df in firewall.dashboard(fw).items():
        label = "port" if panel == "port" else "label"
        assert sorted((r["label"], r["hits"]) for r in rows if r["panel"] == panel) == sorted(
            (r[label], r["hits"]) for r in df.collect()
        )


def test_unusual_below_ten(spark):
    rows = [("u", "1.1.1.1")] * 9 + [("u", "2.2.2.2")] * 10 + [("v", "3.3.3.3")]
    seen = spark.createDataFrame(rows, "username string, remoteip string")
    assert rows_of(vpn.ips_by_user(seen, "u")) == [("1.1.1.1", 9, "Unusual"), ("2.2.2.2", 10, "Normal")]


def test_measure_counts_rows_and_bytes(spark):
    from vigil.operators.sizing import measure

    df = spark.createDataFrame([("a" * 1000,), (None,)], "t string")
    rows, size = measure(df)
    assert rows == 2 and size > 1000
    assert measure(df, F.lit(7))[0] == 14
    assert measure(df.filter("false")) == (0, 0)
