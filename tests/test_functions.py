from __future__ import annotations

import ipaddress
import math
import random
import time
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vigil.functions import dates, network
from vigil.functions.text import char_ngrams, entropy


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("v"))).collect()]


def test_ip_to_long(spark):
    good = ["0.0.0.0", "10.1.2.3", "255.255.255.255", "192.168.001.1"]
    bad = ["256.1.1.1", "1.2.3", "1.2.3.4.5", "a.b.c.d", "", None, "1.2.3.4 ", "-1.2.3.4", "1..2.3"]
    got = column(spark, good + bad, network.ip_to_long)
    assert got[:3] == [int(ipaddress.ip_address(ip)) for ip in good[:3]]
    assert got[3] == int(ipaddress.ip_address("192.168.1.1"))
    assert got[4:] == [None] * len(bad)


def test_cidr(spark):
    texts = ["10.1.2.3/8", "10.1.2.3", "0.0.0.0/0", "1.2.3.255/31", "255.255.255.255/32"]
    nets = [ipaddress.ip_network(t, strict=False) for t in texts]
    assert column(spark, texts, lambda c: network.cidr_parts(c)[0]) == [int(n.network_address) for n in nets]
    assert column(spark, texts, lambda c: network.cidr_parts(c)[1]) == [n.prefixlen for n in nets]
    assert column(spark, ["1.2.3.4/33", "x/8", "host", ""], lambda c: network.cidr_parts(c)[1]) == [None] * 4


def shannon(text):
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())


TEXTS = st.lists(st.text(st.characters(exclude_categories=("Cs",), exclude_characters="\0"), max_size=30), max_size=20)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(TEXTS)
def test_entropy(spark, texts):
    got = column(spark, texts, entropy) if texts else []
    assert got == pytest.approx([shannon(t) if t else 0.0 for t in texts], abs=1e-9)


def pieces(text):
    return [text[i : i + n] for n in (3, 4, 5) for i in range(len(text) - n + 1)]


def test_char_ngrams(spark):
    texts = ["", "ab", "abc", "abcabc", "Ä-example.com", "a  \t b", "😀😀😀😀"]
    clean = ["", "ab", "abc", "abcabc", "ä-example.com", "a b", "😀😀😀😀"]
    assert column(spark, texts, char_ngrams) == [pieces(t) for t in clean]
    assert column(spark, [None], char_ngrams) in ([None], [[]])


@pytest.mark.parametrize(
    "text, seconds",
    [("1d 2h:03m:04s", 93784), ("2h:03m:04s", 7384), ("", None), ("2h", None), ("0h:00m:00s", 0)],
)
def test_duration(spark, text, seconds):
    assert column(spark, [text], dates.vpn_duration_seconds) == [seconds]


def test_date_spine(spark):
    days = [str(r["date"]) for r in dates.date_spine(spark, "2024-02-27", "2024-03-01").collect()]
    assert days == ["2024-02-27", "2024-02-28", "2024-02-29", "2024-03-01"]
    assert dates.date_spine(spark, "2024-03-01", "2024-02-27").count() == 0


def test_long_tokens_take_linear_time(spark):
    from vigil.operators.ngrams import ngram_vocab

    rng = random.Random(1)
    blob = "".join(rng.choice("abcdefgh") for _ in range(100_000))
    ngram_vocab(spark.createDataFrame([("warm",)], "t string"), "t", 0.0).count()
    start = time.perf_counter()
    found = {r["gram"]: (r["docs"], r["total"]) for r in ngram_vocab(spark.createDataFrame([(blob,)], "t string"), "t", 0.0).collect()}
    assert time.perf_counter() - start < 6
    grams = Counter(blob[i : i + n] for n in (3, 4, 5) for i in range(len(blob) - n + 1))
    assert found == {g: (1, n) for g, n in grams.items()}
