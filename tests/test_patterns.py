"""The one-pass field cut against Python's own regular expressions, on damaged lines."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

import test_parse as samples
from vigil.functions.patterns import FORMATS, RAW_FIELDS, line_fields

LINES = [
    samples.FW, samples.ICMP, samples.SHELL, samples.WARN, samples.LOGIN, samples.LOGOUT,
    samples.PLAIN, samples.TLS, samples.WEB,
]


def damaged(rng: random.Random, line: str) -> str:
    for _ in range(rng.randrange(4)):
        i = rng.randrange(len(line))
        j = min(len(line), i + rng.randrange(1, 6))
        line = rng.choice(
            [
                line[:i] + line[j:],
                line[:i] + line[i:j] * 2 + line[j:],
                line[:i] + rng.choice([" ", '"', "'", "\t", "\r", "é", " ", "\u0085", "$1", "\\", "\u0001", "9"]) + line[i:],
                line + " " + rng.choice(LINES),
                "prefix " + line,
            ]
        )
    return line


@pytest.fixture(scope="module")
def many():
    rng = random.Random(7)
    return LINES + [damaged(rng, rng.choice(LINES)) for _ in range(1500)]


@pytest.mark.parametrize("table", sorted(FORMATS))
def test_same_fields_as_python(spark, many, table):
    def expected(line):
        for form in FORMATS[table]:
            found = re.search(form.pattern, line, re.ASCII)
            if found:
                return [(found.group(c) or "") if c else "" for c in form.captures]
        return None

    df = spark.createDataFrame(list(enumerate(many)), "i int, value string")
    got = [r[0] for r in df.orderBy("i").select(line_fields(F.col("value"), table)).collect()]
    for line, fields in zip(many, got):
        assert fields == expected(line), line
    assert sum(f is not None for f in got) > 20


@pytest.mark.parametrize("table", sorted(FORMATS))
def test_formats_fill_every_field(table):
    for form in FORMATS[table]:
        assert len(form.captures) == len(RAW_FIELDS[table])
        assert max(form.captures) <= re.compile(form.pattern).groups


@pytest.mark.parametrize(
    "line",
    [
        samples.PLAIN.replace(' "10.0.0.8"', "") + ' "x"' * 8000,
        samples.PLAIN + ' "x"' * 8000,
        samples.PLAIN.replace(' "10.0.0.8"', ' x "10.0.0.8"') + ' "x"' * 8000,
        samples.TLS.replace(" 10.0.0.8", "") + ' "x" y' * 8000,
        samples.TLS + " x" * 8000,
    ],
)
def test_lines_that_nearly_fit_take_linear_time(spark, line):
    def read(text):
        return spark.createDataFrame([(text,)], "value string").select(line_fields(F.col("value"), "proxysg")).first()[0]

    read(samples.PLAIN)
    start = time.perf_counter()
    read(line)
    assert time.perf_counter() - start < 4
