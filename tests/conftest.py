from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from vigil.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "vigil tests",
        master="local[8]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__driver__memory="8g",
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from bindings.views import Tables

    return Tables(spark, SF)


@pytest.fixture
def lines(spark):
    """Text lines as the parsers take them."""

    def make(*texts: str):
        return spark.createDataFrame([(t,) for t in texts], "value string")

    return make


@pytest.fixture
def nothing_fits(monkeypatch):
    """Make every size check fail, so operators take their shuffled way."""
    from vigil.operators import sizing

    monkeypatch.setattr(sizing, "MAX_ROWS", -1)


def rows_of(df, *columns):
    chosen = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in chosen.collect()), key=repr)
