"""Every query of the training-data operators against SQL, or the facts it has to meet."""

from __future__ import annotations

import math
import sys
import zlib
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline  # noqa: E402
from conftest import SF  # noqa: E402
from llm_helpers import words  # noqa: E402
from vigil.llm.queries import ORACLES, QUERIES  # noqa: E402

TABLES = "documents pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def _cells(rows, order):
    return sorted(repr([float(f"{r[i]:.6g}") if isinstance(r[i], float) else r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    found = QUERIES[name](spark, SF)
    expected = duck.execute(ORACLES[name])
    names = [c[0] for c in expected.description]
    assert sorted(found.columns) == sorted(names)
    order = sorted(names)
    ours = _cells(found.collect(), [found.columns.index(c) for c in order])
    assert ours == _cells(expected.fetchall(), [names.index(c) for c in order])


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert len(corpus_pipeline.STAGES) == 5


def test_unigram_base(spark, duck):
    texts = dict(duck.execute("select doc_id, text from documents").fetchall())
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    counts: dict[str, int] = {}
    for i, text in texts.items():
        for w in [*words(text), None] if not held[i] else []:
            counts[w] = counts.get(w, 0) + 1
    total = sum(counts.values())
    for row in QUERIES["op4_lm_score"](spark, SF).collect():
        tokens = [*words(texts[row.doc_id]), None]
        base = sum(math.log10((counts.get(w, 0) + 1) / (total + len(counts) + 1)) for w in tokens)
        assert row.base_score == pytest.approx(base, rel=1e-9)
        assert (row.n_tokens, row.n_known) == (len(tokens), sum(w in counts for w in tokens))
        assert (row.held_out, row.train_tokens) == (held[row.doc_id], total)
        assert row.score < 0
