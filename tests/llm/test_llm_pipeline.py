"""The pipeline against plain versions of its stages, and on the rows it has to stand."""

from __future__ import annotations

import re

import pytest

import corpus_pipeline
from conftest import SF
from llm_helpers import AWKWARD, documents, plain_groups
from vigil.llm import decontam, quality


def test_kept_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    model = quality.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = {i: t for i, t in rows.items() if model.score([t])[0] >= quality.THRESHOLD}
    best: dict[str, tuple] = {}
    for i, text in rows.items():
        key = re.sub(r"[\x20\x09-\x0d]", "", text)
        best[key] = min(best.get(key, (1, 0)), (-len(text), i))
    rows = {i: rows[i] for _, i in best.values()}
    groups = plain_groups(sorted(rows.items()), 5, 80)
    rows = {i: t for i, t in rows.items() if groups[i][1] == i}
    squeeze = lambda t: f" {' '.join(decontam._plain(t).decode().split())} "
    items = [squeeze(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = {i: t for i, t in rows.items() if not any(x in squeeze(t) for x in items)}
    found = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in found.collect()} == set(rows) and len(rows) > 100


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_stand_awkward_rows(spark, name, stage):
    docs = documents(spark, *AWKWARD, more="1 AS kept").withColumnRenamed("kept", "sequence_id" if name == "n-gram Jaccard join" else "kept")
    out = stage(spark, docs, SF)
    assert out.count() >= 0
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == docs.columns
    assert stage(spark, documents(spark), SF).collect() == []
