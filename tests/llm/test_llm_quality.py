from __future__ import annotations

import zlib

import numpy as np

from conftest import SF
from llm_helpers import AWKWARD, documents
from vigil.llm import quality


def _labelled(spark):
    docs = spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet")
    return docs, spark.read.parquet(SF.replace("0.001", "0.01") + "/labels.parquet")


def test_held_out_accuracy(spark):
    docs, labels = _labelled(spark)
    found = quality.score_documents(docs, quality.learn(docs, labels)).join(labels, "doc_id").toPandas()
    assert (found.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in found.doc_id]).all()
    held = found[found.held_out]
    assert held.score.between(0, 1).all() and (held.predicted == (held.score >= 0.7)).all()
    assert (held.predicted == held.quality).mean() > 0.93
    good, bad = held[held.quality == 1], held[held.quality == 0]
    assert (good.predicted == 1).mean() > 0.95
    assert np.mean(good.score.to_numpy()[:, None] > bad.score.to_numpy()) > 0.95


def test_held_out_labels_are_not_learned(spark):
    docs, labels = _labelled(spark)
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality", "toxic")
    assert np.array_equal(quality.learn(docs, labels, 200).values, quality.learn(docs, turned, 200).values)


def test_texts_together_score_as_alone():
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("ab \né"), rng.integers(0, 40))) for _ in range(80)] + ["", " ", "a", "a a a a"]
    model = quality.Model(rng.normal(size=(1 << quality.BITS) + 4).astype(np.float32), 0.3)
    assert np.allclose(model.score(texts, at_once=100), [model.score([t])[0] for t in texts])


def test_repeated_words_are_marked():
    marks = quality.features([b"a b a b a b", b"a b c d"])[2]
    assert [(b - (1 << quality.BITS)).tolist() for b, _ in marks] == [[0, 0, 1, 1, 1, 0, 0, 0], [2, 2, 3, 3, 2, 2]]


def test_awkward_rows(spark):
    model = quality.train(["good text here"] * 5 + ["### %%%"] * 5, [1] * 5 + [0] * 5)
    found = quality.score_documents(documents(spark, *AWKWARD, more="0.5 AS score"), model).collect()
    assert len(found) == len(AWKWARD) and all(0 <= r.score <= 1 for r in found)
    assert len({r.score for r in found if r.doc_id in (1, 2)}) == 1
    kept = quality.accepted(documents(spark, *AWKWARD, more="0.5 AS score"), quality.train([], []))
    assert kept.count() == len(AWKWARD) and kept.columns[-1] == "score"


def test_odd_labels(spark):
    docs = documents(spark, (1, "a"), (2, "b"), (3, "c"), (3, "c"))
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, None), (None, 1, 1), (2, None, 0), (3, 0, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.learn(docs, labels).score(["a"]) > quality.learn(docs, labels).score(["c"])
    none = quality.learn(docs, labels.limit(0))
    assert (none.score(["", "x"]) > 0.99).all()


def test_no_rows(spark):
    model = quality.train([], [])
    assert quality.score_documents(documents(spark), model).collect() == []
    assert quality.accepted(documents(spark), model).collect() == []
