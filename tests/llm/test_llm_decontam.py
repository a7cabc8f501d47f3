from __future__ import annotations

import random

import numpy as np

from conftest import SF
from llm_helpers import AWKWARD, documents
from vigil.llm import decontam


def _plain_align(a, b):
    """Smith-Waterman, cell by cell."""
    best, last = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            same = decontam.MATCH if x == y and x else decontam.MISMATCH
            row.append(max(0, last[j] + same, last[j + 1] + decontam.GAP, row[j] + decontam.GAP))
        best, last = max(best, *row), row
    return best


def test_alignment_is_smith_waterman():
    rng = random.Random(1)
    pairs = [([rng.randint(1, 5) for _ in range(rng.randint(1, 9))], [rng.randint(0, 5) for _ in range(rng.randint(1, 14))]) for _ in range(400)]
    scores, _ = decontam.align([np.array(a, np.int32) for a, _ in pairs], [np.array(b, np.int32) for _, b in pairs])
    assert scores.tolist() == [_plain_align(a, b) for a, b in pairs]


def _benchmark(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


ITEM = "The quick brown fox jumps over one lazy dog while seven green birds watch from the old oak tree"


def _hits(spark, docs, items, **more):
    return {(r.doc_id, r.item_id): r.score for r in decontam.contaminated(docs, _benchmark(spark, items), **more).collect()}


def test_copies_edited_or_not(spark):
    words = ITEM.split()
    edited = list(words)
    for i in (3, 9, 15):
        edited[i] = "changed"
    swapped = words[:5] + ["very", "very"] + words[6:12] + words[13:]
    filler = "some other words that have nothing to do with it " * 30
    docs = documents(
        spark, (1, filler + ITEM.upper() + "! " + filler), (2, filler + " ".join(edited)), (3, ",  ".join(swapped) + "\n" + filler),
        (4, filler), (5, " ".join(sorted(words))), (6, " ".join(words[:6]) + " " + filler),
    )
    found = _hits(spark, docs, [(7, ITEM), (8, "seven words that no document here holds at all")])
    assert set(found) == {(1, 7), (2, 7), (3, 7)} and found[(1, 7)] == 1.0
    kept = decontam.clean_documents(docs, _benchmark(spark, [(7, ITEM)]))
    assert sorted(r.doc_id for r in kept.collect()) == [4, 5, 6] and kept.columns == docs.columns


def test_passages_that_many_documents_hold(spark):
    docs = documents(spark, *[(i, f"doc {i} says {ITEM} and ends") for i in range(300)], *[(i, f"clean {i}") for i in range(300, 400)])
    assert {d for d, _ in _hits(spark, docs, [(1, ITEM)])} == set(range(300))


def _edited(words, every, first):
    return " ".join(f"edit{i}" if i % every == first else w for i, w in enumerate(words))


def test_an_edited_copy_alone_in_its_corpus(spark):
    short, long = ITEM.split()[:15], [f"word{i}" for i in range(40)]
    middle = " ".join([*short[:7], "changed", *short[8:]])
    for n, (words, copy) in enumerate([(short, middle), *[(w, _edited(w, every, every - 1)) for w in (short, long) for every in range(4, 9)]]):
        docs = documents(spark, (1, f"before it {copy} and after"), (2, "nothing of that kind " * 20))
        assert set(_hits(spark, docs, [(7, " ".join(words))])) == {(1, 7)}, n
        kept = decontam.clean_documents(docs, _benchmark(spark, [(7, " ".join(words))]))
        assert [r.doc_id for r in kept.collect()] == [2]


def test_an_edited_copy_beside_many_whole_ones(spark):
    words = ITEM.split()[:15]
    docs = documents(spark, (99, _edited(words, 4, 3)), *[(i, " ".join(words)) for i in range(30)])
    assert set(_hits(spark, docs, [(7, " ".join(words))])) == {(i, 7) for i in [*range(30), 99]}


def test_a_long_run_of_a_longer_item(spark):
    words = [f"word{i}" for i in range(500)]
    docs = documents(spark, (1, "so " + " ".join(words[150:350]) + " on"), (2, " ".join(words[20:60])), (3, "other words"))
    assert _hits(spark, docs, [(7, " ".join(words))]) == {(1, 7): 0.4}
    assert [r.doc_id for r in decontam.clean_documents(docs, _benchmark(spark, [(7, " ".join(words))])).orderBy("doc_id").collect()] == [2, 3]


def test_items_whose_words_never_come_together(spark):
    docs = documents(spark, (1, " ".join(reversed(ITEM.split()))))
    assert _hits(spark, docs, [(7, ITEM)]) == {}
    assert decontam.clean_documents(docs, _benchmark(spark, [(7, ITEM)])).count() == 1


def test_all_copies_of_the_given_tables(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    plain = lambda t: f" {decontam._plain(t).decode().strip()} "
    squeeze = lambda t: " ".join(plain(t).split())
    texts = {r.doc_id: f" {squeeze(r.text)} " for r in docs.collect()}
    expected = {(d, r.item_id) for r in items.collect() for d, t in texts.items() if f" {squeeze(r.text)} " in t}
    found = {(r.doc_id, r.item_id): r.score for r in decontam.contaminated(docs, items).collect()}
    assert {k for k, s in found.items() if s == 1.0} == expected and expected
    assert set(found) == expected
    blocks = {(r.doc_id, r.item_id): r.score for r in decontam.contaminated(docs, items, block=7).collect()}
    assert blocks == found


def test_awkward_rows(spark):
    docs = documents(spark, *AWKWARD, (20, ITEM), (20, ITEM), more="1 AS score")
    items = [(None, ITEM), (1, None), (2, ""), (3, "a b"), (4, "word " * 40), (4, "word " * 40)]
    found = decontam.contaminated(docs, _benchmark(spark, items)).collect()
    assert sorted((r.doc_id, str(r.item_id)) for r in found) == [(5, "4"), (20, "None"), (20, "None")]
    assert decontam.clean_documents(docs, _benchmark(spark, items)).count() == len(AWKWARD) - 1


def test_no_rows(spark):
    docs = documents(spark, (1, ITEM))
    assert _hits(spark, documents(spark), [(1, ITEM)]) == {} == _hits(spark, docs, [])
    assert decontam.clean_documents(docs, _benchmark(spark, [])).count() == 1
