from __future__ import annotations

import random

import numpy as np
import pytest

from conftest import SF
from llm_helpers import AWKWARD, documents, plain_groups, shingles
from vigil.llm import jaccard


def _corpus(seed: int, n: int = 160) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    texts = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 90))] for _ in range(n // 4)]
    rows = []
    for i in range(n):
        text = list(rng.choice(texts))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            text[rng.randrange(len(text))] = rng.choice(vocabulary)
        rows.append((i, " ".join(text).upper() if rng.random() < 0.2 else "\n".join(text)))
    return rows


@pytest.mark.parametrize("words, percent, seed", [(3, 90, 1), (3, 90, 2), (5, 80, 3), (2, 60, 4)])
def test_all_links_are_found(spark, words, percent, seed):
    rows = _corpus(seed)
    found = jaccard.near_duplicates(documents(spark, *rows), words, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == plain_groups(rows, words, percent)


def test_large_group_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(3000)}" for _ in range(200)]
    rows = []
    for i in range(300):
        text = list(base)
        text[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(text)))
    assert {r.component_id for r in jaccard.near_duplicates(documents(spark, *rows)).collect()} == {0}


@pytest.mark.parametrize("words, percent", [(3, 90), (5, 80)])
def test_pairs_of_a_group_of_near_copies_are_not_made(spark, monkeypatch, words, percent):
    rng = random.Random(words)
    # Nearly all of two texts is the same, but most pairs are not linked; a few texts share edits.
    base = [f"w{rng.randrange(3000)}" for _ in range(150)]
    rows = []
    for i in range(400):
        text = list(base)
        for place in rng.sample(range(150), rng.choice([2, 3, 4, 5])):
            text[place] = f"x{rng.randrange(400)}"
        rows.append((i, " ".join(text)))
        if i % 20 == 0:
            text[rng.randrange(150)] = f"y{i}"
            rows.append((1000 + i, " ".join(text)))
    counts = []

    def counted(function):
        def run(*given):
            found = jaccard.settle(function(*given), "counted")
            counts.append(found.count())
            return found

        return run

    pairs = jaccard._possible
    monkeypatch.setattr(jaccard, "_possible", lambda given, *more: pairs(counted(lambda: given)(), *more))
    monkeypatch.setattr(jaccard, "_differing", counted(jaccard._differing), raising=False)
    found = jaccard.near_duplicates(documents(spark, *rows), words, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == plain_groups(rows, words, percent)
    assert sum(counts) < 10 * len(rows)


@pytest.mark.parametrize("words, percent, seed", [(3, 90, 1), (5, 80, 3), (2, 60, 4)])
def test_all_links_are_found_by_differences(spark, monkeypatch, words, percent, seed):
    monkeypatch.setattr(jaccard, "LONG", 1)
    monkeypatch.setattr(jaccard, "STARS", 1)
    rows = _corpus(seed)
    found = jaccard.near_duplicates(documents(spark, *rows), words, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == plain_groups(rows, words, percent)


def test_groups_of_the_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    found = jaccard.near_duplicates(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == plain_groups(rows, 3, 90)


def test_smallest_grams_of_windows():
    for size in (1, 2, 15, 16, 17, 60):
        hashes = np.random.default_rng(size).integers(0, 2**63, size).astype(np.uint64)
        width = min(size, jaccard.WINDOW)
        assert jaccard.smallest(hashes).tolist() == [min(hashes[i : i + width]) for i in range(size - width + 1)]


def test_a_shared_passage_comes_last(spark):
    rng = random.Random(9)
    # Every word is as rare as any other, so only counts of grams tell the passage.
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(40))
    rows = [(i, " ".join(f"a{i}x{k}" for k in range(30)) + f" {passage} " + " ".join(f"b{i}x{k}" for k in range(30))) for i in range(40)]
    texts = documents(spark, *rows).select("text")
    order, often = jaccard.sketch(texts, 3)
    # As in a table so large that 40 documents do not stand out of a counter.
    order.excess[:] = 0
    counted = jaccard.passages(texts, order, often, 3).groupBy("gram").agg({"n": "sum"}).collect()
    by = {r[0] % 2**64: r[1] for r in counted}
    assert all(by.get(g) == 40 for g in jaccard.grams(passage, 3).tolist())
    assert {r.component_id for r in jaccard.near_duplicates(documents(spark, *rows)).collect()} == set(range(40))


@pytest.mark.parametrize("length", [1, 2, 3, 4])
def test_similar_sets_share_enough_of_every_prefix(length):
    rng = np.random.default_rng(length)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**63, 60).astype(np.uint64))
        b = np.unique(np.concatenate([a[3:], rng.integers(0, 2**63, 2).astype(np.uint64)]))
        cut = lambda s: set(np.sort(s)[: len(s) - jaccard.needed(len(s), 90) + length].tolist())
        if 100 * len(np.intersect1d(a, b)) >= 90 * len(np.union1d(a, b)):
            assert len(cut(a) & cut(b)) >= length


def test_longer_prefixes_for_frequent_grams():
    found = np.sort(np.random.default_rng(1).integers(0, 2**63, 100).astype(np.uint64))
    assert jaccard.adaptive_prefix(found, np.full(100, 1e-6), 90)[1] == 1
    prefix, length = jaccard.adaptive_prefix(found, np.full(100, 50.0), 90)
    assert length > 1 and len(prefix) == 10 + length
    expected = np.arange(100, 0, -1.0)
    assert jaccard.adaptive_prefix(found, expected, 90)[0][0] == found[-1]


def test_bitmaps_rule_out_no_link():
    rng = np.random.default_rng(3)
    for size in (1, 5, 60, 900, 6000):
        a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        for changed in (0, size // 30, size // 12, size // 5):
            b = np.unique(np.concatenate([a[changed:], rng.integers(0, 2**63, changed // 2).astype(np.uint64)]))
            apart = sum(int(x).bit_count() for x in (jaccard._bitmap(a) ^ jaccard._bitmap(b)).view(np.uint64))
            assert apart <= len(np.setxor1d(a, b))


def test_order_knows_frequent_grams(spark):
    rows = [(i, f"shared passage of words u{i} v{i} w{i} the") for i in range(400)]
    order, _ = jaccard.sketch(documents(spark, *rows).select("text"), 3)
    found, expected = order.grams(rows[7][1], 3)
    by = dict(zip(found.tolist(), expected.tolist()))
    frequent = jaccard.grams("shared passage of", 3).tolist() + jaccard.grams("passage of words", 3).tolist()
    assert min(by[g] for g in frequent) > 100 * by[jaccard.grams("u7 v7 w7", 3).tolist()[0]]


def test_awkward_rows(spark):
    found = jaccard.near_duplicates(documents(spark, *AWKWARD, more="1 AS component_id")).collect()
    assert len(found) == len(AWKWARD)
    by = {r.doc_id: (r.n_shingles, r.component_id) for r in found}
    assert by[1] == (0, 1) and by[3] == (0, 3) and by[6] == by[7] == (1, 6) and by[5] == (1, 5) and by[None] == (2, None)
    kept = jaccard.one_of_each(documents(spark, *AWKWARD, more="1 AS low")).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "2", "3", "4", "5", "6", "None"]
    assert kept[0].low == 1


def test_sets_are_those_of_the_words():
    text = "É a B c\x0bd  a b C"
    assert len(jaccard.grams(text, 3)) == len(shingles(text, 3)) == 5


def test_no_rows(spark):
    assert jaccard.near_duplicates(documents(spark)).collect() == []
    assert jaccard.one_of_each(documents(spark)).collect() == []


def test_texts_are_not_moved_for_the_few_that_go(spark):
    rows = _corpus(6)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = jaccard.one_of_each(documents(spark, *rows), 5, 80)
        assert {r.doc_id for r in found.collect()} == {low for _, low in plain_groups(rows, 5, 80).values()}
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan.replace("BroadcastExchange", "")
