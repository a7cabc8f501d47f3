from __future__ import annotations

from llm_helpers import AWKWARD, documents
from vigil.llm import exact

A = [(1, "a b c"), (2, "a  b c"), (3, "abc\n"), (4, "other"), (5, "a  b c")]


def _by_id(df):
    return {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in df.collect()}


def test_longest_then_smallest_stays(spark):
    assert _by_id(exact.deduplicate(documents(spark, *A, more="1 AS kept"))) == {
        1: (2, 4, False), 2: (2, 4, True), 3: (2, 4, False), 5: (2, 4, False), 4: (4, 1, True),
    }


def test_index_remembers_earlier_batches(spark):
    index = exact.new_index(spark, buckets=4)
    exact.deduplicate(documents(spark, (1, "a"), (2, "b")), index)
    later = _by_id(exact.deduplicate(documents(spark, (3, " a"), (4, "c"), (5, "c")), index))
    assert later[3][0] == 1 and not later[3][2]
    assert later[4][2] and not later[5][2]
    assert index.read().count() == 3
    assert [r.doc_id for r in exact.distinct_documents(documents(spark, (6, "b"), (7, "d")), index).collect()] == [7]


def test_a_batch_can_be_given_again(spark):
    docs = documents(spark, (1, "a"), (2, "a"), (2, "a"), (3, "b"), (4, "c"))
    index = exact.new_index(spark, buckets=4)
    exact.deduplicate(documents(spark, (9, "c")), index, "first")
    once = sorted(map(tuple, exact.deduplicate(docs, index, "second").collect()))
    assert [r[:4] for r in once] == [(1, 1, 3, True), (2, 1, 3, False), (2, 1, 3, False), (3, 3, 1, True), (4, 9, 1, False)]
    # The digests are in the index, the rows of the result were not written: all again.
    assert sorted(map(tuple, exact.deduplicate(docs.repartition(3), index, "second").collect())) == once
    assert sorted(r.doc_id for r in exact.distinct_documents(docs, index, "second").collect()) == [1, 3]
    assert index.read().count() == 3
    assert not any(r.kept for r in exact.deduplicate(docs, index, "third").collect())


def test_a_batch_that_was_added_in_part(spark):
    docs = documents(spark, (1, "a"), (2, "b"), (3, "b"))
    index = exact.new_index(spark, buckets=4)
    whole = exact.digests(docs).selectExpr("*", "monotonically_increasing_id() AS __row")
    index.append(whole.where("doc_id = 1"), "batch")
    assert _by_id(exact.deduplicate(docs, index, "batch")) == {1: (1, 1, True), 2: (2, 2, True), 3: (2, 2, False)}
    assert index.read().count() == 2
    index.drop()
    assert not spark.catalog.tableExists(index.name)


def test_index_is_not_shuffled(spark):
    index = exact.new_index(spark, buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        digests = exact.digests(documents(spark, *A)).select("text_sha256").distinct()
        plan = digests.join(index.read().hint("merge"), "text_sha256", "left_anti")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan
    assert "Exchange" not in plan.split("\n:- ")[0].split("FileScan")[-1]


def test_awkward_rows(spark):
    found = exact.deduplicate(documents(spark, *AWKWARD)).collect()
    assert len(found) == len(AWKWARD)
    assert {r.keep_id for r in found if r.doc_id in (1, 2, 3)} == {3}
    assert sorted(r.kept for r in found if r.doc_id == 7) == [False, False]
    kept = exact.distinct_documents(documents(spark, *AWKWARD, more="'x' AS group_size")).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["3", "4", "5", "6", "None"]
    assert kept[0].asDict().keys() >= {"lang", "group_size"}


def test_repeated_rows_leave_one(spark):
    found = exact.deduplicate(documents(spark, (1, "a"), (1, "a"), (2, "a"))).collect()
    assert sum(r.kept for r in found) == 1 and {r.keep_id for r in found} == {1}
    assert exact.distinct_documents(documents(spark, (1, "a"), (1, "a"), (2, "b"))).count() == 2


def test_hot_text(spark):
    rows = [(i, "same") for i in range(400)] + [(i, f"t{i}") for i in range(400, 1200)]
    found = _by_id(exact.deduplicate(documents(spark, *rows)))
    assert found[399] == (0, 400, False) and found[0][2] and found[777] == (777, 1, True)


def test_no_rows(spark):
    assert exact.deduplicate(documents(spark)).collect() == []
    assert exact.distinct_documents(documents(spark)).collect() == []
