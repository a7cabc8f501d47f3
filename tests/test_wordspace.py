from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from vigil.plans import wordspace

SCHEMA = "command string, username string"


def _plain_pairs(commands, window):
    found = Counter()
    for command in commands:
        words = command.split(" ")
        for i, a in enumerate(words):
            for j, b in enumerate(words):
                if i != j and abs(i - j) <= window:
                    found[a, b] += 1
    return found


@pytest.fixture(scope="module")
def bash(spark):
    # One command is a third of all rows; nulls, empty texts, lone words and repeats are in.
    texts = ["ls -l /tmp"] * 60 + [f"cp file{i % 9} /srv/{i % 4}" for i in range(60)]
    texts += [f"curl http://h{i % 5}/a -o a.sh" for i in range(40)] + ["", "", "who", "a a a", " ".join(["x"] * 3000), None]
    return spark.createDataFrame([(c, f"u{i % 7}") for i, c in enumerate(texts)], SCHEMA)


def test_pairs_match_a_plain_count(bash):
    commands = [r["command"] for r in bash.collect() if r["command"] is not None]
    rows = bash.filter("command is not null").groupBy("command").agg(F.count(F.lit(1)).alias("hits"))
    rows = rows.withColumn("tokens", F.split("command", " "))
    for window in (1, 5):
        found = {(r["word"], r["near"]): r["n"] for r in wordspace.pair_counts(rows, window=window).collect()}
        assert found == dict(_plain_pairs(commands, window))


def _layouts(bash):
    yield bash
    yield bash.repartition(1).sortWithinPartitions(F.desc("command"))
    yield bash.repartition(11, "username")


def test_layouts_and_shuffles_give_the_same_words_and_clusters(spark, bash):
    seen = []
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for shuffles, rows in zip(("8", "3", "17"), _layouts(bash)):
            spark.conf.set("spark.sql.shuffle.partitions", shuffles)
            words = wordspace.learn(rows, size=12)
            model = wordspace.train(words, rows, k=6, size=12)
            found = wordspace.assign(words, model, rows, size=12)
            centres = [tuple(c) for c in model.clusterCenters()]
            seen.append((rows_of(words), centres, rows_of(found, "command", "username", "prediction")))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert seen[0] == seen[1] == seen[2]
    assert len(seen[0][2]) == bash.filter("command is not null").count()


def test_shuffled_joins_give_the_same(spark, bash, nothing_fits):
    words = wordspace.learn(bash, size=8)
    model = wordspace.train(words, bash, k=4, size=8)
    found = wordspace.assign(words, model, bash, size=8)
    assert found.count() == bash.filter("command is not null").count()
    assert found.groupBy("command").agg(F.count_distinct("prediction").alias("n")).filter("n > 1").count() == 0


def test_words_used_alike_are_nearer_than_others(spark):
    texts = [f"{verb} -rf /var/{i}" for i in range(30) for verb in ("rm", "del")]
    texts += [f"ping host{i} --count 3" for i in range(30)]
    rows = spark.createDataFrame([(c, "u") for c in texts], SCHEMA)
    held = {r["word"]: r["vector"] for r in wordspace.learn(rows).collect()}
    names = spark.createDataFrame([("rm",), ("del",), ("ping",)], "w string").select("w", wordspace.bucket(F.col("w")).alias("b"))
    rm, other, ping = (held[dict(names.collect())[w]] for w in ("rm", "del", "ping"))

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5

    assert cosine(rm, other) > cosine(rm, ping) + 0.2


def test_buckets_bound_the_words(bash):
    words = wordspace.learn(bash, size=4, buckets=8)
    assert words.count() <= 8 and words.filter("size(vector) <> 4").count() == 0


def test_saved_words_score_new_commands(spark, bash, tmp_path):
    words = wordspace.learn(bash, size=8)
    model = wordspace.train(words, bash, k=4, size=8)
    wordspace.save(words, model, str(tmp_path / "m"))
    again = wordspace.load(spark, str(tmp_path / "m"))
    known = wordspace.assign(words, model, bash, size=8)
    assert rows_of(wordspace.assign(*again, bash, size=8)) == rows_of(known)
    fresh = spark.createDataFrame([("ls -l /tmp", "x"), ("never seen", "x"), (None, "x")], SCHEMA)
    scored = {r["command"]: r["prediction"] for r in wordspace.assign(*again, fresh, size=8).collect()}
    assert set(scored) == {"ls -l /tmp", "never seen"}
    assert scored["ls -l /tmp"] == known.filter("command = 'ls -l /tmp'").first()["prediction"]


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    words = wordspace.learn(empty, size=4)
    assert words.count() == 0
    assert wordspace.vectors(words, empty, size=4).count() == 0


def test_other_columns_stay(spark, bash):
    clash = bash.selectExpr("*", "1 as prediction", "'k' as key", "2 as hits", "'w' as word")
    words = wordspace.learn(clash, size=4)
    model = wordspace.train(words, clash, k=2, size=4)
    found = wordspace.assign(words, model, clash, size=4)
    assert found.columns == ["command", "username", "key", "hits", "word", "prediction"]
    assert found.filter("key <> 'k' or hits <> 2 or word <> 'w'").count() == 0


def test_groups_do_not_change_sums(spark, bash, monkeypatch):
    def found():
        words = wordspace.learn(bash, size=6)
        return rows_of(words), rows_of(wordspace.vectors(words, bash, size=6).selectExpr("key", "hits", "string(features)"))

    whole = found()
    monkeypatch.setattr(wordspace, "CELLS", 32)
    assert found() == whole


def test_words_too_large_for_packing_are_refused(spark, bash):
    words = spark.createDataFrame([(1, [40_000, 0])], "word long, vector array<long>")
    with pytest.raises(Exception, match="16 bits"):
        wordspace.vectors(words, bash, size=2).collect()


def test_training_partitions_grow_with_the_rows(spark, bash, monkeypatch):
    class Seen:
        def __init__(self, **_):
            pass

        def fit(self, rows):
            return rows.rdd.getNumPartitions()

    monkeypatch.setattr(wordspace, "KMeans", Seen)
    words = wordspace.learn(bash, size=2)
    assert wordspace.train(words, bash, size=2) == wordspace.TRAINERS
    monkeypatch.setattr(wordspace, "TRAINING_ROWS", 10)
    assert wordspace.train(words, bash, size=2) == -(-bash.select("command").distinct().filter("command is not null").count() // 10)


def test_kept_vectors_are_not_made_again(spark, bash, monkeypatch):
    words = wordspace.learn(bash, size=4)
    plain = wordspace.assign(words, wordspace.train(words, bash, k=3, size=4), bash, size=4)
    points = wordspace.settle(wordspace.vectors(words, bash, size=4), "points")
    monkeypatch.delattr(wordspace, "vectors")
    model = wordspace.train(words, bash, k=3, size=4, points=points)
    assert rows_of(wordspace.assign(words, model, bash, size=4, points=points)) == rows_of(plain)
