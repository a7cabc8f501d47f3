"""Queries over command vectors that come out the same on every run."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from bindings.queries import query
from vigil.plans import wordspace
from vigil.plans.commands import BUCKETS, VECTOR_SIZE
from vigil.session import scratch_path, settle

_WORDS = """(select c, hits, unnest(string_split(c, ' ')) as word, generate_subscripts(string_split(c, ' '), 1) as place
    from (select command as c, count(*) as hits from {v_bash} where command is not null group by command) g)"""


def _pairs(word: str) -> str:
    return f"""select {word.format('a.word')} as word, {word.format('b.word')} as near, cast(sum(a.hits) as bigint) as n
        from {_WORDS} a join {_WORDS} b on a.c = b.c and a.place <> b.place and abs(a.place - b.place) <= {wordspace.WINDOW}
        group by 1, 2"""


@query("cmd_word_pairs", _pairs("{}"))
def _(t):
    rows = t["v_bash"].filter(F.col("command").isNotNull()).groupBy("command").agg(F.count(F.lit(1)).alias("hits"))
    return wordspace.pair_counts(rows.withColumn("tokens", F.split("command", " ")))


_BUCKET = f"(cast('0x' || substr(md5({{}}), 1, 13) as bigint) % {BUCKETS})"


def _projected(vectors: str) -> str:
    return f"""select word, i, v * {wordspace.UNIT} // greatest(max(abs(v)) over (partition by word), 1) as v
        from (select w.word, i, cast(sum(weight * v) as bigint) as v from weights w join {vectors} x on x.word = w.near group by w.word, i) s"""


@query(
    "cmd_word_vectors",
    f"""select * from (with pairs as materialized ({_pairs(_BUCKET)}),
          totals as materialized (select word, cast(sum(n) as bigint) as total from pairs group by word),
          weights as materialized (select * from (
            select p.word, p.near, cast(floor(ln(cast(n as double) * (select cast(sum(total) as double) from totals)
                / (cast(a.total as double) * cast(b.total as double))) * {wordspace.WEIGHT}) as bigint) as weight
            from pairs p join totals a on a.word = p.word join totals b on b.word = p.near) w where weight > 0),
          own as materialized (select word, i, case when substr(md5(word || ':' || i), 1, 1) < '8' then {wordspace.UNIT} else -{wordspace.UNIT} end as v
            from (select distinct {_BUCKET.format('word')} as word from {_WORDS} x) y, range({VECTOR_SIZE}) r(i)),
          first as materialized ({_projected('own')}),
          second as materialized ({_projected('first')})
        select word, string_agg(cast(v as varchar), ',' order by i) as vector
        from (select word, i, cast(sum(v) as bigint) as v from (
            select word, i, v from own union all select word, i, v from first union all select word, i, v from second) u
          group by word, i) s group by word) found""",
)
def _(t):
    return wordspace.learn(t["v_bash"]).select("word", F.array_join(F.col("vector").cast("array<string>"), ",").alias("vector"))


_CLUSTERS = 25


def _assigned(t, bash):
    """Cluster of each row, through a saved and loaded model."""
    words = wordspace.learn(bash)
    # Trained on and assigned, so kept.
    points = settle(wordspace.vectors(words, bash), "points")
    path = scratch_path(t.spark, "wordspace")
    wordspace.save(words, wordspace.train(words, bash, k=_CLUSTERS, points=points), path)
    words, model = wordspace.load(t.spark, path)
    return words, model, settle(wordspace.assign(words, model, bash, points=points), "assigned")


@query(
    "cmd_stable_clusters",
    """select count(*) as clustered, 0::bigint as moved, 0::bigint as not_nearest from {v_bash} where command is not null""",
)
def _(t):
    words, model, found = _assigned(t, t["v_bash"])
    # The same rows from other files in another order.
    shuffled = settle(t["v_bash"].repartition(7, "username", "date").sortWithinPartitions(F.desc("command")), "shuffled")
    other = _assigned(t, shuffled)[2].select("command", F.col("prediction").alias("other")).distinct()
    # Distances to all centres by plain arithmetic; there are as many as clusters.
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    distances = F.transform(centres, lambda c: F.aggregate(
        F.zip_with("point", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d))
    points = wordspace.vectors(words, t["v_bash"]).select("key", vector_to_array("features").alias("point"))
    points = points.withColumn("distances", distances).select(
        "key", "distances", F.array_min("distances").alias("least"))
    rows = found.select("command", "prediction").join(other, "command", "left").withColumn("key", F.md5("command"))
    rows = rows.join(points, "key", "left")
    own = F.get("distances", F.col("prediction"))
    return rows.agg(
        F.count(F.lit(1)).alias("clustered"),
        F.count(F.when(~F.col("prediction").eqNullSafe(F.col("other")), 1)).alias("moved"),
        F.count(F.when(own.isNull() | (own > F.col("least") * (1 + 1e-9) + 1e-6), 1)).alias("not_nearest"),
    )
