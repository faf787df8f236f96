"""Votes in blocks and keys in texts against plain forms."""

import random

from pyspark.sql import functions as F

from chainloom.operators import containment, transfer, votes


def test_votes_in_blocks_are_those_of_all_scores(spark):
    rng = random.Random(0)
    rows = [(i, [rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(4)], i % 3) for i in range(150)] + [(200, None, 1), (201, [0.0] * 4, 1), (7, [1.0, 1.0, 0.0, 0.0], 2)]
    d = spark.createDataFrame(rows, "t long, v array<double>, label int").repartition(4)
    q = d.where("t % 10 = 0").select(F.col("t").alias("q"), "v")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    pairs = q.select("q", F.col("v").alias("u")).crossJoin(d).where("q <> t").withColumn("score", F.try_divide(100 * dot("u", "v"), F.sqrt(dot("u", "u") * dot("v", "v")))).where("score is not null")
    options = {"cutoff": 10.0, "pctl": 0.8, "top": 5}
    for cells, block in ((1024, 1000), (7, 4)):
        got = {(r["q"], r["t"], round(r["score"], 6)): round(r["w"], 6) for r in votes.vector_votes(q, d, block=block, n_cells=cells, **options).collect()}
        want = {(r["q"], r["t"], round(r["score"], 6)): round(r["w"], 6) for r in transfer.vote_weights(pairs.select("q", "t", "label", "score"), "q", "score", tie="t", **options).collect()}
        assert {k[:2] for k in got} == {k[:2] for k in want} and got == want
    assert votes.vector_votes(q.where("false"), d).count() == 0 and votes.vector_votes(q, d.where("false")).count() == 0


def test_keys_in_texts_as_contains_has_them(spark):
    rng = random.Random(1)
    texts = [(i, "".join(rng.choices("abé ", k=rng.randint(0, 30)))) for i in range(60)] + [(60, None), (61, ""), (61, "")]
    keys = [("".join(rng.choices("abé", k=rng.randint(1, 4))),) for _ in range(40)] + [(None,), ("",), ("a",), ("a",)]
    t, k = spark.createDataFrame(texts, "id long, place string"), spark.createDataFrame(keys, "key string")
    want = sorted((i, x) for i, s in texts for x in {y[0] for y in keys} if x and s and x in s)
    for size in (4 << 20, 9):
        found = containment.containing(t, "id", "place", k, "key", size)
        assert sorted(map(tuple, found.collect())) == want
        assert "NestedLoop" not in found._jdf.queryExecution().toString()
    assert containment.containing(t, "id", "place", k.where("false"), "key").count() == 0
    joined = spark.createDataFrame([want[0], (60, "zz")], "id long, key string")
    apart = containment.disagreements(found, joined)
    assert apart.where("only = 'joined'").count() == 1 and apart.where("only = 'contained'").count() == len(set(want)) - 1
