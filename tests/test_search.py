"""Search by seeds against alignment of all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainloom.functions.labels import AMINO_ACIDS
from chainloom.operators import search, transfer
from chainloom.plans import reference_queries

MATRIX = search.class_matrix()


def related(seed, families=8, members=4, length=90):
    rng, out = random.Random(seed), []
    for f in range(families):
        root = rng.choices(AMINO_ACIDS, k=length)
        for m in range(members):
            seq = []
            for c in root:
                x = rng.random()
                seq += [] if x < 0.02 else [c, rng.choice(AMINO_ACIDS)] if x < 0.04 else [rng.choice(AMINO_ACIDS) if x < 0.30 else c]
            out.append((f"f{f}m{m}", "".join(rng.choices(AMINO_ACIDS, k=rng.randint(0, 20)) + seq)))
    return [*out, ("none", None), ("empty", ""), ("short", "MK"), ("odd", "B" * 30)]


def test_search_finds_what_aligning_all_pairs_finds(spark):
    rows = related(1)
    d = spark.createDataFrame(rows, "k string, s string")
    options = {"matrix": MATRIX, "gap": -8.0, "extend": -1.0, "other": -4.0, "local": True}
    best = {(a, b): transfer.alignment(x or "", y or "", **options) for a, x in rows for b, y in rows if a != b}
    want = {p for p, (s, _) in best.items() if s >= search.CUTOFF}
    for common in (10_000, 5):
        got = {(r["q"], r["t"]): r for r in search.search(d, d, "k", "s", MATRIX, common=common).collect()}
        assert set(got) <= want and len(got) >= 0.95 * len(want), (len(got), len(want))
        assert all(r["score"] == best[p][0] and r["aligned"] == len(best[p][1]) for p, r in got.items())
    assert len(want) > 60 and search.search(d.where("false"), d, "k", "s", MATRIX).count() == 0


def test_bands_that_hold_the_whole_table_give_the_full_score():
    rng, scores = random.Random(3), search.Scores(MATRIX, -4.0)
    texts = [("".join(rng.choices(AMINO_ACIDS, k=rng.randint(1, 40))), "".join(rng.choices(AMINO_ACIDS, k=rng.randint(1, 40)))) for _ in range(40)]
    texts += [(a, a[:5] + a[9:]) for a, _ in texts[:20] if len(a) > 12]
    got = search.banded([(scores.codes(a), scores.codes(b), -len(a), len(b)) for a, b in texts], scores, -8.0, -1.0)
    assert got.tolist() == [transfer.alignment(a, b, gap=-8.0, extend=-1.0, matrix=MATRIX, other=-4.0, local=True)[0] for a, b in texts]
    one = search.banded([(scores.codes("MKVLA"), scores.codes("MKVLA"), 0, 0)], scores, -8.0, -1.0)
    assert one.tolist() == [25.0]


def test_neighbourhoods_and_extension():
    scores = search.Scores(MATRIX, -4.0)
    near = search.neighbourhood("AVD", scores, 11.0)
    assert near == sorted({a + b + c for a in AMINO_ACIDS for b in AMINO_ACIDS for c in AMINO_ACIDS if MATRIX["A" + a] + MATRIX["V" + b] + MATRIX["D" + c] >= 11})
    assert search.neighbourhood("BBB", scores, 11.0) == ["BBB"]
    assert search.ungapped(np.array([5.0, -2, 5, -9, -9, 50]), 2, 10) == (8.0, 4) and search.ungapped(np.array([5.0, -2, 5]), 0, 10) == (8.0, 3)


def test_matrix_tables(spark):
    t = spark.createDataFrame([("A", "B", 1.0), ("B", "A", 2.0), ("A", "A", 4.0), (None, "A", 9.0)], "a string, b string, score double")
    assert search.matrix_of(t) == {"AB": 2.0, "BA": 2.0, "AA": 4.0}


def test_templates_are_those_of_all_pairs(spark, sf_dir):
    p = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name").collect()]
    got = {r["q"]: r for r in reference_queries.queries()["template_hits"](spark, sf_dir).collect()}
    right, queries = 0, [x for x in p if x[0] % 20 == 0]
    for q, a in queries:
        hits = []
        for t, b in p:
            if q != t:
                score, at = transfer.alignment(a, b, gap=-8.0, extend=-1.0, matrix=search.letter_matrix("abcdefghijklmnopqrstuvwxyz "), other=-1.0, local=True)
                same = sum(a[i] == b[j] for i, j in at)
                if score >= 20 and len(at) >= 9 and same / len(at) >= 0.5:
                    hits.append((-same / len(at), t))
        right += (q not in got) if not hits else q in got and got[q]["t"] == min(hits)[1]
    assert right >= 0.95 * len(queries)


def test_transferred_labels_are_those_of_plain_alignment(spark, sf_dir):
    from chainloom.plans.bindings import residues

    chains = {}
    base = {r["o_orderkey"]: r["o_custkey"] for r in spark.read.parquet(f"{sf_dir}/orders.parquet").collect()}
    for r in residues(spark, sf_dir).select("chain", "pos", "aa", "label").collect():
        chains.setdefault(r["chain"], []).append((r["pos"], r["aa"], r["label"]))
    refs, want = {}, {}
    for c in sorted(chains):
        chains[c].sort()
        refs.setdefault(base[c], c)
    for c, rows in chains.items():
        ref = chains[refs[base[c]]]
        if refs[base[c]] != c:
            at = transfer.alignment("".join(x[1] for x in rows), "".join(x[1] for x in ref), matrix=MATRIX, gap=-8.0, extend=-1.0, local=True)[1]
            n = sum(rows[i][1] == ref[j][1] and ref[j][2] == 1 for i, j in at)
            if n:
                want[c] = n
    assert {r["q"]: r["n_transferred"] for r in reference_queries.queries()["alignment_transfer"](spark, sf_dir).collect()} == want


@pytest.mark.parametrize("least", [1, 3])
def test_kmer_candidates_with_salts(spark, least):
    rng = random.Random(least)
    d = spark.createDataFrame([(i, "".join(rng.choices("AB", k=rng.randint(0, 9)))) for i in range(40)], "k int, s string")
    rows = {r["k"]: {r["s"][i : i + 3] for i in range(len(r["s"]) - 2)} for r in d.collect()}
    want = {(a, b, len(rows[a] & rows[b])) for a in rows for b in rows if a != b and len(rows[a] & rows[b]) >= least}
    for common in (10_000, 4):
        assert {tuple(r) for r in transfer.kmer_candidates(d, d, "k", "s", 3, least, common).collect()} == want
    assert transfer.kmer_candidates(d, d, "k", "s", 3, least).select(F.max("shared")).first()[0] > 0


def test_pairs_of_copies_in_blocks(spark):
    rng = random.Random(5)
    d = spark.createDataFrame([(i, rng.choice(["AABBA", "ABBAB", "BBBBB", "AABBA", None])) for i in range(60)], "k int, s string")
    rows = {r["k"]: r["s"] for r in d.collect() if r["s"]}
    grams = {k: {s[i : i + 3] for i in range(3)} for k, s in rows.items()}
    want = {(a, b, len(grams[a] & grams[b])) for a in rows for b in rows if a != b and a % 3 == 0 and grams[a] & grams[b]}
    found = transfer.kmer_texts(d.where("k % 3 = 0"), d, "s", 3, 1).drop("grams")
    assert found.count() <= 9 and found.count() == found.select("q", "t").distinct().count()
    for block in (3, 4_096):
        got = [tuple(r) for r in transfer.pairs_of_rows(found, d.where("k % 3 = 0"), d, "k", "s", block).collect()]
        assert len(got) == len(want) and set(got) == want


def test_pairs_of_many_copies_are_not_held_at_once(spark):
    n = 8_192
    d = spark.range(n).select(F.col("id").alias("k"), F.lit("red bolt").alias("s"))
    pairs = transfer.kmer_candidates(d, d, "k", "s", 4, 5)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    outer, inner = plan.index("Generate explode(t_keys"), plan.index("Generate explode(q_keys")
    assert "SortMergeJoin" in plan[outer:inner] and "Sort [" in plan[outer:inner]
    pairs.write.format("noop").mode("overwrite").save()
    assert tuple(pairs.agg(F.count("*"), F.sum("q"), F.sum("t"), F.min("shared"), F.max("shared")).first()) == (n * (n - 1), n * (n - 1) ** 2 // 2, n * (n - 1) ** 2 // 2, 5, 5)


def test_searches_compare_copies_once(spark):
    d = spark.createDataFrame([(i, ["red bolt", "red bolts", "hot plate"][i % 3]) for i in range(90)], "k int, s string")
    options = {"other": -1.0, "word": 4, "least": 8.0, "drop": 8.0, "trigger": 14.0, "cutoff": 14.0}
    matrix = search.letter_matrix("abcdefghijklmnopqrstuvwxyz ")
    found = search.search_texts(transfer.texts(d, "s"), transfer.texts(d, "s"), "id", "s", matrix, **options)
    assert found.count() == 5  # three texts with themselves, two of them with each other
    assert {(r["q"], r["t"]) for r in search.search(d, d, "k", "s", matrix, **options).collect()} == {(a, b) for a in range(90) for b in range(90) if a != b and (a % 3 == 2) == (b % 3 == 2)}


@pytest.mark.parametrize("family", [None, "f"])
def test_best_of_texts_is_the_best_of_rows(spark, family):
    rng = random.Random(7)
    rows = [(i, rng.choice("abcde"), rng.choice(["x", "y", "z", None]) if i % 4 else "x") for i in range(80)]
    d = spark.createDataFrame(rows, "k int, s string, f string")
    q = d.where("k % 2 = 0")
    ids = {r["s"]: r["id"] for r in transfer.texts(d, "s").collect()}
    rank = {(a, b): rng.choice([0.5, 0.7, 1.0]) for a in "abcde" for b in "abcde" if rng.random() < 0.6}
    pairs = spark.createDataFrame([(ids[a], ids[b], v) for (a, b), v in rank.items()], "q string, t string, v double")
    want = set()
    for k, s, f in rows:
        hits = [(-rank[s, y], j) for j, y, g in rows if (s, y) in rank and k % 2 == 0 and (j != k if family is None else None not in (f, g) and f != g)]
        if hits:
            want.add((k, min(hits)[1], -min(hits)[0]))
    got = [tuple(r) for r in transfer.best_of_texts(pairs, q, d, "k", "s", "v", family).select("q", "t", "v").collect()]
    assert len(got) == len(want) and set(got) == want


def test_top_hits_without_a_brand_are_none(spark, tmp_path):
    rows = [(0, "red bolt nut", None), (1, "red bolt nut", "b"), (20, "hot iron ring", "a"), (21, "hot iron ring", None), (22, "hot iron ring", "a"), (40, "new cold rod", "a"), (41, "new cold rod", "b"), (42, "new cold rod", "c")]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string").write.parquet(str(tmp_path / "part.parquet"))
    got = {tuple(r) for r in reference_queries.queries()["top_hit_selection"](spark, str(tmp_path)).collect()}
    assert got == {(0, None, None), (20, None, None), (40, 41, 1.0)}
