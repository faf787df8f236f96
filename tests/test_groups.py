"""Pairs within groups, proposals of columns and contacts against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from chainloom.operators import screen, spatial, transfer


def test_all_pairs_of_a_group_once_whatever_the_blocks(spark):
    rows = [(b, f"{b}{i:02}", "A" * (i + 1)) for b, n in (("x", 23), ("y", 1), ("z", 2)) for i in range(n)]
    d = spark.createDataFrame(rows, "base string, id string, seq string")
    want = sorted((a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1])
    for block in (200, 3):
        assert sorted((r["base"], r["q"], r["t"]) for r in screen.sequence_pairs(d, block).collect()) == want


def test_a_large_group_is_many_keys(spark):
    d = spark.range(10_000).select(F.lit("b").alias("base"), F.col("id").cast("string").alias("id"), F.lit("A").alias("seq"))
    n = d.groupBy("base").agg(F.ceil(F.count("*") / screen.PAIR_BLOCK)).first()[1]
    assert n == 50 and screen.sequence_pairs(d.limit(600), 50).count() == 600 * 599 / 2


def test_losses_between_all_members_both_ways(spark):
    rng = random.Random(4)
    members = [(b, f"{b}-{i}", "".join(rng.choices("MKV", k=rng.choice([4, 5, 6])))) for b in ("p", "q") for i in range(5)] + [("p", "p-9", None), ("r", "r-1", "MK"), ("q", "q-same", None)]
    members = [m if m[1] != "q-same" else ("q", "q-same", next(x[2] for x in members if x[1] == "q-0")) for m in members]
    members.append((None, "z", "M"))
    sites = [(b, m, i) for b, m, _ in members for i in range(-1, 8) if rng.random() < 0.4]
    d = spark.createDataFrame(members, "base string, member string, seq string")
    s = spark.createDataFrame([*sites, *sites[:3]], "base string, member string, pos int")

    def align(pairs):
        at = transfer.align_pairs(pairs.withColumn("q2", F.concat("base", F.lit("|"), "q")), "q2", "t", "q_seq", "t_seq", match=2.0, mismatch=-1.0, gap=-2.0).where("same")
        return at.select(F.substring_index("q", "|", 1).alias("base"), F.substring_index("q", "|", -1).alias("q"), "t", "qpos", "tpos")

    want = set()
    chosen = [m for m in members if m[0] == "q"]
    for _, a, x in chosen:
        for _, b, y in chosen:
            if a != b:
                import hashlib

                first, second = sorted((x, y), key=lambda v: hashlib.md5(v.encode()).hexdigest())
                at = transfer.alignment(first, second, match=2.0, mismatch=-1.0, gap=-2.0)[1]
                at = [(i, i) for i in range(len(x))] if x == y else at if first == x else [(j, i) for i, j in at]
                want |= {("q", a, b, i, j) for i, j in at if x[i] == y[j] and ("q", a, i) in sites and ("q", b, j) not in sites}
    for block in (200, 2):
        lost, skipped = screen.member_losses(d, s, align, block)
        assert {tuple(r) for r in lost.collect()} == want and lost.count() == len(want) > 0
        assert {tuple(r) for r in skipped.collect()} == {("p", 6, "no sequence"), ("r", 1, "one member")}
    assert screen.member_losses(d.where("false"), s, align)[0].count() == 0


def test_losses_read_members_and_sites_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(r):
        seen.add(1)
        return r

    members = spark.sparkContext.parallelize([(b, f"m{i}", "MKVA"[: 3 + i % 2]) for b in ("p", "q") for i in range(4)], 2).map(counted)
    sites = spark.sparkContext.parallelize([(b, f"m{i}", i) for b in ("p", "q") for i in range(4)], 2).map(counted)
    align = lambda p: p.select("base", "q", "t", F.explode(F.sequence(F.lit(0), F.least(F.length("q_seq"), F.length("t_seq")) - 1)).alias("qpos")).withColumn("tpos", F.col("qpos"))
    lost, _ = screen.member_losses(spark.createDataFrame(members, "base string, member string, seq string"), spark.createDataFrame(sites, "base string, member string, pos int"), align)
    # m3's site 3 lies in m1 too; all others lie in every sequence
    assert lost.count() == lost.distinct().count() == 2 * (3 + 3 + 3 + 1) and seen.value == 16


def test_losses_align_each_pair_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def align(pairs):
        def at(p):
            seen.add(1)
            assert p["q"] < p["t"] and {len(p["q"]), len(p["t"])} == {32}
            return [(p["base"], p["q"], p["t"], i, i) for i, (a, b) in enumerate(zip(p["q_seq"], p["t_seq"], strict=False)) if a == b]

        return spark.createDataFrame(pairs.rdd.flatMap(at), "base string, q string, t string, qpos int, tpos int")

    members = [("p", "a", "MKV"), ("p", "b", "MKVA"), ("p", "c", "MKA"), ("p", "d", "MKV")]
    lost, _ = screen.member_losses(spark.createDataFrame(members, "base string, member string, seq string"), spark.createDataFrame([("p", "a", 2), ("p", "c", 0)], "base string, member string, pos int"), align)
    assert sorted(map(tuple, lost.collect())) == [("p", "a", "b", 2, 2), ("p", "a", "d", 2, 2), ("p", "c", "a", 0, 0), ("p", "c", "b", 0, 0), ("p", "c", "d", 0, 0)]
    assert seen.value == 3


def test_proposals_are_those_of_a_plain_loop(spark):
    rng = random.Random(5)
    votes = [("f", c, m, c + 3 * m % 5, rng.choice("AC"), int(rng.random() < 0.5)) for c in range(60) for m in range(4) if rng.random() < 0.8] + [("f", 1, 1, 1, None, 1)]
    positives = [(m, p, a) for _, _, m, p, a, y in votes if y and a] + [(None, 3, "A")]
    want = set()
    for c in range(60):
        here = [v for v in votes if v[1] == c and v[4]]
        if here:
            letter = max(sorted({v[4] for v in here}), key=lambda x: sum(v[4] == x for v in here))
            mine = [v for v in here if v[4] == letter]
            if len(mine) >= 2 and sum(v[5] for v in mine) / len(mine) >= 0.5:
                want |= {(v[2], v[3]) for v in mine if not any(m == v[2] and a == letter and p != v[3] and abs(p - v[3]) <= 2 for m, p, a in positives)}
    d = spark.createDataFrame(votes, "file string, col int, member int, pos int, aa string, label int")
    p = spark.createDataFrame(positives, "member int, pos int, aa string")
    assert {tuple(r) for r in screen.column_proposals(d, p, ["file"], 0.5, nearby=2).collect()} == want and want
    assert screen.column_proposals(d.where("false"), p, ["file"], 0.5).count() == 0


def test_entries_at_one_place_never_meet(spark):
    atoms = spark.range(2000).select((F.col("id") % 100).alias("entry"), F.lit("c").alias("chain"), *[(F.col("id") / 1e9).alias(c) for c in spatial.XYZ])
    pairs = spatial.within(atoms, atoms, 1.0, ["entry"])
    assert pairs.count() == 100 * 20 * 20
    joins = [x for x in pairs._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x]
    assert len(joins) == 1 and joins[0].count(" = ") == 4


@pytest.mark.parametrize("alphas", [4, 3])
def test_contact_rule(spark, alphas):
    rows = [("e", c, i, "CA", "C", i * 20.0, 0.0, 7.9 * k) for k, c in enumerate("ab") for i in range(alphas)] + [("e", "a", 9, "CA", "C", 900.0, 0.0, 0.0), ("e", "b", 9, "CA", "C", 900.0, 0.0, 8.0), (None, "c", 1, "CA", "C", 0.0, 0.0, 0.0)]
    rows += [("e", c, 0, "N", "N", 0.0, 0.0, 4.0) for c in "ab"]
    d = spark.createDataFrame(rows, "entry string, chain string, residue int, name string, element string, x double, y double, z double")
    got = [tuple(r) for r in spatial.chain_contacts(d, "entry", "chain", "residue", "name", "element").collect()]
    assert got == ([("e", "a", "b", 4, 1)] if alphas == 4 else [])
    assert math.dist((900, 0, 0), (900, 0, 8)) == 8.0  # not less than the radius
