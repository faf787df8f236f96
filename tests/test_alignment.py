"""Alignment with affine gaps against a plain dynamic program, votes and propagation by hand, schedules against all orders."""

import random
from itertools import permutations

import pytest

from chainloom.operators import merge, transfer

MATRIX = {"AA": 4.0, "BB": 6.0, "CC": 9.0, "AB": -2.0, "BC": -3.0, "AC": 1.0}


def plain_score(q, t, pair, gap, extend, local):
    low = float("-inf")
    h, e, f = ([[low] * (len(t) + 1) for _ in range(len(q) + 1)] for _ in range(3))
    for i in range(len(q) + 1):
        for j in range(len(t) + 1):
            if i:
                f[i][j] = max(h[i - 1][j] + gap, f[i - 1][j] + extend)
            if j:
                e[i][j] = max(h[i][j - 1] + gap, e[i][j - 1] + extend)
            start = 0.0 if local or not (i or j) else low
            h[i][j] = max(start, e[i][j], f[i][j], h[i - 1][j - 1] + pair(q[i - 1], t[j - 1]) if i and j else low)
    return max(max(r) for r in h) if local else h[-1][-1]


def score_of(q, t, at, pair, gap, extend, local):
    """What the aligned positions are worth, gaps between them (and at the ends, if global) included."""
    cost = lambda n: gap + extend * (n - 1) if n else 0.0
    points = [(-1, -1), *at, (len(q), len(t))]
    total = sum(pair(q[i], t[j]) for i, j in at)
    for k, ((i, j), (x, y)) in enumerate(zip(points, points[1:], strict=False)):
        if not local or 0 < k < len(points) - 2:
            total += cost(x - i - 1) + cost(y - j - 1)
    return total


@pytest.mark.parametrize("local", [True, False])
@pytest.mark.parametrize("matrix", [None, MATRIX])
@pytest.mark.parametrize(("gap", "extend"), [(-8.0, -1.0), (-2.0, None), (-3.0, -0.5)])
def test_alignment_is_optimal(local, matrix, gap, extend):
    draw = random.Random(7)
    pair = (lambda c, k: 2.0 if c == k else -1.0) if matrix is None else (lambda c, k: matrix.get(c + k, matrix.get(k + c, 0.0)))
    for _ in range(60):
        q, t = ("".join(draw.choices("ABC", k=draw.randint(1, 30))) for _ in range(2))
        score, at = transfer.alignment(q, t, gap=gap, extend=extend, matrix=matrix, local=local)
        step = gap if extend is None else extend
        assert score == pytest.approx(plain_score(q, t, pair, gap, step, local))
        assert score == pytest.approx(score_of(q, t, at, pair, gap, step, local))
        assert all(a < x and b < y for (a, b), (x, y) in zip(at, at[1:], strict=False))


def test_alignment_of_nothing_and_of_bad_gaps():
    assert transfer.alignment("", "A") == (0.0, []) and transfer.alignment("A", "B", local=True) == (0.0, [])
    with pytest.raises(ValueError):
        transfer.alignment("A", "A", gap=-1.0, extend=-2.0)


def test_align_scores(spark):
    pairs = spark.createDataFrame([(1, 2, "ABCABC", "ABCABC"), (1, 3, None, "AB"), (1, 4, "", "AB")], "a int, b int, x string, y string")
    got = {tuple(r) for r in transfer.align_scores(pairs, "a", "b", "x", "y", local=True).collect()}
    assert got == {(1, 2, 12.0, 6, 6), (1, 3, 0.0, 0, 0), (1, 4, 0.0, 0, 0)}
    assert transfer.align_pairs(pairs, "a", "b", "x", "y").count() == 6
    assert transfer.align_pairs(pairs.limit(0), "a", "b", "x", "y").count() == 0


def test_template_hits_against_all_pairs(spark, sf_dir):
    from chainloom.plans import reference_queries

    names = dict(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name").collect())
    pair = lambda c, k: 2.0 if c == k else -1.0
    got = reference_queries.queries()["template_hits"](spark, sf_dir).collect()
    assert got
    grams = lambda s: {s[i : i + 4] for i in range(len(s) - 3)}
    for r in got:
        best = []
        for t, name in names.items():
            if t != r.q and len(grams(names[r.q]) & grams(name)) >= 6:
                score, at = transfer.alignment(names[r.q], name, gap=-8.0, extend=-1.0, local=True)
                assert score == plain_score(names[r.q], name, pair, -8.0, -1.0, True)
                same = sum(names[r.q][i] == name[j] for i, j in at)
                if len(at) >= 9:
                    best.append((-same / len(at), t, score))
        assert (min(best)[1], min(best)[2]) == (r.t, r.score)


def test_votes_take_template_weight_and_least_length(spark):
    hits = spark.createDataFrame([("q", "a", 100.0, 2.0, 20, 0), ("q", "b", 90.0, 1.0, 8, 0), ("q", "c", 80.0, 3.0, 9, 0), ("q", "d", None, 1.0, 9, 0), ("r", "a", 10.0, 1.0, 9, 0)], "q string, t string, s double, tw double, n int, _x0 int")
    got = {r.t: r.w for r in transfer.vote_weights(hits, "q", "s", pctl=0.5, template="tw", exponent=2.0, aligned="n").collect()}
    thr, den = 50.0, 99.0 - 50.0
    assert got == pytest.approx({"a": (100 - thr) / den * 4, "c": (80 - thr) / den * 9})
    assert "_x0" in transfer.vote_weights(hits, "q", "s").columns


def test_cluster_propagation(spark):
    base = spark.createDataFrame([("t", 0, 0), ("t", 1, 0), ("t", 2, 1), ("u", 0, 0)], "target string, pos int, label int")
    votes = spark.createDataFrame([("t", 0, "a", 1, 9.0, True), ("t", 0, "b", 1, 9.0, False), ("t", 1, "a", 1, 9.0, True), ("t", 1, "b", 1, 9.0, True), ("t", 0, "c", 1, 5.0, True), ("u", 0, "a", 1, None, True)], "target string, pos int, hit string, label int, score double, same boolean")
    run = lambda tau: {(r.target, r.pos): r.label for r in transfer.cluster_propagation(votes, base, "target", "pos", "hit", "label", "score", "same", 5.0, tau).collect()}
    assert run(0.6) == {("t", 0): 0, ("t", 1): 1, ("t", 2): 1, ("u", 0): 0}
    assert run(0.5)[("t", 0)] == 1


@pytest.mark.parametrize("seed", range(3))
def test_best_schedule_against_all_orders(spark, seed):
    draw = random.Random(seed)
    cells = {(a, b): draw.randint(0, 3) for a in range(4) for b in range(4) if draw.random() < 0.8}
    frame = spark.createDataFrame([(a, b, n) for (a, b), n in cells.items()] + [(7, 1, 5)], "fold_a int, fold_b int, n long")
    total = sum(cells.values()) + 5
    want = min((total - sum(cells.get((a, b), 0) for a, b in enumerate(p)), ",".join(map(str, p))) for p in permutations(range(4)))
    got = merge.best_schedule(frame, 4).collect()
    assert [(r.leak, r.perm, r.aligned) for r in got] == [(*want, total - want[0])]


def test_few_cells_give_what_arrays_give(monkeypatch):
    rng = random.Random(13)
    texts = [("".join(rng.choices("ACDEF", k=rng.randint(0, 9))), "".join(rng.choices("ACDEF", k=rng.randint(0, 9)))) for _ in range(300)]
    for options in ({}, {"local": True}, {"gap": -3.3, "extend": -0.7, "matrix": {"AC": 1.1, "AA": 2.3, "EF": -0.4}, "other": -0.1, "local": True}):
        small = [transfer.alignment(a, b, **options) for a, b in texts]
        monkeypatch.setattr(transfer, "FEW_CELLS", 0)
        assert small == [transfer.alignment(a, b, **options) for a, b in texts]
        monkeypatch.undo()
