"""The ways that hot keys, hubs and hot values take give what the plain ways give; readers that have no query."""

import hashlib
import json

from pyspark.sql import functions as F

from chainloom.functions import labels as L
from chainloom.operators import audit, components, evaluate, folds, lookup, prefix, ranking, resample, sweep, transfer
from chainloom.plans import bindings, reference_queries
from chainloom.plans.materialize import dealt, fresh, spread_join
from chainloom.sources import readers
from chainloom.streaming import worklist


def test_hot_keys_are_joined_alike(spark):
    rows = spark.createDataFrame([(i, 7 if i % 3 else i % 5, None if i == 4 else "x") for i in range(90)] + [(99, None, "n")], "id int, k int, `_salt0` string")
    t = spark.createDataFrame([(7, "seven"), (1, "one")], "k int, name string")
    want = sorted(rows.join(t, "k", "left").select("id", "k", "name").collect(), key=str)
    got = spread_join(rows, t, "k", "left", hot_rows=5)
    assert sorted(got.select("id", "k", "name").collect(), key=str) == want and "_salt0" in got.columns


def test_hubs_give_the_same_components(spark):
    edges = [(0, i) for i in range(1, 40)] + [(i, i + 100) for i in range(1, 20)] + [(500, 501), (None, 3), (9, 9)]
    e = spark.createDataFrame(edges, "u long, v long")
    want = sorted(map(tuple, components.component_roots(e).collect()))
    assert sorted(map(tuple, components.component_roots(e, hub_rows=3).collect())) == want and ("501" in str(want))
    m = spark.createDataFrame([(i, "a") for i in range(30)] + [(29, "b"), (40, "b"), (50, None)], "n long, k string")
    got = dict(map(tuple, components.shared_key_components(m, "n", "k", hub_rows=4).collect()))
    assert got == {**{i: 0 for i in range(30)}, 40: 0, 50: 50}


def test_places_of_hot_values(spark):
    rows = [(i, i % 2, 5.0 if i % 4 else float(i % 7), i + 1) for i in range(120)]
    d = spark.createDataFrame(rows, "id long, g int, v double, c long")
    for hot in (1000, 6):
        got = {r["id"]: (r["place"], r["before"]) for r in prefix.row_places(d, ["g"], "v", "id", cost="c", hot_rows=hot).collect()}
        for g in (0, 1):
            order = sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0]))
            total = 0
            for n, r in enumerate(order):
                assert got[r[0]] == (n, total)
                total += r[3]
    names = d.select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("id"), "v")
    got = {r["id"]: r["place"] for r in prefix.row_places(names, [], "v", "id", hot_rows=6).collect()}
    assert [k for k, _ in sorted(got.items(), key=lambda x: x[1])] == [f"k{r[0]}" for r in sorted(rows, key=lambda r: (-r[2], f"k{r[0]}"))]


def test_caps_and_folds_of_hot_groups(spark):
    d = spark.createDataFrame([(i, 0 if i % 9 else 1, i % 4 if i % 3 else 0) for i in range(150)], "id long, comp int, cluster int")
    want = sorted(r["id"] for r in folds.round_robin_cap(d, "comp", "cluster", "id", 13).collect())
    assert sorted(r["id"] for r in folds.round_robin_cap(d, "comp", "cluster", "id", 13, hot_rows=10).collect()) == want
    assert folds.round_robin_cap(d, "comp", "cluster", "id", 13).groupBy("comp").count().where("count > 13").count() == 0 and len(want) == 26
    m = spark.createDataFrame([(i, 3.0, i % 2) for i in range(60)], "c long, total double, k int")
    plain = sorted(map(tuple, folds.serpentine_folds(m, "c", "total", "k").collect()))
    assert sorted(map(tuple, folds.serpentine_folds(m, "c", "total", "k", hot_rows=7).collect())) == plain
    t = spark.createDataFrame([(i, 10) for i in range(70)], "id long, n int")
    assert sorted(map(tuple, worklist.token_batches(t, "id", "n", 100, hot_rows=9).collect())) == sorted(map(tuple, worklist.token_batches(t, "id", "n", 100).collect()))


def test_empty_tables_nulls_and_clashing_names(spark):
    d = spark.createDataFrame([(1, "a", 2, "r", 0.5), (1, "b", 1, "s", None), (None, "c", 3, None, 0.1)], "k int, v string, o int, `_r` string, `_x0` double")
    first = audit.keep_first(d, ["k"], [F.col("o")])
    assert first.columns == d.columns and sorted((r["k"] or 0, r["v"], r["_r"]) for r in first.collect()) == [(0, "c", None), (1, "b", "s")]
    none = d.where("false")
    assert audit.keep_first(none, ["k"], [F.col("o")]).count() == audit.ecdf(none, ["k"], "o").count() == audit.top_per_group(none, ["k"], [F.asc("o")], 2).count() == 0
    assert fresh(d) == ["_x1"] and lookup.two_hop(none, "k", d.select("k", F.col("v").alias("m")), "m", d.select(F.col("v").alias("m"), F.col("o").alias("l")), "l").count() == 0
    got = audit.nonfinite(d, "a", "v", "_x0", "o").collect()
    assert sorted((r["v"], r["o"], round(r["_x0"], 3)) for r in got) == [("a", 2, 0.5), ("b", 0, 0.3), ("c", 3, 0.1)]


def test_readers_without_a_query(spark, tmp_path):
    (tmp_path / "m.csv").write_text("Sequence_ID,EC\na,1\nb,2\na,3\n")
    assert {tuple(r) for r in readers.read_metadata_csv(spark, str(tmp_path / "m.csv"), "Sequence_ID string, EC string").collect()} == {("a", "1"), ("b", "2")}
    for n, rows in ((1, [{"k": "a", "v": 1}]), (2, [{"k": "a", "v": 2}, {"k": "b", "v": 3}])):
        (tmp_path / f"shard{n}.json").write_text("\n".join(map(json.dumps, rows)))
    shards = readers.union_shards(spark, [str(tmp_path / f"shard{n}.json") for n in (1, 2, 3)], "k string, v int", "k")
    assert {(r["k"], r["v"], r["shard"]) for r in shards.collect()} == {("a", 2, 2), ("b", 3, 2)}
    run = tmp_path / "runs" / "cnn__version=x__fold=2"
    run.mkdir(parents=True)
    (run / "result.json").write_text("{}")
    (r,) = readers.discover_runs(spark, str(tmp_path / "runs"), "result.json").collect()
    assert (r["run"], r["fields"]) == ("cnn__version=x__fold=2", {"model_name": "cnn", "version": "x", "cv_fold": "2"})
    s = spark.createDataFrame([("s1", ["p", "q"], ["MK", "A"], [[0, 1], [0]], [{0: 1}, {}], [2.0, None])], "split string, ids array<string>, aa array<string>, labels array<array<int>>, maps array<map<int,int>>, weights array<double>")
    assert {(r["id"], r["aa"], tuple(r["labels"]), r["weight"]) for r in readers.split_db_rows(s).collect()} == {("p", "MK", (0, 1), 2.0), ("q", "A", (0,), 1.0)}
    d = spark.createDataFrame([([1, 0], [0.5, 0.1]), ([1], [0.5, 0.2]), (None, [0.1])], "label array<int>, score array<double>")
    assert sorted(r["lengths"] for r in readers.length_report(d, ["label", "score"]).collect()) == [[-1, 1], [1, 2]]
    assert readers.chain_scores(d).count() == 3 and readers.chain_scores(d, "drop").count() == 2
    one = spark.range(1)
    assert [one.select(L.count_sites(F.lit(c))).first()[0] for c in ("[('0','A','66'),('0','A','5')]", "5, 7, 9", "none here; x", "", None)] == [2, 1, 1, 0, 0]


def test_queries_meet_all_targets_in_blocks(spark):
    q = spark.createDataFrame([(i,) for i in [*range(25), 3, None]], "q int")
    t = spark.createDataFrame([*[(i, i % 4) for i in [*range(40), 7]], (None, 1)], "t int, label int")
    got = transfer.against_all(q, t, "q", "t", query_rows=4, target_rows=9)
    count = lambda d: sorted(map(str, d.collect()))
    assert count(got) == count(q.crossJoin(t))
    assert got.columns == ["q", "t", "label"]
    assert transfer.against_all(q, t.limit(0), "q", "t").count() == 0
    assert transfer.against_all(q.limit(0), t, "q", "t").count() == 0


def test_tasks_hold_as_many_rows_whatever_the_table(spark):
    d = spark.range(10_000).withColumn("k", F.col("id") % 500)
    assert dealt(d, "k", 1_000, 100).rdd.getNumPartitions() == 10 and dealt(d.unionByName(d), "k", 1_000, 100).rdd.getNumPartitions() == 20
    assert dealt(d, "k", 1_000, 100).select("k", F.spark_partition_id().alias("p")).distinct().count() == 500
    assert dealt(d, "k").rdd.getNumPartitions() == d.rdd.getNumPartitions()


def test_chains_of_a_large_table_are_dealt_out(spark, sf_dir, monkeypatch):
    """Ranks and sweeps stay in the tasks that their rows are dealt into, with the same results."""
    names = ["operating_points", "pareto_frontier", "threshold_sweep", "max_precision_at_k", "top1_success", "topk_confusion"]
    results = lambda: [sorted(map(str, reference_queries.queries()[n](spark, sf_dir).collect())) for n in names]
    plain = results()
    monkeypatch.setattr(bindings, "dealt", lambda rows, key: dealt(rows, key, 400, 100))
    r = ranking.ranked(bindings.residues(spark, sf_dir), ["chain"]).groupBy(F.spark_partition_id()).count().select("count").collect()
    assert len(r) >= 14 and max(x[0] for x in r) < 600
    assert results() == plain


def test_sweeps_read_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(r):
        seen.add(1)
        return r

    rows = spark.sparkContext.parallelize([(c, 1.0 + c % 3, int(i % 3 == 0), i / 7) for c in range(6) for i in range(5)], 2).map(counted)
    s = sweep.threshold_sweep(spark.createDataFrame(rows, "chain int, weight double, label int, score double"), [0.1, 0.5])
    # of a chain, the places 0 and 3 are positives; 0 passes no threshold and 3 passes 0.1 only
    assert sorted(map(tuple, s.select("tau", "tp", "fp", "fn").collect())) == [(0.1, 12.0, 36.0, 12.0), (0.5, 0.0, 12.0, 24.0)]
    assert {r["point"]: r["tau"] for r in sweep.operating_points(s).collect()} == {"conservative": 0.1, "balanced": 0.1, "discovery": 0.1}
    assert seen.value == 30


def test_folds_and_all_of_them_come_from_one_reading(spark):
    rows = [(c, p, f, "ab"[c % 2], (c + p) % 2, p / 7, 1.0) for c in range(6) for p in range(4) for f in (c % 3,)]
    d = spark.createDataFrame(rows, "chain int, pos int, fold int, split string, label int, score double, weight double").repartition(3, "chain")
    mine = evaluate.fold_table(d, "fold", "chain", "split", 1)
    got = {r["fold"]: r["n"] for r in mine.collect()}
    assert got == {"0": 2, "1": 2, "2": 2, "all": 6}
    assert "Union" not in mine._jdf.queryExecution().optimizedPlan().toString()



def test_places_in_sorted_values(spark):
    for cuts in ([], [1.0], [1.0, 1.0, 2.0], [float(x) for x in range(407)]):
        xs = [-1.0, 0.0, 0.5, 1.0, 1.5, 2.0, 405.5, 406.0, 1e9, float("inf"), None]
        d = spark.createDataFrame([(x, cuts) for x in xs], "x double, cuts array<double>")
        got = [r[0] for r in d.select(prefix.at_most(F.col("cuts"), F.col("x"), len(cuts))).collect()]
        assert got == [0 if x is None else sum(c <= x for c in cuts) for x in xs]


def test_draws_of_a_unit_are_worked_out_once(spark, monkeypatch):
    d = spark.createDataFrame([("ab"[u % 2], u % 30, u % 4 / 2, u % 3 == 0, float(u % 5) if u % 7 else None) for u in range(200)], "g string, u int, v double, y boolean, w double")
    hashed = resample.bootstrap_sums(d, ["g"], ["u"], ["v", "y"], F.col("w"), 7)
    want = {tuple(r)[:4]: r["weight"] for r in hashed.collect()}
    draws = {u: [int(hashlib.md5(f"3:{u}:{b // 4}".encode()).hexdigest()[8 * (b % 4) : 8 * (b % 4) + 8], 16) for b in range(7)] for u in range(30)}
    plain = {}
    for r in d.where("w is not null").collect():
        for b in range(7):
            key = (r["g"], b, r["v"], r["y"])
            plain[key] = plain.get(key, 0.0) + r["w"] * sum(e <= draws[r["u"]][b] for e in resample.poisson_edges())
    assert want == {k: v for k, v in plain.items() if v}
    monkeypatch.setattr(resample, "SUM_CELLS", 21)
    assert {tuple(r)[:4]: r["weight"] for r in resample.bootstrap_sums(d, ["g"], ["u"], ["v", "y"], F.col("w"), 7).collect()} == want
    text = hashed._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in text.splitlines() if "Generate explode" in x and "sequence" in x]  # no row for each hash of each sum


def test_ragged_stores_come_in_pieces(spark):
    n = {("a", k): k * 7 % 4 for k in range(1, 24)} | {("b", 5): 0, ("b", 9): 0, (None, 1): 2}
    rows = spark.createDataFrame([(s, k, f"{s}{k}" if k != 9 else "b5", v) for (s, k), v in n.items()], "store string, k long, name string, n int")
    for piece, pieces in ((4, {"a": 6, "b": 1, None: 1}), (4096, {"a": 1, "b": 1, None: 1})):
        p = readers.ragged_pieces(rows, "store", "k", "name", "n", piece)
        assert {r["store"]: r["count"] for r in p.groupBy("store").count().collect()} == pieces and p.where((F.size("ids") > piece) | (F.size("offsets") != F.size("ids") + 1)).count() == 0
        values = F.when(F.col("size") > 0, F.sequence(F.col("begin"), F.col("begin") + F.col("size") - 1)).otherwise(F.array().cast("array<bigint>"))
        got = sorted((r["id"], r["at"], r["values"]) for r in readers.ragged_rows(p.withColumn("values", values), begin="begin").collect())
        want, at = [], {}
        for (s, k), v in sorted(n.items(), key=lambda x: (str(x[0][0]), x[0][1])):
            first = at.get(s, 0)
            want.append((f"{s}{k}" if k != 9 else "b5", first, list(range(first, first + v))))
            at[s] = first + v
        assert got == sorted(want)
