"""Names of helpers clash with no column, output names that are taken are errors, and functions that no query has give what a plain reading gives."""

import pytest
from pyspark.sql import functions as F

from chainloom.functions import labels as L
from chainloom.operators import audit, folds, lookup, merge, prefix, ranking, resample, screen, spatial, transfer
from chainloom.sources import readers, writers
from chainloom.streaming import worklist

CLASHING = "k string, _m int, _n int, place int, _w double, _x0 int, _g string, label int, score double, `a.b` string"


@pytest.fixture
def d(spark):
    return spark.createDataFrame([("a", 1, 1, 1, 1.0, 1, "x", 1, 0.5, "p"), ("a", 1, 1, 1, 1.0, 1, "x", 1, 0.5, "p"), (None, 2, 2, 2, 2.0, 2, None, 0, 0.25, None), ("b", 2, 1, 3, 1.0, 1, "y", 0, None, "q")], CLASHING)


OPERATORS = {
    "ensemble_mean": (lambda t: merge.ensemble_mean(t, ["_m", "k"], "_n", "score", "label", 1), 3),
    "merge_folds": (lambda t: merge.merge_folds(t, ["_m", "k"], "_n", "score", weight="_w"), 3),
    "distribution": (lambda t: audit.distribution(t, ["_n"], "_w"), 2),
    "overlap_report": (lambda t: audit.overlap_report(t, "_n", "_m"), 1),
    "hierarchical_weights": (lambda t: audit.hierarchical_weights(t, "k", "_m", "_n", "_x0"), 4),
    "overview": (lambda t: audit.overview(t, "_g", "_n", "label", "_w"), 4),
    "frequency_rollup": (lambda t: audit.frequency_rollup(t, "_g", "k"), 6),
    "ownership_count": (lambda t: lookup.ownership_count(t.withColumn("s", F.array("_m")), "_n", "s"), 2),
    "exclusive_structures": (lambda t: lookup.exclusive_structures(t.withColumn("s", F.array("_m")), "_n", "s"), 1),
    "ratio_split": (lambda t: folds.ratio_split(t, "_n", "_w", {"train": 0.5, "test": 0.5}), 2),
    "bootstrap_sums": (lambda t: resample.bootstrap_sums(t, ["_g"], ["_n"], ["label"], F.col("_w"), 3), None),
    "average_propagation": (lambda t: transfer.average_propagation(t, t, ["_m", "_n"], "label", 0.5), None),
    "pending": (lambda t: worklist.pending(t, t.where("k = 'a'"), "k"), 2),
    "top_per_group": (lambda t: audit.top_per_group(t, ["k"], [F.asc("_m")], 1), 3),
    "ranked": (lambda t: ranking.ranked(t, ["k"], pos="_m"), 4),
    "keep_first": (lambda t: audit.keep_first(t, ["k"], [F.col("_m")]), 3),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_helpers_clash_with_no_column(d, name):
    run, rows = OPERATORS[name]
    assert rows is None or run(d).count() == rows
    assert run(d.where("false")).count() in (0, 1)  # one: a total of nothing


def test_taken_output_names_are_errors(d):
    for run in (lambda: prefix.row_places(d, [], "_w", "_m"), lambda: audit.top_per_group(d.withColumn("rank", F.lit(1)), ["k"], [F.asc("_m")], 1), lambda: ranking.ranked(d.withColumn("Rank", F.lit(1)), ["k"]), lambda: screen.novelty(d.withColumn("novel", F.lit(1)), "k", "k")):
        with pytest.raises(ValueError, match="rename"):
            run()


def test_repeated_keys_of_a_lookup(spark):
    rows, twice, once = (spark.createDataFrame(x, "k int, v string") for x in ([(1, "r")], [(1, "a"), (1, "b")], [(1, "a"), (None, "x"), (None, "y")]))
    two = twice.select("k", F.col("v").alias("m"))
    with pytest.raises(ValueError, match="repeat"):
        lookup.two_hop(rows, "k", two, "m", two.select("m", F.lit(1).alias("l")).distinct(), "l", check=True)
    with pytest.raises(ValueError, match="repeat"):
        lookup.with_alias(rows.select("k"), "k", twice, "v", once.select("k", F.col("k").alias("o")), "o", check=True)
    with pytest.raises(ValueError, match="repeat"):
        lookup.cached_or(rows.withColumn("n", F.lit(1)), "k", "n", once.withColumn("n", F.lit(1)), twice, "v", check=True)
    assert lookup.with_alias(rows.select("k"), "k", once, "v", once.select("k", F.col("k").alias("o")), "o", check=True).count() == 1


def test_weights_of_merged_folds_and_counters_of_lengths(spark):
    r = spark.createDataFrame([("a", 1, 0.2, 1.0), ("a", 2, 0.4, 3.0), ("b", 1, None, None)], "k string, f int, s double, w double")
    assert {x["k"]: (x["s"] and round(x["s"], 6), x["w"]) for x in merge.merge_folds(r, ["k"], "f", "s", weight="w").collect()} == {"a": (0.3, 2.0), "b": (None, None)}
    y = spark.createDataFrame([(c, p) for c, n in (("a", 3), ("b", 2), ("c", 2), ("d", 1)) for p in range(n)], "c string, p int")
    s = spark.createDataFrame([(c, p) for c, n in (("a", 3), ("b", 4), ("c", 1), ("e", 1)) for p in range(n)] + [(None, 1)], "c string, p int")
    assert tuple(merge.length_mismatches(y, s, "c", "p").first()) == (5, 1, 1, 1, 1, 1)
    assert tuple(merge.length_mismatches(y.where("false"), s.where("false"), "c", "p").first()) == (0,) * 6


def test_buckets_follow_the_rows(spark):
    assert prefix.buckets_for(10) == 64 and prefix.buckets_for(200_000_000) == 200
    c = spark.range(50).select(F.col("id").alias("o"), F.lit(1).alias("s"))
    got = {r["o"]: r["up_s"] for r in prefix.prefix_sums(c, [], "o", ["s"], buckets=200).collect()}
    assert got == {i: i + 1 for i in range(50)}


def test_expressions_without_a_query(spark):
    one = lambda e: spark.range(1).select(e).first()[0]
    lit, arr = F.lit, lambda *x: F.array(*map(F.lit, x))
    assert one(L.chain_id(lit("1abc"), lit("A"))) == "1abc_A" and one(L.chain_id(lit("1abc_A"), lit("A"))) == "1abc_A"
    assert one(L.isoform_base(lit("P1-2"))) == "P1" and one(L.isoform_base(lit("P1"))) == "P1"
    assert one(L.range_positions(F.array(F.struct(lit(3).alias("start"), lit(5).alias("end")), F.struct(lit(5).alias("start"), lit(6).alias("end")), F.struct(lit(9).alias("start"), lit(8).alias("end"))))) == [3, 4, 5, 6]
    assert one(L.floor_scores(F.array(lit(0.05), lit(0.5), lit(float("nan")), lit(None).cast("double")), 0.1)) == [0.0, 0.5, 0.0, 0.0]
    assert one(L.channel(F.array(arr(0.1, 0.9), arr(0.3, 0.7)))) == [0.9, 0.7] and one(L.channel(F.array(arr(0.1, 0.9)), 1)) == [0.1]
    assert one(L.log_weight(lit(100.0), 10)) == pytest.approx(2.0) and one(L.log_weight(lit(0.0), 10)) == pytest.approx(-12.0)
    assert one(L.sites_in_text(lit("ACT_SITE 5; ACT_SITE  71; SITE 3"))) == [5, 71] and one(L.sites_in_text(lit(None).cast("string"))) == []
    assert one(L.first_code(lit(" 1.1.1.1 ; 2"))) == "1.1.1.1" and one(L.first_code(lit("nan"))) == "not found"
    assert one(readers.all_class_codes(arr(" 2.1 ", "1.1", ""), lit(None).cast("array<string>"), arr("1.1"))) == ["1.1", "2.1"]
    f = spark.createDataFrame([([("Active site", ((5, "EXACT"), (5, None)), "x"), ("Active site", ((6, "EXACT"), (7, "EXACT")), "y"), ("Active site", ((2, "UNSURE"), (2, "EXACT")), "z"), ("Site", ((1, None), (1, None)), "s")], "MKVLA", 3.0)], "f array<struct<type:string,location:struct<start:struct<value:int,modifier:string>,end:struct<value:int,modifier:string>>,description:string>>, s string, score double")
    assert [tuple(x) for x in f.select(readers.exact_sites(F.col("f"), F.col("s"))).first()[0]] == [(5, "A", "x")]
    assert f.select(readers.record_filter(F.col("score"), F.col("f"))).first()[0] is True and f.select(readers.record_filter(lit(2.0), F.col("f"))).first()[0] is False
    assert one(readers.keep_human_reviewed(lit(9606), lit("Reviewed (x)"))) and one(readers.keep_human_reviewed(lit(None).cast("int"), lit(None).cast("string"))) and not one(readers.keep_human_reviewed(lit(1), lit("reviewed")))


def test_tables_without_a_query(spark):
    r = spark.createDataFrame([("P1", ["P1-1", "P1-2", "P1-2"], "g"), ("P2", [], "h"), ("P3", None, "i")], "a string, v array<string>, c string")
    assert sorted(map(tuple, screen.explode_variants(r, "a", "v", ["c"]).collect())) == [("P1-1", "P1", "g"), ("P1-2", "P1", "g")]
    f = spark.createDataFrame([("P1-2", " ", "x"), ("P1", "name", None), ("Q-1", None, None)], "k string, n string, o string")
    assert sorted(map(tuple, merge.with_fallback(f, "k", L.isoform_base(F.col("k")), ["n"]).collect()), key=str) == sorted([("P1-2", "name", "x"), ("P1", "name", None), ("Q-1", None, None)], key=str)
    assert merge.parameter_grid(spark, {"a": [1, 2], "b": ["x", "y", "z"]}).count() == 6
    m = worklist.manifest_rows(spark.createDataFrame([("i", "text"), ("j", None)], "k string, c string"), "k", "c").collect()
    assert [tuple(x) for x in m] == [("i", "done", "372ea08cab33e71c02c651dbc83a474d32c676ea"), ("j", "done", None)]
    a = spark.createDataFrame([("p", "A", 0, 0.0, 0.0, 0.0), ("q", "C", 0, 5.0, 0.0, 0.0), ("r", None, 1, 0.0, 0.0, 0.0)], "k string, l string, y int, x double, y1 double, z double").withColumnRenamed("y", "label").withColumnRenamed("y1", "y")
    b = a.withColumn("label", F.lit(1)).withColumn("x", F.col("x") + 1.0)
    assert {x["k"]: x["label"] for x in spatial.nearest_same_letter(a, b, "k", "l", "label").collect()} == {"p": 1, "q": 1, "r": 1}
    assert {x["k"]: x["label"] for x in spatial.nearest_same_letter(a, b.where("k = 'q'"), "k", "l", "label").collect()} == {"p": 0, "q": 1, "r": 1}


def test_files_without_a_query(spark, tmp_path):
    d = spark.createDataFrame([("a", "MKV", 1.5, "s1"), ("b", "AA", 2.5, "s2")], "id string, seq string, score double, split string")
    writers.write_fasta(d, str(tmp_path / "f"), "id", "seq")
    assert sorted((r["accession"], r["sequence"]) for r in readers.read_fasta(spark, str(tmp_path / "f")).collect()) == [("a", "MKV"), ("b", "AA")]
    writers.write_scores(d, str(tmp_path / "s"), ["split"])
    assert {r["split"] for r in spark.read.parquet(str(tmp_path / "s")).collect()} == {"s1", "s2"}
    for sep, name in (("\t", "t"), (",", "c")):
        (tmp_path / name).write_text(sep.join(["x", "y", "z"]) + "\n" + sep.join(["1", "2", "3"]) + "\n")
        assert tuple(readers.sniff_table(spark, str(tmp_path / name)).first()) == ("1", "2", "3")
    logs = tmp_path / "logs"
    logs.mkdir()
    for name, text in (("r_1.out", "[SUMMARY] test AUCPR=0.5\n"), ("r_1.err", "x"), ("r_2.err", "OOM")):
        (logs / name).write_text(text)
    assert {r["stem"]: (r["out"], r["err"]) for r in readers.read_run_logs(spark, str(logs)).collect()} == {"r_1": ("[SUMMARY] test AUCPR=0.5\n", "x"), "r_2": (None, "OOM")}
    one = spark.createDataFrame([("a", "f1"), ("a", "f2"), ("b", "f1"), ("a", "f1")], "id string, file string")
    assert [tuple(r) for r in readers.duplicate_ids(one).collect()] == [("a", 2)]
