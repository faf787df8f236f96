"""Merging folds and models, seed statistics, run bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import col, fresh


def merge_folds(rows: DataFrame, key: list[str], fold: str, score: str, how: str = "mean", weight: str | None = None) -> DataFrame:
    """(key, score[, weight], n_folds, folds): one score per key from all folds that have it: mean, median, or that of the first fold; and the mean weight.

    Null scores and weights count in no mean; null keys are a key; repeated rows count each; no rows give none.
    """
    value = {"mean": F.avg(score), "median": F.percentile(score, F.lit(0.5)), "first": F.min_by(score, fold)}[how]
    carried = [F.avg(weight).alias(weight)] if weight else []
    return rows.groupBy(*key).agg(value.alias(score), *carried, F.count_distinct(fold).alias("n_folds"), F.array_join(F.array_sort(F.collect_set(F.col(fold).cast("string"))), ",").alias("folds"))


def ensemble_mean(rows: DataFrame, key: list[str], model: str, score: str, label: str, n_models: int | Column) -> DataFrame:
    """(key, label, score): keys that every model has with one label, scores averaged. Null keys are a key; repeated rows count each in the mean; no rows give none."""
    m, most = fresh(rows, n=2)
    g = rows.groupBy(*key).agg(F.count_distinct(model).alias(m), F.min(label).alias(label), F.max(label).alias(most), F.avg(score).alias(score))
    return g.where((F.col(m) == n_models) & F.col(label).eqNullSafe(F.col(most))).drop(m, most)


def seed_summary(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, n, mean, std): sample deviation, 0 of one value."""
    return rows.groupBy(*group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"))


def snr(model: DataFrame, baseline: DataFrame, on: list[str]) -> DataFrame:
    """(on, mean, base, std, snr) of two seed summaries."""
    b = baseline.select(*on, F.col("mean").alias("base"))
    return model.join(b, on).select(*on, "mean", "base", "std", ((F.col("mean") - F.col("base")) / F.greatest("std", F.lit(1e-12))).alias("snr"))


def leaderboard(runs: DataFrame, config: list[str], seed: str, fold: str, value: str, n_folds: int) -> tuple[DataFrame, DataFrame]:
    """(per config and seed with status, per config over complete seeds): missing folds before doubled ones."""
    g = runs.groupBy(*config, seed).agg(F.count_distinct(fold).alias("n_folds"), F.count("*").alias("n_runs"), F.avg(value).alias("value"))
    status = F.when(F.col("n_folds") < n_folds, "missing_folds").when(F.col("n_runs") > F.col("n_folds"), "duplicate_runs").otherwise("ok")
    g = g.withColumn("status", status)
    ok = F.when(F.col("status") == "ok", F.col("value"))
    board = g.groupBy(*config).agg(F.count(ok).alias("n_ok"), F.avg(ok).alias("mean"), F.stddev_samp(ok).alias("std"))
    return g, board


def pair_models(rows: DataFrame, keys: list[str], model: str, a: str, b: str, value: str) -> DataFrame:
    """(keys, a, b, diff) where both models have a value."""
    wide = rows.groupBy(*keys).agg(F.avg(F.when(F.col(model) == a, F.col(value))).alias("a"), F.avg(F.when(F.col(model) == b, F.col(value))).alias("b"))
    return wide.where("a is not null and b is not null").withColumn("diff", F.col("a") - F.col("b"))


def rotating_schedule(items: DataFrame, split: str, n: int = 5) -> DataFrame:
    """items for each rotation r, with role: test is split r + 4, validation r + 3, the rest train (modulo n)."""
    r = items.sparkSession.range(n).select(F.col("id").cast("int").alias("rotation"))
    role = F.when(F.col(split) == F.pmod(F.col("rotation") + 4, F.lit(n)), "test").when(F.col(split) == F.pmod(F.col("rotation") + 3, F.lit(n)), "val").otherwise("train")
    return items.crossJoin(F.broadcast(r)).withColumn("role", role)


def fold_overlap(a: DataFrame, b: DataFrame, key: str, fold: str) -> DataFrame:
    """(fold_a, fold_b, n): shared keys of two foldings."""
    x, y = a.select(key, F.col(fold).alias("fold_a")).distinct(), b.select(key, F.col(fold).alias("fold_b")).distinct()
    return x.join(y, key).groupBy("fold_a", "fold_b").agg(F.count("*").alias("n"))


def best_schedule(overlap: DataFrame, n: int = 5) -> DataFrame:
    """(perm, leak, aligned): the order of b's folds that leaves the least overlap outside the diagonal; ties go to the first order.

    Folds of a are placed one after the other; of all orders of the same set of b's folds only the best goes on, so there are at most 2^n rows, not n!.
    """
    cells = overlap.select(F.col("fold_a").cast("int").alias("a"), F.col("fold_b").cast("int").alias("b"), F.col("n").cast("long").alias("n")).groupBy("a", "b").agg(F.sum("n").alias("n"))
    inside = F.col("a").between(0, n - 1) & F.col("b").between(0, n - 1)
    cell = F.when(inside, F.struct((F.col("a") * n + F.col("b")).alias("key"), F.col("n").alias("value")))
    start = cells.agg(F.map_from_entries(F.collect_list(cell)).alias("cells"), F.sum("n").alias("total"))
    s = start.select("cells", "total", F.lit(0).cast("long").alias("cost"), F.array().cast("array<int>").alias("perm"))
    for a in range(n):
        free = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda b: ~F.array_contains("perm", b))
        s = s.select("cells", "total", "cost", "perm", F.explode(free).alias("b"))
        s = s.select("cells", "total", (F.col("cost") - F.coalesce(F.col("cells")[F.lit(a * n) + F.col("b")], F.lit(0))).alias("cost"), F.concat("perm", F.array("b")).alias("perm"))
        s = s.groupBy(F.array_sort("perm").alias("folds")).agg(F.min(F.struct("cost", "perm")).alias("best"), F.first("cells").alias("cells"), F.first("total").alias("total")).select("cells", "total", "best.*")
    return s.select(F.array_join("perm", ",").alias("perm"), (F.col("total") + F.col("cost")).alias("leak"), (-F.col("cost")).alias("aligned"))


def label_diff(before: DataFrame, after: DataFrame, chain: str, pos: str, label: str) -> DataFrame:
    """(chain, before, after, new_positions): chains whose labels gained positions."""
    x, y = before.select(chain, pos, F.col(label).alias("b")), after.select(chain, pos, F.col(label).alias("a"))
    j = x.join(y, [chain, pos])
    new = F.array_join(F.array_sort(F.collect_list(F.when((F.col("a") == 1) & (F.col("b") == 0), F.col(pos)))), ",")
    return j.groupBy(chain).agg(F.sum("b").alias("before"), F.sum("a").alias("after"), new.alias("new_positions")).where("new_positions <> ''")


def enrich(rows: DataFrame, table: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """rows with blank columns filled from the table."""
    new = dict(zip(columns, fresh(rows, n=len(columns)), strict=True))
    j = rows.join(table.select(*on, *[F.col(c).alias(new[c]) for c in columns]), on, "left")
    return j.select(*[F.coalesce(F.nullif(F.trim(c), F.lit("")), F.col(new[c])).alias(c) if c in columns else col(c) for c in rows.columns])


def with_fallback(rows: DataFrame, key: str, base: Column, columns: list[str]) -> DataFrame:
    """Blank columns of a record filled from the record that `base` names."""
    b, *names = fresh(rows, n=len(columns) + 1)
    new = dict(zip(columns, names, strict=True))
    parent = rows.select(F.col(key).alias(b), *[F.col(c).alias(new[c]) for c in columns])
    j = rows.join(parent, base == F.col(b), "left")
    return j.select(*[F.coalesce(F.nullif(F.trim(c), F.lit("")), F.col(new[c])).alias(c) if c in columns else col(c) for c in rows.columns])


def parameter_grid(spark, axes: dict[str, list]) -> DataFrame:
    """All combinations of a few values for each axis, as given by the caller."""
    out = None
    for name, values in axes.items():
        axis = spark.createDataFrame([(v,) for v in values], [name])
        out = axis if out is None else out.crossJoin(axis)
    return out


def ordinal_join(labels: DataFrame, scores: DataFrame, chain: str, pos: str) -> DataFrame:
    """Every labelled position with the scores that its chain has at the same place; null where there is none."""
    return labels.join(scores, [chain, pos], "left")


def score_coverage(rows: DataFrame, chain: str, score: str) -> DataFrame:
    """(chain, n, covered, total): positions, those with a score, and the sum of scores, 0 without any."""
    return rows.groupBy(chain).agg(F.count("*").alias("n"), F.count(score).alias("covered"), F.coalesce(F.sum(score), F.lit(0.0)).alias("total"))


def length_mismatches(labels: DataFrame, scores: DataFrame, chain: str, pos: str) -> DataFrame:
    """(chains, equal, longer, shorter, unscored, unlabelled): one row: how many chains have as many scores as labels, more, fewer, none, and how many have scores alone.

    Null chains are left out; a place that repeats counts once; empty tables give zeros.
    """
    n = lambda d, name: d.where(F.col(chain).isNotNull()).groupBy(F.col(chain).alias("c")).agg(F.count_distinct(pos).alias(name))
    both = n(labels, "a").join(n(scores, "b"), "c", "full_outer")
    count = lambda test: F.count_if(F.coalesce(test, F.lit(False)))
    a, b = F.col("a"), F.col("b")
    return both.agg(F.count("*").alias("chains"), count(a == b).alias("equal"), count(b > a).alias("longer"), count(b < a).alias("shorter"), count(b.isNull()).alias("unscored"), count(a.isNull()).alias("unlabelled"))
