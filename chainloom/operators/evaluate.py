"""Evaluation tables: per group, per chain, per fold, and the cases worth a look."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import audit, curves, ranking


def group_evaluation(rows: DataFrame, group: str, chain: str, ks: list[int], label: str = "label", score: str = "score", weight: str = "weight", intervals: DataFrame | None = None) -> DataFrame:
    """(group, n, n_positive, prevalence, weight, n_eff, median_npos, mp_at_<k>, aucpr[, low, high]): one row per group of chains.

    n and n_positive count chains and positions with label 1; prevalence is their share of positions; n_eff is (sum w)^2 / sum w^2; mp_at_<k> is the weighted mean of
    max precision. intervals: (group, low, high). Rows of a chain have one group and weight; null groups are left out. Groups without positives have AUCPR 0.
    """
    rows = rows.where(F.col(group).isNotNull())
    per = rows.groupBy(group, chain, weight).agg(F.count("*").alias("length"), F.sum(label).alias("npos"))
    w = F.col(weight).cast("double")
    t = per.groupBy(group).agg(
        F.count("*").alias("n"), F.sum("npos").alias("n_positive"), F.try_divide(F.sum("npos"), F.sum("length")).alias("prevalence"), F.sum(w).alias("weight"),
        F.try_divide(F.pow(F.sum(w), F.lit(2.0)), F.sum(w * w)).alias("n_eff"), F.percentile("npos", F.lit(0.5)).alias("median_npos"),
    )
    top = ranking.topk_metrics(ranking.at_k(rows, [chain], ks, [group, weight], label=label, score=score), [group], w)
    wide = top.groupBy(group).agg(*[F.max(F.when(F.col("k") == k, F.col("max_precision"))).alias(f"mp_at_{k}") for k in ks])
    auc = curves.pr_summary(rows, [group], label=label, score=score, weight=w).select(group, "aucpr")
    out = t.join(wide, group, "left").join(auc, group, "left").withColumn("aucpr", F.coalesce("aucpr", F.lit(0.0)))
    return out if intervals is None else out.join(intervals.select(group, "low", "high"), group, "left")


def chain_table(rows: DataFrame, chain: str, ks: list[int], carry: list[str], label: str = "label", score: str = "score", names: DataFrame | None = None) -> DataFrame:
    """(chain, carry, length, npos, ap, mp_at_<k>[, names]): one row per chain; average precision is unweighted, and 0 without positives.

    carry has one value a chain. names: further columns by chain, null where it has none.
    """
    per = ranking.at_k(rows, [chain], ks, carry, label=label, score=score)
    most = F.nullif(F.least("npos", "kk"), F.lit(0))
    wide = per.groupBy(chain, *carry, "length", "npos").agg(*[F.max(F.when(F.col("k") == k, F.coalesce(F.col("tp") / most, F.lit(0.0)))).alias(f"mp_at_{k}") for k in ks])
    ap = curves.pr_summary(rows, [chain], label=label, score=score, buckets=2).select(chain, "ap")
    out = wide.join(ap, chain, "left").select(chain, *carry, "length", "npos", F.coalesce("ap", F.lit(0.0)).alias("ap"), *[f"mp_at_{k}" for k in ks])
    return out if names is None else out.join(names, chain, "left")


def fold_table(rows: DataFrame, fold: str, chain: str, split: str, k: int, label: str = "label", score: str = "score", weight: str = "weight") -> DataFrame:
    """(fold, n, split, aucpr, loss, mp): each fold, and all of them merged as "all"; split is the one with most chains, loss is 1 - AUCPR, three digits.

    Of equally frequent splits the first in order counts.
    """
    w = F.col(weight).cast("double")
    both = rows.withColumn(fold, F.explode(F.array(F.col(fold).cast("string"), F.lit("all"))))  # rows stay where they are: no second shuffle by chain
    chains = both.groupBy(fold, split, chain).agg(F.lit(1).alias("one")).groupBy(fold, split).agg(F.count("*").alias("n"))
    size = chains.groupBy(fold).agg(F.sum("n").alias("n"), F.min_by(split, F.struct(-F.col("n"), F.col(split))).alias("split"))
    auc = curves.pr_summary(both, [fold], label=label, score=score, weight=w).select(fold, "aucpr")
    mp = ranking.topk_metrics(ranking.at_k(both, [fold, chain], [k], [weight], label=label, score=score), [fold], w).select(fold, F.col("max_precision").alias("mp"))
    out = size.join(auc, fold, "left").join(mp, fold, "left")
    return out.select(fold, "n", "split", F.round("aucpr", 3).alias("aucpr"), F.round(1 - F.col("aucpr"), 3).alias("loss"), F.round("mp", 3).alias("mp"))


def metric_grid(runs: DataFrame, a: str, b: str, values: list, value: str) -> DataFrame:
    """(a, mean_<v>, std_<v> for each value v of b): mean and population deviation of the runs of each cell; cells without a run are null."""
    per = runs.groupBy(a, b).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    of = lambda x, v: F.max(F.when(F.col(b) == v, F.col(x))).alias(f"{x}_{v}")
    return per.groupBy(a).agg(*[of(x, v) for v in values for x in ("mean", "std")])


def pivot_mean(rows: DataFrame, key: str, columns: str, values: list, value: str) -> DataFrame:
    """(key, one column per value): means; null where a cell has no row."""
    return rows.groupBy(key).pivot(columns, values).agg(F.avg(value))


def top1_groups(rows: DataFrame, chain: str, group: list[str], weight: str, label: str = "label", score: str = "score") -> DataFrame:
    """(group, success, n, weight): chains by whether their first position is a positive one, with the weight of each side."""
    per = ranking.at_k(rows, [chain], [1], [*group, weight], label=label, score=score)
    return per.groupBy(*group, (F.col("tp") > 0).cast("int").alias("success")).agg(F.count("*").alias("n"), F.sum(F.col(weight).cast("double")).alias("weight"))


def chain_confusion(rows: DataFrame, chain: list[str], tau: float, label: str = "label", score: str = "score") -> DataFrame:
    """(chain, tp, fp, fn, tn, max_fp): counts at a threshold, and the greatest score of a false positive."""
    hit, y = curves.passes(F.col(score), tau), F.col(label) == 1
    n = lambda c: F.sum(c.cast("int")).cast("double")
    return rows.groupBy(*chain).agg(n(hit & y).alias("tp"), n(hit & ~y).alias("fp"), n(~hit & y).alias("fn"), n(~hit & ~y).alias("tn"), F.max(F.when(hit & ~y, F.col(score))).alias("max_fp"))


def cases(confusion: DataFrame, chain: str, kind: str, n: int, a: float = 1.0, b: float = 2.0, ap: str | None = None) -> DataFrame:
    """(chain, fp, fn, error, place): the n worst or best chains; error is a * fp + b * fn, ties go to the chain.

    kind: "worst" by error, then fn; "false_positives" by fp, then the greatest score of one, then error; "missed" by fn, then error; "best" by the least error, then ap.
    """
    rows = confusion.withColumn("error", (a * F.col("fp") + b * F.col("fn")).cast("double"))
    order = {
        "worst": [F.desc("error"), F.desc("fn")], "false_positives": [F.desc("fp"), F.desc_nulls_last("max_fp"), F.desc("error")] if kind == "false_positives" else [],
        "missed": [F.desc("fn"), F.desc("error")], "best": [F.asc("error"), *([F.desc_nulls_last(ap)] if ap else [])],
    }[kind]
    return audit.top_rows(rows.select(chain, "fp", "fn", "error", *(["max_fp"] if kind == "false_positives" else []), *([ap] if ap else [])), [*order, F.asc(chain)], n)


def confident_false_positives(rows: DataFrame, chain: list[str], k: int, n: int, carry: list[str], pos: str = "pos", label: str = "label", score: str = "score") -> DataFrame:
    """(chain, pos, carry, score, rank, place): of the first k positions of each chain that are no positives, the n with the greatest scores; ties by chain and position."""
    r = ranking.ranked(rows, chain, score=score, pos=pos).where((F.col("rank") <= k) & (F.col(label) == 0) & ~F.isnan(score))
    return audit.top_rows(r.select(*chain, pos, *carry, score, "rank"), [F.desc_nulls_last(score), *map(F.asc, chain), F.asc(pos)], n)
