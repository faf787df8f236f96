"""Threshold sweeps, weighted quantiles, frontiers and operating points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialize import written
from .prefix import at_most, exact_quantiles, prefix_sums


def threshold_sweep(rows: DataFrame, taus: list[float], chain: str = "chain", label: str = "label", score: str = "score", weight: str = "weight", budget: int = 3, over: tuple[int, ...] = ()) -> DataFrame:
    """(tau, tp, fp, fn, precision, recall, avg_pred, p95_pred, over_budget, avg_fp, p95_fp, any_fp, the last six with _raw, and over_<b> for each b of over): one row per threshold.

    over_<b> is the weighted share of chains with more than b candidates, as over_budget is for `budget`.

    Rows fall into threshold buckets once. A chain's counts change only at its own buckets, so it adds its weight to a histogram
    (tau, count) at the ends of each run of thresholds with the same count; rows and chains are never multiplied by thresholds.
    The ends are written, a row for each place where a count changes: all that follows is worked out from them, and rows are read once.
    Averages, shares and p95 over chains are weighted (weights below 0 count as 0), those with _raw are not; NaN scores pass no threshold.
    """
    taus = sorted({float(t) for t in taus})
    s = F.when(~F.isnan(score), F.col(score).cast("double"))
    bucket = at_most(F.lit(taus), s, len(taus))
    w = F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0))
    per = rows.select(F.col(chain).alias("c"), w.alias("w"), F.col(label).alias("y"), bucket.alias("b")).groupBy("c", "w", "b").agg(F.coalesce(F.sum("y"), F.lit(0)).alias("p"), F.count("*").alias("n"))
    down = Window.partitionBy("c", "w").orderBy(F.desc("b"))
    up_to = down.rowsBetween(Window.unboundedPreceding, 0)
    run = per.select("w", "b", F.lag("b").over(down).alias("above"), F.coalesce(F.lead("b").over(down), F.lit(0)).alias("below"), F.sum("p").over(up_to).alias("p"), F.sum("n").over(up_to).alias("n"), F.col("p").alias("own"))
    counts = lambda p, n: [("tp", p), ("fp", n - p), ("pred", n)]
    span = lambda lo, hi, p, n: [F.struct(F.lit(k).alias("kind"), x.cast("long").alias("count"), at.alias("at"), F.lit(sign).alias("sign"), F.col("w").alias("w")) for k, x in counts(p, n) for at, sign in ((lo, 1), (hi, -1))]
    top = F.when(F.col("above").isNull(), F.array(*span(F.col("b"), F.lit(len(taus)), F.lit(0), F.lit(0)))).otherwise(F.array())
    own = F.struct(F.lit("own").alias("kind"), F.lit(0).cast("long").alias("count"), F.lit(0).alias("at"), F.lit(1).alias("sign"), (F.col("w") * F.col("own")).alias("w"))
    ends = run.select(F.explode(F.concat(F.array(*span(F.col("below"), F.col("b"), F.col("p"), F.col("n")), own), top)).alias("e")).select("e.*")
    steps = ends.groupBy("kind", "count", "at").agg(F.sum(F.col("w") * F.col("sign")).alias("dw"), F.sum("sign").alias("dn"))
    steps = written(steps, "steps")
    along = Window.partitionBy("kind", "count").orderBy("at")
    held = steps.where("kind <> 'own'").select("kind", "count", "at", F.coalesce(F.lead("at").over(along), F.lit(len(taus))).alias("to"), F.sum("dw").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("w"), F.sum("dn").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("n"))
    hist = held.where("n > 0 and at < to").select("kind", "count", F.greatest("w", F.lit(0.0)).alias("w"), "n", F.explode(F.sequence("at", F.col("to") - 1)).alias("i"))
    less = Window.partitionBy("kind", "i")
    seen = hist.withColumn("cw", F.sum("w").over(less.orderBy("count").rowsBetween(Window.unboundedPreceding, 0))).withColumn("tw", F.sum("w").over(less))
    c, ratio = F.col("count"), lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    share = lambda x, x_of: ratio(F.sum(F.when(x, F.col(x_of)).otherwise(0)), F.sum(x_of))
    stats = seen.groupBy("i", "kind").agg(
        F.sum(F.col("w") * c).alias("sum"), ratio(F.sum(F.col("w") * c), F.sum("w")).alias("avg"), ratio(F.sum(F.col("n") * c), F.sum("n")).alias("avg_raw"),
        F.percentile("count", F.lit(0.95), F.col("n")).alias("p95_raw"), F.min(F.when((F.col("tw") > 0) & (F.col("cw") >= 0.95 * F.col("tw") - 1e-12), c)).cast("double").alias("p95"),
        share(c > budget, "w").alias("over"), share(c > budget, "n").alias("over_raw"), share(c >= 1, "w").alias("any"), share(c >= 1, "n").alias("any_raw"), *[share(c > b, "w").alias(f"over_{b}") for b in over],
    )
    of = lambda kind, x: F.max(F.when(F.col("kind") == kind, F.col(x)))
    p95 = lambda kind: F.coalesce(of(kind, "p95"), of(kind, "p95_raw"))
    wide = stats.groupBy("i").agg(
        of("tp", "sum").alias("tp"), of("fp", "sum").alias("fp"), of("pred", "avg").alias("avg_pred"), p95("pred").alias("p95_pred"), of("pred", "over").alias("over_budget"), of("fp", "avg").alias("avg_fp"), p95("fp").alias("p95_fp"), of("fp", "any").alias("any_fp"),
        *[of(k, f"{x}_raw").alias(f"{name}_raw") for k, x, name in (("pred", "avg", "avg_pred"), ("pred", "p95", "p95_pred"), ("pred", "over", "over_budget"), ("fp", "avg", "avg_fp"), ("fp", "p95", "p95_fp"), ("fp", "any", "any_fp"))],
        *[of("pred", f"over_{b}").alias(f"over_{b}") for b in over],
    )
    out = wide.crossJoin(F.broadcast(steps.where("kind = 'own'").agg(F.sum("dw").alias("positives")))).withColumn("fn", F.col("positives") - F.col("tp"))
    tail = ["avg_pred", "p95_pred", "over_budget", "avg_fp", "p95_fp", "any_fp"]
    return out.select(
        F.element_at(F.lit(taus), (F.col("i") + 1).cast("int")).alias("tau"), "tp", "fp", "fn", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), *tail, *[f"{x}_raw" for x in tail], *[f"over_{b}" for b in over],
    )


def weighted_quantile(rows: DataFrame, value: str, weight: str, qs: list[float], group: list[str] | None = None) -> DataFrame:
    """(group, q, quantile): the least value whose cumulative weight reaches q of the whole; plain quantiles where no weight is positive.

    Weights below 0 count as 0; null and NaN values are left out. Values are added up first, so ties cost nothing.
    """
    group = group or []
    w = F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0))
    v = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*group, F.col(value).cast("double").alias("v")).agg(F.sum(w).alias("w"), F.count("*").alias("n"))
    run = prefix_sums(v, group, "v", ["w", "n"])
    picks = [F.min(F.when(F.col("up_w") >= q * F.col("all_w") - 1e-12, F.col("v"))).alias(f"q{i}") for i, q in enumerate(qs)]
    at = [F.lit(float(q)) * (F.col("all_n") - 1) for q in qs]
    plain = [x for i, a in enumerate(at) for x in (F.min(F.when(F.col("up_n") > F.floor(a), F.col("v"))).alias(f"lo{i}"), F.min(F.when(F.col("up_n") > F.ceil(a), F.col("v"))).alias(f"hi{i}"), F.max(a - F.floor(a)).alias(f"part{i}"))]
    out = run.groupBy(*group).agg(F.max("all_w").alias("tw"), *picks, *plain).select(*group, "tw", *[f"q{i}" for i in range(len(qs))], *[(F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * F.col(f"part{i}")).alias(f"p{i}") for i in range(len(qs))])
    each = F.explode(F.array(*[F.struct(F.lit(float(q)).alias("q"), F.when(F.col("tw") > 0, F.col(f"q{i}")).otherwise(F.col(f"p{i}")).alias("quantile")) for i, q in enumerate(qs)])).alias("e")
    return out.select(*group, each).select(*group, "e.q", "e.quantile")


def pareto(rows: DataFrame, cost: str, gain: str, group: list[str] | None = None) -> DataFrame:
    """rows and `frontier`: whether no cheaper (or equally cheap and better) row has as much gain."""
    before = Window.partitionBy(*(group or [])).orderBy(F.col(cost), F.desc(gain)).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("frontier", F.col(gain) > F.coalesce(F.max(gain).over(before), F.lit(float("-inf"))) + 1e-12)


def operating_points(sweep: DataFrame, avg: str = "avg_pred", tail: str = "p95_pred", recall: str = "recall", avg_limit: float = 15.0, tail_limit: float = 30.0) -> DataFrame:
    """(point, tau, recall, avg): conservative, balanced and discovery choices from a small table of thresholds."""
    top = sweep.agg(F.max(recall).alias("top"))
    t = sweep.crossJoin(F.broadcast(top))
    value = F.col(recall) / F.log(1 + F.col(avg) + 1e-6) - 0.005 * F.col(tail)
    cons = t.where(F.col(recall) >= 0.60 * F.col("top")).select(F.lit("conservative").alias("point"), F.struct((-F.col(avg)).alias("a"), F.col(recall).alias("b"), F.col("tau").alias("c")).alias("key"), "tau", recall, avg)
    bal = t.select(F.lit("balanced").alias("point"), F.struct(F.round(value, 12).alias("a"), F.col(recall).alias("b"), F.col("tau").alias("c")).alias("key"), "tau", recall, avg)
    fits = ((F.col(avg) <= avg_limit) & (F.col(tail) <= tail_limit)).cast("double")
    disc = t.select(F.lit("discovery").alias("point"), F.struct(fits.alias("a"), F.col(recall).alias("b"), F.col("tau").alias("c")).alias("key"), "tau", recall, avg)
    every = cons.unionByName(bal).unionByName(disc)
    return every.groupBy("point").agg(F.max_by(F.struct("tau", recall, avg), "key").alias("m")).select("point", "m.tau", f"m.{recall}", f"m.{avg}")


# Budgets of candidates a chain: the mean and p95 at most, and of chains with more than `b` candidates the share at most.
BUDGETS = {"strict": {"avg": 3, "p95": 12, "b": 8, "share": 0.10}, "discover": {"avg": 8, "p95": 25, "b": 8, "share": 0.30}, "wide": {"avg": 15, "p95": 35, "b": 15, "share": 0.30}}


def budget_points(sweep: DataFrame, budgets: dict[str, dict] | None = None, avg: str = "avg_pred", tail: str = "p95_pred", recall: str = "recall") -> DataFrame:
    """(budget, tau, recall, avg): for each budget the threshold that keeps it with the most recall, then the fewest candidates, then the largest threshold.

    sweep: a table of thresholds with over_<b> for the b of each budget. A budget that no threshold keeps has no row; a null or NaN load keeps none.
    """
    fits = [
        F.when((F.col(avg) <= x["avg"]) & (F.col(tail) <= x["p95"]) & (F.col(f"over_{x['b']}") <= x["share"]), F.lit(name)) for name, x in (BUDGETS if budgets is None else budgets).items()
    ]
    each = sweep.select("tau", recall, avg, F.explode(F.array_compact(F.array(*fits))).alias("budget"))
    key = F.struct(F.col(recall).alias("a"), (-F.col(avg)).alias("b"), F.col("tau").alias("c"))
    return each.groupBy("budget").agg(F.max_by(F.struct("tau", recall, avg), key).alias("m")).select("budget", "m.tau", f"m.{recall}", f"m.{avg}")


def threshold_grid(rows: DataFrame, score: str, n: int, anchors: list[float]) -> DataFrame:
    """(tau): n quantiles of scores cut to [0, 1], with 0, 1 and the anchors, each once, rounded to nine digits. Null and NaN scores are left out.

    Without rounding, the last bits of a quantile would decide whether a score equal to it passes.
    """
    seen = rows.where(F.col(score).isNotNull() & ~F.isnan(score)).groupBy(F.col(score).cast("double").alias("s")).agg(F.count("*").alias("n"))
    q = exact_quantiles(seen, [], "s", "n", [k / (n - 1) for k in range(n)])
    inside = [F.least(F.greatest(F.col(f"q{k}"), F.lit(0.0)), F.lit(1.0)) for k in range(n)]
    return q.select(F.explode(F.array_distinct(F.transform(F.array_compact(F.array(*inside, *[F.lit(float(a)) for a in [0, 1, *anchors]])), lambda x: F.round(x, 9)))).alias("tau"))


def interpolated_mean(curves: DataFrame, curve: str, x: str, y: str, grid: int = 501) -> DataFrame:
    """(g, y): curves read at `grid` even places of [0, 1] by straight lines, ends held, then averaged.

    A place is read between the last point at or before it and the first one behind it. Points are reduced to the first and last one between
    neighbouring places, so what is put in order is at most `grid` rows a curve. Of points with equal x the greatest y is the last.
    """
    at = F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    cell = F.greatest(F.ceil(F.col(x) * (grid - 1)).cast("int"), F.lit(0))
    ends = curves.groupBy(curve, cell.alias("k")).agg(F.min(at).alias("first"), F.max(at).alias("last"))
    every = curves.select(curve).distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    along = Window.partitionBy(curve).orderBy("k")
    both = every.join(ends, [curve, "k"], "full_outer").select(
        curve, "k", F.last("last", True).over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("a"), F.first("first", True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("b"),
    ).where(F.col("k") < grid)
    g = F.col("k") / (grid - 1)
    line = F.col("a.y") + (F.col("b.y") - F.col("a.y")) * F.try_divide(g - F.col("a.x"), F.col("b.x") - F.col("a.x"))
    value = F.when(F.col("a").isNull(), F.col("b.y")).when(F.col("b").isNull() | (g <= F.col("a.x")), F.col("a.y")).otherwise(F.coalesce(line, F.col("a.y")))
    return both.select(g.alias("g"), value.alias("v")).groupBy("g").agg(F.avg("v").alias(y))
