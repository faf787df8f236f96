"""Weighted precision-recall and ROC curves, by group, as prefix sums over distinct scores.

Input rows: a 0/1 label, a score and a weight. Equal scores make one point. Null and NaN scores, null labels, and null weights and
weights of 0 make no point. The prefix sum runs inside score buckets that are cut at approximate quantiles; bucket totals
give the offsets, so no window holds a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialize import written
from .prefix import BUCKETS, at_most, buckets_for


def points(rows: DataFrame, group: list[str], label: str = "label", score: str = "score", weight: Column | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(group, score, tp, fp, pos, neg): sums at or above each distinct score, and group totals."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    clean = rows.select(*group, F.col(score).cast("double").alias("score"), F.col(label).cast("double").alias("y"), w.alias("w")).where("score is not null and not isnan(score) and y is not null and w <> 0")
    by_score = clean.groupBy(*group, "score").agg(F.sum(F.col("w") * F.col("y")).alias("dtp"), F.sum(F.col("w") * (1 - F.col("y"))).alias("dfp"))
    by_score = written(by_score, "scores")
    buckets = buckets_for(by_score.count(), buckets)
    cuts = by_score.groupBy(*group).agg(F.percentile_approx("score", [k / buckets for k in range(1, buckets)], max(1000, 16 * buckets)).alias("cuts"), F.sum("dtp").alias("pos"), F.sum("dfp").alias("neg"))
    cuts = written(cuts, "cuts")  # read twice below: approximate quantiles worked out twice may differ, and buckets with them
    on = [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in group]
    placed = by_score.alias("a").join(cuts.alias("b"), on if on else F.lit(True)).select(*[F.col(f"a.{g}").alias(g) for g in group], "score", "dtp", "dfp", "pos", "neg", at_most(F.col("cuts"), F.col("score"), buckets).alias("bucket"))
    totals = placed.groupBy(*group, "bucket").agg(F.sum("dtp").alias("btp"), F.sum("dfp").alias("bfp"))
    above = Window.partitionBy(*group).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group, "bucket", F.coalesce(F.sum("btp").over(above), F.lit(0.0)).alias("otp"), F.coalesce(F.sum("bfp").over(above), F.lit(0.0)).alias("ofp"))
    on = [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in [*group, "bucket"]]
    joined = placed.alias("a").join(offsets.alias("b"), on).select(*[F.col(f"a.{g}").alias(g) for g in group], "a.bucket", "score", "dtp", "dfp", "pos", "neg", "otp", "ofp")
    inside = Window.partitionBy(*group, "bucket").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    return joined.select(*group, "bucket", "score", (F.col("otp") + F.sum("dtp").over(inside)).alias("tp"), (F.col("ofp") + F.sum("dfp").over(inside)).alias("fp"), "dtp", "dfp", "pos", "neg")


def pr_points(rows: DataFrame, group: list[str], **options) -> DataFrame:
    """points() with precision, recall and f1."""
    p = points(rows, group, **options)
    precision, recall = F.col("tp") / (F.col("tp") + F.col("fp")), F.when(F.col("pos") > 0, F.col("tp") / F.col("pos")).otherwise(0.0)
    return p.withColumn("precision", precision).withColumn("recall", recall).withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-12)))


def pr_summary(rows: DataFrame, group: list[str], **options) -> DataFrame:
    """(group, aucpr, ap, n_points): trapezoids from the anchor (recall 0, precision 1), and the step sum; 0 without positives.

    The point before each one follows from its own sums: tp - dtp and fp - dfp, so no second ordered window is needed.
    """
    p = pr_points(rows, group, **options)
    tp0, fp0 = F.col("tp") - F.col("dtp"), F.col("fp") - F.col("dfp")
    # sums of all rows above are 0 for the first point only; rounding leaves no exact 0 behind an offset
    before = F.when(tp0 + fp0 > 1e-9 * (F.col("pos") + F.col("neg")), tp0 / (tp0 + fp0)).otherwise(1.0)
    step = F.col("dtp") / F.col("pos")
    area = F.when(F.col("pos") > 0, step * (F.col("precision") + before) / 2).otherwise(0.0)
    return p.groupBy(*group).agg(F.sum(area).alias("aucpr"), F.sum(F.when(F.col("pos") > 0, step * F.col("precision")).otherwise(0.0)).alias("ap"), F.count("*").alias("n_points"))


def roc_auc(rows: DataFrame, group: list[str], **options) -> DataFrame:
    """(group, roc_auc): null without positives or without negatives."""
    p = points(rows, group, **options)
    area = (F.col("dfp") / F.nullif("neg", F.lit(0.0))) * (2 * F.col("tp") - F.col("dtp")) / F.nullif("pos", F.lit(0.0)) / 2
    return p.groupBy(*group).agg(F.sum(area).alias("roc_auc"))


def best_f1(rows: DataFrame, group: list[str], **options) -> DataFrame:
    """(group, threshold, f1, precision, recall): the greatest f1, the lowest threshold of equal ones."""
    p = pr_points(rows, group, **options)
    best = F.max(F.struct(F.round("f1", 12).alias("f"), (-F.col("score")).alias("s"), "f1", "precision", "recall")).alias("b")
    return p.groupBy(*group).agg(best).select(*group, (-F.col("b.s")).alias("threshold"), "b.f1", "b.precision", "b.recall")


def confusion(rows: DataFrame, group: list[str], predicted: Column, label: str = "label", weight: Column | None = None) -> DataFrame:
    """(group, tp, fp, fn, tn, precision, recall, f1, fpr): sums of weights where predicted or not; empty ratios are 0."""
    w, y = (F.lit(1.0) if weight is None else weight.cast("double")), F.col(label) == 1
    hit = F.coalesce(predicted, F.lit(False))
    part = lambda c: F.sum(F.when(c, w).otherwise(0.0))
    t = rows.groupBy(*group).agg(part(hit & y).alias("tp"), part(hit & ~y).alias("fp"), part(~hit & y).alias("fn"), part(~hit & ~y).alias("tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    t = t.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return t.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).withColumn("fpr", ratio(F.col("fp"), F.col("fp") + F.col("tn")))


def passes(score: Column, tau: Column | float) -> Column:
    """score >= tau, never for NaN."""
    tau = tau if isinstance(tau, Column) else F.lit(tau)
    return ~F.isnan(score) & (score >= tau)
