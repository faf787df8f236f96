"""Top-k metrics: residues ranked within their chain by score, ties by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialize import free_names
from .prefix import prefix_sums


def ranked(rows: DataFrame, chain: list[str], score: str = "score", pos: str = "pos") -> DataFrame:
    """rows and their rank from 1; null and NaN scores come last."""
    free_names(rows, "rank")
    clean = F.when(~F.isnan(score), F.col(score))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*chain).orderBy(clean.desc_nulls_last(), F.col(pos))))


def at_k(rows: DataFrame, chain: list[str], ks: list[int], carry: list[str] | None = None, label: str = "label", **options) -> DataFrame:
    """One row per chain and k: (chain, carry, k, length, npos, tp, kk) with kk = min(k, length)."""
    r = ranked(rows, chain, **options)
    sums = [F.sum(F.when(F.col("rank") <= k, F.col(label)).otherwise(0)).alias(f"tp{k}") for k in ks]
    per = r.groupBy(*chain, *(carry or [])).agg(F.count("*").alias("length"), F.sum(label).alias("npos"), *sums)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"tp{k}").alias("tp")) for k in ks])).alias("e")
    return per.select(*chain, *(carry or []), "length", "npos", each).select(*chain, *(carry or []), "e.k", "length", "npos", "e.tp", F.least("e.k", "length").alias("kk"))


def _mean(value: Column, weight: Column, where: Column) -> Column:
    top, low = F.sum(F.when(where, weight * value)), F.sum(F.when(where, weight))
    return F.coalesce(F.try_divide(top, low), F.lit(0.0))


def topk_metrics(per: DataFrame, group: list[str], weight: Column | None = None) -> DataFrame:
    """(group, k, max_precision, precision, recall, hit, f): weighted means over chains, f micro.

    Max precision is 0 for chains without positives; recall and hit are over chains with positives only. Weight sums of 0 give 0.
    """
    w = F.lit(1.0) if weight is None else weight.cast("double")
    some, always = F.col("npos") > 0, F.lit(True)
    most = F.least("npos", "kk")
    return per.groupBy(*group, "k").agg(
        _mean(F.when(some, F.col("tp") / F.nullif(most, F.lit(0))).otherwise(0.0), w, always).alias("max_precision"), _mean(F.col("tp") / F.col("kk"), w, always).alias("precision"),
        _mean(F.col("tp") / F.nullif("npos", F.lit(0)), w, some).alias("recall"), _mean((F.col("tp") > 0).cast("double"), w, some).alias("hit"),
        F.coalesce(F.try_divide(F.sum(w * F.col("tp")), F.sum(w * F.least("npos", "k"))), F.lit(0.0)).alias("f"),
    )


def chain_confusion_topk(rows: DataFrame, chain: list[str], k: int, confident: float, label: str = "label", score: str = "score", **options) -> DataFrame:
    """(chain, tp, fp, fn, confident_fp, max_fp): the first k of each chain are predicted."""
    r = ranked(rows, chain, score=score, **options)
    hit, y = F.col("rank") <= k, F.col(label) == 1
    return r.groupBy(*chain).agg(
        F.sum((hit & y).cast("int")).alias("tp"), F.sum((hit & ~y).cast("int")).alias("fp"), F.sum((~hit & y).cast("int")).alias("fn"),
        F.sum((hit & ~y & (F.col(score) >= confident)).cast("int")).alias("confident_fp"), F.max(F.when(hit & ~y, F.col(score))).alias("max_fp"),
    )


def dense_ranks(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, value, rank, n): the dense rank of each distinct value, the greatest first, and how often it occurs; null and NaN values are left out."""
    seen = rows.groupBy(*group, value).agg(F.count("*").alias("n"), F.lit(1).alias("one"))
    return prefix_sums(seen, group, value, ["one"], descending=True).select(*group, value, F.col("up_one").cast("long").alias("rank"), "n")
