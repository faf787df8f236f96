"""Joins that look something up: with checks of keys, reports of what is missing, and fallbacks.

Null keys match nothing. Rows of the left side that repeat keep their rows. Empty tables give no rows, or rows with nothing found.
"""

from __future__ import annotations

from functools import reduce
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import BROADCAST_ROWS, col, columns, fresh, written


def repeated_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, n): keys that more than one row has."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def _unique(rows: DataFrame, key: list[str], side: str) -> None:
    bad = repeated_keys(rows, key).limit(3).collect()
    if bad:
        raise ValueError(f"keys repeat in the {side} table: {[tuple(r)[:-1] for r in bad]}")


def one_to_one(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Inner join of two tables whose keys are unique; a repeated key, or no common key, is an error."""
    _unique(left, key, "left")
    _unique(right, key, "right")
    out = left.join(right, key)
    if out.isEmpty():
        raise ValueError("the tables have no key in common")
    return out


def many_to_one(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Left join with a table whose keys are unique; a repeated key there is an error."""
    _unique(right, key, "right")
    return left.join(right, key, "left")


def join_report(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """(side, keys, left_rows, right_rows): how many keys, with how many rows, are in both tables, in the left or in the right one only."""
    a, b = left.groupBy(*key).agg(F.count("*").alias("a")), right.groupBy(*key).agg(F.count("*").alias("b"))
    both = a.join(b, key, "full_outer")
    side = F.when(F.col("b").isNull(), "left").when(F.col("a").isNull(), "right").otherwise("both")
    return both.groupBy(side.alias("side")).agg(F.count("*").alias("keys"), F.coalesce(F.sum("a"), F.lit(0)).alias("left_rows"), F.coalesce(F.sum("b"), F.lit(0)).alias("right_rows"))


def two_hop(rows: DataFrame, key: str, first: DataFrame, middle: str, second: DataFrame, last: str, check: bool = False) -> DataFrame:
    """rows with middle and last, looked up one after the other, and `missing`: "first" or "second" where a hop finds nothing.

    first: (key, middle), second: (middle, last), each key once; with check, a repeated one is an error, without, it repeats rows.
    """
    if check:
        _unique(first.where(F.col(key).isNotNull()), [key], "first")
        _unique(second.where(F.col(middle).isNotNull()), [middle], "second")
    out = rows.join(first.select(key, middle), key, "left").join(second.select(middle, last), middle, "left")
    missing = F.when(F.col(middle).isNull(), "first").when(F.col(last).isNull(), "second")
    return out.select(*columns(rows), middle, last, missing.alias("missing"))


def ownership_count(rows: DataFrame, owner: str, structures: str) -> DataFrame:
    """(structure, owners): how many owners have each structure of an array column; repeats within an owner count once."""
    pairs = rows.select(F.col(owner).alias("owner"), F.explode(structures).alias("structure")).where("structure is not null and owner is not null").distinct()
    return pairs.groupBy("structure").agg(F.count("*").alias("owners"))


def exclusive_structures(rows: DataFrame, owner: str, structures: str, inventory: DataFrame | None = None) -> DataFrame:
    """(owner, structure): structures that exactly one owner has, and that the inventory (structure), if given, holds."""
    pairs = rows.select(F.col(owner).alias("first"), F.explode(structures).alias("structure")).where("structure is not null and first is not null")
    alone = pairs.groupBy("structure").agg(F.min("first").alias("first"), F.max("first").alias("last")).where("first = last").select("structure", F.col("first").alias(owner))
    if inventory is not None:
        alone = alone.join(inventory.select("structure").distinct(), "structure", "left_semi")
    return alone.select(owner, "structure")


def with_alias(rows: DataFrame, key: str, table: DataFrame, value: str, alias: DataFrame, other: str, check: bool = False) -> DataFrame:
    """rows with value, looked up by key, else by the key that alias (key, other) names, and `found`: "key", "alias" or null. With check, a key that table or alias repeats is an error; without, it repeats rows."""
    if check:
        _unique(table.where(F.col(key).isNotNull()), [key], "value")
        _unique(alias.where(F.col(key).isNotNull()), [key], "alias")
    direct, by_alias, o = fresh(rows, n=3)
    t = table.select(F.col(key).alias(key), F.col(value).alias(direct))
    out = rows.join(t, key, "left").join(alias.select(F.col(key), F.col(other).alias(o)), key, "left")
    out = out.join(table.select(F.col(key).alias(o), F.col(value).alias(by_alias)), o, "left")
    found = F.when(F.col(direct).isNotNull(), "key").when(F.col(by_alias).isNotNull(), "alias")
    return out.select(*columns(rows), F.coalesce(direct, by_alias).alias(value), found.alias("found"))


def cached_or(rows: DataFrame, key: str, length: str, cache: DataFrame, fallback: DataFrame, value: str, check: bool = False) -> DataFrame:
    """rows with value, from the cache (key, length, value) where the lengths agree, else from the fallback (key, value), and `origin`. With check, a key that one of them repeats is an error; without, it repeats rows."""
    if check:
        _unique(cache.where(F.col(key).isNotNull()), [key], "cache")
        _unique(fallback.where(F.col(key).isNotNull()), [key], "fallback")
    n, a, b = fresh(rows, n=3)
    out = rows.join(cache.select(F.col(key), F.col(length).alias(n), F.col(value).alias(a)), key, "left").join(fallback.select(F.col(key), F.col(value).alias(b)), key, "left")
    valid = F.col(n) == F.col(length)
    used = F.when(valid & F.col(a).isNotNull(), "cache").when(F.col(b).isNotNull(), "fallback")
    return out.select(*columns(rows), F.when(valid & F.col(a).isNotNull(), F.col(a)).otherwise(F.col(b)).alias(value), used.alias("origin"))


def manifest_scores(manifest: DataFrame, scores: DataFrame, key: list[str], carry: list[str]) -> DataFrame:
    """Every row of the manifest with its scores, null where there are none, and `scored`."""
    (mark,) = fresh(manifest, scores)
    out = manifest.join(scores.select(*key, *carry, F.lit(True).alias(mark)), key, "left")
    return out.select(*columns(manifest), *carry, F.coalesce(mark, F.lit(False)).alias("scored"))


def weight_of(rows: DataFrame, key: str, weights: DataFrame, weight: str, names: DataFrame, name: str, default: float = 1.0) -> DataFrame:
    """rows with weight (default where there is none) and name (the key itself where there is none)."""
    out = rows.join(weights.select(key, F.col(weight)), key, "left").join(names.select(key, F.col(name)), key, "left")
    return out.select(*columns(rows), F.coalesce(F.col(weight), F.lit(default)).alias(weight), F.coalesce(F.col(name), F.col(key).cast("string")).alias(name))


def grid_gaps(rows: DataFrame, unit: str, axes: list[str]) -> DataFrame:
    """(unit, axes): combinations of the axes' values that a unit has no row for. Axes are a small parameter grid; units are not multiplied but by it. More than BROADCAST_ROWS combinations are an error."""
    values = [written(rows.select(x).where(F.col(x).isNotNull()).distinct(), "axis") for x in axes]
    size = prod(v.count() for v in values)
    if size > BROADCAST_ROWS:
        raise ValueError(f"{size} combinations of {', '.join(axes)}")
    grid = reduce(lambda a, b: a.crossJoin(b), [F.broadcast(v) for v in values])
    every = rows.select(unit).where(F.col(unit).isNotNull()).distinct().crossJoin(F.broadcast(grid))
    return every.join(rows.select(unit, *axes).distinct(), [unit, *axes], "left_anti")


def by_prefix(rows: DataFrame, text: str, pattern: str, table: DataFrame, key: str) -> DataFrame:
    """rows joined to the table by the key that the pattern's first group finds in a text: an equi-join where substrings would match wrong keys."""
    (found,) = fresh(rows, table)
    cut = F.nullif(F.regexp_extract(col(text), pattern, 1), F.lit("")).try_cast(dict(table.dtypes)[key])
    return rows.withColumn(found, cut).join(table, F.col(found) == F.col(key)).drop(found)


def propagated(chains: DataFrame, component: str, assigned: DataFrame, value: str) -> DataFrame:
    """chains with what their component was assigned; chains of other components keep a null."""
    return chains.join(assigned.select(component, value), component, "left")


def with_provenance(frames: dict[str, DataFrame], name: str = "origin") -> DataFrame:
    """All rows of the frames, with the name of the frame each comes from; columns that a frame lacks are null."""
    parts = [f.withColumn(name, F.lit(k)) for k, f in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def agreement_report(rows: DataFrame, key: list[str], model: str, label: str, n_models: int | Column) -> DataFrame:
    """(reason, n): how many keys are kept by ensemble_mean(), lack a model, or have labels that differ."""
    g = rows.groupBy(*key).agg(F.count_distinct(model).alias("m"), F.min(label).alias("lo"), F.max(label).alias("hi"))
    reason = F.when(F.col("m") != n_models, "missing_model").when(~F.col("lo").eqNullSafe(F.col("hi")), "labels_differ").otherwise("kept")
    return g.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def score_above(rows: DataFrame, key: str, scores: DataFrame, score: str, least: float, default: float = 0.0) -> DataFrame:
    """rows whose looked-up score, the default where there is none, is above `least`; with the score."""
    out = rows.join(scores.select(key, F.col(score)), key, "left").withColumn(score, F.coalesce(score, F.lit(default)))
    return out.where(F.col(score) > least)


def same_length_as_first(rows: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """rows whose text is as long as that of the first row of their group."""
    n = fresh(rows)[0]
    first = rows.groupBy(group).agg(F.min_by(F.length(text), order).alias(n))
    return rows.join(first, group).where(F.length(text) == F.col(n)).select(*columns(rows))
