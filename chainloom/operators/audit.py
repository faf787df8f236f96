"""Audit tables: overviews, distributions, leakage, sample weights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialize import col, columns, free_names, fresh
from .prefix import exact_quantiles, prefix_sums


def chain_rollup(residues: DataFrame, chain: str = "chain", aa: str = "aa", label: str = "label") -> DataFrame:
    """(chain, length, n_positive, residues array): the sorted set of letters at positive positions."""
    return residues.groupBy(chain).agg(F.count("*").alias("length"), F.sum(label).alias("n_positive"), F.array_sort(F.collect_set(F.when(F.col(label) == 1, F.col(aa)))).alias("residues"))


def overview(chains: DataFrame, split: str, length: str, positives: str, weight: str) -> DataFrame:
    """One row per split and one for "all"."""
    (g,) = fresh(chains)
    t = chains.groupingSets([[split], []], split).agg(
        F.grouping(split).alias(g), F.count("*").alias("chains"), F.sum(length).alias("residues"), F.sum(positives).alias("positives"), F.avg(length).alias("mean_length"),
        F.percentile(length, F.lit(0.25)).alias("p25"), F.percentile(length, F.lit(0.75)).alias("p75"), F.sum(weight).alias("weight"),
    )
    return t.select(F.when(F.col(g) == 1, "all").otherwise(F.col(split).cast("string")).alias(split), "chains", "residues", "positives", "mean_length", "p25", "p75", "weight", F.try_divide(F.col("positives"), F.col("residues")).alias("fraction"))


def distribution(rows: DataFrame, key: list[str], weight: str | None = None) -> DataFrame:
    """(key, n, pct[, weight, weight_pct]); totals come from the grouped table."""
    aggs = [F.count("*").alias("n")] + ([F.sum(weight).alias("weight")] if weight else [])
    free_names(rows.select(*key), "n", "pct", *(["weight", "weight_pct"] if weight else []))
    g = rows.groupBy(*key).agg(*aggs)
    n, w = fresh(g, n=2)
    total = g.agg(F.sum("n").alias(n), *([F.sum("weight").alias(w)] if weight else []))
    out = g.crossJoin(F.broadcast(total)).withColumn("pct", 100.0 * F.col("n") / F.col(n))  # one row
    if weight:
        out = out.withColumn("weight_pct", 100.0 * F.try_divide(F.col("weight"), F.col(w)))
    return out.drop(n, w)


def pivot_share(rows: DataFrame, key: str, columns: str, values: list, measure: Column, normalise: bool = True) -> DataFrame:
    """One column per value of `columns`, zero-filled, with the total; shares of the row if normalised."""
    wide = rows.groupBy(key).pivot(columns, values).agg(measure)
    names = [str(v) for v in values]
    wide = wide.select(key, *[F.coalesce(F.col(f"`{n}`"), F.lit(0)).cast("double").alias(n) for n in names])
    total = reduce(lambda a, b: a + b, [F.col(f"`{n}`") for n in names])
    wide = wide.withColumn("total", total)
    return wide.select(key, *[(F.try_divide(F.col(f"`{n}`"), F.col("total")) if normalise else F.col(f"`{n}`")).alias(n) for n in names], "total")


def zero_filled(rows: DataFrame, key: str, domain: list) -> DataFrame:
    """(key, n) for each value of the domain, also where it does not occur."""
    every = rows.sparkSession.createDataFrame([(v,) for v in domain], rows.select(key).schema)
    return every.join(rows.groupBy(key).count(), key, "left").select(key, F.coalesce("count", F.lit(0)).alias("n"))


def capped_histogram(rows: DataFrame, value: str, cap: int) -> DataFrame:
    """(bin, n) of values other than 0, those above the cap as the cap; null values are in none."""
    return rows.where(F.col(value) != 0).groupBy(F.least(F.col(value), F.lit(cap)).alias("bin")).agg(F.count("*").alias("n"))


def fixed_histogram(rows: DataFrame, group: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """(group, bin, n): equal bins of [low, high); lower values are bin 0, higher ones bin bins + 1."""
    return rows.groupBy(*group, F.width_bucket(F.col(value).cast("double"), F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))


def box_statistics(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, low, q1, median, q3, high, mean) of the values that are not null."""
    q = F.percentile(value, F.array(*map(F.lit, (0.25, 0.5, 0.75))))
    return rows.groupBy(*group).agg(F.min(value).alias("low"), q.alias("q"), F.max(value).alias("high"), F.avg(value).alias("mean")).select(*group, "low", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "high", "mean")


def frequency_rollup(rows: DataFrame, part: str, label: str) -> DataFrame:
    """(part, label, n, share): shares of each label within a part, and overall with part "all"."""
    (g,) = fresh(rows)
    n = rows.groupingSets([[part, label], [label]], part, label).agg(F.grouping(part).alias(g), F.count("*").alias("n"))
    n = n.select(F.when(F.col(g) == 1, "all").otherwise(F.col(part).cast("string")).alias(part), label, "n")
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(part)))


def ecdf(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, value, n, cdf): the share of rows at or below each distinct value, which is numeric; null values are left out."""
    g = rows.groupBy(*group, value).agg(F.count("*").alias("n"))
    return prefix_sums(g, group, value, ["n"]).select(*group, value, "n", (F.col("up_n") / F.col("all_n")).alias("cdf"))


def majority_override(rows: DataFrame, group: str, code: str, digit: Column, missing: str = "not found") -> DataFrame:
    """rows with `repaired`: codes whose digit is not the group's most frequent one become `missing`; ties go to the lowest digit."""
    known = rows.where(F.col(code) != missing).select(F.col(group), digit.alias("d")).groupBy(group, "d").agg(F.count("*").alias("n"))
    (m,) = fresh(rows)
    mode = known.groupBy(group).agg(F.min_by("d", F.struct(-F.col("n"), F.col("d"))).alias(m))
    return rows.join(mode, group, "left").withColumn("repaired", F.when((F.col(code) == missing) | (digit == F.col(m)), F.col(code)).otherwise(missing)).withColumnRenamed(m, "mode")


def leakage(rows: DataFrame, columns: list[str], split: str) -> DataFrame:
    """(column, value, splits, n_splits): values that are seen in more than one split."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("e")
    pairs = rows.select(F.col(split).alias("s"), each).select("s", "e.*").where("value is not null").distinct()
    return pairs.groupBy("column", "value").agg(F.count("*").alias("n_splits"), F.array_join(F.array_sort(F.collect_list("s")), ",").alias("splits")).where("n_splits > 1")


def overlap_report(rows: DataFrame, entry: str, split: str) -> DataFrame:
    """(entry, n, splits): entries in more than one split."""
    (n,) = fresh(rows)
    pairs = rows.groupBy(entry, split).agg(F.count("*").alias(n))
    return pairs.groupBy(entry).agg(F.sum(n).alias("n"), F.array_join(F.array_sort(F.collect_list(F.col(split).cast("string"))), ",").alias("splits"), F.count("*").alias("n_splits")).where("n_splits > 1")


def hierarchical_weights(chains: DataFrame, top: str, mid: str, parent: str, structure: str, cap: int = 100) -> DataFrame:
    """chains and w_top = min(cap, mids of the top), w_mid, w_seq, w_struct: each level shares out the one above; null becomes 1."""
    free_names(chains, "w_top", "w_mid", "w_seq", "w_struct")
    n_mid, n_parent, n_struct = fresh(chains, n=3)
    mids = chains.select(top, mid).distinct().groupBy(top).agg(F.least(F.count("*"), F.lit(cap)).cast("double").alias("w_top"), F.count("*").alias(n_mid))
    parents = chains.select(mid, parent).distinct().groupBy(mid).agg(F.count("*").alias(n_parent))
    structures = chains.select(mid, parent, structure).distinct().groupBy(mid, parent).agg(F.count("*").alias(n_struct))
    t = chains.join(mids, top, "left").join(parents, mid, "left").join(structures, [mid, parent], "left")
    t = t.withColumn("w_mid", F.col("w_top") / F.col(n_mid)).withColumn("w_seq", F.col("w_mid") / F.col(n_parent)).withColumn("w_struct", F.col("w_seq") / F.col(n_struct))
    return t.select(*columns(chains), *[F.coalesce(c, F.lit(1.0)).alias(c) for c in ("w_top", "w_mid", "w_seq", "w_struct")])


def component_class_matrix(rows: DataFrame, component: str, cls: str, weight: str, classes: list) -> DataFrame:
    """(component, total, class_<c>): weight of each component, whole and by class; null weights count as nothing."""
    sums = [F.sum(F.when(F.col(cls) == c, F.col(weight)).otherwise(0.0)).alias(f"class_{c}") for c in classes]
    return rows.groupBy(component).agg(F.sum(weight).alias("total"), *sums)


def purity(rows: DataFrame, component: str, group: str) -> DataFrame:
    """(component, n_groups, groups): which groups each component holds."""
    return rows.select(component, group).distinct().groupBy(component).agg(F.count(group).alias("n_groups"), F.array_join(F.array_sort(F.collect_list(group)), ",").alias("groups"))


def effective_size(rows: DataFrame, group: list[str], weight: str, mask: Column) -> DataFrame:
    """(group, n, weight, n_eff, fraction): (sum w)^2 / sum w^2, and the weight share of the rows of the mask."""
    w = F.col(weight).cast("double")
    return rows.groupBy(*group).agg(F.count("*").alias("n"), F.sum(w).alias("weight"), F.try_divide(F.pow(F.sum(w), F.lit(2.0)), F.sum(w * w)).alias("n_eff"), F.try_divide(F.sum(F.when(mask, w).otherwise(0.0)), F.sum(w)).alias("fraction"))


def keep_first(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order, columns as they are; null keys are a key.

    Partial aggregates of the least row, so the rows of a hot key are never in one task. Of rows that are equal in the order, the least in their other columns.
    """
    (r,) = fresh(rows)
    plain = all(not t.startswith(("map", "variant")) and "map<" not in t for _, t in rows.dtypes)
    if not plain:  # rows with maps have no order
        return rows.withColumn(r, F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col(r) == 1).drop(r)
    first = F.min(F.struct(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]).alias("o"), F.struct(*columns(rows)).alias("row"))).alias(r)
    return rows.groupBy(*key).agg(first).select(*[F.col(r)["row"].getField(c).alias(c) for c in rows.columns])


def varies_within(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Rows of groups that hold more than one value."""
    mixed = rows.groupBy(group).agg(F.min(value).alias("low"), F.max(value).alias("high")).where("low <> high").select(group)
    return rows.join(mixed, group, "left_semi")


def rejects(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """rows that break a check, with a `reason` each; a check that is null counts as broken."""
    reason = F.explode(F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))).alias("reason")
    return rows.select("*", reason)


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): left, right or both."""
    a, b = left.select(key).distinct().withColumn("_a", F.lit(1)), right.select(key).distinct().withColumn("_b", F.lit(1))
    return a.join(b, key, "full_outer").select(key, F.when(F.col("_b").isNull(), "left").when(F.col("_a").isNull(), "right").otherwise("both").alias("side"))


def sequence_collisions(rows: DataFrame, origin: str, sequence: str) -> DataFrame:
    """rows with `name`: the origin, with the first 8 digits of the sequence's SHA-1 where an origin has several sequences."""
    (m,) = fresh(rows)
    many = rows.groupBy(origin).agg((F.min(sequence) != F.max(sequence)).alias(m))
    tag = F.substring(F.sha1(F.col(sequence).cast("binary")), 1, 8)
    return rows.join(many, origin).withColumn("name", F.when(F.col(m), F.concat_ws("_", F.col(origin).cast("string"), tag)).otherwise(F.col(origin).cast("string"))).drop(m)


def routed(items: DataFrame, inventory: DataFrame, key: str, kind: str, order: list[str], default: str) -> DataFrame:
    """items with `route`: the first kind of `order` that the inventory has for the key (or its lower case), else the default."""
    k_, have_ = fresh(items, n=2)
    have = inventory.groupBy(F.lower(key).alias(k_)).agg(F.collect_set(kind).alias(have_))
    route = F.lit(default)
    for k in reversed(order):
        route = F.when(F.array_contains(have_, k), k).otherwise(route)
    return items.join(have, F.lower(F.col(key)) == F.col(k_), "left").withColumn("route", F.coalesce(route, F.lit(default))).drop(k_, have_)


def nonfinite(rows: DataFrame, policy: str, chain: str, score: str, weight: str) -> DataFrame:
    """rows with finite scores by policy: (a) row weight 0 and the median of all, (b) chain weight 0 and its median, (c) left out, (d) the chain's median."""
    bad = F.col(score).isNull() | F.isnan(score) | (F.abs(score) == float("inf"))
    if policy == "c":
        return rows.where(~bad)
    fine = F.when(~bad, F.col(score))
    if not rows.columns or policy not in ("a", "b", "d"):
        raise ValueError(f"unknown policy {policy!r}")
    m, some = fresh(rows, n=2)
    if policy == "a":  # the median of all from counts of values, in ranges
        seen = rows.where(~bad).groupBy(F.col(score).cast("double").alias("v")).agg(F.count("*").alias("n"))
        stats = exact_quantiles(seen, [], "v", "n", [0.5]).agg(F.coalesce(F.max("q0"), F.lit(0.0)).alias(m), F.lit(0).alias(some))
        j = rows.crossJoin(F.broadcast(stats))
    else:
        stats = rows.groupBy(chain).agg(F.coalesce(F.percentile(fine, F.lit(0.5)), F.lit(0.0)).alias(m), F.max(bad.cast("int")).alias(some))
        j = rows.join(stats, chain)
    w = {"a": F.when(bad, 0.0).otherwise(F.col(weight)), "b": F.when(F.col(some) == 1, 0.0).otherwise(F.col(weight)), "d": F.col(weight)}[policy]
    return j.withColumn(weight, w).withColumn(score, F.when(bad, F.col(m)).otherwise(F.col(score))).drop(m, some)


def class_by_split(chains: DataFrame, split: str, cls: str, length: str, positives: str) -> DataFrame:
    """(split, class, chains, with_sites, residues, fraction): counts, chains with positives, and the share of positives."""
    (p,) = fresh(chains)
    t = chains.groupBy(split, cls).agg(F.count("*").alias("chains"), F.sum((F.col(positives) > 0).cast("int")).alias("with_sites"), F.sum(length).alias("residues"), F.sum(positives).alias(p))
    return t.select(split, cls, "chains", "with_sites", "residues", F.try_divide(F.col(p), F.col("residues")).alias("fraction"))


def component_sizes(rows: DataFrame, component: str, weight: str) -> DataFrame:
    """(component, n, weight): rows and weight of each component."""
    return rows.groupBy(component).agg(F.count("*").alias("n"), F.sum(weight).alias("weight"))


def coverage(rows: DataFrame, accession: str, structures: str, group: list[str]) -> DataFrame:
    """(group, accessions, with_any, with_one, with_more, most): shares of accessions by the number of their structures, an array; null is none."""
    n = F.coalesce(F.size(F.array_distinct(structures)), F.lit(0))
    n = F.greatest(n, F.lit(0))
    share = lambda c: F.avg(c.cast("int")).alias
    return rows.groupBy(*group).agg(F.count(accession).alias("accessions"), share(n >= 1)("with_any"), share(n == 1)("with_one"), share(n >= 2)("with_more"), F.max(n).alias("most"))


def source_by_split(chains: DataFrame, source: str, split: str, length: str) -> DataFrame:
    """(source, split, chains, residues)."""
    return chains.groupBy(source, split).agg(F.count("*").alias("chains"), F.sum(length).alias("residues"))


def letter_distribution(residues: DataFrame, letter: str, label: str) -> DataFrame:
    """(letter, n, positives, share, positive_share): of all positions, and of positive ones; shares are null where there are none."""
    g = residues.groupBy(letter).agg(F.count("*").alias("n"), F.sum(label).alias("positives"))
    total = g.agg(F.sum("n").alias("_n"), F.sum("positives").alias("_p"))
    return g.crossJoin(F.broadcast(total)).select(letter, "n", "positives", F.try_divide("n", "_n").alias("share"), F.try_divide("positives", "_p").alias("positive_share"))


def with_positives(chains: DataFrame, positives: str) -> DataFrame:
    """Chains that have a positive position; null counts as none."""
    return chains.where(F.coalesce(F.col(positives), F.lit(0)) > 0)


def code_distribution(rows: DataFrame, code: Column, novel: Column, missing: str = "No EC") -> DataFrame:
    """(code, ord, n, share, n_novel, novel_share): codes 1 to 7 in order, then others, then `missing` for null; shares of all, and of novel rows."""
    named = rows.select(F.coalesce(code.cast("string"), F.lit(missing)).alias("code"), F.coalesce(novel, F.lit(False)).cast("int").alias("new"))
    g = named.groupBy("code").agg(F.count("*").alias("n"), F.sum("new").alias("n_novel"))
    total = g.agg(F.sum("n").alias("_n"), F.sum("n_novel").alias("_v"))
    return g.crossJoin(F.broadcast(total)).select("code", code_order(F.col("code"), missing).alias("ord"), "n", F.try_divide("n", "_n").alias("share"), "n_novel", F.try_divide("n_novel", "_v").alias("novel_share"))


def code_order(code: Column, missing: str = "No EC") -> Column:
    """Place of a class bucket: 1 to 7 by number, 8 for others, 9 for `missing`."""
    return F.when(code.rlike("^[1-7]$"), code.try_cast("int")).when(code == missing, 9).otherwise(8)


def split_order(split: Column) -> Column:
    """Place of a split: by the number in its name, those without one behind."""
    return F.coalesce(F.nullif(F.regexp_extract(split, r"(\d+)", 1), F.lit("")).try_cast("int"), F.lit(2**31 - 1))


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], n: int, parts: int = 32) -> DataFrame:
    """The first n rows of each group with their `rank`. Each of `parts` hashed parts of a group gives its own first n, so no task ranks a whole group."""
    free_names(rows, "rank")
    part, r = fresh(rows, n=2)
    cut = rows.withColumn(part, F.pmod(F.xxhash64(*[col(c) for c, t in rows.dtypes if not t.startswith(("map", "variant"))]), F.lit(parts)))
    cut = cut.withColumn(r, F.row_number().over(Window.partitionBy(*group, part).orderBy(*order))).where(F.col(r) <= n).drop(r, part)
    return cut.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= n)


def top_rows(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows of the whole table with their `place`: a report, put in order in one task only once it is n rows."""
    return rows.orderBy(*order).limit(n).withColumn("place", F.row_number().over(Window.orderBy(*order)))


def cluster_statistics(rows: DataFrame, cluster: str, members: list[str]) -> DataFrame:
    """(cluster, n_<m> for each column m): distinct members of each cluster."""
    return rows.groupBy(cluster).agg(*[F.count_distinct(m).alias(f"n_{m}") for m in members])
