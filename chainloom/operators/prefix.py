"""Running sums and ranks in an order, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialize import HOT_ROWS, col, free_names, fresh, small, written

BUCKETS, BUCKET_ROWS = 64, 1_000_000


def buckets_for(rows: int, least: int = BUCKETS) -> int:
    """Buckets of about BUCKET_ROWS rows each, `least` of them at least."""
    return max(least, -(-rows // BUCKET_ROWS))


def at_most(sorted_values: Column, x: Column, size: int) -> Column:
    """How many entries of an ascending array of up to `size` numbers are x or less, by a binary search: no pass over the array for each row."""
    powers = [1 << k for k in reversed(range(max(size, 1).bit_length()))]
    return F.aggregate(F.lit(powers), F.lit(0), lambda n, step: F.when((n + step <= F.size(sorted_values)) & (F.get(sorted_values, n + step - 1) <= x), n + step).otherwise(n))


def prefix_sums(cells: DataFrame, group: list[str], order: str, sums: list[str], descending: bool = False, tie: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """cells with up_<s>, the sum of s up to each cell in the order, itself included, and all_<s>, that of the group.

    cells: one row per (group, order[, tie]), the order numeric; rows with a null or NaN order are left out. Cells fall into buckets cut at approximate
    quantiles, as many as the counted cells ask for; totals of buckets give offsets, and windows run inside a bucket. Null groups are a group. No cells give no rows.
    """
    b, cuts = fresh(cells, n=2, prefix="_bucket")
    cells = written(cells.where(F.col(order).isNotNull() & ~F.isnan(F.col(order).cast("double"))), "cells")
    buckets = buckets_for(cells.count(), buckets)
    x = F.col(order).cast("double")
    totals = cells.groupBy(*group).agg(F.percentile_approx(x, [k / buckets for k in range(1, buckets)], max(1000, 16 * buckets)).alias(cuts), *[F.sum(s).alias(f"all_{s}") for s in sums])
    totals = written(totals, "cuts")  # read twice below: approximate quantiles worked out twice may differ, and buckets with them
    on = lambda names: [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in names] or F.lit(True)
    placed = cells.alias("a").join(totals.alias("b"), on(group)).select("a.*", *[f"b.all_{s}" for s in sums], at_most(F.col(f"b.{cuts}"), x, buckets).alias(b))
    first = F.desc if descending else F.asc
    before = Window.partitionBy(*group).orderBy(first(b)).rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(*group, b).agg(*[F.sum(s).alias(f"in_{s}") for s in sums]).select(*group, b, *[F.coalesce(F.sum(f"in_{s}").over(before), F.lit(0)).alias(f"off_{s}") for s in sums])
    joined = placed.alias("a").join(offsets.alias("b"), on([*group, b])).select("a.*", *[f"b.off_{s}" for s in sums])
    inside = Window.partitionBy(*group, b).orderBy(first(order), *([tie] if tie else [])).rowsBetween(Window.unboundedPreceding, 0)
    return joined.select(*cells.columns, *[(F.col(f"off_{s}") + F.sum(s).over(inside)).alias(f"up_{s}") for s in sums], *[f"all_{s}" for s in sums])


def monotone(key: str, kind: str) -> Column:
    """A number that does not fall where the key grows: the key itself, or the first bytes of a string."""
    if kind == "string":
        return F.conv(F.rpad(F.hex(F.substring(F.encode(F.col(key), "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("double")
    return F.col(key).cast("double")


def row_places(rows: DataFrame, group: list[str], value: str, tie: str, descending: bool = True, cost: str | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """rows with `place`, from 0, in the order of value and then of tie (ascending), and with a cost also `before`, the sum of cost of the rows in front.

    Rows are counted by value; counts give the place at which each value begins. Rows of a value with more than hot_rows rows are cut into ranges of the
    tie, so that no task ranks them all. tie is a number or a string and tells the rows of a group apart. Rows with a null value are left out.
    """
    free_names(rows, "place", *(["before"] if cost else []))
    t, v, c, n, cut, number, total = fresh(rows, n=7, prefix="_place")
    rows = rows.where(F.col(value).isNotNull()).withColumn(t, monotone(tie, dict(rows.dtypes)[tie])).withColumn(v, F.col(value).cast("double"))
    many = rows.groupBy(*group, v).count().where(F.col("count") > hot_rows)
    many = written(many.select(*group, v, F.col("count").alias(n)), "hot-values")
    if many.isEmpty():
        rows = rows.withColumn(c, F.lit(0))
    else:
        pieces = int(many.agg(F.max(n)).first()[0] // hot_rows) + 1
        ranges = rows.join(small(many), [*group, v]).groupBy(*group, v).agg(F.percentile_approx(t, [k / pieces for k in range(1, pieces)], 10_000).alias(cut))
        ranges = written(ranges, "tie-ranges")
        rows = rows.join(small(ranges), [*group, v], "left").withColumn(c, F.when(F.col(cut).isNull(), 0).otherwise(at_most(F.col(cut), F.col(t), pieces)))
        rows = rows.drop(cut)
    add = [F.count("*").alias(number), *([F.sum(cost).alias(total)] if cost else [])]
    cells = rows.groupBy(*group, v, c).agg(*add)
    sums = [number, *([total] if cost else [])]
    begin = prefix_sums(cells, group, v, sums, descending, tie=c).select(*group, v, c, *[(F.col(f"up_{s}") - F.col(s)).alias(f"at{s}") for s in sums])
    inside = Window.partitionBy(*group, v, c).orderBy(tie)
    on = [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in [*group, v, c]]
    joined = rows.alias("a").join(begin.alias("b"), on).select("a.*", *[f"b.at{s}" for s in sums])
    out = joined.withColumn("place", F.col(f"at{number}") + F.row_number().over(inside) - 1)
    if cost:
        out = out.withColumn("before", F.col(f"at{total}") + F.coalesce(F.sum(cost).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return out.drop(t, v, c, *[f"at{s}" for s in sums])


def exact_quantiles(values: DataFrame, group: list[str], value: str, n: str, qs: list[float]) -> DataFrame:
    """(group, q0, q1, ...): quantiles between neighbours by straight lines, of values that occur n times each.

    A value covers the places from up to down of its running counts; wanted places are joined to them by blocks of places.
    """
    run = prefix_sums(values, group, value, [n]).select(*group, F.col(value).cast("double").alias("v"), (F.col(f"up_{n}") - F.col(n)).alias("from"), (F.col(f"up_{n}") - 1).alias("to"), F.col(f"all_{n}").alias("whole"))
    run = written(run, "places")
    size = F.greatest(F.floor(F.col("whole") / len(qs)), F.lit(1))
    rows = run.withColumn("block", F.explode(F.sequence(F.floor(F.col("from") / size), F.floor(F.col("to") / size))))
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(float(q)) * (F.col("whole") - 1)).alias("at")) for i, q in enumerate(qs)]))
    wanted = run.select(*group, "whole").distinct().withColumn("w", at).select(*group, "whole", "w.i", "w.at")
    ends = F.explode(F.array(F.floor("at"), F.ceil("at")))
    wanted = wanted.withColumn("place", ends).withColumn("block", F.floor(F.col("place") / size))
    on = [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in group] + [F.col("a.block") == F.col("b.block"), F.col("b.place").between(F.col("a.from"), F.col("a.to"))]
    found = wanted.alias("b").join(rows.alias("a"), on).select(*[F.col(f"b.{g}").alias(g) for g in group], "b.i", "b.at", "a.v")
    line = F.min("v") + (F.max("v") - F.min("v")) * F.max(F.col("at") - F.floor("at"))
    each = found.groupBy(*group, "i").agg(line.alias("q"))
    q = each.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("i", "q"))).alias("m"))
    return q.select(*group, *[F.col("m")[i].alias(f"q{i}") for i in range(len(qs))])
