"""Capping and assigning groups to folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialize import HOT_ROWS, columns, fresh, small, written
from .prefix import row_places


def hashed_order(key: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))


def round_robin_cap(rows: DataFrame, component: str, cluster: str, key: str, cap: int, seed: int = 1, hot_rows: int = HOT_ROWS) -> DataFrame:
    """rows of each component up to the cap, taken in turn from its clusters, in hashed order; ties go to the lower key.

    A row's place is its turn at least, so rows beyond the cap-th of a cluster go first, and so do clusters that have nothing left to give: what is put
    in order is at most cap rows a cluster, and of these only turns up to the one at which the component is full. A cluster with more than hot_rows rows is
    first cut by ranges of the hash. key tells rows apart. Null components and clusters are values of their own.
    """
    h, piece, turn, place, n = fresh(rows, n=5, prefix="_turn")
    r = rows.withColumn(h, hashed_order(F.col(key), seed))
    big = written(r.groupBy(component, cluster).count().where(F.col("count") > hot_rows).select(component, cluster, F.lit(1).alias(n)), "big-clusters")
    if not big.isEmpty():  # the first `cap` of each range of the hash hold the first `cap` of the cluster
        part = Window.partitionBy(component, cluster, F.substring(h, 1, 3)).orderBy(h, key)
        r = r.join(small(big), [component, cluster], "left")
        cut = r.where(F.col(n).isNotNull()).withColumn(piece, F.row_number().over(part)).where(F.col(piece) <= cap).drop(piece)
        r = r.where(F.col(n).isNull()).unionByName(cut).drop(n)
    r = r.withColumn(turn, F.row_number().over(Window.partitionBy(component, cluster).orderBy(h, key))).where(F.col(turn) <= cap)
    turns = r.groupBy(component, turn).agg(F.count("*").alias(n))
    before = F.coalesce(F.sum(n).over(Window.partitionBy(component).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = turns.withColumn(place, before).where(F.col(place) < cap).drop(n)  # at most cap rows a component
    on = [F.col(f"a.{component}").eqNullSafe(F.col(f"b.{component}")), F.col(f"a.{turn}") == F.col(f"b.{turn}")]
    r = r.alias("a").join(offsets.alias("b"), on).select("a.*", f"b.{place}")
    within = F.row_number().over(Window.partitionBy(component, turn).orderBy(cluster, key))
    return r.withColumn(n, F.col(place) + within).where(F.col(n) <= cap).select(*columns(rows))


def serpentine_folds(matrix: DataFrame, component: str, weight: str, cls: str, n: int = 5, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(component, fold, class, weight): components by class and falling weight, dealt out 0..n-1 and back again; ties go to the lower component.

    Places come from row_places(): neither a class nor one weight is ever in one task. Rows with a null weight are left out.
    """
    placed = row_places(matrix.select(component, cls, weight), [cls], weight, component, hot_rows=hot_rows)
    lap = F.pmod(F.col("place"), F.lit(2 * n))
    return placed.select(component, F.when(lap < n, lap).otherwise(2 * n - 1 - lap).cast("int").alias("fold"), cls, weight)


def greedy_folds(matrix: DataFrame, component: str, classes: list[str], n: int = 5, total_weight: float = 24.0) -> DataFrame:
    """(component, fold): heaviest first, each to the fold that keeps the worst fold's deviation least.

    For comparison with serpentine_folds() on tables of components, which are aggregates: one pass in order is inherently one task.
    """
    import pandas as pd

    def assign(t: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        t = t.sort_values(["total", component], ascending=[False, True])
        w = t[["total", *classes]].to_numpy(dtype=float)
        ideal = np.maximum(w.sum(axis=0) / n, 1e-12)
        scale = np.array([total_weight, *[1.0] * len(classes)]) / ideal
        folds, out = np.zeros((n, w.shape[1])), []
        for i, row in enumerate(w):
            if i < n:
                best = i
            else:
                now = np.abs(folds - ideal) @ scale
                new = np.abs(folds + row - ideal) @ scale
                worst = [max(new[f], np.delete(now, f).max()) for f in range(n)]
                best = min(range(n), key=lambda f: (round(worst[f], 12), folds[f, 0]))
            folds[best] += row
            out.append(best)
        return pd.DataFrame({component: t[component].to_numpy(), "fold": out})

    kind = dict(matrix.dtypes)[component]
    return matrix.select(component, "total", *classes).groupBy().applyInPandas(assign, f"{component} {kind}, fold int")


def fold_discrepancy(matrix: DataFrame, assigned: DataFrame, component: str, classes: list[str], n: int = 5, total_weight: float = 24.0) -> DataFrame:
    """(fold, total, discrepancy): weighted relative distance of each fold from the ideal fifth."""
    j = matrix.join(assigned.select(component, "fold"), component)
    per = j.groupBy("fold").agg(*[F.sum(c).alias(c) for c in ["total", *classes]])
    ideal = matrix.agg(*[F.greatest(F.sum(c) / n, F.lit(1e-12)).alias(f"_{c}") for c in ["total", *classes]])
    x = per.crossJoin(F.broadcast(ideal))
    d = total_weight * F.abs(F.col("total") - F.col("_total")) / F.col("_total")
    for c in classes:
        d = d + F.abs(F.col(c) - F.col(f"_{c}")) / F.col(f"_{c}")
    return x.select("fold", "total", d.alias("discrepancy"))


def ratio_split(rows: DataFrame, component: str, weight: str, shares: dict[str, float], seed: int = 1) -> DataFrame:
    """(component, set): components in hashed order, cut where the cumulative weight passes the shares.

    Cumulative weights run within 256 hash ranges, offset by the ranges before.
    """
    h = hashed_order(F.col(component), seed)
    w_, h_, b_, sum_, off_, all_ = fresh(rows, n=6, prefix="_part")
    t = rows.groupBy(component).agg(F.sum(weight).alias(w_)).withColumn(h_, h).withColumn(b_, F.substring(h_, 1, 2))
    before = Window.orderBy(b_).rowsBetween(Window.unboundedPreceding, -1)
    b = t.groupBy(b_).agg(F.sum(w_).alias(sum_)).withColumn(off_, F.coalesce(F.sum(sum_).over(before), F.lit(0.0))).drop(sum_)
    total = t.agg(F.sum(w_).alias(all_))
    inside = Window.partitionBy(b_).orderBy(h_, component).rowsBetween(Window.unboundedPreceding, -1)
    share = (F.col(off_) + F.coalesce(F.sum(w_).over(inside), F.lit(0.0))) / F.col(all_)
    edge, out = 0.0, None
    for name, s in list(shares.items())[:-1]:
        edge += s
        out = F.when(share < edge, name) if out is None else out.when(share < edge, name)
    out = out.otherwise(list(shares)[-1]) if out is not None else F.lit(next(iter(shares)))
    return t.join(F.broadcast(b), b_).crossJoin(F.broadcast(total)).select(component, out.alias("set"))
