"""Permutation tests and bootstraps whose draws are hashes, so they do not hang on partitioning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.materialize import BROADCAST_ROWS, col, fresh, written


def digest(seed: int, *keys: Column) -> Column:
    """32 hex digits of the keys' text, which any engine with MD5 gives alike; null keys are the text "null"."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("null")) for k in keys]).cast("binary"))


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) from a hash of the keys, of 52 bits."""
    return F.conv(F.substring(digest(seed, *keys), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def few(pairs: DataFrame) -> DataFrame:
    """A table of (fold, seed) pairs, written; more than BROADCAST_ROWS are an error."""
    pairs = written(pairs, "pairs")
    if pairs.count() > BROADCAST_ROWS:
        raise ValueError(f"more than {BROADCAST_ROWS} pairs")
    return pairs


def signflip_test(diffs: DataFrame, fold: str, seed_col: str, diff: str, n_perm: int, seed: int = 1) -> DataFrame:
    """(d, n, p_two, p_greater, p_less): the mean of fold means against random signs of each pair; p with one added."""
    observed = diffs.groupBy(fold).agg(F.avg(diff).alias("m")).agg(F.avg("m").alias("d"))
    spark = diffs.sparkSession
    flips = spark.range(n_perm).withColumnRenamed("id", "perm").crossJoin(F.broadcast(few(diffs.select(fold, seed_col, diff))))  # counted
    sign = F.when(uniform(seed, F.col("perm"), F.col(fold), F.col(seed_col)) < 0.5, -1.0).otherwise(1.0)
    stars = flips.groupBy("perm", fold).agg(F.avg(sign * F.col(diff)).alias("m")).groupBy("perm").agg(F.avg("m").alias("s"))
    t = stars.crossJoin(F.broadcast(observed))
    up = lambda c: ((F.sum(F.when(c, 1).otherwise(0)) + 1) / (F.count("*") + 1))
    eps = 1e-12
    return t.groupBy("d").agg(F.count("*").alias("n"), up(F.abs("s") >= F.abs("d") - eps).alias("p_two"), up(F.col("s") >= F.col("d") - eps).alias("p_greater"), up(F.col("s") <= F.col("d") + eps).alias("p_less"))


def hierarchical_bootstrap(diffs: DataFrame, fold: str, seed_col: str, diff: str, n_boot: int, seed: int = 2, level: float = 0.95) -> DataFrame:
    """(mean, low, high): folds drawn with replacement, then seeds within each drawn fold.

    diffs is the small table of (fold, seed) pairs.
    """
    diffs = few(diffs.select(fold, seed_col, diff))
    cells = diffs.groupBy(fold).agg(F.array_sort(F.collect_list(F.struct(F.col(seed_col).alias("s"), F.col(diff).alias("d")))).alias("pairs"))
    folds = cells.agg(F.array_sort(F.collect_list(F.struct(F.col(fold).alias("f"), "pairs"))).alias("folds"))
    draws = diffs.sparkSession.range(n_boot).withColumnRenamed("id", "boot").crossJoin(F.broadcast(folds))

    def pick(boot: Column, k: Column, f: Column) -> Column:
        def one(j: Column) -> Column:
            return F.element_at(f["pairs"], (F.floor(uniform(seed + 1, boot, k, j) * F.size(f["pairs"])) + 1).cast("int"))["d"]

        got = F.transform(F.sequence(F.lit(1), F.size(f["pairs"])), one)
        return F.aggregate(got, F.lit(0.0), lambda a, x: a + x) / F.size(f["pairs"])

    n = F.size("folds")
    means = F.transform(F.sequence(F.lit(1), n), lambda k: pick(F.col("boot"), k, F.element_at("folds", (F.floor(uniform(seed, F.col("boot"), k) * n) + 1).cast("int"))))
    per = draws.select((F.aggregate(means, F.lit(0.0), lambda a, x: a + x) / n).alias("m"))
    tail = (1 - level) / 2
    return per.agg(F.avg("m").alias("mean"), F.percentile("m", F.lit(tail)).alias("low"), F.percentile("m", F.lit(1 - tail)).alias("high"))


#: Draws that one hash gives, of 32 bits each.
DRAWS_PER_HASH = 4


def poisson_edges() -> list[int]:
    """Numbers of 32 bits below which a Poisson(1) count is at most 0, 1, 2, ...; beyond the last, no such number is left."""
    from math import exp, factorial

    edges, total = [], 0.0
    for k in range(13):
        total += exp(-1) / factorial(k)
        edges.append(round(total * (1 << 32)))
    return edges


def poisson_count(u: Column) -> Column:
    """Poisson(1) count of a uniform number of 32 bits, as eight hex digits: their order is that of the numbers."""
    edges = [f"{e:08x}" for e in poisson_edges() if e < 1 << 32]
    out = F.when(u < edges[0], 0)
    for k, edge in enumerate(edges[1:], 1):
        out = out.when(u < edge, k)
    return out.otherwise(len(edges))


#: Sums of draws that a task holds at once.
SUM_CELLS = 1 << 22


def bootstrap_sums(rows: DataFrame, group: list[str], unit: list[str], by: list[str], weight: Column, n_boot: int, seed: int = 3) -> DataFrame:
    """(group, boot, by, weight): for each draw, the sums of weight times how often the unit was drawn, where that is not 0.

    A unit is a residue, or a chain with all of its. Rows are added up by unit first. The hashes of a unit, four draws to a hash, are worked out once for all of its sums, which then meet all draws as rows
    of a matrix; matrices are added up by (group, by) before any shuffle, so what is sent grows with the groups and draws, not with the units. Null units are one unit.
    """
    w, h, n, sums, cells, boot = fresh(rows, n=6, prefix="_draw")
    keys = [*group, *by]
    each = rows.groupBy(*group, *unit, *by).agg(F.sum(weight).cast("double").alias(w))
    one = each.groupBy(*group, *unit).agg(F.collect_list(F.struct(*[col(c) for c in by], w)).alias(cells))
    hashes = F.concat(*[digest(seed, *[col(c) for c in unit], F.lit(b)) for b in range(-(-n_boot // DRAWS_PER_HASH))])
    kinds = {f.name: f.dataType for f in each.schema.fields}
    edges = np.array([e for e in poisson_edges() if e < 1 << 32], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = max(1, SUM_CELLS // n_boot)
            for at in range(0, batch.num_rows, size):
                yield from some(batch.slice(at, size))

    def some(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lists = batch.column(batch.schema.get_field_index(cells))
        unit_at, flat = pc.list_parent_indices(lists), pc.list_flatten(lists)
        frame = {c: batch.column(batch.schema.get_field_index(c)).take(unit_at) for c in group} | {c: flat.field(c) for c in by}
        words = np.frombuffer(bytes.fromhex("".join(batch.column(batch.schema.get_field_index(h)).to_pylist())), dtype=">u4").reshape(batch.num_rows, -1)[:, :n_boot]
        times = np.searchsorted(edges, words.ravel().astype(np.int64), side="right").reshape(words.shape).astype(np.float64)
        table = pa.table(frame | {n: pa.array(np.arange(len(unit_at)))})
        found = table.group_by(keys, use_threads=False).aggregate([(n, "list")])
        u, x, there = unit_at.to_numpy(), flat.field(w).fill_null(0.0).to_numpy(), flat.field(w).is_valid().to_numpy(zero_copy_only=False)
        total = np.zeros((len(found), n_boot))
        for i, members in enumerate(found.column(f"{n}_list").to_pylist()):
            m = np.array(members)
            for part in range(0, len(m), size_of):
                k = m[part : part + size_of]
                k = k[there[k]]
                total[i] += x[k] @ times[u[k]]
        lengths = pa.array(np.arange(0, total.size + 1, n_boot), pa.int32())
        out = [found.column(c).combine_chunks() for c in keys]
        yield pa.RecordBatch.from_arrays([*out, pa.ListArray.from_arrays(lengths, pa.array(total.ravel()))], names=[*keys, sums])

    size_of = max(1, SUM_CELLS // n_boot)
    schema = T.StructType([T.StructField(c, kinds[c]) for c in keys] + [T.StructField(sums, T.ArrayType(T.DoubleType()))])
    drawn = one.select(*[col(c) for c in group], cells, hashes.alias(h)).mapInArrow(run, schema)
    return drawn.select(*[col(c) for c in keys], F.posexplode(sums).alias(boot, w)).where(F.col(w) != 0).groupBy(*group, F.col(boot).cast("long").alias("boot"), *by).agg(F.sum(w).alias("weight"))


def random_labels(rows: DataFrame, share: float, *keys: str, seed: int = 4) -> DataFrame:
    """rows with random_label: 1 for about this share of them, by a hash of the keys."""
    return rows.withColumn("random_label", (uniform(seed, *[F.col(k) for k in keys]) < share).cast("int"))
