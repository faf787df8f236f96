"""Connected components over an edge table, as alternating star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import BROADCAST_ROWS, HOT_ROWS, checkpointed, discard


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _hung(rows: DataFrame, low: DataFrame, hub_rows: int) -> DataFrame:
    """rows (u, v) with the m of their u; the rows of hubs go through a broadcast of the hubs, so none meets in one task.

    low: (u, m, n) with the number n of rows of u. Hubs have more than hub_rows rows, so there are few of them; they are counted.
    """
    hubs = low.where(F.col("n") > hub_rows).select("u", "m")
    few = hubs.count()
    if not few:
        return rows.join(low.select("u", "m"), "u")
    hubs = F.broadcast(hubs) if few <= BROADCAST_ROWS else hubs
    return rows.join(low.where(F.col("n") <= hub_rows).select("u", "m"), "u").unionByName(rows.join(hubs, "u"))


def _large_star(edges: DataFrame, hub_rows: int) -> tuple[DataFrame, DataFrame]:
    """Every neighbour above u is tied to the smallest member of u's neighbourhood; also the table of these members."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = checkpointed(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")))
    return _hung(both.where("v > u"), low, hub_rows).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), low


def _small_star(edges: DataFrame, hub_rows: int) -> tuple[DataFrame, DataFrame]:
    """u and its neighbours below are tied to the smallest of them; also the table of these."""
    low = checkpointed(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
    hung = _hung(edges, low, hub_rows).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), low


def component_roots(edges: DataFrame, u: str = "u", v: str = "v", hub_rows: int = HOT_ROWS) -> DataFrame:
    """(node, root) for every node of an edge other than the root itself; root is the smallest node.

    Nulls and self-loops in edges tie nothing and are left out; repeated edges count once; no edges
    give no rows. Rounds go on until none changes an edge and grow with the logarithm of the diameter; roots only ever get smaller, so they end. Every round is written to the shared folder, so a lost
    executor costs one round. Smallest neighbours are partial aggregates; a node with more than hub_rows edges is joined to its
    own by broadcast, so the edges of a hub stay where they are.
    """
    e = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = checkpointed(e)
    seen = _signature(e)
    while seen[0]:
        star, low = _large_star(e, hub_rows)
        large = checkpointed(star)
        star, low2 = _small_star(large, hub_rows)
        new = checkpointed(star)
        for done in (e, low, large, low2):
            discard(done)
        e, now = new, _signature(new)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def shared_key_components(members: DataFrame, node: str, key: str, hub_rows: int = HOT_ROWS) -> DataFrame:
    """(node, component) where nodes that share a key value, directly or through others, are together.

    Cliques are replaced by stars: each key ties its nodes to its smallest node. component is the smallest
    node id. A null key ties nothing; such nodes are components of their own; null nodes are left out. Repeated rows count once; an empty
    table gives no rows. Rows of a key that more than hub_rows nodes share meet its smallest node by broadcast.
    """
    m = checkpointed(members.select(F.col(node).alias("node"), F.col(key).alias("u")).where("node is not null").distinct())
    low = checkpointed(m.where("u is not null").groupBy("u").agg(F.min("node").alias("m"), F.count("*").alias("n")))
    edges = _hung(m.where("u is not null"), low, hub_rows).select(F.col("node").alias("u"), F.col("m").alias("v")).where("u <> v")
    roots = component_roots(edges, hub_rows=hub_rows)
    nodes = m.select("node").distinct()
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("component"))
