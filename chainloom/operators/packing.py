"""Greedy packing of ordered items into batches, without a task that holds all items."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialize import HOT_ROWS, col, columns, fresh, small, written
from .prefix import row_places

#: Places of one block, and how many times wider blocks get from one level to the next.
BLOCK, WIDER = 1 << 18, 64


def next_starts(placed: DataFrame, max_cost: int, max_items: int) -> DataFrame:
    """(place, next): where the next batch begins if one begins at a place. placed: (place, cost, before), before the cost of all earlier places.

    A batch that begins at p ends before the last place whose `before` is at most that of p and max_cost; it has one item at least and max_items at most. That place is looked up in a range of `before`, in
    buckets of max_cost, each with the rows of the one behind it: at most two batches' worth of rows of one task.
    """
    end = placed.agg(F.max(F.struct("place", "before", "cost")).alias("e")).where("e is not null").select((F.col("e.place") + 1).alias("place"), (F.col("e.before") + F.col("e.cost")).alias("before"), F.lit(False).alias("item"))
    rows = placed.select("place", "before", F.lit(True).alias("item")).unionByName(end)
    bucket = F.floor(F.col("before") / max_cost)
    both = rows.withColumn("bucket", F.explode(F.array(bucket, bucket - 1))).withColumn("own", F.col("bucket") == bucket)
    reach = Window.partitionBy("bucket").orderBy("before").rangeBetween(0, max_cost)
    found = both.withColumn("last", F.max("place").over(reach)).where("own and item")
    return found.select("place", F.greatest(F.col("place") + 1, F.least(F.col("last"), F.col("place") + max_items)).alias("next"))


def _exits(rows: pd.DataFrame) -> pd.DataFrame:
    """For each entry of a block the first place outside it that its jumps lead to: pointers are squared until all of them lead outside."""
    rows = rows.sort_values("place")
    place, to = rows["place"].to_numpy(np.int64), rows["next"].to_numpy(np.int64).copy()
    at = np.searchsorted(place, to)
    inside = (at < len(place)) & (place[np.minimum(at, len(place) - 1)] == to)
    while inside.any():
        to = np.where(inside, to[np.minimum(at, len(place) - 1)], to)
        at = np.searchsorted(place, to)
        inside = (at < len(place)) & (place[np.minimum(at, len(place) - 1)] == to)
    entry = rows["entry"].to_numpy(bool)
    return pd.DataFrame({"place": place[entry], "next": to[entry]})


def _followed(rows: pd.DataFrame, first: int | None, width: int) -> pd.DataFrame:
    """(block, place, start): which places of a block the jumps from its first reached place reach."""
    rows = rows.sort_values("place")
    place, to = rows["place"].to_numpy(np.int64), rows["next"].to_numpy(np.int64)
    start, p = np.zeros(len(place), bool), first
    while p is not None and p <= place[-1]:
        i = int(np.searchsorted(place, p))
        start[i] = True
        p = int(to[i])
    return pd.DataFrame({"block": place // width, "place": place, "start": start})


def reached(jumps: DataFrame, width: int = BLOCK, wider: int = WIDER) -> DataFrame:
    """(block, place, start), written: whether each place is reached from place 0 by jumps (place, next), which lead forward; block: place / width.

    A block can be entered only where a jump from an earlier one leads into it. Jumps from there to the first place outside are found by pointer doubling inside the block;
    they are jumps of a smaller table, of the entries alone, which is worked out in the same way, in blocks that are `wider` times wider. Then each block follows its jumps from the one entry that is reached.
    """
    block, to = F.floor(F.col("place") / width), F.floor(F.col("next") / width)
    entries = written(jumps.where(block != to).select(F.col("next").alias("place")).distinct(), "entries")
    if entries.isEmpty() or jumps.agg(F.max(block)).first()[0] == 0:
        firsts = jumps.sparkSession.createDataFrame([(0, 0)], "block long, place long")
    else:
        marked = jumps.join(entries.select("place", F.lit(True).alias("entry")), "place", "left").withColumn("entry", F.coalesce("entry", F.col("place") == 0))
        short = written(marked.groupBy(block.alias("block")).applyInPandas(_exits, "place long, next long"), "jumps")
        firsts = reached(short, width * wider, wider).where("start").select(block.alias("block"), "place")

    def follow(rows: pd.DataFrame, first: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:  # an entry behind the last place
            return pd.DataFrame({"block": [], "place": [], "start": []})
        return _followed(rows, int(first["place"].iloc[0]) if len(first) else None, width)

    both = jumps.withColumn("block", block).groupBy("block").cogroup(firsts.groupBy("block"))
    return written(both.applyInPandas(follow, "block long, place long, start boolean"), "starts")


def token_batches(items: DataFrame, key: str, length: str, max_tokens: int, max_items: int = 16, extra: int = 2, hot_rows: int = HOT_ROWS, width: int = BLOCK, wider: int = WIDER) -> DataFrame:
    """items with `batch`, from 0: in the order of falling length, equal ones by key, a batch is closed when the next item would take it over max_tokens or max_items.

    An item costs its length and `extra`; one that costs more than max_tokens is a batch of its own. The same batches come out as from one pass over all items, but
    places and running costs come from row_places(), the next start of each place from a range lookup, and the starts that are reached from pointer doubling in blocks. key tells items
    apart; items with a null length are left out; no items give no rows. A column named batch is an error.
    """
    if "batch" in (c.lower() for c in items.columns):
        raise ValueError("items have a column named batch")
    k, cost = fresh(items, n=2)
    slim = items.select(col(key).alias("key"), col(length).cast("long").alias("length"), (col(length).cast("long") + extra).alias("cost"))
    placed = written(row_places(slim, [], "length", "key", cost="cost", hot_rows=hot_rows).select("key", F.col("place").cast("long").alias("place"), "cost", F.col("before").cast("long").alias("before")), "placed")
    jumps = written(next_starts(placed, max_tokens, max_items), "jumps")
    starts = reached(jumps, width, wider)
    order = Window.partitionBy("block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    blocks = starts.groupBy("block").agg(F.sum(F.col("start").cast("long")).alias("n")).withColumn("n0", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a block
    numbered = starts.withColumn("n1", F.sum(F.col("start").cast("long")).over(order)).join(small(written(blocks.select("block", "n0"), "blocks")), "block")
    batch = placed.join(numbered, "place").select(F.col("key").alias(k), (F.col("n0") + F.col("n1") - 1).alias("batch"))
    return items.join(batch, col(key) == F.col(k)).select(*columns(items), "batch")
