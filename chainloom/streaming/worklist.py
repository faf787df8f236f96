"""Incremental work lists: what is not done yet, or not with its present content, as a batch or as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.packing import token_batches  # noqa: F401  batches of what is pending
from ..plans.materialize import col, fresh

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def pending(items: DataFrame, manifest: DataFrame, key: str, content_hash: str | None = None) -> DataFrame:
    """Items without an entry in the manifest, or, with content_hash, without one of their hash; works on a stream of items against a static manifest, too.

    Both tables name the columns alike. Null keys are pending always; repeated items stay repeated; an empty manifest leaves all items.
    """
    names = [key] if content_hash is None else [key, content_hash]
    own = fresh(items, manifest, n=len(names))
    done = manifest.select(*[col(c).alias(x) for c, x in zip(names, own, strict=True)]).distinct()
    match = [col(c) == F.col(x) for c, x in zip(names, own, strict=True)]
    return items.join(done, match, "left_outer").where(F.col(own[0]).isNull()).drop(*own) if items.isStreaming else items.join(done, match, "left_anti")


def manifest_rows(items: DataFrame, key: str, content: str, status: str = "done") -> DataFrame:
    """(key, status, hash) of items: hash is the SHA-1 of the content, null for null."""
    return items.select(key, F.lit(status).alias("status"), F.sha1(F.col(content).cast("binary")).alias("hash"))


def due(steps: DataFrame, key: str) -> DataFrame:
    """(key, at, hash, reason): arrivals that are to be worked on, of a whole history of steps (key, at, hash, status).

    A step with a null status is an arrival of an item with a content; others, done and failed, are outcomes of a content. An arrival is due if it is the item's first ("new"), if its hash is not that of the arrival
    before ("changed"), or if the last thing known of this content is a failure ("again"). Outcomes of other contents than the last one that arrived say nothing. Steps go by `at`, outcomes before arrivals of one
    place, then by hash. Null keys are one item; a null hash is a content; an empty table gives no rows. due_stream() gives the same rows of a stream.
    """
    code = F.coalesce("hash", F.lit(""))
    order = Window.partitionBy(key).orderBy(F.asc("at"), F.col("status").isNull(), code, "status")
    known = F.last(F.when(F.col("status").isNull(), code), True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    k, b = fresh(steps, n=2)
    told = steps.withColumn(k, known).where(F.col("status").isNull() | (code == F.col(k))).withColumn(b, F.lag(F.coalesce("status", F.lit("new"))).over(order))
    reason = F.when(F.col(k).isNull(), "new").when(F.col(k) != code, "changed").when(F.col(b) == "failed", "again")
    return told.where("status is null").select(key, "at", "hash", reason.alias("reason")).where("reason is not null")


class DueItems(StatefulProcessor):
    """State of an item: the hash of the content that arrived last, and what is known of it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("content", "hash string, status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        steps = [(r.at, r.status is None, r.hash or "", r.status or "", r.hash) for part in rows for r in part.astype(object).where(part.notna(), None).itertuples()]
        known, status = self.state.get() if self.state.exists() else (None, None)
        out = []
        for at, arrives, code, said, content in sorted(steps, key=lambda s: s[:4]):
            if not arrives:
                status = said if code == known else status
                continue
            reason = "new" if known is None else "changed" if code != known else "again" if status == "failed" else None
            if reason:
                out.append((key[0], at, content, reason))
            known, status = code, "new" if reason else status
        if known is not None:
            self.state.update((known, status))
        if out:
            yield pd.DataFrame(out, columns=["item", "at", "hash", "reason"])

    def close(self) -> None:
        pass


def due_stream(steps: DataFrame, key: str) -> DataFrame:
    """due() of a stream of steps, by a state for each item, kept in RocksDB (spark.sql.streaming.stateStore.providerClass must name STATE_STORE). Micro-batches must come in the order of `at`."""
    kinds = dict(steps.dtypes)
    slim = steps.select(col(key).alias("item"), F.col("at").cast("long").alias("at"), "hash", "status")
    return slim.groupBy("item").transformWithStateInPandas(DueItems(), f"item {kinds[key]}, at long, hash string, reason string", "Append", "None").withColumnRenamed("item", key)
