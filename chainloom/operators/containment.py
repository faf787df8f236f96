"""Which keys stand in which texts, as they are: one automaton for a block of keys, and each text read once for it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import col

#: Bytes of keys of one automaton.
KEY_BYTES = 4 << 20


def key_blocks(keys: DataFrame, key: str, most: int) -> Iterator[list[str]]:
    """Distinct keys, `most` bytes or one key at a time."""
    now, size = [], 0
    for (k,) in keys.where(col(key).isNotNull() & (col(key) != "")).select(col(key).cast("string")).distinct().toLocalIterator():
        n = len(k.encode())
        if now and size + n > most:
            yield now
            now, size = [], 0
        now.append(k)
        size += n
    if now:
        yield now


def containing(texts: DataFrame, text_id: str, text: str, keys: DataFrame, key: str, key_bytes: int = KEY_BYTES) -> DataFrame:
    """(id, key): every text id with each different key that its text contains anywhere, as contains() has it; no text is compared with keys one by one.

    Keys are taken in blocks by size; each task builds the automaton of a block once and runs its texts through it. Null texts contain nothing; null and empty keys are in nothing; repeated keys count once, and
    repeated rows of texts are rows of their own. Empty tables give no rows.
    """
    kind, out = dict(texts.dtypes)[text_id], None
    for block in key_blocks(keys, key, key_bytes):

        def find(frames: Iterator[pd.DataFrame], block: list[str] = block) -> Iterator[pd.DataFrame]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for k in block:
                automaton.add_word(k, k)
            automaton.make_automaton()
            for f in frames:
                rows = [(i, k) for i, t in zip(f["id"].tolist(), f["text"].tolist(), strict=True) for k in sorted({k for _, k in automaton.iter(t)})]
                yield pd.DataFrame(rows, columns=["id", "key"])

        found = texts.where(col(text).isNotNull()).select(col(text_id).alias("id"), col(text).cast("string").alias("text")).mapInPandas(find, f"id {kind}, key string")
        out = found if out is None else out.unionByName(found)
    return texts.sparkSession.createDataFrame([], f"id {kind}, key string") if out is None else out


def disagreements(contained: DataFrame, joined: DataFrame) -> DataFrame:
    """(id, key, only): pairs (id, key) that only containment has, or only a join by keys (see lookup.by_prefix())."""
    a, b = contained.select("id", "key").distinct(), joined.select("id", F.col("key").cast("string").alias("key")).distinct()
    return a.join(b, ["id", "key"], "left_anti").withColumn("only", F.lit("contained")).unionByName(b.join(a, ["id", "key"], "left_anti").withColumn("only", F.lit("joined")))
