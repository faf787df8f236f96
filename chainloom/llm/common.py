"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text handled at once inside a task.
SLICE_BYTES = 2 << 20


def ship_code(spark: SparkSession) -> None:
    """Let local Python workers find this library when it is not installed; clusters ship it as a package.

    Workers are forked, so numpy gets one thread each: Spark's tasks are the parallelism.
    """
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS"):
        env.setdefault(name, "1")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slices(batches: Iterator[pa.RecordBatch], text: int = 1, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each slice stay near `most` bytes; no row is left out or cut."""
    for batch in batches:
        start = size = 0
        lengths = pa.compute.binary_length(batch.column(text)).to_pylist()
        for i, n in enumerate(lengths):
            size += (n or 0) + 16
            if size >= most:
                yield batch.slice(start, i + 1 - start)
                start, size = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)
    pa.default_memory_pool().release_unused()  # the worker waits for other tasks


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()
