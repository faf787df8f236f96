"""Cutting lineage in the folder that all executors share, fresh column names, and joins on hot keys."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one key beyond which a join on it is dealt out over salts.
HOT_ROWS = 500_000
#: Rows of a counted table up to which it is broadcast.
BROADCAST_ROWS = 100_000
#: Rows of a task that sorts them, and rows of a table up to which it is left to Spark how it is dealt out.
TASK_ROWS, FEW_ROWS = 250_000, 3_000_000
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset, a folder of our own, in local mode only; it goes when Python ends."""
    conf = spark.sparkContext.getConf()
    named = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return _OWN[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder, read back: survives lost executors, columnar and compressed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/chainloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """A step of an iteration, written and read back.

    A checkpoint() keeps the size estimate of the plan it cuts off, and estimates of joins are products: over some twenty rounds
    of joins they grow to numbers of millions of digits, and planning never ends. A file has the size it has.
    """
    return written(df, "step")


def discard(df: DataFrame) -> None:
    """Remove the files of a written() table that nothing reads any more."""
    spark = df.sparkSession
    base = shared_dir(spark)
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/chainloom-" in path and path.split("/chainloom-")[0].split(":", 1)[-1].lstrip("/") == base.split(":", 1)[-1].lstrip("/"):
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def fresh(*frames: DataFrame, n: int = 1, prefix: str = "_x") -> list[str]:
    """n column names that none of the frames has, whatever the case."""
    taken = {c.lower() for f in frames for c in f.columns}
    out, k = [], 0
    while len(out) < n:
        name = f"{prefix}{k}"
        if name.lower() not in taken:
            out.append(name)
        k += 1
    return out


def free_names(df: DataFrame, *names: str) -> None:
    """An error if df has a column of one of these names, which an operator adds."""
    taken = sorted({c.lower() for c in df.columns} & {n.lower() for n in names})
    if taken:
        raise ValueError(f"the table has columns named {', '.join(taken)}, which are added here: rename them first")


def col(name: str) -> Column:
    """A column by its whole name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns(df: DataFrame) -> list[Column]:
    """All columns of df, by whole names."""
    return [col(c) for c in df.columns]


def small(table: DataFrame) -> DataFrame:
    """table, broadcast if its counted rows are few; a table that is read twice should be written."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def dealt(rows: DataFrame, key: str, task_rows: int = TASK_ROWS, few: int = FEW_ROWS) -> DataFrame:
    """rows dealt out by a key into tasks of about task_rows each, as many as the counted rows ask for: a fixed number of shuffle partitions would let each one grow with the table."""
    n = rows.count()
    return rows if n <= few else rows.repartition(-(-n // task_rows), col(key))


def spread_join(rows: DataFrame, table: DataFrame, key: str, how: str = "left", hot_rows: int = HOT_ROWS) -> DataFrame:
    """rows joined by key with table, whose keys are unique; rows of a key with more than hot_rows rows are dealt out over salts.

    Only keys above the limit are salted, so there are at most rows / hot_rows of them and each adds one row of the table per hot_rows of its
    rows; salts are hashes of whole rows, so a retried task deals alike. Null keys match nothing. Both tables should be cheap to read twice.
    """
    hot = rows.where(col(key).isNotNull()).groupBy(col(key).alias("k")).count().where(F.col("count") > hot_rows).select("k", F.ceil(F.col("count") / hot_rows).cast("int").alias("n"))
    hot = written(hot, "hot")
    if hot.isEmpty():
        return rows.join(table, key, how)
    k, n, salt = fresh(rows, table, n=3, prefix="_salt")
    hot = hot.select(F.col("k").alias(k), F.col("n").alias(n))
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot
    left = rows.join(hot, col(key) == F.col(k), "left").withColumn(salt, F.when(F.col(n).isNull(), 0).otherwise(F.pmod(F.xxhash64(*columns(rows)), F.col(n))).cast("int")).drop(k, n)
    right = table.join(hot, col(key) == F.col(k), "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(n), F.lit(1)) - 1))).drop(k, n)
    return left.join(right, [key, salt], how).drop(salt)
