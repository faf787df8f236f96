"""How the star-schema tables stand in for chains, residues, records and runs; Spark and SQL forms of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.labels import AMINO_ACIDS
from .materialize import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_quantity", "l_discount", "l_tax"]


def residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as positions of a chain; the order gives weight, fold, seed and split."""
    lines, orders = dealt(table(spark, sf_dir, "lineitem"), "l_orderkey"), table(spark, sf_dir, "orders")
    o = orders.select(F.col("o_orderkey").alias("chain"), (1.0 + F.col("o_custkey") % 4).alias("weight"), (F.col("o_orderkey") % 5).cast("int").alias("fold"), (F.col("o_custkey") % 3).cast("int").alias("seed"), F.element_at(F.lit(["train", "val", "test"]), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("split"))
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*ORDER)) - 1
    r = lines.select(
        F.col("l_orderkey").alias("chain"), pos.alias("pos"), (F.col("l_returnflag") == "R").cast("int").alias("label"), F.col("l_extendedprice").alias("score"), F.col("l_discount").alias("tied"),
        F.substr(F.lit(AMINO_ACIDS), (F.col("l_partkey") % 20 + 1).cast("int"), F.lit(1)).alias("aa"), F.col("l_quantity").alias("quantity"), (F.col("l_tax") * 10).alias("rsa"), (F.col("l_suppkey") % 5).cast("int").alias("prior"),
    )
    return r.join(o, "chain")


RESIDUES = f"""res AS (SELECT l.l_orderkey AS chain, (row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(ORDER)}) - 1)::INT AS pos,
CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, l_extendedprice AS score, l_discount AS tied, substr('{AMINO_ACIDS}', (l_partkey % 20 + 1)::INT, 1) AS aa, l_quantity AS quantity, l_tax * 10 AS rsa, (l_suppkey % 5)::INT AS prior,
1.0::DOUBLE + o_custkey % 4 AS weight, (o_orderkey % 5)::INT AS fold, (o_custkey % 3)::INT AS seed, (['train', 'val', 'test'])[(o_orderkey % 3 + 1)::INT] AS split FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)"""


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as chains of a cluster hierarchy: region, nation, customer, order."""
    o, c, n = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return j.select(
        F.col("o_orderkey").alias("chain"), F.col("n_regionkey").alias("cluster_2"), F.col("n_nationkey").alias("cluster_1"), F.col("c_custkey").alias("parent"), F.concat(F.lit("split"), (F.col("o_orderkey") % 5).cast("string")).alias("split"), F.col("o_totalprice").alias("price"),
        F.concat_ws(".", (F.col("o_custkey") % 7 + 1).cast("string"), F.substring("o_orderpriority", 1, 1), F.when(F.col("o_orderkey") % 11 == 0, "-").otherwise((F.col("o_orderkey") % 13).cast("string"))).alias("ec"), F.col("c_mktsegment").alias("segment"), F.col("o_orderstatus").alias("status"),
    )


CHAINS = """chains AS (SELECT o_orderkey AS chain, n_regionkey AS cluster_2, n_nationkey AS cluster_1, c_custkey AS parent, 'split' || (o_orderkey % 5)::VARCHAR AS split, o_totalprice AS price,
(o_custkey % 7 + 1)::VARCHAR || '.' || substr(o_orderpriority, 1, 1) || '.' || CASE WHEN o_orderkey % 11 = 0 THEN '-' ELSE (o_orderkey % 13)::VARCHAR END AS ec, c_mktsegment AS segment, o_orderstatus AS status
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as runs: a user is a configuration, the event type a model, the hour a seed and the day a fold."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("run"), F.col("user_id").alias("config"), F.col("event_type").alias("model"), (F.hour("ts") % 3).cast("int").alias("seed"), (F.dayofmonth("ts") % 5).cast("int").alias("fold"), F.col("value"), F.get_json_object("props", "$.k").cast("int").alias("k"))


RUNS = "runs AS (SELECT event_id AS run, user_id AS config, event_type AS model, (hour(ts) % 3)::INT AS seed, (day(ts) % 5)::INT AS fold, value, CAST(props->>'$.k' AS INT) AS k FROM events)"


def screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position sets of a user: hours with clicks or views are predicted, hours with purchases or errors known."""
    e = table(spark, sf_dir, "events")
    types = e.select(F.col("user_id").alias("id"), F.hour("ts").alias("h"), F.col("event_type").alias("t"), F.col("value"))
    return types.groupBy("id").agg(F.collect_set(F.when(F.col("value") >= 20, F.col("h"))).alias("predicted"), F.collect_set(F.when(F.col("t").isin("purchase", "error") & (F.col("value") >= 30), F.col("h"))).alias("known"))


SCREENS = """screens AS (SELECT user_id AS id, coalesce(list(DISTINCT hour(ts)::INT) FILTER (value >= 20), []) AS predicted, coalesce(list(DISTINCT hour(ts)::INT) FILTER (event_type IN ('purchase', 'error') AND value >= 30), []) AS known FROM events GROUP BY user_id)"""
