"""Sharding by fixed virtual slots, in DataFrame functions only.

Records are hashed into a fixed number of slots, far more than there are shards. Bytes and rows are added up by slot, and a versioned map
says which shard a slot is in. Rebalancing edits the map: slots move from shards over their share to the lightest one, and only rows of moved
slots change their place. A record's slot never changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.materialize import BROADCAST_ROWS, HOT_ROWS, col, written

#: Virtual slots. Tables of slots have this many rows, whatever the input.
SLOTS = 4096
OVERHEAD = 8


def record_key(doc_id: Column, text: Column) -> Column:
    """48 bits of the MD5 of "id:text"; a null id is "null", a null text empty."""
    whole = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, 12), 16, 10).cast("long")


def records(docs: DataFrame, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, key, virtual_slot, part), written: one row per row, without the text. part is the task that wrote it."""
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), record_key(col(id_col), text).alias("key"),
    )
    return written(rows.withColumn("virtual_slot", F.pmod("key", F.lit(slots))).withColumn("part", F.spark_partition_id()), "records")


def slot_sizes(rows: DataFrame) -> DataFrame:
    """(virtual_slot, bytes, rows) of the slots that hold records; summed in each task before rows are sent."""
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1 of a map (version, virtual_slot, shard): slots dealt in turn, whatever they will hold."""
    return spark.range(slots).select(F.lit(1).alias("version"), F.col("id").alias("virtual_slot"), (F.col("id") % shards).cast("int").alias("shard"))


def edited(slot_map: DataFrame, sizes: DataFrame, shards: int, into: int | None = None) -> DataFrame:
    """The next version of a map (version, virtual_slot, shard): slots of shards over their share of bytes are moved, others stay.

    Slots go from large to small, equal ones by number. A slot moves if its shard holds more than the mean and the receiving shard, with it, less than
    its shard holds: the lightest shard (the first of equals), or `into` alone, which is how a shard is added: no slot moves between the others. Both tables have at most
    one row per virtual slot, so the pass is one fold over a list of that length.
    """
    now = slot_map.join(sizes, "virtual_slot", "left").select("version", "virtual_slot", "shard", F.coalesce("bytes", F.lit(0)).alias("bytes"))
    all_slots = now.agg(F.max("version").alias("version"), F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "virtual_slot", "shard"))).alias("slots"))
    zero = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.lit(0).cast("long"))
    put = lambda loads, shard, b: F.transform(loads, lambda x, i: F.when(i == shard, x + b).otherwise(x))
    loads = F.aggregate("slots", zero, lambda acc, s: put(acc, s["shard"], -s["less"]))
    total = F.aggregate("slots", F.lit(0).cast("long"), lambda acc, s: acc - s["less"])

    def step(acc: Column, s: Column) -> Column:
        loads, b = acc["loads"], -s["less"]
        own = F.get(loads, s["shard"])
        to = (F.array_position(loads, F.array_min(loads)) - 1).cast("int") if into is None else F.lit(into)
        moves = (own * shards > F.col("total")) & (F.get(loads, to) + b < own) & (b > 0)
        if into is not None:
            moves = moves & ((F.get(loads, to) + b) * shards <= F.col("total"))
        after = put(put(loads, s["shard"], -b), to, b)
        return F.struct(F.when(moves, after).otherwise(loads).alias("loads"), F.concat(acc["map"], F.array(F.struct(s["virtual_slot"], F.when(moves, to).otherwise(s["shard"]).alias("shard")))).alias("map"))

    start = F.struct(F.col("loads").alias("loads"), F.array().cast("array<struct<virtual_slot:bigint,shard:int>>").alias("map"))
    done = all_slots.select("version", "slots", loads.alias("loads"), total.alias("total")).select("version", F.explode(F.aggregate("slots", start, step, lambda acc: acc["map"])).alias("m"))
    return done.select((F.col("version") + 1).alias("version"), "m.virtual_slot", "m.shard")


def store_map(slot_map: DataFrame, path: str) -> None:
    """Add the versions in slot_map to the map stored at path; versions that are there stay as they are."""
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def stored_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the stored map, the last one by default."""
    stored = spark.read.schema("virtual_slot long, shard int, version int").parquet(path).select("version", "virtual_slot", "shard")
    newest = stored.agg(F.max("version").alias("version")) if version is None else spark.range(1).select(F.lit(version).alias("version"))
    return stored.join(F.broadcast(newest), "version")  # one row


def placed(rows: DataFrame, slot_map: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """rows of records() with shard and place: the place within the shard, from 0, without a gap.

    Within a shard rows go by virtual slot, then by key, id and checksum. A slot with more than hot_rows rows (records that are repeated, or more input than
    slots can spread) is cut into pieces by key and writing task, which go one after another, so no task ranks more than about hot_rows rows.
    Offsets of pieces are running counts over a table of slots and pieces.
    """
    at = slot_map.select("virtual_slot", "shard").join(slot_sizes(rows), "virtual_slot").select("virtual_slot", "shard", F.ceil(F.col("rows") / hot_rows).alias("pieces"))
    cut = rows.join(F.broadcast(at), "virtual_slot").withColumn("piece", F.when(F.col("pieces") == 1, 0).otherwise(F.pmod(F.xxhash64("key", "doc_id", "part"), "pieces")))  # one row a slot
    before = Window.partitionBy("shard").orderBy("virtual_slot", "piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = written(cut.groupBy("shard", "virtual_slot", "piece").agg(F.count("*").alias("n")).select("virtual_slot", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "pieces")
    pieces = F.broadcast(pieces) if pieces.count() <= BROADCAST_ROWS else pieces
    rank = F.row_number().over(Window.partitionBy("virtual_slot", "piece").orderBy("key", "doc_id", "text_crc32"))
    return cut.join(pieces, ["virtual_slot", "piece"]).withColumn("place", (F.col("before") + rank - 1).cast("long")).drop("pieces", "piece", "before")


def sharded(docs: DataFrame, shards: int, map_path: str, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", hot_rows: int = HOT_ROWS) -> DataFrame:
    """(doc_id, size, text_crc32, key, virtual_slot, part, version, shard, place): every row in its shard by the map at map_path.

    The map's last version is edited to the bytes of these docs and the new version is stored beside it; a path without a map gets version 1 first (see first_map()).
    Sizes of shards end nearly equal: further moves would not bring the heaviest below the lightest with any slot moved. Null texts have no bytes, null ids
    are spread by their texts; repeated rows are in one slot; columns of other names are not read. An empty table gives no rows, and a map as it was.
    """
    spark, rows = docs.sparkSession, records(docs, slots, id_col, text_col)
    try:
        before = stored_map(spark, map_path)
        before.isEmpty()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        store_map(first_map(spark, shards, slots), map_path)
        before = stored_map(spark, map_path)
    store_map(edited(before, slot_sizes(rows), shards), map_path)
    after = stored_map(spark, map_path)
    version = after.select("version").limit(1)
    return placed(rows, after, hot_rows).crossJoin(F.broadcast(version))
