"""Sharding through fixed virtual slots and a versioned slot-to-shard map.

Every record hashes into one of ``slots`` virtual slots for good. A map row ``version, slot, shard`` says where a slot
lies; moving data means editing a few map rows into a new version. Maps have one row per slot whatever the data, so
they may be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

SLOTS = 8192


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The virtual slot of a record; it depends on the key alone. A null key has a slot of its own hash too."""
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes plus 1; a null text has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1: slots dealt in turn."""
    slot = F.col("id").cast("int")
    return spark.range(0, slots, 1, 1).select(F.lit(1).alias("version"), slot.alias("slot"), (slot % shards).alias("shard"))


def grow(slot_map: DataFrame, shards: int) -> DataFrame:
    """The next version for one shard more: shard number ``shards`` takes an equal part of every old shard's slots.

    Only those slots move. Which ones depends on slot numbers and the count of shards alone.
    """
    own = Window.partitionBy("shard")
    place = F.row_number().over(own.orderBy("slot"))
    kept = F.ceil(F.count(F.lit(1)).over(own) * F.lit(shards) / F.lit(shards + 1))
    return slot_map.select(
        (F.col("version") + 1).alias("version"), "slot",
        F.when(place > kept, F.lit(shards)).otherwise(F.col("shard")).alias("shard"),
    )


def slot_sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """``slot, rows, bytes``: one row per used slot, summed map-side first."""
    sized = docs.select(slot_of(F.col(key), slots).alias("slot"), text_bytes(F.col(text)).alias("size"))
    return sized.groupBy("slot").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))


def rebalance(slot_map: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The next version with near equal bytes: an over-full shard gives slots up, under-full ones take them.

    A shard keeps its slots, largest first, while they fit the fair part of all bytes; the slots beyond are laid end to
    end over the free room of the shards. The bound on any shard is its fair part plus one slot. A slot moves only if
    its shard is over-full.
    """
    full = slot_map.join(sizes, "slot", "left").select(
        "version", "slot", "shard", F.coalesce("bytes", F.lit(0)).alias("bytes")
    )
    fair = F.sum("bytes").over(Window.partitionBy("version")) / F.lit(shards)
    up_to = Window.partitionBy("shard").orderBy(F.desc("bytes"), "slot").rowsBetween(Window.unboundedPreceding, 0)
    full = full.withColumn("fair", fair).withColumn("filled", F.sum("bytes").over(up_to))
    stays = full.filter("filled <= fair")
    numbers = slot_map.sparkSession.range(0, shards, 1, 1).select(F.col("id").cast("int").alias("shard"))
    held = numbers.join(stays.groupBy("shard").agg(F.sum("bytes").alias("held")), "shard", "left")
    part = full.agg(F.max("fair").alias("fair"))
    room = held.join(F.broadcast(part), F.lit(True)).select(  # one row
        "shard", F.greatest(F.lit(0.0), F.col("fair") - F.coalesce("held", F.lit(0))).alias("room")
    )
    ends = Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    room = room.withColumn("to", F.sum("room").over(ends)).withColumn("from", F.col("to") - F.col("room"))
    room = room.withColumn("last", F.col("shard") == F.max("shard").over(Window.partitionBy(F.lit(0))))
    goes = full.filter("filled > fair")
    before = Window.partitionBy("version").orderBy(F.desc("bytes"), "slot").rowsBetween(Window.unboundedPreceding, -1)
    goes = goes.withColumn("at", F.coalesce(F.sum("bytes").over(before), F.lit(0))).drop("shard")
    inside = (F.col("at") >= F.col("from")) & ((F.col("at") < F.col("to")) | F.col("last"))
    moved = goes.join(F.broadcast(room), inside)  # one row per shard; each slot falls into one range
    return stays.select("version", "slot", "shard").unionByName(moved.select("version", "slot", "shard")).withColumn(
        "version", F.col("version") + 1
    )


def store_map(slot_map: DataFrame, path: str) -> None:
    """Add a version to the map table at ``path``; earlier versions stay readable."""
    slot_map.write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of a stored map, by default the latest."""
    maps = spark.read.parquet(path)
    if version is None:
        version = maps.agg(F.max("version")).first()[0]
    return maps.filter(F.col("version") == version).select("version", "slot", "shard")


def assign(
    docs: DataFrame, slot_map: DataFrame, grown: DataFrame | None = None, key: str = "doc_id", text: str = "text",
    slots: int = SLOTS, balanced: DataFrame | None = None,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot``, and
    ``balanced_shard`` if a map ``balanced`` is given.

    ``slot`` numbers the rows of a shard from 0 without a gap: rows are numbered inside their virtual slot, and the
    virtual slots of a shard are laid end to end, so no shard is ever sorted as a whole. A null text has size 1 and the
    checksum of no bytes. Rows without a key share one virtual slot; equal keys are numbered by size and checksum.
    """
    rows = docs.select(
        F.col(key).alias("doc_id"), text_bytes(F.col(text)).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        slot_of(F.col(key), slots).alias("virtual_slot"),
    )
    counts = rows.groupBy("virtual_slot").agg(F.count(F.lit(1)).alias("n"))
    placed = slot_map.select(F.col("slot").alias("virtual_slot"), "shard").join(counts, "virtual_slot", "left")
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.select("virtual_slot", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    if grown is not None:
        placed = placed.join(grown.select(F.col("slot").alias("virtual_slot"), F.col("shard").alias("grown_shard")), "virtual_slot")
    else:
        placed = placed.withColumn("grown_shard", F.lit(None).cast("int"))
    if balanced is not None:
        even = balanced.select(F.col("slot").alias("virtual_slot"), F.col("shard").alias("balanced_shard"))
        placed = placed.join(even, "virtual_slot")
    inside = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32"))
    numbered = rows.withColumn("nth", inside)
    return numbered.join(F.broadcast(placed), "virtual_slot").select(  # one row per virtual slot
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("first") + F.col("nth") - 1).cast("bigint").alias("slot"), "grown_shard", "virtual_slot",
        *(["balanced_shard"] if balanced is not None else []),
    )
