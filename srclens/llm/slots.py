"""Sharding over fixed virtual slots (DataFrame functions only).

A record is hashed into one of SLOTS virtual slots and never leaves it; a
versioned map tells which shard a slot belongs to. ``slot_sizes`` sums the
bytes of every slot, ``rebalance`` edits a map so that the shards' sizes come
near each other: a shard keeps its slots, largest first, up to the mean, and
what does not fit goes, largest first, to the shard that is smallest by then.
The same edit grows or shrinks the number of shards: a new one starts empty, a
given up one keeps nothing. Records follow their slot's entry; nothing else
moves.

The hash takes the id, the text and the number of the copy among rows equal in
both, so a row that is repeated often is spread over the slots like any other.
Copies are counted per input partition first: a record that holds a third of
all rows reaches the next task as one row per partition.

``MapStore`` keeps the versions as written tables below the shared folder, one
folder each, written once.

Rows: nulls count as rows of their own; a null text has size 1 and checksum 0,
like an empty one. Repeated rows are shared out one by one. An empty table gives
no rows and a map whose slots are all empty. Extra columns are not read. No
text is moved: size, checksum and hash are taken at the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage

SLOTS = 4096
MAP = "slot int, shard int, bytes long, n_rows long"


def records(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, order: one row per row of docs, as a written table."""
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0))
    same = ["doc_id", "size", "text_crc32", "h"]
    rows = docs.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.xxhash64("doc_id", "text").alias("h"))
    per_part = rows.groupBy(*same, F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"))
    before = Window.partitionBy(*same).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    numbered = per_part.withColumn("from", F.coalesce(F.sum("n").over(before), F.lit(0)))
    spread = numbered.repartition("h", "part")  # the parts of a record repeated often go to many tasks before they are rows again
    each = spread.select(*same, F.explode(F.sequence(F.col("from"), F.col("from") + F.col("n") - 1)).alias("copy"))
    order = F.xxhash64("h", "copy")
    return stage(each.select("doc_id", "size", "text_crc32", F.pmod(order, F.lit(SLOTS)).cast("int").alias("virtual_slot"), order.alias("order")), "slots")


def slot_sizes(found: DataFrame) -> DataFrame:
    """slot, bytes, n_rows of all SLOTS slots, empty ones too."""
    sums = found.groupBy(F.col("virtual_slot").alias("slot")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n_rows"))
    every = found.sparkSession.range(SLOTS).select(F.col("id").cast("int").alias("slot"))
    return every.join(sums, "slot", "left").select("slot", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"), F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"))


def first_map(spark: SparkSession, shards: int) -> DataFrame:
    """The map before any size is known: slots in turn."""
    return spark.range(SLOTS).select(F.col("id").cast("int").alias("slot"), (F.col("id") % shards).cast("int").alias("shard"))


def _deal(loose: Column, loads: Column) -> Column:
    """The shard of each loose slot (structs with bytes): always the one with the smallest load, ties to the lower number."""
    start = F.struct(loads.alias("loads"), F.array().cast("array<int>").alias("to"))

    def give(state: Column, slot: Column) -> Column:
        to = (F.array_position(state["loads"], F.array_min(state["loads"])) - 1).cast("int")
        loads = F.transform(state["loads"], lambda x, i: F.when(i == to, x + slot["bytes"]).otherwise(x))
        return F.struct(loads.alias("loads"), F.concat(state["to"], F.array(to)).alias("to"))
    return F.aggregate(loose, start, give, lambda state: state["to"])


def rebalance(old: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The edited map (MAP): old has slot and shard, sizes comes from ``slot_sizes``.

    All tables here have SLOTS rows whatever the input's size, so the edit is one row's work."""
    now = old.select("slot", "shard").join(F.broadcast(sizes), "slot")
    largest = Window.partitionBy("shard").orderBy(F.col("bytes").desc(), "slot")
    mean = F.sum("bytes").over(Window.partitionBy()) / F.lit(shards)
    now = now.withColumn("mean", mean).withColumn("upto", F.sum("bytes").over(largest))
    now = now.withColumn("keeps", (F.col("shard") < shards) & (F.col("upto") <= F.col("mean")))
    kept = F.sort_array(F.collect_list(F.when(F.col("keeps"), F.struct("shard", "slot", "bytes", "n_rows"))))
    loose = F.sort_array(F.collect_list(F.when(~F.col("keeps"), F.struct((-F.col("bytes")).alias("order"), "slot", "bytes", "n_rows"))))
    one = now.agg(kept.alias("kept"), loose.alias("loose"))
    load = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.aggregate(
        "kept", F.lit(0).cast("long"), lambda sum_, x: sum_ + F.when(x["shard"] == s, x["bytes"]).otherwise(0)))
    one = one.withColumn("loads", load).withColumn("to", _deal(F.col("loose"), F.col("loads")))
    moved = F.transform("loose", lambda x, i: F.struct(x["slot"].alias("slot"), F.get("to", i).alias("shard"), x["bytes"].alias("bytes"), x["n_rows"].alias("n_rows")))
    stay = F.transform("kept", lambda x: F.struct(x["slot"].alias("slot"), x["shard"].alias("shard"), x["bytes"].alias("bytes"), x["n_rows"].alias("n_rows")))
    return one.select(F.inline(F.concat(stay, moved)))


@dataclass
class MapStore:
    """Versions of a slot-to-shard map, one written table each below ``path`` (a shared folder)."""

    spark: SparkSession
    path: str

    def read(self, version: int) -> DataFrame:
        return self.spark.read.schema(MAP).parquet(f"{self.path}/version={version}")

    def write(self, version: int, table: DataFrame) -> DataFrame:
        """Written once: a version that exists is an error."""
        table.coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/version={version}")
        return self.read(version)

    def edit(self, version: int, sizes: DataFrame, shards: int) -> DataFrame:
        """The next version: ``version`` rebalanced to these sizes and number of shards."""
        return self.write(version + 1, rebalance(self.read(version), sizes, shards))


def place(found: DataFrame, table: DataFrame) -> DataFrame:
    """records with their shard and slot (the position in the shard, gapless from 0).

    Positions follow virtual slot, then hash: a row's number within its virtual slot, plus the rows of the
    shard's virtual slots before it. The map has SLOTS rows, so it is broadcast."""
    before = Window.partitionBy("shard").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    start = table.select(F.col("slot").alias("virtual_slot"), "shard", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("virtual_slot").orderBy("order", "doc_id", "size", "text_crc32")
    numbered = found.withColumn("nth", F.row_number().over(within) - 1)
    return numbered.join(F.broadcast(start), "virtual_slot").select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("nth")).cast("long").alias("slot"), "virtual_slot")


def assign(docs: DataFrame, store: MapStore, shards: int) -> DataFrame:
    """Every row's shard and slot: version 0 deals the slots in turn, version 1 is edited to their sizes."""
    found = records(docs)
    sizes = stage(slot_sizes(found), "slot-sizes")
    store.write(0, first_map(docs.sparkSession, shards).join(F.broadcast(sizes), "slot").select("slot", "shard", "bytes", "n_rows"))
    return place(found, store.edit(0, sizes, shards))
