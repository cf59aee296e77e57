"""Sharding by fixed virtual slots.

Records are hashed by key into `SLOTS` virtual slots, once and for all. A map, stored in versions, says which shard holds
a slot; growing or rebalancing edits the map and so moves whole slots. Nothing else decides where a record goes.

* `grown` adds one shard: it takes slots evenly from the others, and no slot moves anywhere else.
* `rebalanced` moves slots from shards with too many bytes to those with too few, by the bytes summed for each slot.
* `numbered` gives each record its gapless place in its shard without ever bringing a shard into one task: rows are kept
  once as files of bounded size, counted for each (file partition, shard), and numbered inside that.

Defined results: a null key has a slot of its own (the hash of null); a null text counts as empty, of size 1; equal keys
share a shard, however many there are; repeated rows have places of their own; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vayuspark.llm.tables import table, written
from vayuspark.session import run_dir

SLOTS = 4096
SHARDS = 16


def grown(slot_map: list[int]) -> list[int]:
    """The map with one shard more. Decided by the map alone: the shard with most slots gives its highest one."""
    shards = max(slot_map) + 1
    held = [[] for _ in range(shards)]
    for slot, shard in enumerate(slot_map):
        held[shard].append(slot)
    heap = [(-len(slots), shard) for shard, slots in enumerate(held)]
    heapq.heapify(heap)
    out = list(slot_map)
    for _ in range(len(slot_map) // (shards + 1)):
        size, shard = heapq.heappop(heap)
        out[held[shard].pop()] = shards
        heapq.heappush(heap, (size + 1, shard))
    return out


def slot_map(shards: int, slots: int = SLOTS) -> list[int]:
    """The map of a number of shards: one shard, grown one by one, so that maps of n and n + 1 shards differ by one step."""
    out = [0] * slots
    for _ in range(shards - 1):
        out = grown(out)
    return out


def rebalanced(slot_map: list[int], slot_bytes: dict[int, int], tolerance: float = 0.02) -> list[int]:
    """The map after moving slots from the fullest to the emptiest shard while that helps by more than `tolerance`."""
    shards = max(slot_map) + 1
    out, load = list(slot_map), [0] * shards
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(out):
        size = slot_bytes.get(slot, 0)
        load[shard] += size
        held[shard].append((size, slot))
    mean = sum(load) / shards
    for _ in range(len(slot_map)):
        full, free = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
        if load[full] <= mean * (1 + tolerance):
            break
        room = (load[full] - load[free]) / 2
        size, slot = max(((s, k) for s, k in held[full] if 0 < s <= room), default=(0, -1))
        if slot < 0:
            break
        held[full].remove((size, slot))
        held[free].append((size, slot))
        load[full] -= size
        load[free] += size
        out[slot] = free
    return out


def with_slot(df: DataFrame, key: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    return df.withColumn("virtual_slot", F.pmod(F.xxhash64(key), F.lit(slots)).cast("int"))


def slot_bytes(df: DataFrame, size: str = "size") -> DataFrame:
    """Rows and bytes of each slot: at most `SLOTS` rows, summed before the shuffle."""
    return df.groupBy("virtual_slot").agg(F.sum(size).alias("slot_bytes"), F.count(F.lit(1)).alias("slot_rows"))


class MapStore:
    """Versions of a slot map under one folder: each version is a table of its own, never changed once written."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def save(self, version: int, slot_map: list[int]) -> DataFrame:
        rows = self.spark.createDataFrame(list(enumerate(slot_map)), "virtual_slot int, shard int")
        rows.coalesce(1).write.mode("error").parquet(f"{self.path}/version={version}")
        return self.load(version)

    def load(self, version: int) -> DataFrame:
        return self.spark.read.schema("virtual_slot int, shard int").parquet(f"{self.path}/version={version}")


def numbered(df: DataFrame, shard: str = "shard", name: str = "slot") -> DataFrame:
    """Rows with a gapless number from 0 in each shard, in the order of the stored rows."""
    kept = written(df.withColumn("_row", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_row", 33).cast("int")), "numbered")
    counts = kept.groupBy(shard, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(shard).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("_part", shard).orderBy("_row")) - 1
    return kept.withColumn("_inside", inside).join(before.drop("_n"), [shard, "_part"]).withColumn(name, (F.col("_before") + F.col("_inside")).cast("long")).drop("_row", "_part", "_before", "_inside")


def op6_virtual_slots(spark, sf_dir: str) -> DataFrame:
    """Law `key`: doc_id and the number of shards decide."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    store = MapStore(spark, run_dir(spark, "llm-slot-map"))
    first = slot_map(SHARDS)
    now = store.save(SHARDS, first)
    more = store.save(SHARDS + 1, grown(first)).withColumnRenamed("shard", "grown_shard")
    maps = F.broadcast(now.join(more, "virtual_slot"))  # SLOTS rows
    placed = numbered(with_slot(docs).join(maps, "virtual_slot"))
    return placed.join(F.broadcast(slot_bytes(placed)), "virtual_slot").select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "virtual_slot", "slot_bytes"
    )
