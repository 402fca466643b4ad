"""Sharding over fixed virtual slots (operator 4, DataFrame functions only).

Records are hashed into :data:`SLOTS` virtual slots. The bytes of each slot are
aggregated, and a slot-to-shard map is stored as a table with a version. The
first version deals the slots, largest first, each to the lightest shard, so
that the shards' sizes come out near equal (the law ``bytes``). Rebalancing
writes a new version in which only the slots that must move have another shard;
rows are never hashed anew.

The map has ``SLOTS`` rows whatever the input is, so it may pass through the
driver and be broadcast.

Defined results: a null text has no bytes (size 1) and the CRC of the empty
text; rows with a null ``doc_id`` are hashed by their text; equal rows land in
one slot; an empty table gives an empty result and a map of empty slots. Extra
columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from vigil.llm.common import materialise
from vigil.session import scratch_path

SLOTS = 4096
MAP_SCHEMA = "version INT, vslot INT, bytes BIGINT, shard INT"


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``doc_id, size, text_crc32, vslot`` of every row (doc_id, text)."""
    raw = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    return (docs.select("doc_id", raw.alias("raw"))
            .select("doc_id", (F.octet_length("raw") + 1).cast("long").alias("size"),
                    F.crc32("raw").alias("text_crc32"))
            .withColumn("vslot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int")))


def slot_bytes(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``vslot, bytes`` of every virtual slot, empty ones too."""
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("vslot"))
    have = rows.groupBy("vslot").agg(F.sum("size").alias("bytes"))
    return every.join(have, "vslot", "left").select("vslot", F.coalesce("bytes", F.lit(0)).alias("bytes"))


def first_map(weights: dict[int, int], shards: int) -> dict[int, int]:
    """Slots, largest first, each to the shard that is lightest so far."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for slot in sorted(weights, key=lambda k: (-weights[k], k)):
        load, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + weights[slot], shard))
    return out


def rebalanced(weights: dict[int, int], old: dict[int, int], shards: int) -> dict[int, int]:
    """The map edited for another number of shards or changed slot sizes: a slot
    stays where it is unless its shard is gone or holds more than its share."""
    total = sum(weights.values())
    share = total / shards
    new, load, moving = {}, [0] * shards, []
    for slot in sorted(weights, key=lambda k: (-weights[k], k)):
        at = old[slot]
        if at < shards and load[at] + weights[slot] <= share:
            new[slot] = at
            load[at] += weights[slot]
        else:
            moving.append(slot)
    heap = [(load[s], s) for s in range(shards)]
    heapq.heapify(heap)
    for slot in moving:
        held, shard = heapq.heappop(heap)
        new[slot] = shard
        heapq.heappush(heap, (held + weights[slot], shard))
    return new


class SlotMap:
    """The stored map: one Parquet folder per version below ``path``."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch_path(spark, "slot-map")

    def store(self, version: int, weights: dict[int, int], shard_of: dict[int, int]) -> DataFrame:
        rows = [(version, k, weights[k], shard_of[k]) for k in sorted(weights)]
        (self.spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1)
         .write.mode("overwrite").parquet(f"{self.path}/version={version:06d}"))
        return self.load(version)

    def load(self, version: int) -> DataFrame:
        return self.spark.read.schema(MAP_SCHEMA).parquet(f"{self.path}/version={version:06d}")


def weights_of(per_slot: DataFrame) -> dict[int, int]:
    return {r["vslot"]: r["bytes"] for r in per_slot.collect()}


def assign(rows: DataFrame, slot_map: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``, the row's place in its shard, from
    0 without gaps.

    Places are numbered inside (virtual slot, part) and shifted by the rows
    before them, so no task holds a shard; the offsets have at most ``slots``
    times :data:`PARTS` rows.
    """
    rows = rows.withColumn("part", F.pmod(F.xxhash64("size", "text_crc32", "doc_id"), F.lit(PARTS)).cast("int"))
    small = F.broadcast(slot_map.select("vslot", "shard"))  # one row per virtual slot
    counts = rows.groupBy("vslot", "part").agg(F.count("*").alias("n")).join(small, "vslot")
    before = (W.Window.partitionBy("shard").orderBy("vslot", "part")
              .rowsBetween(W.Window.unboundedPreceding, -1))
    offsets = materialise(counts.select("vslot", "part", "shard", F.coalesce(
        F.sum("n").over(before), F.lit(0)).alias("offset")), "slot-offsets")
    place = F.row_number().over(W.Window.partitionBy("vslot", "part").orderBy("doc_id", "text_crc32", "size"))
    return (rows.withColumn("place", place)
            .join(F.broadcast(offsets), ["vslot", "part"])
            .withColumn("slot", (F.col("offset") + F.col("place") - 1).cast("long"))
            .drop("offset", "place", "part"))


PARTS = 4


def shard_by_bytes(docs: DataFrame, shards: int = 8, slots: int = SLOTS) -> DataFrame:
    """``doc_id, size, text_crc32, vslot, shard, slot`` of every row, and the
    stored map as its version 1."""
    rows = materialise(sized(docs, slots), "sharding-rows")
    weights = weights_of(slot_bytes(rows, slots))
    slot_map = SlotMap(docs.sparkSession).store(1, weights, first_map(weights, shards))
    return assign(rows, slot_map, slots)


def op4_virtual_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = shard_by_bytes(docs)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"),
                      "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
                      "vslot")
