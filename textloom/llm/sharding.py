"""Sharding by fixed virtual slots and a stored, versioned slot-to-shard map.

A record's virtual slot is a hash of its doc_id and never changes; only the map from slots to shards does. Bytes are
summed by slot (a fixed number of rows, whatever the input), slots are dealt to shards so that bytes are near equal,
and every edit of the map is stored as a new version. A change of the number of shards moves as few bytes as it can.

Defined cases: a null text has no bytes and the crc32 of an empty text; rows with null doc_id are spread by their
text; rows that repeat a doc_id share a virtual slot and follow one another in it by text hash; texts are only hashed and
measured, however long; an empty table gives an empty result; only doc_id and text are read, and assign() carries the
rest of a row as one value, so no further column clashes.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, table, text_bytes, text_crc32

SLOTS = 4096
#: What a record takes besides its text.
RECORD_BYTES = 16


def virtual_slot(doc_id: Column, text: Column, slots: int = SLOTS) -> Column:
    # the text is hashed only where there is no doc_id, so that rows without one do not meet in one slot
    return F.pmod(F.when(doc_id.isNull(), F.xxhash64(text)).otherwise(F.xxhash64(doc_id)), F.lit(slots)).cast("int")


@dataclass(frozen=True)
class SlotMap:
    """version, number of shards, and the shard of each virtual slot."""

    version: int
    shards: int
    shard_of: tuple[int, ...]

    @classmethod
    def balanced(cls, slot_bytes: Sequence[int], shards: int) -> SlotMap:
        """Largest slot first, always to the shard with the fewest bytes."""
        load = [(0, 0, s) for s in range(shards)]
        shard_of = [0] * len(slot_bytes)
        for slot in sorted(range(len(slot_bytes)), key=lambda i: (-slot_bytes[i], i)):
            size, n, s = heapq.heappop(load)
            shard_of[slot] = s
            heapq.heappush(load, (size + slot_bytes[slot], n + 1, s))
        return cls(1, shards, tuple(shard_of))

    def grown(self, slot_bytes: Sequence[int], shards: int) -> SlotMap:
        """The next version with more shards: rows move only into new shards, each taking slots from the fullest others."""
        shard_of = list(self.shard_of)
        owned: list[list[int]] = [[] for _ in range(shards)]
        load = [0] * shards
        for slot, s in enumerate(shard_of):
            owned[s].append(slot)
            load[s] += slot_bytes[slot]
        for own in owned:
            own.sort(key=lambda i: (slot_bytes[i], -i))
        mean = sum(load) / shards
        for new in range(self.shards, shards):
            while load[new] < mean:
                fullest = max(range(self.shards), key=lambda s: (load[s], -s))
                fits = [i for i in owned[fullest] if load[new] + slot_bytes[i] <= mean]
                if load[fullest] <= mean or not fits:
                    break
                slot = fits[-1]
                owned[fullest].remove(slot)
                shard_of[slot] = new
                load[fullest] -= slot_bytes[slot]
                load[new] += slot_bytes[slot]
        return replace(self, version=self.version + 1, shards=shards, shard_of=tuple(shard_of))

    def rebalanced(self, slot_bytes: Sequence[int], tolerance: float = 0.02) -> SlotMap:
        """The next version for changed bytes: slots move from the fullest to the emptiest shard until none is more than tolerance over the mean."""
        shard_of = list(self.shard_of)
        load = [0] * self.shards
        for slot, s in enumerate(shard_of):
            load[s] += slot_bytes[slot]
        mean = sum(load) / self.shards
        for _ in range(len(shard_of)):
            full, low = max(range(self.shards), key=load.__getitem__), min(range(self.shards), key=load.__getitem__)
            gap = load[full] - load[low]
            fits = [i for i, s in enumerate(shard_of) if s == full and 0 < slot_bytes[i] < gap]
            if load[full] <= mean * (1 + tolerance) or not fits:
                break
            slot = min(fits, key=lambda i: (abs(slot_bytes[i] - gap / 2), i))
            shard_of[slot] = low
            load[full] -= slot_bytes[slot]
            load[low] += slot_bytes[slot]
        return replace(self, version=self.version + 1, shard_of=tuple(shard_of))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.version, self.shards, i, s) for i, s in enumerate(self.shard_of)], "version int, shards int, virtual_slot int, shard int")

    def store(self, spark: SparkSession, path: str) -> None:
        """Adds this version to the history at path."""
        self.frame(spark).coalesce(1).write.mode("append").partitionBy("version").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        history = spark.read.parquet(path)
        if version is None:
            version = history.agg(F.max("version")).first()[0]
        rows = history.where(F.col("version") == version).orderBy("virtual_slot").collect()
        return cls(int(version), rows[0].shards, tuple(r.shard for r in rows))


def slot_totals(docs: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Rows and bytes of each virtual slot."""
    rows, size = [0] * slots, [0] * slots
    slot = virtual_slot(F.col("doc_id"), F.col("text"), slots).alias("vs")
    for r in docs.select(slot, (text_bytes(F.col("text")) + RECORD_BYTES).alias("b")).groupBy("vs").agg(F.count("*").alias("n"), F.sum("b").alias("b")).collect():
        rows[r.vs], size[r.vs] = r.n, r.b
    return rows, size


def build_map(docs: DataFrame, shards: int, path: str, slots: int = SLOTS) -> tuple[SlotMap, list[int]]:
    """The first version for docs, stored at path, and the rows of each slot."""
    rows, size = slot_totals(docs, slots)
    slot_map = SlotMap.balanced(size, shards)
    slot_map.store(docs.sparkSession, path)
    return slot_map, rows


def assign(docs: DataFrame, slot_map: SlotMap) -> DataFrame:
    """docs with virtual_slot and shard added; columns of these names, in any case, are replaced and all others kept. No row moves."""
    mapped = F.broadcast(slot_map.frame(docs.sparkSession).select(F.col("virtual_slot").alias("_vs"), F.col("shard").alias("_shard")))
    kept = docs.select(*[docs[f"`{c.replace('`', '``')}`"] for c in docs.columns if c.lower() not in ("virtual_slot", "shard")])
    keyed = kept.select(F.struct("*").alias("_row"), virtual_slot(kept["doc_id"], kept["text"], len(slot_map.shard_of)).alias("_vs"))
    return keyed.join(mapped, "_vs").select("_row.*", F.col("_vs").alias("virtual_slot"), F.col("_shard").alias("shard"))


def placed(docs: DataFrame, slot_map: SlotMap, rows: Sequence[int]) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, shard and slot: the row's place in its shard, from 0 without gaps.

    Slots of a shard follow one another, so a place is the rows of the slots before plus the place within the slot;
    windows are of one slot each, a 4096th of the rows.
    """
    before, starts = [0] * slot_map.shards, []
    for i, s in enumerate(slot_map.shard_of):
        starts.append((i, s, before[s]))
        before[s] += rows[i]
    mapped = F.broadcast(docs.sparkSession.createDataFrame(starts, "virtual_slot int, shard int, start long"))
    slim = docs.select(F.col("doc_id"), (text_bytes(F.col("text")) + RECORD_BYTES).alias("size"), text_crc32(F.col("text")).alias("text_crc32"), virtual_slot(F.col("doc_id"), F.col("text"), len(slot_map.shard_of)).alias("virtual_slot"))
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    numbered = slim.withColumn("_place", F.row_number().over(within) - 1).join(mapped, "virtual_slot")
    return numbered.select("doc_id", "size", "text_crc32", "virtual_slot", "shard", (F.col("start") + F.col("_place")).cast("long").alias("slot"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    slot_map, rows = build_map(docs, 40, fresh_path(spark, "slot-map"))
    return placed(docs, slot_map, rows).withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int"), "map_version": F.lit(slot_map.version)})
