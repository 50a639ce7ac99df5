"""Sharding over fixed virtual slots.

Every record hashes to one of a few thousand virtual slots, for good. Bytes are added up per slot, and a versioned
slot-to-shard map says which shard holds a slot. Rebalancing edits the map: whole slots move, records never rehash.
All work on records is DataFrame code; only the map, whose size is the number of virtual slots, is edited on the driver.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stayframe.llm.stored import stored
from stayframe.session import new_workspace
from stayframe.sources.snapshots import SnapshotTable

VIRTUAL_SLOTS = 4096
#: Bytes that a record takes besides its text.
RECORD_BYTES = 16


@dataclass(frozen=True)
class SlotLoad:
    slot: int
    size: int
    rows: int


def record_size(text: str) -> Column:
    """UTF-8 bytes of the text (null: none) plus :data:`RECORD_BYTES`."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + RECORD_BYTES).cast("long")


def virtual_slot(columns: Sequence[str], slots: int = VIRTUAL_SLOTS) -> Column:
    """The slot of a record, by its key (the first column) and the others, so that rows which share a key stay apart.

    Rows without a key are spread by their place, as they may be equal in everything. Store what this gives: it does not
    give them the same slots again.
    """
    place = F.when(F.col(columns[0]).isNull(), F.monotonically_increasing_id())
    return F.pmod(F.xxhash64(*[F.col(name) for name in columns], place), F.lit(slots)).cast("int")


def slot_loads(records: DataFrame) -> list[SlotLoad]:
    """Bytes and rows of every slot that has any. The result has at most as many entries as there are virtual slots."""
    rows = records.groupBy("virtual_slot").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    return sorted((SlotLoad(row["virtual_slot"], row["size"], row["n"]) for row in rows), key=lambda load: load.slot)


def balanced_map(loads: Sequence[SlotLoad], shards: int, slots: int = VIRTUAL_SLOTS) -> list[int]:
    """The shard of every slot: heaviest slot first, each to the shard with the fewest bytes so far.

    Slots without records go to the shards in turn. Ties go to the lower number.
    """
    placed = [slot % shards for slot in range(slots)]
    lightest = [(0, shard) for shard in range(shards)]
    for load in sorted(loads, key=lambda load: (-load.size, load.slot)):
        size, shard = heapq.heappop(lightest)
        placed[load.slot] = shard
        heapq.heappush(lightest, (size + load.size, shard))
    return placed


def rebalanced_map(placed: Sequence[int], loads: Sequence[SlotLoad], shards: int, tolerance: float = 0.01) -> list[int]:
    """The map edited for ``shards`` shards: as few slots move as a greedy choice needs.

    Slots of shards beyond ``shards`` leave first. Then, while the fullest shard exceeds the mean by more than
    ``tolerance``, it gives the lightest shard the largest slot that narrows the gap between the two.
    """
    size_of = {load.slot: load.size for load in loads}
    members: list[set[int]] = [set() for _ in range(shards)]
    homeless = []
    for slot, shard in enumerate(placed):
        members[shard].add(slot) if shard < shards else homeless.append(slot)
    total = [sum(size_of.get(slot, 0) for slot in own) for own in members]

    def give(slot: int, shard: int) -> None:
        members[shard].add(slot)
        total[shard] += size_of.get(slot, 0)

    for slot in sorted(homeless, key=lambda slot: (-size_of.get(slot, 0), slot)):
        give(slot, total.index(min(total)))
    mean = sum(total) / shards
    while True:
        full, light = total.index(max(total)), total.index(min(total))
        gap = total[full] - total[light]
        movable = [slot for slot in members[full] if 0 < size_of.get(slot, 0) < gap]
        if total[full] <= mean * (1 + tolerance) or not movable:
            break
        # Half the gap evens the two out; the slot nearest to that is the best single move.
        slot = min(movable, key=lambda slot: (abs(gap - 2 * size_of[slot]), slot))
        members[full].remove(slot)
        total[full] -= size_of[slot]
        give(slot, light)
    edited = list(placed)
    for shard, own in enumerate(members):
        for slot in own:
            edited[slot] = shard
    return edited


class SlotMap:
    """A versioned slot-to-shard map: one row per virtual slot, every edit a new version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.table = SnapshotTable(spark, path)

    def store(self, placed: Sequence[int], operation: str = "BALANCE") -> int:
        shards = F.from_json(F.lit(json.dumps(list(placed))), "array<int>")
        rows = self.spark.range(len(placed), numPartitions=1).select(
            F.col("id").cast("int").alias("virtual_slot"), F.get(shards, F.col("id").cast("int")).alias("shard")
        )
        return self.table.write(rows, operation=operation)

    def read(self, version: int | None = None) -> DataFrame:
        return self.table.read(version)

    def placed(self, version: int | None = None) -> list[int]:
        return [row["shard"] for row in self.read(version).orderBy("virtual_slot").collect()]

    def rebalance(self, loads: Sequence[SlotLoad], shards: int, tolerance: float = 0.01) -> int:
        """Edit the newest map for other loads or another number of shards; returns the new version."""
        return self.store(rebalanced_map(self.placed(), loads, shards, tolerance), operation="REBALANCE")


def located(records: DataFrame, slot_map: DataFrame, order: Sequence[str]) -> DataFrame:
    """Records with ``shard`` and ``slot``, their place in the shard, counted from 0 without gaps.

    A record's place is its rank in its virtual slot plus the rows of the shard's earlier virtual slots. Only virtual
    slots are sorted, thousands of them; the running count over earlier ones is on one row per virtual slot.
    """
    counts = records.groupBy("virtual_slot").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        slot_map.join(counts, "virtual_slot")
        .withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .select("virtual_slot", "shard", "before")
    )
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy(*order))
    # At most one row per virtual slot.
    return (
        records.withColumn("rank", rank)
        .join(F.broadcast(offsets), "virtual_slot")
        .withColumn("slot", (F.col("before") + F.col("rank") - 1).cast("long"))
        .drop("rank", "before")
    )


def shard_documents(docs: DataFrame, shards: int = 40, slots: int = VIRTUAL_SLOTS, path: str | None = None) -> DataFrame:
    """Address every document: shard by bytes, and place in the shard.

    Takes ``doc_id`` and ``text``; other columns are ignored. Returns doc_id, size, text_crc32, virtual_slot, shard,
    slot. Null texts have no bytes and the checksum of nothing. Equal rows with a doc_id share a virtual slot and get
    places of their own; rows that share a doc_id alone spread by their texts, and rows without one by their place. No documents give no rows. The
    map is kept as a versioned table below ``path`` (a fresh workspace if not given).
    """
    spark = docs.sparkSession
    records = stored(
        docs.select(
            "doc_id",
            record_size("text").alias("size"),
            F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
            virtual_slot(["doc_id", "text"], slots).alias("virtual_slot"),
        ),
        "records",
    )
    slot_map = SlotMap(spark, path or new_workspace(spark, "slot-map"))
    version = slot_map.store(balanced_map(slot_loads(records), shards, slots))
    return located(records, slot_map.read(version), ["doc_id", "size", "text_crc32"])


def write_shards(docs: DataFrame, slot_map: DataFrame, path: str, slots: int = VIRTUAL_SLOTS) -> None:
    """Write documents as one folder per shard. A task writes whole virtual slots, so a shard is the work of many."""
    (
        docs.withColumn("virtual_slot", virtual_slot(["doc_id", "text"], slots))
        .join(F.broadcast(slot_map), "virtual_slot")
        .repartition("shard", "virtual_slot")
        .write.partitionBy("shard")
        .parquet(path)
    )
