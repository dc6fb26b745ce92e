"""Sharding by fixed virtual slots.

A record's key decides one of thousands of virtual slots for good. Bytes and rows are summed per slot, and
a versioned map says which shard holds which slot. Rebalancing edits the map, so that whole slots move and
no record is hashed anew. The map has as many rows as there are slots, whatever the size of the corpus.

A slot that holds many times its share, as one key of very many records makes it, is split: the map says so, and the
records of split slots are dealt over all slots by key, text and row.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace

N_SLOTS = 4096
#: A slot with more than so many times the mean of bytes or rows is split.
MOST_OF_MEAN = 16


@dataclass(frozen=True)
class SlotMap:
    """One version of the slot-to-shard map, with the load that it was made for."""

    version: int
    n_shards: int
    shard: tuple[int, ...]
    bytes: tuple[int, ...]
    rows: tuple[int, ...]
    split: frozenset[int] = frozenset()

    def loads(self) -> list[int]:
        out = [0] * self.n_shards
        for slot, shard in enumerate(self.shard):
            out[shard] += self.bytes[slot]
        return out

    def frame(self, spark: SparkSession) -> DataFrame:
        """virtual_slot, shard and first: the place in its shard of the slot's first record."""
        first, after = [], [0] * self.n_shards
        for slot, shard in enumerate(self.shard):
            first.append(after[shard])
            after[shard] += self.rows[slot]
        return spark.createDataFrame(
            list(zip(range(len(self.shard)), self.shard, first, self.bytes, self.rows, (k in self.split for k in range(len(self.shard))))),
            "virtual_slot int, shard int, first long, slot_bytes long, slot_rows long, split boolean",
        )


def virtual_slot(key: Column, spare: Column, n_slots: int = N_SLOTS) -> Column:
    """The slot of a key; rows whose key is null are spread by spare, lest they share one slot."""
    return F.pmod(F.when(key.isNull(), F.xxhash64(spare)).otherwise(F.xxhash64(key)), F.lit(n_slots)).cast("int")


def slot_loads(records: DataFrame, n_slots: int = N_SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of every slot; the sums are made on the map side, and n_slots rows come here."""
    sizes, rows = [0] * n_slots, [0] * n_slots
    for r in records.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect():
        sizes[r.virtual_slot], rows[r.virtual_slot] = r.b, r.n
    return sizes, rows


def overfull(sizes: list[int], rows: list[int], most: int = MOST_OF_MEAN) -> frozenset[int]:
    """The slots to split; fewer than a `most`th of all slots for bytes and for rows each, whatever the records."""
    return frozenset(k for own in (sizes, rows) for k, x in enumerate(own) if x * len(own) > most * sum(own) and rows[k] > most)


def with_split(records: DataFrame, split: frozenset[int], n_slots: int = N_SLOTS) -> DataFrame:
    """records (doc_id, text_crc32, row, virtual_slot and more) with those of split slots dealt over all slots."""
    if not split:
        return records
    finer = F.pmod(F.xxhash64("doc_id", "text_crc32", "row"), F.lit(n_slots)).cast("int")
    return records.withColumn("virtual_slot", F.when(F.col("virtual_slot").isin(*split), finer).otherwise(F.col("virtual_slot")))


def first_map(sizes: list[int], rows: list[int], n_shards: int, split: frozenset[int] = frozenset()) -> SlotMap:
    """Version 1: the largest slot left goes to the shard with the fewest bytes."""
    shard = [0] * len(sizes)
    heap = [(0, 0, k) for k in range(n_shards)]
    for slot in sorted(range(len(sizes)), key=lambda s: (-sizes[s], s)):
        load, n, k = heapq.heappop(heap)
        shard[slot] = k
        heapq.heappush(heap, (load + sizes[slot], n + 1, k))
    return SlotMap(1, n_shards, tuple(shard), tuple(sizes), tuple(rows), split)


def rebalanced(old: SlotMap, sizes: list[int], rows: list[int], n_shards: int, tolerance: float = 0.02) -> SlotMap:
    """The next version for new loads or more shards, with few slots moved.

    A slot moves from the fullest to the emptiest shard, as long as a move narrows the gap between them and the
    fullest is over its share by more than the tolerance.
    """
    shard, loads = list(old.shard), [0] * n_shards
    if n_shards < old.n_shards:
        raise ValueError("shards are only added; move slots away by giving a larger count first")
    held: list[list[tuple[int, int]]] = [[] for _ in range(n_shards)]
    for slot, k in enumerate(shard):
        loads[k] += sizes[slot]
        held[k].append((sizes[slot], slot))
    for own in held:
        own.sort()
    share = sum(sizes) / n_shards
    for _ in range(len(shard)):
        top, low = max(range(n_shards), key=loads.__getitem__), min(range(n_shards), key=loads.__getitem__)
        gap = loads[top] - loads[low]
        fits = [x for x in held[top] if 0 < x[0] < gap]
        if loads[top] <= share * (1 + tolerance) or not fits:
            break
        size, slot = min(fits, key=lambda x: (abs(gap / 2 - x[0]), x[1]))
        held[top].remove((size, slot))
        held[low].append((size, slot))
        held[low].sort()
        loads[top] -= size
        loads[low] += size
        shard[slot] = low
    return SlotMap(old.version + 1, n_shards, tuple(shard), tuple(sizes), tuple(rows), old.split)


def save_map(spark: SparkSession, slots: SlotMap, path: str) -> None:
    """Adds the version to the map's table; versions already there stay."""
    slots.frame(spark).withColumns({"n_shards": F.lit(slots.n_shards)}).coalesce(1).write.mode("overwrite").parquet(f"{path}/version={slots.version}")


def load_map(spark: SparkSession, path: str, version: int) -> SlotMap:
    rows = sorted(spark.read.parquet(f"{path}/version={version}").collect(), key=lambda r: r.virtual_slot)
    return SlotMap(version, rows[0].n_shards, tuple(r.shard for r in rows), tuple(r.slot_bytes for r in rows), tuple(r.slot_rows for r in rows), frozenset(r.virtual_slot for r in rows if r.split))


def assign(records: DataFrame, slots: SlotMap, order: list[str]) -> DataFrame:
    """records with their shard and slot, their place in the shard from 0 without gaps.

    Places are counted within a virtual slot and begin where the map says, so no task holds a whole shard. The map
    is broadcast: it has a row for each virtual slot and nothing else.
    """
    within = Window.partitionBy("virtual_slot").orderBy(*order)
    return (
        records.join(F.broadcast(slots.frame(records.sparkSession)), "virtual_slot")
        .withColumn("slot", F.col("first") + F.row_number().over(within) - 1)
        .drop("first", "slot_bytes", "slot_rows", "split")
    )


def slotted(documents: DataFrame, work: Workspace, n_slots: int = N_SLOTS) -> tuple[DataFrame, list[int], list[int], frozenset[int]]:
    """doc_id, size, text_crc32, row and virtual_slot of all documents; bytes and rows by slot; the split slots."""
    text = F.coalesce(documents["text"], F.lit(""))
    crc = F.crc32(text.cast("binary"))
    records = work.stage(
        documents.select(
            documents["doc_id"], (F.octet_length(text) + 8).cast("long").alias("size"), crc.alias("text_crc32"), F.monotonically_increasing_id().alias("row"),
            virtual_slot(documents["doc_id"], crc, n_slots).alias("virtual_slot"),
        ),
        "records",
    )
    sizes, rows = slot_loads(records, n_slots)
    if split := overfull(sizes, rows):
        records = with_split(records, split, n_slots)
        sizes, rows = slot_loads(records, n_slots)
    return records, sizes, rows, split


_ORDER = ["doc_id", "size", "text_crc32", "row"]


def shard_documents(documents: DataFrame, n_shards: int = 24, n_slots: int = N_SLOTS, map_path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and virtual_slot of all documents; near equal bytes.

    Null text has no bytes and the checksum of empty text; null doc_ids are spread by the text's checksum; a very long
    text is one record and moves whole; repeated rows take a place each; a doc_id that very many rows have is spread
    over all slots; empty tables give no rows; further columns are ignored. The map's first version is written beside
    the records or to map_path.
    """
    spark, work = documents.sparkSession, Workspace(documents.sparkSession, "shards")
    records, sizes, rows, split = slotted(documents, work, n_slots)
    slots = first_map(sizes, rows, n_shards, split)
    save_map(spark, slots, map_path or work.path("slot_map"))
    return assign(records, slots, _ORDER).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot"
    )


def grown(documents: DataFrame, n_shards: int = 24, more: int = 32, n_slots: int = N_SLOTS, map_path: str | None = None) -> DataFrame:
    """doc_id, size, virtual_slot, shard, slot, grown_shard and moved of all documents, before and after a rebalancing.

    Both versions of the map are written; the second is the first with whole slots moved to the new shards, until
    bytes are near equal again. Awkward rows are as in shard_documents().
    """
    spark, work = documents.sparkSession, Workspace(documents.sparkSession, "shards")
    records, sizes, rows, split = slotted(documents, work, n_slots)
    first = first_map(sizes, rows, n_shards, split)
    second = rebalanced(first, sizes, rows, more)
    path = map_path or work.path("slot_map")
    save_map(spark, first, path)
    save_map(spark, second, path)
    after = F.broadcast(second.frame(spark).select("virtual_slot", F.col("shard").alias("grown_shard")))
    return assign(records, first, _ORDER).join(after, "virtual_slot").select("doc_id", "size", "virtual_slot", "shard", "slot", "grown_shard", (F.col("shard") != F.col("grown_shard")).alias("moved"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op1b_rebalanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grown(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op1_sharding": op1_sharding, "op1b_rebalanced": op1b_rebalanced}
ORACLE_SQL: dict[str, str] = {}
