"""Shards over fixed virtual slots.

Records are hashed into a fixed number of slots, many more than shards. Rows and bytes
are summed by slot, and a versioned table maps slots to shards. Rebalancing edits that
table: slots are moved or exchanged until shards hold nearly equal bytes. Growing by a
shard moves slots into the new one only. Records never move except with their slot.

Defined cases: a null text has no bytes and checksum 0. Repeated rows share a slot and
get places of their own. An empty table gives an empty result. Other columns are ignored.
"""

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyflow.session import shared_dir, written

SLOTS = 8192
#: Bytes a record takes besides its text.
RECORD_BYTES = 8


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual slot of every document."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    facts = docs.select("doc_id", (F.octet_length(text) + RECORD_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return facts.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(slots)).cast("int"))


def slot_loads(facts: DataFrame, slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and rows of each slot: one row per slot reaches the driver, ``slots`` at most."""
    totals = facts.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
    loads, rows = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
    for t in totals:
        loads[t.virtual_slot], rows[t.virtual_slot] = t.bytes, t.rows
    return loads, rows


def first_map(slots: int, shards: int) -> np.ndarray:
    return np.arange(slots) % shards


def rebalanced(shard_of: np.ndarray, loads: np.ndarray, shards: int) -> np.ndarray:
    """Edit a map so that shards hold nearly equal bytes.

    The fullest and the emptiest shard give and take the slot, or exchange the two slots,
    that best halves their difference, until no single edit helps.
    """
    shard_of = shard_of.copy()
    totals = np.bincount(shard_of, weights=loads, minlength=shards)
    while True:
        full, empty = int(totals.argmax()), int(totals.argmin())
        gap = totals[full] - totals[empty]
        ours, theirs = np.flatnonzero((shard_of == full) & (loads > 0)), np.flatnonzero((shard_of == empty) & (loads > 0))
        theirs = theirs[np.argsort(loads[theirs], kind="stable")]
        # Against nothing, and against the neighbours of the slot that would halve the gap.
        against = np.concatenate(([0], loads[theirs]))
        near = np.searchsorted(against, loads[ours] - gap / 2)
        best = (gap / 2, -1, -1)
        for offset in (-1, 0, 1):
            at = np.clip(near + offset, 0, len(against) - 1)
            moved = loads[ours] - against[at]
            off = np.where((moved > 0) & (moved < gap), np.abs(moved - gap / 2), np.inf)
            if len(off) and off.min() < best[0]:
                k = int(off.argmin())
                best = (off[k], int(ours[k]), int(at[k]) - 1)
        if best[1] < 0:
            return shard_of
        _, mine, other = best
        moved = loads[mine] - (loads[theirs[other]] if other >= 0 else 0)
        shard_of[mine] = empty
        if other >= 0:
            shard_of[theirs[other]] = full
        totals[full] -= moved
        totals[empty] += moved


def grown(shard_of: np.ndarray, loads: np.ndarray, shards: int) -> np.ndarray:
    """Edit a map for one more shard: slots move into the new shard only."""
    shard_of = shard_of.copy()
    totals = np.bincount(shard_of, weights=loads, minlength=shards + 1)
    aim = totals.sum() / (shards + 1)
    while True:
        full = int(totals[:shards].argmax())
        ours = np.flatnonzero((shard_of == full) & (loads > 0))
        ours = ours[totals[shards] + loads[ours] <= aim]
        if not len(ours):
            return shard_of
        mine = int(ours[np.argmax(loads[ours])])
        shard_of[mine] = shards
        totals[full] -= loads[mine]
        totals[shards] += loads[mine]


def store_map(spark: SparkSession, path: str, version: int, shard_of: np.ndarray, loads: np.ndarray, rows: np.ndarray) -> None:
    """Add a version to the map table: slot, shard, load, and where its rows start in the shard."""
    order = np.lexsort((np.arange(len(shard_of)), shard_of))
    before = np.cumsum(rows[order]) - rows[order]
    first_of_shard = np.append(True, np.diff(shard_of[order]) > 0)
    start = np.empty_like(rows)
    start[order] = before - np.maximum.accumulate(np.where(first_of_shard, before, 0))
    lines = list(zip(range(len(shard_of)), shard_of.tolist(), loads.tolist(), rows.tolist(), start.tolist(), strict=True))
    table = spark.createDataFrame(lines, "virtual_slot int, shard int, slot_bytes long, slot_rows long, slot_start long")
    table.coalesce(1).write.parquet(f"{path}/version={version}")


def read_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path}/version={version}")


def shard(docs: DataFrame, shards: int, slots: int = SLOTS) -> tuple[DataFrame, str]:
    """Every document with its shard and its place there, and the path of the map table.

    Version 1 of the map deals slots out in turn; version 2 is rebalanced by bytes.
    """
    spark = docs.sparkSession
    facts = written(records(docs, slots), "records")
    loads, rows = slot_loads(facts, slots)
    path = shared_dir(spark, "slot-map")
    dealt = first_map(slots, shards)
    store_map(spark, path, 1, dealt, loads, rows)
    store_map(spark, path, 2, rebalanced(dealt, loads, shards), loads, rows)
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    placed = facts.withColumn("_place", F.row_number().over(inside) - 1)
    # The map has one row per slot, a fixed number.
    placed = placed.join(F.broadcast(read_map(spark, path, 2)), "virtual_slot")
    return placed.select("doc_id", "size", "text_crc32", "virtual_slot", "shard", (F.col("slot_start") + F.col("_place")).alias("slot")), path


def write_shards(docs: DataFrame, map_table: DataFrame, path: str, slots: int = SLOTS) -> None:
    """Write whole documents into one folder per shard, by a version of the map."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    slot = F.pmod(F.xxhash64("doc_id", F.crc32(text), (F.octet_length(text) + RECORD_BYTES).cast("long")), F.lit(slots)).cast("int")
    keyed = docs.withColumn("_slot", slot).join(F.broadcast(map_table.select(F.col("virtual_slot").alias("_slot"), F.col("shard").alias("_shard"))), "_slot")
    keyed.drop("_slot").write.partitionBy("_shard").parquet(path)
