"""Shards through fixed virtual slots.

Records are hashed into ``n_slots`` slots, a number that never changes for a corpus. Bytes are added up per slot, and a
small versioned table says which shard owns each slot. Growing or rebalancing edits that table: a new version moves
whole slots, and only the records in them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from shiftframe.functions.workspace import materialize, new_path

N_SLOTS = 4096
ROW_BYTES = 16  # fixed value: what a record takes besides its text
MAP_TYPE = "version int, virtual_slot int, shard int"


def slot_of(doc_id: Column, text_crc32: Column, n_slots: int = N_SLOTS) -> Column:
    """Slot of a record. The checksum spreads records whose id is null or repeated."""
    return F.pmod(F.xxhash64(doc_id, text_crc32), F.lit(n_slots)).cast("int")


def slotted(docs: DataFrame, n_slots: int = N_SLOTS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, virtual_slot`` of every record; a null text has no bytes and the checksum 0."""
    content = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    narrow = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(content) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(content).alias("text_crc32"),
    )
    return narrow.withColumn("virtual_slot", slot_of(F.col("doc_id"), F.col("text_crc32"), n_slots))


def slot_loads(records: DataFrame) -> DataFrame:
    """Bytes and rows per slot that has any: at most ``n_slots`` rows."""
    return records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def first_map(loads: Iterable[Row], n_shards: int, n_slots: int = N_SLOTS) -> list[tuple[int, int, int]]:
    """Version 1: the largest slot first, each to the shard with the fewest bytes so far."""
    size = {row["virtual_slot"]: row["bytes"] for row in loads}
    lightest = [(0, shard) for shard in range(n_shards)]
    owners = []
    for slot in sorted(range(n_slots), key=lambda s: (-size.get(s, 0), s)):
        filled, shard = heapq.heappop(lightest)
        owners.append((1, slot, shard))
        heapq.heappush(lightest, (filled + size.get(slot, 0), shard))
    return sorted(owners)


def rebalanced_map(
    owners: Iterable[tuple[int, int, int]], loads: Iterable[Row], n_shards: int
) -> list[tuple[int, int, int]]:
    """The next version for ``n_shards``: slots move only out of shards that hold more than their share.

    A shard gives up slots, the largest first, as long as it keeps its share, and all of them if it no longer exists.
    Freed slots go to the shard with the fewest bytes. All other slots stay where they are.
    """
    owners = list(owners)
    version = max((v for v, _, _ in owners), default=0) + 1
    size = {row["virtual_slot"]: row["bytes"] for row in loads}
    share = sum(size.values()) / n_shards
    held: dict[int, list[int]] = {shard: [] for shard in range(n_shards)}
    loose = []
    for _, slot, shard in owners:
        (held[shard] if shard < n_shards else loose).append(slot)
    filled = {shard: sum(size.get(s, 0) for s in slots) for shard, slots in held.items()}
    for shard, slots in held.items():
        for slot in sorted(slots, key=lambda s: (-size.get(s, 0), s)):
            if size.get(slot, 0) and filled[shard] - size[slot] >= share:
                filled[shard] -= size[slot]
                slots.remove(slot)
                loose.append(slot)
    lightest = [(filled[shard], shard) for shard in held]
    heapq.heapify(lightest)
    for slot in sorted(loose, key=lambda s: (-size.get(s, 0), s)):
        used, shard = heapq.heappop(lightest)
        held[shard].append(slot)
        heapq.heappush(lightest, (used + size.get(slot, 0), shard))
    return sorted((version, slot, shard) for shard, slots in held.items() for slot in slots)


def save_map(spark: SparkSession, owners: Iterable[tuple[int, int, int]], path: str) -> None:
    """Append one version to the stored map; older versions stay readable."""
    spark.createDataFrame(list(owners), MAP_TYPE).coalesce(1).write.mode("append").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of the stored map, the newest if none is named."""
    stored = spark.read.schema(MAP_TYPE).parquet(path)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    return stored.where(F.col("version") == version)


def current_map(spark: SparkSession, path: str, loads: Iterable[Row], n_shards: int, n_slots: int = N_SLOTS) -> list[Row]:
    """The map stored under ``path`` for these loads: the newest version edited where it is out of balance and stored as
    the next one, or version 1 if there is none yet."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    known = [tuple(r) for r in load_map(spark, path).orderBy("virtual_slot").collect()] if system.exists(target) else []
    owners = rebalanced_map(known, loads, n_shards) if known else first_map(loads, n_shards, n_slots)
    if [o[1:] for o in owners] != [k[1:] for k in known]:
        save_map(spark, owners, path)
    return load_map(spark, path).orderBy("virtual_slot").collect()


def shard_documents(
    docs: DataFrame, n_shards: int = 40, n_slots: int = N_SLOTS, key: str = "doc_id", text: str = "text", map_path: str | None = None
) -> DataFrame:
    """Shard and gapless position of every record, sizes near equal across shards.

    The slots' owners are those of the map stored under ``map_path`` (a new map if none is named), which is edited and
    stored as a new version when the slots' sizes or the number of shards have changed; see ``current_map``.

    Only the slot totals, ``n_slots`` rows whatever the input, reach the driver and are broadcast. A position is the
    number of rows in the earlier slots of the shard plus the row's number in its slot, so no task holds a shard.
    Nulls: a null id is a value like any other, a null text has no bytes. Equal rows share a slot and get different
    positions. An empty table gives no rows. Columns other than ``key`` and ``text`` are not read.
    """
    spark = docs.sparkSession
    records = materialize(slotted(docs, n_slots, key, text), "slotted")
    loads = slot_loads(records).collect()
    owners = current_map(spark, map_path or new_path(spark, "shard-map"), loads, n_shards, n_slots)
    rows = {row["virtual_slot"]: row["rows"] for row in loads}
    before, placed = dict.fromkeys(range(n_shards), 0), []
    for version, slot, shard in owners:
        placed.append((version, slot, shard, before[shard]))
        before[shard] += rows.get(slot, 0)
    owner = spark.createDataFrame(placed, f"{MAP_TYPE}, rows_before long")
    in_slot = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return records.join(F.broadcast(owner), "virtual_slot").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("rows_before") + F.row_number().over(in_slot) - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        F.col("version").alias("map_version"),
    )


def write_shards(docs: DataFrame, owners: DataFrame, path: str, n_slots: int = N_SLOTS, key: str = "doc_id",
                 text: str = "text") -> None:
    """Write ``docs`` below one folder per shard; all columns stay, and slots are dealt to tasks as they are."""
    crc = F.crc32(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"))
    packed = docs.select(F.struct("*").alias("doc"), slot_of(F.col(key), crc, n_slots).alias("virtual_slot"))
    owned = packed.join(F.broadcast(owners.select("virtual_slot", "shard")), "virtual_slot")
    owned.repartition("shard", "virtual_slot").select("doc", "shard").write.partitionBy("shard").parquet(path)
