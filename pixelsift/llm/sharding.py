"""Sharding by fixed virtual slots.

Records are hashed into thousands of virtual slots; bytes are aggregated per slot; a small versioned map
says which shard each slot belongs to. Rebalancing edits the map: it moves whole slots away from shards
that hold too much, and leaves every other slot where it is. Records never need to be rehashed.

The law that holds is ``bytes``: the shards' sizes are near equal, to within about one small slot.

A record's slot is (hash of id, size and checksum; split). Records have split 0, but those of *hot* hash slots
(over an eighth of a shard) are dealt over splits: copies of one record are numbered, and a copy's split is its
number, counted on from a hash of the record, modulo the number of splits. A hot slot has a multiple of
``shards`` splits, in proportion to its bytes (:data:`FINE` a shard if it held everything), or one for each
record if it has fewer. So any number of equal records is spread over all shards, to within one record, and which
slots there are depends on the records only, not on the files or tasks they come in.

Scale: the only table that meets in one place is the slot table: ``slots`` plus at most about
``shards * (FINE + 8 * shards)`` rows whatever the input, as at most ``8 * shards`` slots are hot. Copies are
numbered by counts per task and offsets over tasks, so no group of copies is ever in one window. Records are
numbered inside their slot, and slots are laid end to end inside their shard, so the gapless position in a shard
needs no window over a whole shard.

Defined results: a null text has no bytes (size 16, checksum 0); null ids hash like any value; repeated rows are
separate records; a record is never cut, so one very long text may be all of its shard; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixelsift.llm._store import keep

#: Bytes that a record takes besides its text.
RECORD_BYTES = 16
#: Hash slots; splits, in each shard, of a hot slot that held all bytes.
SLOTS, FINE = 4096, 256

MAP_SCHEMA = "version int, slot int, split int, shard int, bytes long, n_rows long"


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """Narrow records: id, size, checksum and virtual slot."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("_id"),
        (F.octet_length(text) + F.lit(RECORD_BYTES)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    return rows.withColumn("vslot", F.pmod(F.xxhash64("_id", "size", "text_crc32"), F.lit(slots)).cast("int"))


def rebalance(slot_bytes: dict, old: dict, shards: int) -> dict:
    """Edit a slot-to-shard map: slots leave shards above the mean, smallest first, and fill those below it."""
    load = [0] * shards
    own: list[list] = [[] for _ in range(shards)]
    pool = []
    for slot, size in sorted(slot_bytes.items()):
        shard = old.get(slot)
        if shard is None or shard >= shards:
            pool.append((size, slot))
        else:
            load[shard] += size
            own[shard].append((size, slot))
    mean = sum(slot_bytes.values()) / max(1, shards)
    new = {s: old[s] for s in slot_bytes if old.get(s) is not None and old[s] < shards}
    for shard in range(shards):
        own[shard].sort(reverse=True)
        while load[shard] > mean and own[shard]:
            size, slot = own[shard].pop()
            load[shard] -= size
            pool.append((size, slot))
    heap = [(load[s], s) for s in range(shards)]
    heapq.heapify(heap)
    for size, slot in sorted(pool, key=lambda x: (-x[0], x[1])):
        least, shard = heapq.heappop(heap)
        new[slot] = shard
        heapq.heappush(heap, (least + size, shard))
    return new


def map_rows(version: int, assigned: dict, table: dict) -> list[tuple]:
    return [(version, *slot, assigned[slot], *table[slot]) for slot in sorted(assigned)]


def save_map(spark: SparkSession, rows: list[tuple], path: str) -> None:
    """Append a version of the map; earlier versions stay readable."""
    spark.createDataFrame(rows, MAP_SCHEMA).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int) -> dict:
    rows = spark.read.parquet(path).where(F.col("version") == version).select("slot", "split", "shard").collect()
    return {(r.slot, r.split): r.shard for r in rows}


def _dealt(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """Records of hot slots with their split: copies of a record are numbered over all tasks."""
    key = ["vslot", "_id", "size", "text_crc32"]
    mine = rows.join(F.broadcast(hot), "vslot").withColumn("_task", F.spark_partition_id())  # one row a hot slot
    mine = keep(mine, "hot")
    same = F.xxhash64("_id", "size", "text_crc32")
    tasks = mine.groupBy(*key, "_task").agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(*key).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    offsets = tasks.withColumn("_from", F.coalesce(before, F.lit(0))).select(*[F.col(c).alias(f"{c}_") for c in key], F.col("_task").alias("_task_"), "_from")
    numbered = mine.withColumn("_k", F.row_number().over(Window.partitionBy(*key, "_task").orderBy("size")) - 1)
    found = numbered.join(offsets, (F.col("_task") == F.col("_task_")) & F.col("_id").eqNullSafe(F.col("_id_")) & (F.col("vslot") == F.col("vslot_")) & (F.col("size") == F.col("size_")) & (F.col("text_crc32") == F.col("text_crc32_")))
    split = F.pmod(F.pmod(same, F.col("splits")) + F.col("_from") + F.col("_k"), F.col("splits")).cast("int")
    return found.select("_id", "size", "text_crc32", "vslot", split.alias("split"))


def shard(docs: DataFrame, shards: int, map_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """One row per record: id, size, text_crc32, law, shard, slot (its place in the shard, from 0 without gaps),
    grown_shard, virtual_slot, split and map_version. ``map_path``: where versions of the map are appended."""
    spark = docs.sparkSession
    rows = keep(sized(docs, id_col, text_col, slots), "sized")
    per_slot = rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()  # at most slots rows
    total = sum(r.bytes for r in per_slot)
    # splits of hot slots: a multiple of the shards, in proportion to the bytes; no more than there are records
    splits = {r.vslot: min(r.n, shards * -(-FINE * r.bytes // total)) for r in per_slot if r.bytes * 8 * shards > total and r.n > 1}
    table = {(r.vslot, 0): (r.bytes, r.n) for r in per_slot if r.vslot not in splits}
    every = rows.withColumn("split", F.lit(0))
    if splits:
        hot = spark.createDataFrame(sorted(splits.items()), "vslot int, splits long")
        dealt = keep(_dealt(rows, hot), "dealt")
        table |= {(r.vslot, r.split): (r.bytes, r.n) for r in dealt.groupBy("vslot", "split").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()}  # at most sum(splits) rows
        every = every.join(F.broadcast(hot), "vslot", "left_anti").unionByName(dealt)
    first = {s: (s[0] + s[1]) % shards for s in table}  # version 1: slots dealt round
    final = rebalance({s: b for s, (b, _) in table.items()}, first, shards)
    if map_path:
        save_map(spark, map_rows(1, first, table), map_path)
        save_map(spark, map_rows(2, final, table), map_path)
    at, placed = [0] * shards, []
    for slot in sorted(final):
        placed.append((*slot, final[slot], at[final[slot]]))
        at[final[slot]] += table[slot][1]
    where = F.broadcast(spark.createDataFrame(placed, "vslot int, split int, shard int, base long"))  # the slot table, whose size is bounded
    inside = Window.partitionBy("vslot", "split").orderBy("_id", "text_crc32", "size")
    return (
        every.withColumn("_n", F.row_number().over(inside) - 1)
        .join(where, ["vslot", "split"])
        .select(
            F.col("_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("_n")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot"), "split", F.lit(2).alias("map_version"),
        )
    )
