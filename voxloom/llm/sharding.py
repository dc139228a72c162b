"""Sharding by fixed virtual slots (operator 2).

Records hash into thousands of virtual slots for good. Only slots move: a small
versioned table maps each slot to a shard, and rebalancing edits that table. The
first version deals slots to shards by their measured bytes, largest first, always
to the lightest shard, so shards come out near equal in bytes (law ``bytes``).

A record's virtual slot is a hash of its id and its text's checksum, so equal texts under
different ids scatter over slots and shards: a large group of copies can't fill one shard.
Rows that agree in id and text are copies of one record: their number within the record joins the hash, so
they spread over slots too. Copy 0 has the slot of the record itself; numbers do not depend on how the table is cut up.

Edge cases: a null or empty text counts one byte; a null id hashes like any value; an
empty table gives no rows and a map that spreads empty slots evenly. Columns beyond the
id and the text are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxloom.llm.common import materialise, scratch_path

SLOTS = 4096
#: Parts in which the rows of one virtual slot are ranked.
SALTS = 16
MAP_SCHEMA = "version int, virtual_slot int, shard int, bytes long, n_rows long"


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, _row, virtual_slot) of each row; the text is left behind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("_row"),
    )
    rows = materialise(rows.withColumns({"_record": F.xxhash64("doc_id", "text_crc32"), "_part": F.shiftright("_row", 33)}), "sized")
    # copies before a part of the table, then those before the row in its part: no task ranks all copies of a record
    parts = rows.groupBy("_record", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_record").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("_record", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy("_record", "_part").orderBy("_row")) - 1
    numbered = rows.withColumn("_copy", within).join(base, ["_record", "_part"]).withColumn("_copy", F.col("_copy") + F.col("_base"))
    return numbered.select("doc_id", "size", "text_crc32", "_row", shard_of(F.col("doc_id"), F.col("text_crc32"), slots, F.col("_copy")).alias("virtual_slot"))


def slot_bytes(rows: DataFrame, slots: int = SLOTS) -> list[tuple[int, int, int]]:
    """(slot, bytes, rows) of every slot; at most ``slots`` rows reach the driver."""
    found = {r["virtual_slot"]: (r["b"], r["n"]) for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()}
    return [(s, *found.get(s, (0, 0))) for s in range(slots)]


def initial_map(loads: list[tuple[int, int, int]], shards: int) -> list[tuple[int, int, int, int, int]]:
    """Version 0: slots, heaviest first, each to the lightest shard so far."""
    heap = [(0, 0, s) for s in range(shards)]
    rows = []
    for slot, size, n in sorted(loads, key=lambda x: (-x[1], x[0])):
        total, count, shard = heapq.heappop(heap)
        rows.append((0, slot, shard, size, n))
        heapq.heappush(heap, (total + size, count + 1, shard))
    return sorted(rows, key=lambda x: x[1])


def rebalance(rows: list[tuple], loads: list[tuple[int, int, int]], shards: int, tolerance: float = 0.01) -> list[tuple]:
    """Next version of a map for new loads or another number of shards.

    Slots leave shards that are above the mean by more than ``tolerance`` (or that no
    longer exist), the best-fitting slot first, and go to the lightest shard; all
    others stay where they are, so the bytes that move are few.
    """
    load = {s: (b, n) for s, b, n in loads}
    place = {r[1]: r[2] for r in rows}
    total = [0] * shards
    homeless = []
    for slot, shard in place.items():
        if shard < shards:
            total[shard] += load[slot][0]
        else:
            homeless.append(slot)
    mean = sum(b for b, _ in load.values()) / shards
    held: dict[int, list[int]] = {s: [] for s in range(shards)}
    for slot, shard in place.items():
        if shard < shards:
            held[shard].append(slot)
    for shard in range(shards):
        for slot in sorted(held[shard], key=lambda x: (-load[x][0], x)):
            if total[shard] <= mean * (1 + tolerance):
                break
            if 0 < load[slot][0] <= total[shard] - mean * (1 - tolerance):
                homeless.append(slot)
                total[shard] -= load[slot][0]
    heap = [(b, s) for s, b in enumerate(total)]
    heapq.heapify(heap)
    for slot in sorted(homeless, key=lambda x: (-load[x][0], x)):
        b, shard = heapq.heappop(heap)
        place[slot] = shard
        heapq.heappush(heap, (b + load[slot][0], shard))
    version = max((r[0] for r in rows), default=-1) + 1
    return [(version, slot, place[slot], *load[slot]) for slot in sorted(place)]


def map_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, MAP_SCHEMA)


def save_map(spark: SparkSession, rows: list[tuple], path: str) -> None:
    """Store one version of the map; other versions stay as they are, and a version stored again is replaced, not doubled."""
    kept = map_table(spark, rows).coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    kept.partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest version of the stored map, or the one asked for."""
    every = spark.read.schema(MAP_SCHEMA).parquet(path)
    if version is None:
        version = every.agg(F.max("version")).first()[0]
    return every.where(F.col("version") == version)


def stored_map(spark: SparkSession, path: str) -> list[tuple]:
    """Rows of the newest version at ``path``; none if nothing is stored there."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        return []
    return [(r["version"], r["virtual_slot"], r["shard"], r["bytes"], r["n_rows"]) for r in load_map(spark, path).orderBy("virtual_slot").collect()]  # one row a slot


def assign(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Adds shard and slot, the row's place in its shard, gapless from 0.

    Places come from three levels: the rows before a virtual slot in its shard, those before
    a part of it (SALTS parts by a hash of the row's number, so that copies of one record
    spread too), and the row's rank in its part. ``rows`` carries _row, a number of its own.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int"))
    # one row per part of a virtual slot: a fixed number
    parts = salted.groupBy("virtual_slot", "_salt").agg(F.count(F.lit(1)).alias("_n")).join(F.broadcast(slot_map.select("virtual_slot", "shard")), "virtual_slot")
    before = Window.partitionBy("shard").orderBy("virtual_slot", "_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("virtual_slot", "_salt", "shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    rank = F.row_number().over(Window.partitionBy("virtual_slot", "_salt").orderBy("doc_id", "text_crc32", "size", "_row"))
    ranked = salted.withColumn("_rank", rank).join(F.broadcast(base), ["virtual_slot", "_salt"])
    return ranked.withColumn("slot", (F.col("_base") + F.col("_rank") - 1).cast("long")).drop("_rank", "_base", "_salt", "_row")


def shard_documents(docs: DataFrame, shards: int = 16, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Shard, slot and virtual slot of every document, by the map stored at ``map_path``.

    Without a stored map the first version is dealt from the measured bytes and stored;
    with one, its newest version is loaded, edited for the bytes and shards of now, and
    stored as the next version if a slot moved. Rows are placed by the map as read back.
    """
    spark = docs.sparkSession
    path = map_path or scratch_path(spark, "slot-map")
    rows = materialise(sized(docs, slots), "slotted")
    loads = slot_bytes(rows, slots)
    old = stored_map(spark, path)
    if old and len(old) != slots:
        raise ValueError(f"the stored map has {len(old)} slots, not {slots}: virtual slots are fixed for good")
    new = rebalance(old, loads, shards) if old else initial_map(loads, shards)
    if [r[2] for r in new] != [r[2] for r in old]:
        save_map(spark, new, path)
    return assign(rows, load_map(spark, path))


def shard_of(doc_id: Column, text_crc32: Column, slots: int = SLOTS, copy: Column | None = None) -> Column:
    """The virtual slot of one record, or of a copy of it by number, for routing a new record by a stored map."""
    own = F.xxhash64(doc_id, text_crc32)
    if copy is not None:
        own = F.when(copy == 0, own).otherwise(F.xxhash64(doc_id, text_crc32, copy.cast("long")))
    return F.pmod(own, F.lit(slots)).cast("int")


def op2_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 16 shards under the law ``bytes``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = shard_documents(docs, 16)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
