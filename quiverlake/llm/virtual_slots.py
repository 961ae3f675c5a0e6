"""Sharding through fixed virtual slots.

A record's id is hashed into one of thousands of virtual slots, for good. Bytes are
summed by slot, and a map from slots to shards is stored as versions in a shared folder.
The first version is dealt by size: slots in descending order of bytes, each to the
lightest shard. Later versions are edits: grow() moves slots only into the new shards,
rebalance() moves only what brings heavy shards down. Moving a shard's data is then
moving whole slots.

What the driver holds is the table of slots, which is of fixed size. Places within a
shard are numbered by slot: a slot's rows follow those of the shard's earlier slots, so
no task sees a whole shard.

Defined results: a null text has no bytes; a null id is hashed like the empty string; rows
that share an id share a slot, but under the law of equal bytes they are spread over all
slots by the numbers of their rows, since one id may hold any share of all bytes; ties within a slot are ordered by id, size and text
checksum; an empty table gives no rows; other columns are ignored. Columns to keep that are
named like one of a placed record get "kept_" before their names.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialise, run_folder

SLOTS = 8192
RECORD_BYTES = 16
NAMES = {"doc_id", "size", "text_crc32", "vslot", "shard", "slot", "_first", "_within"}  # of placed records
MAP = "version int, vslot int, shard int, n_rows bigint, n_bytes bigint"


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The virtual slot of a key: the first 32 bits of its MD5, modulo the number of slots."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(slots)).cast("int")


def deal(sizes: dict[int, int], shards: int) -> dict[int, int]:
    """Slot to shard: descending sizes, each to the lightest shard; ties go to lower numbers."""
    load = [(0, s) for s in range(shards)]
    out = {}
    for slot in sorted(sizes, key=lambda v: (-sizes[v], v)):
        size, shard = heapq.heappop(load)
        out[slot] = shard
        heapq.heappush(load, (size + sizes[slot], shard))
    return out


def grow(shard_of: dict[int, int], sizes: dict[int, int], shards: int) -> dict[int, int]:
    """A map with shards up to `shards`: the new ones take slots from the heaviest until they reach the mean; no other slot moves."""
    out, old = dict(shard_of), 1 + max(shard_of.values(), default=-1)
    load = [0] * shards
    slots: dict[int, list[int]] = {s: [] for s in range(shards)}
    for v in sorted(sizes, key=lambda v: (-sizes[v], v)):
        load[out[v]] += sizes[v]
        slots[out[v]].append(v)
    mean = sum(load) / max(shards, 1)
    for new in range(old, shards):
        while old:
            donor = max(range(old), key=lambda s: (load[s], -s))
            fits = [v for v in slots[donor] if 0 < sizes[v] <= mean - load[new]]
            if not fits or load[donor] <= mean:
                break
            v = fits[0]
            slots[donor].remove(v)
            out[v] = new
            load[donor] -= sizes[v]
            load[new] += sizes[v]
    return out


def rebalance(shard_of: dict[int, int], sizes: dict[int, int], shards: int, tolerance: float = 0.01) -> dict[int, int]:
    """Move slots from the heaviest to the lightest shard while a shard is over the mean by more than tolerance and a move helps."""
    out, load = dict(shard_of), [0] * shards
    slots: dict[int, set[int]] = {s: set() for s in range(shards)}
    for v, n in sizes.items():
        load[out[v]] += n
        slots[out[v]].add(v)
    mean = sum(load) / max(shards, 1)
    while True:
        heavy, light = max(range(shards), key=lambda s: (load[s], -s)), min(range(shards), key=lambda s: (load[s], s))
        gap = load[heavy] - load[light]
        fits = [v for v in slots[heavy] if 0 < sizes[v] < gap]
        if load[heavy] <= mean * (1 + tolerance) or not fits:
            return out
        v = min(fits, key=lambda v: (abs(gap - 2 * sizes[v]), v))
        slots[heavy].remove(v)
        slots[light].add(v)
        out[v] = light
        load[heavy] -= sizes[v]
        load[light] += sizes[v]


def slot_sizes(records: DataFrame) -> list[tuple[int, int, int]]:
    """(vslot, rows, bytes) of records with the columns vslot and size: at most as many as there are slots."""
    return sorted(tuple(r) for r in records.groupBy("vslot").agg(F.count("*").alias("n_rows"), F.sum("size").alias("n_bytes")).collect())


def store_map(spark: SparkSession, path: str, version: int, shard_of: dict[int, int], sizes: list[tuple[int, int, int]]) -> None:
    """Add a version of the map to path."""
    rows = [(version, v, shard_of[v], n, b) for v, n, b in sizes]
    spark.createDataFrame(rows, MAP).coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(MAP).parquet(f"{path}/version={version}")


def kept(names: tuple[str, ...]) -> list[Column]:
    """The columns, renamed where they are named like one of a placed record, in whatever case."""
    used = NAMES | {n.lower() for n in names}
    out = []
    for name in names:
        free = name
        if name.lower() in NAMES:
            while free.lower() in used:
                free = f"kept_{free}"
            used.add(free.lower())
        out.append(F.col(f"`{name}`").alias(free))
    return out


def records_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32 and vslot of each document, and the columns to keep."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(RECORD_BYTES)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), slot_of(F.col(id_col), slots).alias("vslot"), *kept(keep))


def spread_repeated(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """records (of a table, with a number _row) with the slots of rows that share their id dealt by the id and that number; unique ids keep theirs."""
    repeated = records.groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("doc_id").alias("_id"), F.lit(True).alias("_again"))
    if not repeated.limit(1).count():
        return records.drop("_row")
    joined = records.join(repeated, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    salted = slot_of(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("_row").cast("string")), slots)
    return joined.withColumn("vslot", F.when(F.col("_again"), salted).otherwise(F.col("vslot"))).drop("_id", "_again", "_row")


def place(records: DataFrame, table: DataFrame) -> DataFrame:
    """Add shard and slot, the place in the shard from 0 on without gaps."""
    before = F.sum("n_rows").over(Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1))
    starts = table.select("vslot", "shard", F.coalesce(before, F.lit(0)).cast("long").alias("_first"))
    within = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "size", "text_crc32")) - 1
    numbered = records.withColumn("_within", within.cast("long"))
    return numbered.join(F.broadcast(starts), "vslot").withColumn("slot", F.col("_first") + F.col("_within")).drop("_first", "_within")  # a row for each slot


def write_shards(placed: DataFrame, path: str) -> None:
    """Write placed records with a folder for each shard; the rows of a virtual slot lie together in the order of their places."""
    placed.repartition("shard", "vslot").sortWithinPartitions("shard", "slot").write.mode("errorifexists").partitionBy("shard").parquet(path)


def op4_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of nearly equal bytes."""
    numbered = records_of(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("_row", F.monotonically_increasing_id())
    records = spread_repeated(materialise(numbered, run_folder(spark, "shard_records")))
    sizes, path = slot_sizes(records), run_folder(spark, "slot_map")
    store_map(spark, path, 1, deal({v: b for v, _, b in sizes}, 40), sizes)
    placed = place(records, load_map(spark, path, 1))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")


OP4_SQL = """
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) r(i))
), chars AS (
  SELECT doc_id, coalesce(text, '') AS text, CASE WHEN coalesce(text, '') = '' THEN [] ELSE list_transform(string_split(text, ''), lambda c: unicode(c)::BIGINT) END AS u FROM documents
), bytes AS (
  SELECT doc_id, text, flatten(list_transform(u, lambda c: CASE WHEN c < 128 THEN [c] WHEN c < 2048 THEN [192 + c // 64, 128 + c % 64]
    WHEN c < 65536 THEN [224 + c // 4096, 128 + c // 64 % 64, 128 + c % 64] ELSE [240 + c // 262144, 128 + c // 4096 % 64, 128 + c // 64 % 64, 128 + c % 64] END)) AS b FROM chars
), records AS (
  SELECT doc_id, strlen(text)::BIGINT + 16 AS size,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c // 256, t[xor(c, x) % 256 + 1]))) AS text_crc32,
    (('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 8192)::INT AS vslot
  FROM bytes, crc_table
), slots AS (
  SELECT vslot, count(*) AS n_rows, sum(size)::BIGINT AS n_bytes, row_number() OVER (ORDER BY sum(size) DESC, vslot) AS k FROM records GROUP BY vslot
), ordered AS (
  SELECT list(n_bytes ORDER BY k) AS sizes FROM slots
), dealt AS (
  SELECT 0::BIGINT AS k, -1::INT AS shard, list_transform(range(40), lambda s: 0::BIGINT) AS load
  UNION ALL
  SELECT k + 1, list_position(load, list_min(load)) - 1,
    list_concat(load[:list_position(load, list_min(load)) - 1], [list_min(load) + sizes[k + 1]], load[list_position(load, list_min(load)) + 1:])
  FROM dealt, ordered WHERE k < len(sizes)
), starts AS (
  SELECT s.vslot, d.shard::INT AS shard, (sum(n_rows) OVER (PARTITION BY d.shard ORDER BY s.vslot) - n_rows)::BIGINT AS first FROM slots s JOIN dealt d ON s.k = d.k
)
SELECT r.doc_id, r.size, r.text_crc32, 'bytes' AS law, shard,
  first + row_number() OVER (PARTITION BY r.vslot ORDER BY doc_id, size, text_crc32) - 1 AS slot, NULL::INT AS grown_shard, r.vslot
FROM records r JOIN starts ON r.vslot = starts.vslot
"""
