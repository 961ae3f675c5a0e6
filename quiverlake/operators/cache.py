"""Replaying an access log against sharded LRU caches of clusters.

A replay looks sequential, but an LRU cache's state is just the last `slots` distinct
keys. So a shard's log is cut into chunks of about as many accesses: each chunk is
summarised by its most recent keys (at most `slots`), the summaries are folded in order
into the state at every chunk's start, and then all chunks are replayed at once, each from
its own state. What is folded in one task for a shard is a few keys for each chunk, never
the log. Chunks begin at whole minutes, by counts of the accesses of each minute; only a
single minute is never cut.

Reads and writes both admit and touch. A cluster whose object fails to load never enters
a cache, so accesses to such clusters are to be left out of the log.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS, SHARDS, SLOTS = 97, 4, 16
INDEXES, CENTROID_SLOTS = 12, 4  # of the cache of centroids
CHUNK_ROWS = 200_000


def access_log(events: DataFrame, keys: int = KEYS, shards: int = SHARDS) -> DataFrame:
    """event_id, ts, cluster_id, op and shard of each event; purchases are writes."""
    cluster = (F.col("user_id") % keys).cast("int")
    return events.select("event_id", "ts", cluster.alias("cluster_id"), F.when(F.col("event_type") == "purchase", "write").otherwise("read").alias("op"), (cluster % shards).alias("shard"))


def _chunked(log: DataFrame) -> DataFrame:
    """Add the number of the chunk. A minute's chunk follows from the accesses of its shard before it."""
    timed = log.withColumn("_minute", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 60))
    before = F.sum("_n").over(Window.partitionBy("shard").orderBy("_minute").rowsBetween(Window.unboundedPreceding, -1))
    minutes = timed.groupBy("shard", "_minute").agg(F.count("*").alias("_n"))
    chunks = minutes.select("shard", "_minute", F.floor(F.coalesce(before, F.lit(0)) / CHUNK_ROWS).alias("chunk"))
    return timed.join(chunks, ["shard", "_minute"]).drop("_minute")


def chunk_states(chunked: DataFrame, slots: int) -> DataFrame:
    """(shard, chunk, state): the resident clusters at the start of each chunk, the most recent first."""
    last = chunked.groupBy("shard", "chunk", "cluster_id").agg(F.max(F.struct("ts", "event_id")).alias("last"))
    place = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy(F.desc("last")))
    recent = last.withColumn("place", place).where(F.col("place") <= slots).groupBy("shard", "chunk").agg(F.sort_array(F.collect_list(F.struct("place", "cluster_id"))).alias("recent"))
    rows = recent.select("shard", "chunk", F.transform("recent", lambda x: x["cluster_id"]).alias("recent"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, state = None, []
        for batch in batches:
            out = []
            for s, chunk, keys in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != shard:
                    shard, state = s, []
                out.append((s, chunk, state))
                state = (keys + [k for k in state if k not in keys])[:slots]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 3, (pa.int32(), pa.int64(), pa.list_(pa.int32())), strict=True)], names=["shard", "chunk", "state"])

    return rows.repartition("shard").sortWithinPartitions("shard", "chunk").mapInArrow(fold, "shard int, chunk bigint, state array<int>")


def replay(log: DataFrame, slots: int = SLOTS) -> DataFrame:
    """event_id, shard, cluster_id, op, hit, evicted and priority of each access.

    priority: 0 if the shard's previous access was to the same cluster, 1 if the cluster
    is another resident one, 2 if it has to be loaded.
    """
    chunked = _chunked(log)
    columns = "shard", "chunk", "ts", "event_id", "cluster_id", "op", "state"
    joined = chunked.join(chunk_states(chunked, slots), ["shard", "chunk"]).select(*columns)
    fields = pa.schema([("event_id", pa.int64()), ("shard", pa.int32()), ("cluster_id", pa.int32()), ("op", pa.string()), ("hit", pa.bool_()), ("evicted", pa.int32()), ("priority", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cache = None, OrderedDict()
        for batch in batches:
            out = []
            shard, chunk, _, event, key, op = (c.to_pylist() for c in batch.columns[:6])
            for i in range(batch.num_rows):
                if (shard[i], chunk[i]) != at:
                    at = shard[i], chunk[i]
                    cache = OrderedDict.fromkeys(reversed(batch.column(6)[i].as_py()))
                out.append((event[i], shard[i], key[i], op[i], *touch(cache, key[i], slots)))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True) if out else [[]] * 7, fields, strict=True)], schema=fields)

    # not by the join's own keys: Spark would take its exchange for this one and may yet drop it for a broadcast join, which tears chunks apart
    dealt = joined.repartition(F.xxhash64("shard", "chunk")).sortWithinPartitions("shard", "chunk", "ts", "event_id")
    return dealt.mapInArrow(run, "event_id bigint, shard int, cluster_id int, op string, hit boolean, evicted int, priority int")


def touch(cache: OrderedDict, key: int, slots: int) -> tuple[bool, int | None, int]:
    """Admit or touch key: whether it was resident, what was evicted, and its priority class."""
    if key in cache:
        priority = 0 if next(reversed(cache)) == key else 1
        cache.move_to_end(key)
        return True, None, priority
    cache[key] = None
    return False, cache.popitem(last=False)[0] if len(cache) > slots else None, 2


def resident(log: DataFrame, slots: int = SLOTS) -> DataFrame:
    """shard, cluster_id, recency (1 is the latest) and reload (the last access was a write) of what is cached at the log's end."""
    last = log.groupBy("shard", "cluster_id").agg(F.max(F.struct("ts", "event_id", "op")).alias("last"))
    place = F.row_number().over(Window.partitionBy("shard").orderBy(F.desc("last"))).cast("long")
    return last.select("shard", "cluster_id", place.alias("recency"), (F.col("last.op") == "write").alias("reload")).where(F.col("recency") <= slots)


def last_cluster(log: DataFrame) -> DataFrame:
    """shard and the cluster of its last read."""
    return log.where("op = 'read'").groupBy("shard").agg(F.max_by("cluster_id", F.struct("ts", "event_id")).alias("last_cluster_id"))


def counters(replayed: DataFrame) -> DataFrame:
    """Reads, writes, hits, misses and evictions of each shard."""
    number = lambda c: F.count(F.when(c, 1))
    return replayed.groupBy("shard").agg(
        number(F.col("op") == "read").alias("reads"), number(F.col("op") == "write").alias("writes"), number(F.col("hit")).alias("hits"),
        number(~F.col("hit")).alias("misses"), F.count("evicted").alias("evictions"))
