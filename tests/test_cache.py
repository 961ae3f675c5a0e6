import datetime as dt
import random
from collections import OrderedDict

import pytest

from quiverlake.operators import cache as C
from quiverlake.streaming.cache import replay_stream

LOG = "event_id long, ts timestamp, cluster_id int, op string, shard int"


def log_rows(seed, n=3000, keys=30, shards=3):
    pick, at, out = random.Random(seed), dt.datetime(2024, 1, 1), []
    for i in range(n):
        at += dt.timedelta(seconds=pick.choice([0, 1, 600, 7200]))
        key = int(pick.triangular(0, keys, 3))
        out.append((i, at, key, pick.choice(["read", "read", "write"]), key % shards))
    return out


def plain(rows, slots):
    caches, out = {}, []
    for e, _, key, op, shard in sorted(rows, key=lambda r: (r[1], r[0])):
        cache = caches.setdefault(shard, OrderedDict())
        last = next(reversed(cache), None)
        hit, evicted = key in cache, None
        cache.pop(key, None)
        cache[key] = op
        if len(cache) > slots:
            evicted = cache.popitem(last=False)[0]
        out.append((e, shard, key, op, hit, evicted, 0 if hit and last == key else 1 if hit else 2))
    return out, caches


def test_chunks_are_cut_by_rows(spark, monkeypatch):
    monkeypatch.setattr(C, "CHUNK_ROWS", 50)
    at = dt.datetime(2024, 1, 1)
    busy = [(i, at + dt.timedelta(minutes=i // 10), i % 7, "read", 0) for i in range(2000)]  # ten each minute
    idle = [(5000 + i, at + dt.timedelta(days=i), 1, "read", 1) for i in range(40)]
    sizes = C._chunked(spark.createDataFrame(busy + idle, LOG)).groupBy("shard", "chunk").count().collect()
    assert len(sizes) == 41 and {r["count"] for r in sizes if r.shard == 0} == {50}


@pytest.mark.parametrize(("seed", "slots"), [(1, 1), (2, 3), (3, 16)])
def test_chunked_replay_equals_a_plain_one(spark, monkeypatch, seed, slots):
    monkeypatch.setattr(C, "CHUNK_ROWS", 50)
    rows = log_rows(seed)
    log = spark.createDataFrame(rows, LOG).repartition(4)
    want, caches = plain(rows, slots)
    replayed = C.replay(log, slots)
    assert sorted(map(tuple, replayed.collect())) == sorted(want)
    left = {(r.shard, r.cluster_id): (r.recency, r.reload) for r in C.resident(log, slots).collect()}
    assert left == {(s, k): (len(c) - i, c[k] == "write") for s, c in caches.items() for i, k in enumerate(c)}
    counted = {r.shard: r for r in C.counters(replayed).collect()}
    for s in caches:
        mine = [r for r in want if r[1] == s]
        assert (counted[s].hits, counted[s].misses, counted[s].evictions) == (sum(r[4] for r in mine), sum(not r[4] for r in mine), sum(r[5] is not None for r in mine))
    last = {r.shard: r.last_cluster_id for r in C.last_cluster(log).collect()}
    assert last == {s: [r[2] for r in want if r[1] == s and r[3] == "read"][-1] for s in caches}


def test_replay_holds_chunks_together_where_a_join_turns_to_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(C, "CHUNK_ROWS", 50)
    rows = log_rows(4)
    log = spark.createDataFrame(rows, LOG).repartition(4)
    as_for_large_logs = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for name, value in as_for_large_logs.items():  # planned as sort-merge joins of several partitions
        spark.conf.set(name, value)
    try:
        replayed = C.replay(log, 3)
        assert replayed._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_COL") == 2  # of states by shard, of accesses by chunk
        assert sorted(map(tuple, replayed.collect())) == sorted(plain(rows, 3)[0])
    finally:
        for name in as_for_large_logs:
            spark.conf.unset(name)


def test_two_slots(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(i, at + dt.timedelta(seconds=i), c, "read", 0) for i, c in enumerate([0, 1, 2])]
    log = spark.createDataFrame(rows, LOG)
    assert [r.evicted for r in C.replay(log, 2).orderBy("event_id").collect()] == [None, None, 0]
    assert {r.cluster_id for r in C.resident(log, 2).collect()} == {1, 2}
    assert C.replay(log.limit(0), 2).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    rows = log_rows(9, 600)
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    source = tmp_path / "in"
    for k in range(3):
        spark.createDataFrame(ordered[200 * k : 200 * k + 200], LOG).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = replay_stream(stream, 4).writeStream.format("memory").queryName("lru").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(map(tuple, spark.table("lru").collect())) == sorted(plain(rows, 4)[0])
