"""Versions of an index: snapshots, replaced clusters, writers that compete."""

import threading

import pytest
from pyspark.sql import functions as F

from quiverlake.sources import manifest as M

SCHEMA = "cluster_id int, vector_id bigint, codes array<int>"


def rows(spark, clusters, mark, n=5):
    return spark.createDataFrame([(c, v, [mark, c]) for c in clusters for v in range(n)], SCHEMA)


def marks(df):
    return {r.cluster_id: r.m for r in df.groupBy("cluster_id").agg(F.min(F.col("codes")[0]).alias("m")).collect()}


def test_versions_stay_readable(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    assert M.versions(spark, path) == [] and M.load(spark, path, SCHEMA).count() == 0
    M.save(rows(spark, range(4), 1), path)
    first = M.snapshot(spark, path)
    M.overwrite_clusters(rows(spark, [2, 7], 2), path, replaced=[2, 3])
    assert M.versions(spark, path) == [1, 2]
    assert marks(M.load(spark, path, SCHEMA)) == {0: 1, 1: 1, 2: 2, 7: 2}
    assert marks(M.load(spark, path, SCHEMA, first)) == dict.fromkeys(range(4), 1) == marks(M.load(spark, path, SCHEMA, M.snapshot(spark, path, 1)))
    M.save(rows(spark, [5], 3), path)
    assert marks(M.load(spark, path, SCHEMA)) == {5: 3}
    assert len(M.vacuum(spark, path, keep=1)) == 2 and M.versions(spark, path) == [3] and marks(M.load(spark, path, SCHEMA)) == {5: 3}
    M.save(rows(spark, [], 4), path)
    assert M.load(spark, path, SCHEMA).count() == 0


def test_a_reader_keeps_its_snapshot_while_a_cluster_is_replaced(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    M.save(rows(spark, range(3), 1, 2000), path)
    reading = M.load(spark, path, SCHEMA)
    seen, stop = [], threading.Event()

    def read():
        while not stop.is_set():
            seen.append(marks(reading))

    reader = threading.Thread(target=read)
    reader.start()
    for mark in range(2, 6):
        M.overwrite_clusters(rows(spark, [1], mark), path)
    stop.set()
    reader.join()
    seen.append(marks(reading))
    assert all(x == {0: 1, 1: 1, 2: 1} for x in seen) and marks(M.load(spark, path, SCHEMA)) == {0: 1, 1: 5, 2: 1}


def test_losing_writers_try_again(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    M.save(rows(spark, range(8), 0), path)
    failed = []

    def write(c):
        try:
            M.overwrite_clusters(rows(spark, [c], 10 + c), path)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    writers = [threading.Thread(target=write, args=(c,)) for c in range(8)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert not failed and M.versions(spark, path) == list(range(1, 10))
    assert marks(M.load(spark, path, SCHEMA)) == {c: 10 + c for c in range(8)}


def test_conflicts_are_told(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/index"
    base = M.save(rows(spark, [0], 1), path)
    assert not M._add(spark, path, base)
    monkeypatch.setattr(M, "snapshot", lambda *_: M.Snapshot())
    with pytest.raises(M.Conflict):
        M.commit(spark, path, lambda old: old)


def test_only_named_clusters_are_read(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    M.save(rows(spark, range(4), 1), path)
    M.overwrite_clusters(rows(spark, [2], 2), path)
    plan = M.load(spark, path, SCHEMA).where("cluster_id = 2")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [") >= 1 and "cluster_id" in plan.split("PartitionFilters: [")[1]


def positions(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.cluster_id, []).append((r.vector_id, r.codes[0]))
    return {c: sorted(x) for c, x in out.items()}


def test_appended_lists_follow_each_other(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    M.append(rows(spark, [0, 1], 1, 3), path)
    M.append(rows(spark, [1, 2], 2, 2), path)
    first = M.snapshot(spark, path)
    M.append(rows(spark, [1], 3, 4), path)
    want = {0: [(k, 1) for k in range(3)], 1: [(0, 1), (1, 1), (2, 1), (3, 2), (4, 2), *((5 + k, 3) for k in range(4))], 2: [(0, 2), (1, 2)]}
    assert positions(M.load(spark, path, SCHEMA)) == want and M.snapshot(spark, path).sizes() == {0: 3, 1: 9, 2: 2}
    assert first.sizes() == {0: 3, 1: 5, 2: 2} and positions(M.load(spark, path, SCHEMA, first))[1] == want[1][:5]
    folded = M.compact(spark, path, SCHEMA)
    assert [len(p) for _, p in sorted(folded.clusters.items())] == [1, 1, 1] and positions(M.load(spark, path, SCHEMA)) == want
    assert M.compact(spark, path, SCHEMA) == folded
    M.vacuum(spark, path)
    assert positions(M.load(spark, path, SCHEMA)) == want


def test_compaction_beside_writers(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/index"
    for mark in (1, 2):
        M.append(rows(spark, [0, 1, 2], mark, 2), path)
    stored, others = M._store, [lambda: M.append(rows(spark, [0], 3, 1), path), lambda: M.overwrite_clusters(rows(spark, [1], 4, 1), path)]

    def late(*args):  # others commit between the folding's files and its version
        out = stored(*args)
        monkeypatch.setattr(M, "_store", stored)
        for write in others:
            write()
        return out

    monkeypatch.setattr(M, "_store", late)
    after = M.compact(spark, path, SCHEMA)
    assert {c: len(p) for c, p in after.clusters.items()} == {0: 2, 1: 1, 2: 1}
    assert positions(M.load(spark, path, SCHEMA)) == {0: [(0, 1), (1, 1), (2, 2), (3, 2), (4, 3)], 1: [(0, 4)], 2: [(0, 1), (1, 1), (2, 2), (3, 2)]}


def test_appending_writers_compete(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    writers = [threading.Thread(target=lambda mark=mark: M.append(rows(spark, [0, mark], mark, 3), path)) for mark in range(1, 6)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    got = positions(M.load(spark, path, SCHEMA))
    assert [v for v, _ in got[0]] == list(range(15)) and sorted(m for _, m in got[0]) == sorted([1, 2, 3, 4, 5] * 3)
    assert all(got[mark] == [(k, mark) for k in range(3)] for mark in range(1, 6))
