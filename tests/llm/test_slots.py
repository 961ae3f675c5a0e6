import hashlib
import random
import zlib
from collections import Counter

import pytest

from quiverlake.llm import virtual_slots as vs

from .common import documents, nothing


def loads(shard_of, sizes, shards):
    out = [0] * shards
    for v, n in sizes.items():
        out[shard_of[v]] += n
    return out


def test_maps_are_near_equal_and_edits_are_small():
    pick = random.Random(3)
    sizes = {v: pick.randrange(1, 1000) for v in range(4000)}
    first = vs.deal(sizes, 40)
    even = loads(first, sizes, 40)
    assert max(even) - min(even) <= 1000
    grown = vs.grow(first, sizes, 41)
    moved = {v for v in sizes if grown[v] != first[v]}
    assert moved and all(grown[v] == 40 for v in moved)
    assert max(loads(grown, sizes, 41)) <= 1.03 * sum(sizes.values()) / 41
    for v in range(0, 400):
        sizes[v] *= 5
    again = vs.rebalance(first, sizes, 40)
    assert max(loads(again, sizes, 40)) <= 1.011 * sum(sizes.values()) / 40
    assert sum(again[v] != first[v] for v in sizes) < 800
    assert vs.rebalance(again, sizes, 40) == again
    assert vs.deal({}, 3) == {} == vs.grow({}, {}, 3) == vs.rebalance({}, {}, 3)


def test_query(spark, tmp_path):
    docs = documents(spark, [(100 + i, "t" * (i % 50), *[None] * 9) for i in range(500)])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = vs.op4_virtual_slots(spark, str(tmp_path)).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    for shard in range(40):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    unique = [i for i, n in Counter(r.doc_id for r in got).items() if n == 1]
    assert len({r.vslot for r in got if r.doc_id in unique}) > 1 and all(r.vslot == vslot(r.doc_id) for r in got if r.doc_id in unique)
    (tmp_path / "none").mkdir()
    nothing(spark).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert vs.op4_virtual_slots(spark, str(tmp_path / "none")).count() == 0


def vslot(doc_id):
    return int(hashlib.md5(str(doc_id).encode()).hexdigest()[:8], 16) % 8192


@pytest.mark.parametrize("hot", [7, None])
def test_one_id_in_most_rows(spark, tmp_path, hot):
    rows = [(hot, "t" * 1000)] * 2000 + [(100 + i, "u" * 1000) for i in range(500)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = vs.op4_virtual_slots(spark, str(tmp_path)).collect()
    size = Counter()
    for r in got:
        size[r.shard] += r.size
    assert len(got) == 2500 and len(size) == 40 and max(size.values()) - min(size.values()) <= 4 * 1016
    for shard in range(40):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))


def test_versions_are_kept(spark, tmp_path):
    sizes = [(1, 2, 30), (2, 1, 10)]
    vs.store_map(spark, f"file://{tmp_path}/m", 1, {1: 0, 2: 1}, sizes)
    vs.store_map(spark, f"file://{tmp_path}/m", 2, {1: 0, 2: 2}, sizes)
    assert [sorted(r.shard for r in vs.load_map(spark, f"file://{tmp_path}/m", v).collect()) for v in (1, 2)] == [[0, 1], [0, 2]]


def test_shards_are_written_whole(spark, tmp_path):
    docs = documents(spark, [(100 + i, f"t{i}", *[None] * 9) for i in range(60)])
    records = vs.records_of(docs, keep=("text", "lang"))
    sizes = vs.slot_sizes(records)
    table = spark.createDataFrame([(1, v, s, n, b) for (v, n, b), s in zip(sizes, vs.deal({v: b for v, _, b in sizes}, 5).values(), strict=False)], vs.MAP)
    vs.write_shards(vs.place(records, table), f"file://{tmp_path}/shards")
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    assert Counter((r.doc_id, r.text, r.lang) for r in back.collect()) == Counter((r.doc_id, r.text, r.lang) for r in docs.collect())
    for s in {r.shard for r in back.collect()}:
        assert sorted(r.slot for r in back.collect() if r.shard == s) == list(range(sum(r.shard == s for r in back.collect())))


def test_kept_columns_with_clashing_names(spark, tmp_path):
    rows = [(i, f"t{i}", i % 3, f"s{i}", "a", "b") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, size int, Slot string, kept_size string, _first string")
    records = vs.records_of(docs, keep=("size", "Slot", "kept_size", "_first", "doc_id", "text"))
    sizes = vs.slot_sizes(records)
    vs.store_map(spark, f"file://{tmp_path}/m", 1, vs.deal({v: b for v, _, b in sizes}, 3), sizes)
    placed = vs.place(records, vs.load_map(spark, f"file://{tmp_path}/m", 1))
    vs.write_shards(placed, f"file://{tmp_path}/shards")
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    names = "kept_doc_id", "text", "kept_kept_size", "kept_Slot", "kept_size", "kept__first"
    assert Counter(tuple(r[n] for n in names) for r in back.collect()) == Counter(rows)
    assert {(r.doc_id, r.size) for r in back.collect()} == {(i, len(f"t{i}") + 16) for i in range(20)}


def test_text_of_some_megabytes(spark):
    text = "größe " * 700_000
    (r,) = vs.records_of(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert (r.size, r.text_crc32) == (len(text.encode()) + 16, zlib.crc32(text.encode()))
