import struct
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo

from quiverlake.plans.oracles import BLOB_CASES
from quiverlake.sources import blob
from quiverlake.sources.tables import shared_folder

WORDS = np.arange(2 * 4 * 3, dtype=np.float32).reshape(2, 4, 3)
CODES = np.array([[0, 1], [3, 2], [1, 1]])


def test_pack_and_unpack():
    content = blob.pack(WORDS, CODES)
    assert len(content) == blob.size_of(2, 4, 3, 3) == 28 + 4 * 24 + 6
    assert struct.unpack_from("<7I", content) == (0x43505100, 1, 2, 4, 6, 3, 3) and content[:4] == bytes.fromhex("00515043")
    words, codes = blob.unpack(content + b"more")
    assert np.array_equal(words, WORDS) and np.array_equal(codes, CODES)
    assert blob.unpack(content[:-1]) == blob.unpack(b"") == blob.unpack(None) == -22
    assert blob.unpack(blob.pack(WORDS, CODES + 2)) == -22  # a code beyond the codebook
    assert blob.unpack(blob.pack(WORDS, CODES[:0]))[1].shape == (0, 2)


def test_native_status_agrees(spark):
    cases = [None if h is None else bytes.fromhex(h) for h in BLOB_CASES]
    table = spark.createDataFrame(list(enumerate(cases)), "k int, content binary")
    got = {r.k: r.status for r in table.select("k", blob.status(F.col("content")).alias("status")).collect()}
    for k, content in enumerate(cases):
        found = blob.unpack(content)
        assert got[k] == (found if isinstance(found, int) else 0), k


def lists(spark):
    rows = [(c, i, 10 * c + i, [(c + i) % 4, i % 4]) for c in range(5) for i in range(c)]
    return spark.createDataFrame(rows, "cluster_id int, vector_id long, global_id long, codes array<int>").repartition(4)


def test_objects_round_trip(spark):
    table = lists(spark)
    objects = blob.objects(table, WORDS.tolist())
    want = sorted(tuple(r) for r in table.select("cluster_id", "vector_id", "codes").collect())
    assert objects.count() == 4 and sorted(map(tuple, blob.coded_vectors(objects).collect())) == want
    assert all(len(r.content) == blob.size_of(2, 4, 3, r.cluster_id) for r in objects.collect())
    assert blob.objects(table.limit(0), WORDS.tolist()).count() == 0


def test_data_source(spark):
    path = shared_folder(spark, "objects")
    table = lists(spark)
    blob.write_lists(table, WORDS.tolist(), path, partitions=1)
    read = spark.read.format("ivfpq_blob").load(path)
    assert sorted(map(tuple, read.collect())) == sorted(tuple(r) for r in table.select("cluster_id", "vector_id", "codes").collect())
    two = read.where("cluster_id IN (2, 3)")
    assert two.rdd.getNumPartitions() == 2 and two.count() == 5
    assert read.where("cluster_id = 77").count() == 0


def local(path):
    return Path(path.removeprefix("file://"))


@pytest.mark.parametrize("partitions", [1, 3, 7])
def test_objects_are_written_in_parts_and_read_in_ranges(spark, partitions):
    path = shared_folder(spark, "objects")
    rng = np.random.default_rng(partitions)
    codes = rng.integers(0, 4, (4000, 2))
    table = spark.createDataFrame([(0 if i < 3900 else 1, i if i < 3900 else i - 3900, codes[i].tolist()) for i in range(4000)], "cluster_id int, vector_id long, codes array<int>").repartition(5).cache()
    blob.write_lists(table, WORDS.tolist(), path, partitions=partitions)
    names = sorted(f.name for f in local(path).iterdir())
    assert len(names) >= partitions and not any(n.startswith("_") for n in names)
    whole = b"".join((local(path) / n).read_bytes() for n in sorted((n for n in names if n.startswith("cluster_0.")), key=lambda n: (not n.endswith(".bin"), n)))
    assert whole == blob.pack(WORDS, codes[:3900])  # the parts make up a plain object
    want = sorted(tuple(r) for r in table.collect())
    for piece in (1, 100, 1 << 20):
        read = spark.read.format("ivfpq_blob").option("piece_bytes", max(piece, 97)).load(path)
        assert sorted(map(tuple, read.collect())) == want
        assert read.rdd.getNumPartitions() >= (60 if piece <= 100 else 2)
    some = spark.read.format("ivfpq_blob").option("piece_bytes", 500).load(path)
    for condition in ("vector_id = 77", "vector_id IN (3, 3899, 9999)", "vector_id >= 3890 AND cluster_id = 0", "vector_id < 5", "vector_id > 98 AND vector_id <= 101", "vector_id < 0"):
        assert sorted(map(tuple, some.where(condition).collect())) == sorted(tuple(r) for r in table.where(condition).collect()), condition
    fresh = table.where("cluster_id = 0 AND vector_id < 10")
    blob.write_lists(fresh, WORDS.tolist(), path, partitions=2)
    assert some.where("cluster_id = 0").count() == 10 and some.where("cluster_id = 1").count() == 100
    blob.write_lists(fresh, WORDS.tolist(), path, mode="overwrite")
    assert spark.read.format("ivfpq_blob").load(path).count() == 10


def test_only_asked_codes_are_read(spark, tmp_path):
    (tmp_path / "cluster_3.bin").write_bytes(blob.pack(WORDS, np.tile(CODES, (1000, 1))))
    reader = blob.ObjectReader(f"file://{tmp_path}", 1000)
    pieces = reader.partitions()
    assert len(pieces) > 6 and sum(b.num_rows for p in pieces for b in reader.read(p)) == 3000
    list(reader.pushFilters([EqualTo(("vector_id",), 1500)]))
    assert [b.num_rows for p in pieces for b in reader.read(p)] == [1]


def test_odd_objects(spark, tmp_path):
    cases = {"short": blob.pack(WORDS, CODES)[:-1], "code": blob.pack(WORDS, CODES + 2), "magic": b"x" + blob.pack(WORDS, CODES)[1:], "header": b"abc", "nothing": b""}
    for name, content in cases.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "cluster_1.bin").write_bytes(content)
        reader = blob.ObjectReader(f"file://{tmp_path}/{name}", 40)
        with pytest.raises(ValueError, match="not a valid object"):
            [list(reader.read(p)) for p in reader.partitions()]
    good = {"more": (blob.pack(WORDS, CODES) + b"behind it", 3), "none": (blob.pack(WORDS, CODES[:0]), 0), "flat": (blob.pack(WORDS[:0], np.zeros((5, 0), int)), 5)}
    for name, (content, number) in good.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "cluster_1.bin").write_bytes(content)
        reader = blob.ObjectReader(f"file://{tmp_path}/{name}", 30)
        assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == number
    (tmp_path / "gap").mkdir()
    (tmp_path / "gap/cluster_1.bin").write_bytes(blob.pack(WORDS, CODES)[:-2])
    (tmp_path / "gap/cluster_1.000000000002.codes").write_bytes(b"\1")
    with pytest.raises(ValueError, match="not a valid object"):
        list((reader := blob.ObjectReader(f"file://{tmp_path}/gap")).read(reader.partitions()[0]))


def test_gaps_and_wrong_codes_leave_nothing(spark):
    path = shared_folder(spark, "objects")
    for row in ([(0, 0, [1, 1]), (0, 2, [1, 1])], [(0, 0, [1, 4])], [(0, 0, [1])], [(0, 1, [1, 1])], [(0, 0, [1, 1]), (0, 0, [1, 1])]):
        with pytest.raises(Exception):  # noqa: B017
            blob.write_lists(spark.createDataFrame(row, "cluster_id int, vector_id long, codes array<int>"), WORDS.tolist(), path)
        assert not local(path).exists() or not list(local(path).iterdir()), row


def test_raw_files():
    assert blob.float_array(struct.pack("<2f", 1.5, -2)).tolist() == [1.5, -2.0]
    hits = [(7, 0.5), (2**40, 1.25)]
    assert len(blob.pack_topk(hits)) == 24 and blob.topk_records(blob.pack_topk(hits)) == hits


@pytest.mark.parametrize("field", range(7))
def test_header_fields(spark, field):
    values = [0xFF00FE80 + k for k in range(7)]
    table = spark.createDataFrame([(bytes(struct.pack("<7I", *values)),)], "content binary")
    assert int(table.select(blob.header_field(F.col("content"), field)).first()[0]) == values[field]
