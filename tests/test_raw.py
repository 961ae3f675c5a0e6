"""Raw array files: bytes, numbering, pieces, appending, and what is refused."""

import struct

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quiverlake.sources import raw
from quiverlake.sources.tables import file_system, shared_folder


def read(spark, path, **options):
    raw.register(spark)
    return spark.read.format("raw_rows").options(**options).load(path)


def write(df, path, mode="append", **options):
    raw.register(df.sparkSession)
    df.write.format("raw_rows").options(**options).mode(mode).save(path)


def content(path):
    files, folder = file_system(path)
    found = sorted(files.get_file_info(raw.pyarrow.fs.FileSelector(folder)), key=lambda f: f.path)
    assert all(f.base_name.startswith("part-") for f in found)  # nothing of the job is left
    return b"".join(files.open_input_stream(f.path).read() for f in found)


def test_sorted_rows_make_one_array(spark):
    values = np.random.default_rng(1).random((500, 3), np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(values)], "id long, elements array<float>").repartition(5)
    path = shared_folder(spark, "raw")
    write(table.repartitionByRange(4, "id").sortWithinPartitions("id"), path, width=3)
    assert content(path) == values.tobytes()
    got = read(spark, path, width=3).orderBy("row_id").collect()
    assert [r.row_id for r in got] == list(range(500)) and np.array_equal([r.elements for r in got], values)
    write(table.where("id < 2").coalesce(1).sortWithinPartitions("id"), path, width=3)  # follows
    assert content(path) == values.tobytes() + values[:2].tobytes()
    write(table.where("id = 7"), path, "overwrite", width=3)
    assert content(path) == values[7].tobytes()
    write(table.limit(0), path, "overwrite", width=3)
    assert content(path) == b"" and read(spark, path, width=3).count() == 0


def test_pieces_of_a_file(monkeypatch, tmp_path):
    monkeypatch.setattr(raw, "PIECE_BYTES", 70)
    monkeypatch.setattr(raw, "BATCH_BYTES", 25)
    for name, a, b in (("a.bin", 0, 100), ("b.bin", 100, 130)):
        (tmp_path / name).write_bytes(bytes(range(a, b)))
    (tmp_path / "b.txt").write_bytes(b"other")
    reader = raw.RawReader(str(tmp_path), "u8", 10)
    pieces = reader.partitions()
    assert [(p.offset, p.items, p.number) for p in pieces] == [(0, 7, 0), (70, 3, 7), (0, 3, 10)]
    rows = [r for p in pieces for b in reader.read(p) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert rows == [(i, list(range(10 * i, 10 * i + 10))) for i in range(13)]
    assert raw.RawReader(str(tmp_path / "none"), "u8", 10).partitions() == []
    with pytest.raises(ValueError, match="whole rows"):
        raw.RawReader(str(tmp_path / "a.bin"), "u8", 7).partitions()


def test_top_k_records(spark, tmp_path):
    hits = [(2**40 + i, i / 4) for i in range(6)]
    (tmp_path / "golden.bin").write_bytes(b"".join(struct.pack("<Qf", *h) for h in hits))
    got = read(spark, str(tmp_path / "golden.bin"), kind="topk", width=3).orderBy("query", "rank")
    assert list(map(tuple, got.collect())) == [(i // 3, i % 3 + 1, *h) for i, h in enumerate(hits)]
    path = shared_folder(spark, "raw")
    write(got.coalesce(1), path, kind="topk", width=3)
    assert content(path) == (tmp_path / "golden.bin").read_bytes()
    (tmp_path / "far.bin").write_bytes(struct.pack("<Qf", 2**63, 1))
    with pytest.raises(PySparkException, match="bigint"):
        read(spark, str(tmp_path / "far.bin"), kind="topk").collect()


@pytest.mark.parametrize(
    ("kind", "column", "value"),
    [("u8", "elements array<int>", [1, 256]), ("u8", "elements array<int>", [1]), ("f32", "elements array<float>", None),
     ("f32", "elements array<float>", [1.0, None]), ("topk", "vector_id bigint", -1), ("topk", "vector_id bigint", None)],
)
def test_rows_that_are_refused_leave_nothing(spark, kind, column, value):
    path = shared_folder(spark, "raw")
    table = spark.createDataFrame([(value,)], column).withColumn("distance", F.lit(0.5).cast("float"))
    with pytest.raises(PySparkException):
        write(table, path, kind=kind, width=2)
    files, folder = file_system(path)
    assert not files.get_file_info(raw.pyarrow.fs.FileSelector(folder, allow_not_found=True))


@pytest.mark.parametrize("options", [{"kind": "f64"}, {"width": 0}])
def test_options_are_checked(spark, tmp_path, options):
    with pytest.raises(PySparkException):
        read(spark, str(tmp_path), **options).collect()
