"""Raw array files: fixed-width rows without a header, little-endian.

Kinds (option "kind") and what a row holds, "width" being its number of values:

- f32: `width` floats, read as (row_id, elements array<float>);
- u8: `width` bytes, read as (row_id, elements array<int>);
- topk: one record of a query's best hits, u64 id and f32 distance in 12 bytes, read as
  (query, rank, vector_id, distance); `width` records for each query, ranks from 1 on.

spark.read.format("raw_rows").options(kind=..., width=...).load(path) reads a file, or the
.bin files of a folder as one array in the order of their names. Files are read in pieces
of whole rows, and rows are numbered from 0 by their place. df.write.format("raw_rows")
with the same options writes one file for each partition, named in the partitions' order,
so a sorted DataFrame gives one sorted array. What to write is a column `elements`, or
vector_id and distance; other columns aren't stored. Files appear once all tasks are done;
appended files follow those that are there.

A file that isn't whole rows is an error, as are nulls, rows of another width and values
outside the type to write, and ids of 2**63 or more to read. No files are no rows.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from quiverlake.sources.tables import file_system

PIECE_BYTES = 64 << 20  # of a file in one task
BATCH_BYTES = 4 << 20
RECORD = np.dtype([("id", "<u8"), ("distance", "<f4")])
TYPES = {"f32": np.dtype("<f4"), "u8": np.dtype("u1"), "topk": RECORD}
SCHEMAS = {
    "f32": "row_id bigint, elements array<float>",
    "u8": "row_id bigint, elements array<int>",
    "topk": "query bigint, rank int, vector_id bigint, distance float",
}


def _options(options) -> tuple[str, int]:
    kind, width = options.get("kind", "f32"), int(options.get("width", "1"))
    if kind not in TYPES or width < 1:
        raise ValueError(f"kind has to be one of {', '.join(TYPES)} and width at least 1: {kind}, {width}")
    return kind, width


def _files(path: str) -> list[pyarrow.fs.FileInfo]:
    files, place = file_system(path)
    info = files.get_file_info(place)
    if info.type == pyarrow.fs.FileType.File:
        return [info]
    found = files.get_file_info(pyarrow.fs.FileSelector(place, allow_not_found=True))
    return sorted((f for f in found if f.base_name.endswith(".bin")), key=lambda f: f.base_name)


@dataclass
class Piece(InputPartition):
    """Items of a file, the first of which is item `number` of the whole array; an item is a row or a record."""

    file: str
    offset: int
    items: int
    number: int


class RawReader(DataSourceReader):
    def __init__(self, path: str, kind: str, width: int):
        self.path, self.kind, self.width = path, kind, width
        self.item_bytes = TYPES[kind].itemsize * (1 if kind == "topk" else width)

    def partitions(self) -> list[Piece]:
        out, number = [], 0
        each = max(PIECE_BYTES // self.item_bytes, 1)
        for f in _files(self.path):
            items, rest = divmod(f.size, self.item_bytes)
            if rest:
                raise ValueError(f"{f.path}: {f.size} bytes aren't whole rows of {self.item_bytes}")
            for first in range(0, items, each):
                size = min(each, items - first)
                out.append(Piece(f.path, first * self.item_bytes, size, number + first))
            number += items
        return out

    def read(self, partition: Piece | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's way to read no partitions
            return
        files, _ = file_system(self.path)
        each = max(BATCH_BYTES // self.item_bytes, 1)
        with files.open_input_file(partition.file) as f:
            f.seek(partition.offset)
            for first in range(0, partition.items, each):
                size = min(each, partition.items - first)
                content = f.read(size * self.item_bytes)
                if len(content) != size * self.item_bytes:
                    raise ValueError(f"{partition.file}: ends early")
                yield self.rows(np.frombuffer(content, TYPES[self.kind]), partition.number + first)

    def rows(self, values: np.ndarray, number: int) -> pa.RecordBatch:
        if self.kind == "topk":
            if len(values) and values["id"].max() >= 1 << 63:
                raise ValueError(f"{self.path}: an id doesn't fit a bigint")
            place = np.arange(number, number + len(values), dtype=np.int64)
            columns = [place // self.width, (place % self.width + 1).astype(np.int32), values["id"].astype(np.int64), values["distance"].astype(np.float32)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query", "rank", "vector_id", "distance"])
        n = len(values) // self.width
        flat = pa.array(values.astype(np.float32 if self.kind == "f32" else np.int32))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * self.width), flat)
        return pa.RecordBatch.from_arrays([pa.array(np.arange(number, number + n, dtype=np.int64)), lists], names=["row_id", "elements"])


@dataclass
class Written(WriterCommitMessage):
    partition: int
    file: str | None


class RawWriter(DataSourceArrowWriter):
    """Tasks write to a folder of the job; committing moves its files to their names, in the partitions' order."""

    def __init__(self, path: str, kind: str, width: int, overwrite: bool):
        self.path, self.kind, self.width, self.overwrite = path, kind, width, overwrite
        self.job = f"_{uuid.uuid4().hex}"

    def content(self, batch: pa.RecordBatch) -> bytes:
        if self.kind == "topk":
            ids, distances = batch.column("vector_id"), batch.column("distance")
            if ids.null_count or distances.null_count:
                raise ValueError("a hit without id or distance")
            out = np.empty(batch.num_rows, RECORD)
            out["id"], out["distance"] = ids.cast(pa.uint64()).to_numpy(), distances.to_numpy()  # a negative id is an error of the cast
            return out.tobytes()
        lists = batch.column("elements")
        flat = lists.flatten()
        if lists.null_count or flat.null_count or (batch.num_rows and pc.min_max(pc.list_value_length(lists)).as_py() != {"min": self.width, "max": self.width}):
            raise ValueError(f"a row that isn't {self.width} values")
        return flat.cast(pa.float32() if self.kind == "f32" else pa.uint8()).to_numpy().astype(TYPES[self.kind]).tobytes()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, folder = file_system(self.path)
        task, made, out = TaskContext.get(), None, None
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if out is None:
                    files.create_dir(f"{folder}/{self.job}", recursive=True)
                    made = f"{folder}/{self.job}/{task.partitionId()}-{task.taskAttemptId()}"
                    out = files.open_output_stream(made)
                out.write(self.content(batch))
        finally:
            if out is not None:
                out.close()
        return Written(task.partitionId(), made)

    def commit(self, messages: list[Written | None]) -> None:
        files, folder = file_system(self.path)
        files.create_dir(folder, recursive=True)
        there = _files(self.path)
        if self.overwrite:
            for f in there:
                files.delete_file(f.path)
        last = [int(m[1]) for f in there if not self.overwrite and (m := re.fullmatch(r"part-(\d+)\.bin", f.base_name))]
        made = sorted((m for m in messages if m is not None and m.file), key=lambda m: m.partition)
        for n, message in enumerate(made, max(last, default=-1) + 1):
            files.move(message.file, f"{folder}/part-{n:09d}.bin")
        self._clean()

    def abort(self, messages: list[Written | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        files, folder = file_system(self.path)
        if files.get_file_info(f"{folder}/{self.job}").type == pyarrow.fs.FileType.Directory:
            files.delete_dir(f"{folder}/{self.job}")


class RawSource(DataSource):
    """spark.read.format("raw_rows") and df.write.format("raw_rows")"""

    @classmethod
    def name(cls) -> str:
        return "raw_rows"

    def schema(self) -> str:
        return SCHEMAS[_options(self.options)[0]]

    def reader(self, schema) -> DataSourceReader:
        return RawReader(self.options["path"], *_options(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return RawWriter(self.options["path"], *_options(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Make the source known to a session."""
    spark.dataSource.register(RawSource)
