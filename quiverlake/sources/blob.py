"""Cluster objects: a header, a PQ codebook and PQ codes in one blob.

Layout (little-endian): seven u32 (magic, version, M, ksub, D, dsub, number of vectors),
then M * ksub * dsub f32 of codebook, then number * M bytes of codes. Bytes behind that
are allowed. Sizes are checked in whole numbers that can't overflow, and codes have to be
below ksub.

The data source "ivfpq_blob" reads a folder of such objects, named cluster_<id>.bin, as
rows (cluster_id, vector_id, codes). An object is read in ranges of bytes by as many tasks
as it takes; a task reads the header and then the codes that begin in its range. Filters on
cluster_id choose objects, filters on vector_id the codes that are read.

Written objects may have parts: cluster_<id>.bin holds the header, with the number of all
vectors, the codebook and the first codes, and cluster_<id>.<first>.codes further codes from
vector <first> on. Put together in the order of their names they are a plain object. Writing
(rows cluster_id, vector_id, codes and n_vectors, sorted; option "codebook") streams codes
to files of the job, and committing gives them their names once all of them fit together. No task
holds a cluster. Appending replaces the clusters that are written; overwriting all.
"""

from __future__ import annotations

import base64
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)

from quiverlake.sources.tables import file_system, partitions_for

# Fixed values of the format.
MAGIC, VERSION, HEADER = 0x43505100, 1, struct.Struct("<7I")
EINVAL = -22
PIECE_BYTES = 16 << 20  # of an object in one task
BATCH_BYTES = 1 << 20


def size_of(n_sub: int, ksub: int, dsub: int, number):
    """Bytes of an object, for whole numbers or columns."""
    return number * n_sub + (HEADER.size + 4 * n_sub * ksub * dsub)


def pack(codebook: np.ndarray, codes: np.ndarray, dim: int | None = None) -> bytes:
    """An object from a codebook (M, ksub, dsub) and codes (number, M)."""
    m, ksub, dsub = codebook.shape
    return HEADER.pack(MAGIC, VERSION, m, ksub, m * dsub if dim is None else dim, dsub, len(codes)) + codebook.astype("<f4").tobytes() + codes.astype(np.uint8).tobytes()


def unpack(blob: bytes | None) -> tuple[np.ndarray, np.ndarray] | int:
    """(codebook, codes), or EINVAL if the object isn't valid."""
    if blob is None or len(blob) < HEADER.size:
        return EINVAL
    magic, version, m, ksub, _, dsub, number = HEADER.unpack_from(blob)
    if magic != MAGIC or version != VERSION or len(blob) < size_of(m, ksub, dsub, number):
        return EINVAL
    codebook = np.frombuffer(blob, "<f4", m * ksub * dsub, HEADER.size).reshape(m, ksub, dsub)
    codes = np.frombuffer(blob, np.uint8, number * m, HEADER.size + 4 * m * ksub * dsub).reshape(number, m)
    return (codebook, codes) if not codes.size or codes.max() < ksub else EINVAL


def header_field(blob: Column, number: int) -> Column:
    """A u32 of the header; bytes are swapped in their hex form."""
    h = F.hex(F.substring(blob, 4 * number + 1, 4))
    return F.conv(F.concat(*[F.substring(h, 7 - 2 * k, 2) for k in range(4)]), 16, 10).cast("decimal(38,0)")


def status(blob: Column) -> Column:
    """0 or EINVAL from the header and the size, without reading the codes."""
    m, ksub, dsub, number = (header_field(blob, k) for k in (2, 3, 5, 6))
    need = F.lit(HEADER.size) + (m * ksub).cast("decimal(38,0)") * dsub * 4 + number * m
    bad = blob.isNull() | (F.octet_length(blob) < HEADER.size) | (header_field(blob, 0) != MAGIC) | (header_field(blob, 1) != VERSION)
    return F.when(bad, EINVAL).when(F.octet_length(blob) < need, EINVAL).otherwise(0)


def objects(lists: DataFrame, codebook: list[list[list[float]]]) -> DataFrame:
    """(cluster_id, content): one object for each cluster, as a column. An object is a cluster, so a task holds one at a time; write_lists() doesn't."""
    words = np.array(codebook, np.float32)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cluster, parts = None, []
        made = lambda: pa.RecordBatch.from_arrays([pa.array([cluster], pa.int32()), pa.array([pack(words, np.concatenate(parts))], pa.binary())], names=["cluster_id", "content"])
        for batch in batches:
            ids = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if parts and ids[a] != cluster:
                    yield made()
                    parts = []
                cluster = int(ids[a])
                parts.append(batch.column(2).slice(a, b - a).flatten().to_numpy().reshape(b - a, -1))
        if parts:
            yield made()

    dealt = lists.select("cluster_id", "vector_id", "codes").repartition("cluster_id").sortWithinPartitions("cluster_id", "vector_id")
    return dealt.mapInArrow(build, "cluster_id int, content binary")


def coded_vectors(blobs: DataFrame) -> DataFrame:
    """(cluster_id, vector_id, codes) of objects (cluster_id, content); objects that aren't valid give no rows."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cluster, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = unpack(content.as_py())
                if not isinstance(found, int):
                    yield _rows(cluster, found[1])

    return blobs.select("cluster_id", "content").mapInArrow(read, ROWS)


ROWS = "cluster_id int, vector_id bigint, codes array<int>"


def _rows(cluster: int, codes: np.ndarray, first: int = 0) -> pa.RecordBatch:
    n, m = codes.shape
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * m), pa.array(codes.reshape(-1).astype(np.int32)))
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, cluster, np.int32)), pa.array(np.arange(first, first + n, dtype=np.int64)), lists], names=["cluster_id", "vector_id", "codes"])


@dataclass
class ObjectPiece(InputPartition):
    """Bytes from low to high of one of an object's files: the one with the header (first is None), or a part that begins with vector `first`."""

    cluster: int
    head: str
    file: str
    first: int | None
    low: int
    high: int
    size: int
    parts: int | None  # bytes of all parts, or None if the object has none


class ObjectReader(DataSourceReader):
    def __init__(self, path: str, piece_bytes: int = PIECE_BYTES):
        self.path, self.piece, self.only = path, max(piece_bytes, 1), None
        self.low, self.high, self.ids = 0, 1 << 62, None  # of vector_id

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = getattr(f, "attribute", None)
            if isinstance(f, (EqualTo, In)) and name == ("cluster_id",):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = asked if self.only is None else self.only & asked
                continue
            if name == ("vector_id",):  # what is read narrows; Spark still tests each row
                if isinstance(f, (EqualTo, In)):
                    asked = {f.value} if isinstance(f, EqualTo) else {x for x in f.value if x is not None}
                    self.low, self.high = max(self.low, min(asked, default=1 << 62)), min(self.high, max(asked, default=-1) + 1)
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    self.high = min(self.high, f.value + isinstance(f, LessThanOrEqual))
            yield f

    def partitions(self) -> list[ObjectPiece]:
        files, folder = file_system(self.path)
        heads, parts = {}, {}
        for f in files.get_file_info(pa.fs.FileSelector(folder, allow_not_found=True)):
            m = re.fullmatch(r"cluster_(\d+)\.(?:bin|(\d+)\.codes)", f.base_name)
            if m and (self.only is None or int(m[1]) in self.only):
                if m[2] is None:
                    heads[int(m[1])] = f
                else:
                    parts.setdefault(int(m[1]), []).append((int(m[2]), f))
        out = []
        for cluster, head in sorted(heads.items()):
            more = sorted(parts.get(cluster, []), key=lambda p: p[0])
            total = sum(f.size for _, f in more) if more else None
            for first, f in [(None, head), *more]:
                for low in range(0, max(f.size, 1), self.piece):
                    out.append(ObjectPiece(cluster, head.path, f.path, first, low, min(low + self.piece, f.size), f.size, total))
        return out

    def read(self, partition: ObjectPiece | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's way to read no partitions
            return
        files, _ = file_system(self.path)
        with files.open_input_file(partition.head) as f:
            header = f.read(HEADER.size)
        magic, version, m, ksub, _, dsub, number = HEADER.unpack(header) if len(header) == HEADER.size else (0,) * 7
        begin = size_of(m, ksub, dsub, 0) if partition.first is None else 0
        first, size = partition.first or 0, partition.size - begin
        whole = size >= 0 and (size + partition.parts == number * m if partition.first is None and partition.parts is not None else partition.first is not None or size >= number * m)
        if magic != MAGIC or version != VERSION or not whole:
            raise ValueError(f"{partition.file}: not a valid object ({EINVAL})")
        if not m:
            if not partition.low:
                for lo in range(max(self.low, 0), min(self.high, number), 1 << 20):
                    yield _rows(partition.cluster, np.zeros((min(self.high, number, lo + (1 << 20)) - lo, 0), np.uint8), lo)
            return
        # the codes that begin in this range, of those that are asked for
        at, end = (max(-(-(x - begin) // m), 0) + first for x in (partition.low, partition.high))
        at, end = max(at, self.low), min(end, self.high, number, first + size // m)
        step = max(BATCH_BYTES // m, 1)
        with files.open_input_file(partition.file) as f:
            for lo in range(at, end, step):
                n = min(step, end - lo)
                f.seek(begin + (lo - first) * m)
                codes = np.frombuffer(f.read(n * m), np.uint8)
                if len(codes) != n * m or codes.max() >= ksub:
                    raise ValueError(f"{partition.file}: not a valid object ({EINVAL})")
                yield _rows(partition.cluster, codes.reshape(n, m), lo)


@dataclass
class Part:
    cluster: int
    first: int
    number: int
    total: int
    file: str


@dataclass
class Written(WriterCommitMessage):
    parts: list[Part] = field(default_factory=list)


class ObjectWriter(DataSourceArrowWriter):
    """Tasks write the runs of vectors that they get to a folder of the job; committing checks that they fit together and names them."""

    def __init__(self, path: str, codebook: bytes, shape: tuple[int, int, int], overwrite: bool):
        self.path, self.codebook, self.shape, self.overwrite = path, codebook, shape, overwrite
        self.job = f"_{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, folder = file_system(self.path)
        (m, ksub, dsub), task, done, out = self.shape, TaskContext.get(), Written(), None
        name = f"{folder}/{self.job}/{task.partitionId()}-{task.taskAttemptId()}"
        try:
            for batch in iterator:
                cluster, vector, total = (batch.column(x).to_numpy() for x in ("cluster_id", "vector_id", "n_vectors"))
                codes = batch.column("codes")
                flat = codes.flatten().to_numpy()
                if codes.null_count or len(flat) != len(cluster) * m or (len(flat) and (flat.min() < 0 or flat.max() >= ksub)):
                    raise ValueError(f"codes have to be {m} numbers below {ksub}")
                flat = flat.astype(np.uint8).reshape(len(cluster), m)
                begins = np.ones(len(cluster), bool)
                begins[1:] = (cluster[1:] != cluster[:-1]) | (vector[1:] != vector[:-1] + 1)
                cuts = [*np.flatnonzero(begins).tolist(), len(cluster)]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    last = done.parts[-1] if done.parts else None
                    if last is None or cluster[a] != last.cluster or vector[a] != last.first + last.number:
                        if out is not None:
                            out.close()
                        files.create_dir(f"{folder}/{self.job}", recursive=True)
                        last = Part(int(cluster[a]), int(vector[a]), 0, int(total[a]), f"{name}-{len(done.parts)}")
                        done.parts.append(last)
                        out = files.open_output_stream(last.file)
                        if not last.first:
                            out.write(HEADER.pack(MAGIC, VERSION, m, ksub, m * dsub, dsub, last.total) + self.codebook)
                    out.write(flat[a:b].tobytes())
                    last.number += b - a
        finally:
            if out is not None:
                out.close()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        files, folder = file_system(self.path)
        files.create_dir(folder, recursive=True)
        parts: dict[int, list[Part]] = {}
        for message in messages:
            for p in message.parts if message is not None else ():
                parts.setdefault(p.cluster, []).append(p)
        for cluster, found in parts.items():
            found.sort(key=lambda p: p.first)
            ends = [p.first + p.number for p in found]
            if [p.first for p in found] != [0, *ends[:-1]] or ends[-1] != found[0].total:
                self._clean()
                raise ValueError(f"cluster {cluster}: its vectors aren't numbered from 0 to {found[0].total} without gaps")
        for f in files.get_file_info(pa.fs.FileSelector(folder)):
            m = re.fullmatch(r"cluster_(\d+)\.(bin|\d+\.codes)", f.base_name)
            if m and (self.overwrite or int(m[1]) in parts):
                files.delete_file(f.path)
        for cluster, found in parts.items():
            for p in found:
                files.move(p.file, f"{folder}/cluster_{cluster}." + (f"{p.first:012d}.codes" if p.first else "bin"))
        self._clean()

    def abort(self, messages: list[Written | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        files, folder = file_system(self.path)
        if files.get_file_info(f"{folder}/{self.job}").type == pa.fs.FileType.Directory:
            files.delete_dir(f"{folder}/{self.job}")


def write_lists(lists: DataFrame, codebook: list[list[list[float]]], path: str, mode: str = "append", partitions: int | None = None) -> None:
    """Write inverted lists (of a stored table: they are read twice) as objects, by ranges of (cluster, vector) of about equally many rows."""
    register(lists.sparkSession)
    words = np.array(codebook, "<f4")
    counted = lists.join(lists.groupBy("cluster_id").agg(F.count("*").alias("n_vectors")), "cluster_id").select("cluster_id", "vector_id", "codes", "n_vectors")
    ranged = counted.repartitionByRange(partitions or partitions_for(lists), "cluster_id", "vector_id").sortWithinPartitions("cluster_id", "vector_id")
    options = {"codebook": base64.b64encode(words.tobytes()).decode(), "shape": ",".join(map(str, words.shape))}
    ranged.write.format("ivfpq_blob").options(**options).mode(mode).save(path)


class ObjectSource(DataSource):
    """spark.read.format("ivfpq_blob").load(folder) and df.write.format("ivfpq_blob")"""

    @classmethod
    def name(cls) -> str:
        return "ivfpq_blob"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> DataSourceReader:
        return ObjectReader(self.options["path"], int(self.options.get("piece_bytes", PIECE_BYTES)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        m, ksub, dsub = map(int, self.options["shape"].split(","))
        return ObjectWriter(self.options["path"], base64.b64decode(self.options["codebook"]), (m, ksub, dsub), overwrite)


def register(spark: SparkSession) -> None:
    """Make the source known to a session, with its filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ObjectSource)


def float_array(content: bytes) -> np.ndarray:
    """A raw file of f32."""
    return np.frombuffer(content, "<f4")


def topk_records(content: bytes) -> list[tuple[int, float]]:
    """A packed file of (u64 id, f32 distance) records of 12 bytes."""
    return [(int(i), float(d)) for i, d in struct.iter_unpack("<Qf", content)]


def pack_topk(hits: list[tuple[int, float]]) -> bytes:
    return b"".join(struct.pack("<Qf", i, d) for i, d in hits)
