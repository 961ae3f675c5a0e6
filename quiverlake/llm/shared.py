"""What the corpus operators share: the run folder, Arrow text blocks and vectorised word hashing.

Text is handled as UTF-8 bytes straight from the Arrow buffer, a block of rows in a few
passes. Words, lines and pieces of a block are told apart by their bytes, through Arrow's
dictionary encoding; only where tasks have to agree are the different ones of a block
hashed, by BLAKE2b.
"""

from __future__ import annotations

import atexit
import contextlib
import hashlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession

BLOCK_BYTES = 2 << 20
BATCH_BYTES = 4 << 20
MOST_PARTITIONS = 100_000
_BATCH_LIMIT, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def run_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run under spark.checkpoint.dir, which the whole cluster shares; only a local session has a default."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the cluster shares")
    if not base:
        base = tempfile.mkdtemp(prefix="quiverlake-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        base = f"file://{base}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/quiverlake/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Give tasks BATCH_BYTES of rows at a time, unless the session has its own limit."""
    if spark.conf.get(_BATCH_LIMIT) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_LIMIT, str(BATCH_BYTES))


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is made and run within has its shuffle files deleted when it ends; else they stay until the driver happens to collect its garbage."""
    before = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_DROP_SHUFFLES)
        else:
            spark.conf.set(_DROP_SHUFFLES, before)


def materialise(df: DataFrame, path: str, **options: str) -> DataFrame:
    """Write df as Parquet and read it again: cuts the lineage and survives lost executors. The shuffle files of the write go."""
    with shuffles_dropped(df.sparkSession):
        df.write.mode("errorifexists").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions_for(df: DataFrame, each: int = 128 << 20) -> int:
    """How many partitions to deal what is made from df into: the session's number, or more if the plan's size asks for them."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    number = -(-size // each) if size < 1 << 50 else 0  # more means that the plan doesn't know
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(number, MOST_PARTITIONS))


def file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """Arrow's file system for a Spark path, and the path in it."""
    return pyarrow.fs.FileSystem.from_uri("s3" + path[3:] if path.startswith(("s3a:", "s3n:")) else path)


def drop_folder(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def as_text(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as a plain Arrow string array; a null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.string()), "")


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows one after the other, and the offsets of the rows in them."""
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, offsets - offsets[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str, most: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Cut batches into slices of about `most` bytes of text (one row at least), each with its text column."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = as_text(batch.column(batch.schema.get_field_index(text)))
        _, offsets = text_buffers(column)
        at, number = 0, max(1, -(-int(offsets[-1]) * 4 // most - 1) // 4 + 1)  # a quarter more is no slice of its own
        most_here = -(-int(offsets[-1]) // number)
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most_here, side="right")) - 1)
            yield batch.slice(at, end - at), column.slice(at, end - at)
            at = end


def slices(batch: pa.RecordBatch, lengths: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the lengths of a slice's rows add up to about `most` (one row at least)."""
    bounds, at = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]), 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


# --- hashing ---------------------------------------------------------------

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words, the runs of bytes other than ASCII white space."""
    n = len(data)
    solid = ~WHITE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first, last = edge[:n].copy(), edge[1:].copy()
    first[1:] |= ~solid[:-1]
    last[:-1] |= ~solid[1:]
    starts = np.flatnonzero(solid & first)
    ends = np.flatnonzero(solid & last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte ranges as an Arrow array; they are in order and don't overlap. Ranges that follow each other aren't copied."""
    bounds = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=bounds[1:])
    if len(starts) and bounds[-1] != ends[-1] - starts[0]:
        step = np.zeros(len(data) + 1, np.int8)
        step[starts] += 1
        step[ends] -= 1
        raw = data[np.cumsum(step[:-1], dtype=np.int8).astype(bool)]
    else:
        raw = data[starts[0] : ends[-1]] if len(starts) else data[:0]
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(raw))])


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The different byte strings among the ranges, and the number of each range's own. Equal numbers mean equal bytes."""
    coded = runs(data, starts, ends).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy()


def string_hashes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each string, on which all tasks agree.

    Up to seven bytes and their number are put through a permutation of 64 bits, so no two such strings share the first
    one (the second is 0); of longer strings the two are 128 bits of BLAKE2b.
    """
    raw, bounds = text_buffers(strings)
    size = np.diff(bounds)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    value = size.astype(np.uint64) << np.uint64(56)
    for k in range(7):
        value |= np.where(size > k, padded[np.minimum(bounds[:-1] + k, len(raw))], 0).astype(np.uint64) << np.uint64(8 * k)
    value, other = mix(value), np.zeros(len(size), np.uint64)
    long, flat = np.flatnonzero(size > 7), raw.tobytes()
    named = [hashlib.blake2b(flat[a:b], digest_size=16).digest() for a, b in zip(bounds[long].tolist(), bounds[long + 1].tolist(), strict=True)]
    both = np.frombuffer(b"".join(named), "<u8").reshape(-1, 2)
    value[long], other[long] = both[:, 0], both[:, 1]
    return value, other


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first hash of each range's bytes, made once for each different string."""
    found, number = distinct(data, starts, ends)
    return string_hashes(found)[0][number]


def chained(parts: list[np.ndarray]) -> np.ndarray:
    """A hash of each row's sequence of hashes, and of how many there are."""
    sums = np.full(len(parts[0]), int(_STEP) * len(parts) % (1 << 64), np.uint64)
    for part in parts:
        sums ^= part
        sums *= _M1
        sums ^= sums >> np.uint64(32)
    sums *= _M2
    sums ^= sums >> np.uint64(29)
    return sums


def windows(rows: np.ndarray, width: int) -> np.ndarray:
    """The first word of every run of `width` consecutive words of one row."""
    return np.flatnonzero(rows[: max(len(rows) - width + 1, 0)] == rows[width - 1 :])


def window_hashes(word_hash: np.ndarray, width: int) -> np.ndarray:
    """Hash of the `width` words from each word on, as far as there are so many."""
    n = max(len(word_hash) - width + 1, 0)
    return chained([word_hash[k : k + n] for k in range(width)])


def by_row(values: np.ndarray, n_rows: int, rows: np.ndarray) -> np.ndarray:
    """Sum of values for each row number."""
    return np.bincount(rows, weights=values, minlength=n_rows).astype(np.int64) if len(rows) else np.zeros(n_rows, np.int64)


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
