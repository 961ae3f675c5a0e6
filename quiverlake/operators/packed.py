"""Packed codes: two codes to a byte up to 16 codewords, one to a byte up to 256, and a scan over the bytes.

A stored row is cluster_id, vector_id, global_id and `code`, a binary of ceil(M / 2) or M
bytes. For a request the lookup tables are turned into 8-bit ones: an entry is its distance
above the table's smallest one in steps of 1/255 of the widest table's range, rounded down.
For each byte of a code one table of 256 sums gives what its one or two codes add, so a
vector costs a lookup for each byte and whole-number additions.

The bound: the true sum is base + step * sum + e with 0 <= e < M * step, so with s the k-th
smallest sum, no vector whose sum is above s + M can be among the best k. All others get
their true float32 sum, in the order of the sub-quantizers, and are ranked by it. Hits and
distances are the same bits as those of search.cluster_topk, ties included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverlake.operators import search as S
from quiverlake.operators.index import Quantizer, partitions_for

SCHEMA = "vector_id bigint, global_id bigint, code binary, cluster_id int"


def width(n_sub: int, ksub: int) -> int:
    """Bytes of a packed code."""
    if ksub > 256:
        raise ValueError(f"{ksub} codewords don't fit a byte")
    return -(-n_sub // 2) if ksub <= 16 else n_sub


def pack(codes: np.ndarray, ksub: int) -> np.ndarray:
    """Codes (n x M) as bytes: of two in a byte the first is in the low half; an odd last one has an empty high half."""
    n, n_sub = codes.shape
    if ksub > 16 or not n_sub:
        width(n_sub, ksub)
        return codes.astype(np.uint8)
    even = np.zeros((n, n_sub + n_sub % 2), np.uint8)
    even[:, :n_sub] = codes
    return even[:, ::2] | even[:, 1::2] << 4


def unpack(raw: np.ndarray, n_sub: int, ksub: int) -> np.ndarray:
    """The codes (n x M) of packed rows."""
    if ksub > 16 or not n_sub:
        return raw
    return np.stack([raw & 15, raw >> 4], axis=2).reshape(len(raw), 2 * raw.shape[1])[:, :n_sub]


def decoded(codes: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The vectors that codes stand for, in float64."""
    return np.concatenate([book[m][codes[:, m]] for m in range(len(book))], axis=1).astype(np.float64) if len(book) else np.zeros((len(codes), 0))


def binary(rows: np.ndarray) -> pa.Array:
    """Rows of bytes of equal width as a binary column."""
    n, wide = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * wide), pa.py_buffer(np.ascontiguousarray(rows))])


def matrix(column: pa.Array) -> np.ndarray:
    """A binary column of equal width as rows of bytes."""
    if not len(column):
        return np.zeros((0, 0), np.uint8)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    wide = int(bounds[1] - bounds[0])
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]].reshape(len(column), wide) if wide else np.zeros((len(column), 0), np.uint8)


def pack_lists(lists: DataFrame, ksub: int) -> DataFrame:
    """Inverted lists with `code` for the column codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(3).flatten().to_numpy().reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 0), np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), binary(pack(codes, ksub)), batch.column(0)], names=["vector_id", "global_id", "code", "cluster_id"])

    return lists.select("cluster_id", "vector_id", "global_id", "codes").mapInArrow(run, SCHEMA)


def save(packed: DataFrame, path: str) -> None:
    """Store packed lists with a folder for each cluster, dealt by ranges, so that a large cluster is several files."""
    ranged = packed.repartitionByRange(partitions_for(packed), "cluster_id", "vector_id").sortWithinPartitions("cluster_id", "vector_id")
    ranged.write.mode("overwrite").partitionBy("cluster_id").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def eight_bit(lut: np.ndarray) -> tuple[np.ndarray, int]:
    """A request's tables (M x ksub, float32) as whole numbers from 0 to 255, and by how much two sums may differ whose true ones are in the other order."""
    wide = lut.astype(np.float64)
    above = wide - wide.min(axis=1, keepdims=True)
    step = above.max() / 255 or 1.0
    # besides the M steps of rounding down, a float32 sum of M parts is off by at most M roundings of the sum of their sizes
    rounding = 2 * (len(lut) + 1) * 2.0**-24 * np.abs(wide).max(axis=1).sum() / step
    return np.minimum(np.floor(above / step), 255).astype(np.int32), len(lut) + int(np.ceil(rounding)) + 1


def byte_tables(table: np.ndarray) -> np.ndarray:
    """For each byte of a packed code, what each of its 256 values adds."""
    n_sub, ksub = table.shape
    if ksub > 16:
        return np.pad(table, ((0, 0), (0, 256 - ksub)))
    even = np.zeros((n_sub + n_sub % 2, 16), table.dtype)
    even[:n_sub, :ksub] = table
    return (even[1::2, :, None] + even[::2, None, :]).reshape(-1, 256)


def best(codes: np.ndarray, vector: np.ndarray, lut: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and float32 distances of the best k packed codes by (distance, vector)."""
    table, margin = eight_bit(lut)
    tables = byte_tables(table)
    total = np.zeros(len(codes), np.int32)
    for b in range(codes.shape[1]):
        total += tables[b][codes[:, b]]
    near = np.arange(len(codes)) if len(codes) <= k else np.flatnonzero(total <= np.partition(total, k - 1)[k - 1] + margin)
    exact, each = np.zeros(len(near), np.float32), unpack(codes[near], *lut.shape)
    for m in range(len(lut)):
        exact += lut[m][each[:, m]]
    order = np.lexsort((vector[near], exact))[:k]
    return near[order], exact[order]


def cluster_topk(queries: DataFrame, packed: DataFrame, q: Quantizer, metric: str, nprobe: int, k: int) -> DataFrame:
    """What search.cluster_topk gives, from packed lists; a scorer for search.search."""
    spark = packed.sparkSession

    def part(block: DataFrame) -> DataFrame:
        requests = S.with_tables(S.probes(block, q, metric, nprobe).select("qid", "qvec", "cluster_id"), q, metric).select("qid", "cluster_id", "lut").toArrow()  # of bounded size
        flat = requests["lut"].combine_chunks().flatten().flatten().to_numpy().reshape(requests.num_rows, q.n_sub, q.ksub)
        tables: dict[int, list[tuple[int, np.ndarray]]] = {}
        for i, (qid, cluster) in enumerate(zip(requests["qid"].to_pylist(), requests["cluster_id"].to_pylist(), strict=True)):
            tables.setdefault(cluster, []).append((qid, flat[i]))
        shared = spark.sparkContext.broadcast(tables)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vector, ids, cluster, codes = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3).to_numpy(), matrix(batch.column(2))
                out: list[tuple[np.ndarray, ...]] = []
                for c in np.unique(cluster).tolist():
                    at = np.flatnonzero(cluster == c)
                    mine = np.asfortranarray(codes[at])
                    for qid, lut in shared.value.get(c, ()):
                        rows, distance = best(mine, vector[at], lut, k)
                        out.append((np.full(len(rows), qid), np.full(len(rows), c, np.int32), vector[at[rows]], ids[at[rows]], distance))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["qid", "cluster_id", "vector_id", "global_id", "distance"])

        wanted = packed.where(F.col("cluster_id").isin(list(tables))) if tables else packed.limit(0)
        return wanted.mapInArrow(score, "qid bigint, cluster_id int, vector_id bigint, global_id bigint, distance float")

    scores = S.union(part(b) for b in S.in_blocks(queries, nprobe * q.n_sub * q.ksub * 4))
    return S.ranked(scores, k, "qid", "cluster_id").select("qid", "cluster_id", "rank", "vector_id", "global_id", "distance")


def code_bytes(packed: DataFrame) -> DataFrame:
    """cluster_id, n_vectors and the bytes of their codes."""
    return packed.groupBy("cluster_id").agg(F.count("*").alias("n_vectors"), F.sum(F.octet_length("code")).alias("code_bytes"))
