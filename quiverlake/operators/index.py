"""Building an IVF-PQ index.

Parameters of the index (coarse centroids and the PQ codebook, shared by all clusters and
trained on raw vectors) are small: nlist * D and M * ksub * dsub floats, whatever the
table holds. They live on the driver and go to tasks by broadcast, never as literals of a
plan. Everything that grows with the table is a DataFrame: cluster_id, vector_id (position in the cluster), global_id
and codes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quiverlake.functions import vector as V
from quiverlake.functions.arrays import matrix, nearest
from quiverlake.sources.tables import partitions_for, shared_folder

FIXED_POINT = 1 << 20
SAMPLE = 16_384  # vectors that fit() trains on at most


@dataclass(frozen=True)
class Quantizer:
    """Coarse centroids (nlist x D) and codebook (M x ksub x dsub)."""

    centroids: list[list[float]]
    codebook: list[list[list[float]]]

    @property
    def n_sub(self) -> int:
        return len(self.codebook)

    @property
    def ksub(self) -> int:
        return len(self.codebook[0])

    @property
    def dsub(self) -> int:
        return len(self.codebook[0][0])

    @property
    def dim(self) -> int:
        return self.n_sub * self.dsub


def seeds(vectors: DataFrame, n: int, id_col: str = "vec_id", vec_col: str = "embedding") -> list[list[float]]:
    """The n vectors of the lowest ids."""
    return [list(r[0]) for r in vectors.orderBy(id_col).limit(n).select(vec_col).collect()]


def split(vectors: list[list[float]], n_sub: int) -> list[list[list[float]]]:
    dsub = len(vectors[0]) // n_sub if vectors else 0
    return [[v[m * dsub : (m + 1) * dsub] for v in vectors] for m in range(n_sub)]


def seeded_quantizer(vectors: DataFrame, nlist: int = 4, n_sub: int = 8, ksub: int = 16) -> Quantizer:
    """Deterministic start: the first nlist vectors as centroids, slices of the first ksub as codewords."""
    first = seeds(vectors, max(nlist, ksub))
    return Quantizer(first[:nlist], split(first[:ksub], n_sub))


def cluster_of(vector: Column, centroids: list[list[float]], metric: str = V.L2) -> Column:
    return V.nearest(F.transform(V.literal(centroids), lambda c: V.distance(metric, vector, c)))


def assign(vectors: DataFrame, centroids: list[list[float]], vec_col: str = "embedding") -> DataFrame:
    """Add cluster_id, the nearest centroid by L2."""
    return vectors.withColumn("cluster_id", cluster_of(F.col(vec_col), centroids))


def encode(vector: Column, codebook: list[list[list[float]]]) -> Column:
    """The nearest codeword of each sub-quantizer."""
    dsub = len(codebook[0][0])

    def code(m: int) -> Column:
        part = V.subvector(vector, m, dsub)
        return V.nearest(F.transform(V.literal(codebook[m]), lambda c: V.l2(part, c)))

    return F.array(*[code(m) for m in range(len(codebook))])


def valid(vector: Column, q: Quantizer) -> Column:
    """Whether a vector can be coded: not null, without null elements, of the index's dimension at least."""
    dim = max(q.dim, len(q.centroids[0]) if q.centroids else 0)
    return F.coalesce((F.size(vector) >= dim) & ~F.exists(vector, lambda x: x.isNull()), F.lit(False))


def invalid(vectors: DataFrame, q: Quantizer, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(global_id, status) of the vectors that an index build leaves out."""
    return vectors.where(~valid(F.col(vec_col), q)).select(F.col(id_col).alias("global_id"), F.lit(-22).alias("status"))


def coded(vectors: DataFrame, q: Quantizer, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """global_id, cluster_id and codes of the valid vectors (see invalid), cut to the index's dimension.

    A NumPy kernel: it adds in the order of the expressions cluster_of and encode and gives their bits, but those are
    higher-order functions and so interpreted (8.3 s against 0.6 s for 200,000 vectors on four cores).
    """
    centroids, words = np.array(q.centroids, np.float32), np.array(q.codebook, np.float32)
    dim, dsub = centroids.shape[1] if len(q.centroids) else q.dim, q.dsub
    vector = F.slice(vectors[vec_col], 1, max(dim, q.dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            rows = np.asfortranarray(matrix(batch.column(1), max(dim, q.dim)))
            codes = np.stack([nearest(rows[:, m * dsub : (m + 1) * dsub], words[m]) for m in range(q.n_sub)], axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * q.n_sub), pa.array(codes.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nearest(rows[:, :dim], centroids)), lists], names=["global_id", "cluster_id", "codes"])

    good = vectors.where(valid(vectors[vec_col], q)).select(vectors[id_col].cast("long").alias("global_id"), vector.alias("vector"))
    return good.mapInArrow(run, "global_id bigint, cluster_id int, codes array<int>")


Part = tuple[int, np.ndarray]  # the dimension that a quantizer's words begin at, and the words


def step_sums(vectors: DataFrame, parts: list[Part], vec_col: str = "embedding") -> DataFrame:
    """(part, k, j, n, total): of the vectors nearest to word k of a part, their number and the sum of coordinate j in fixed point.

    One pass for all parts. Each task adds up its vectors and gives a row for each word and coordinate, so what is
    shuffled doesn't grow with the vectors. Whole numbers make the sums the same in any order.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(parts)  # nlist * D or M * ksub * dsub floats
    dim = max((at + words.shape[1] for at, words in parts), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = shared.value
        counts = [np.zeros(len(words), np.int64) for _, words in parts]
        sums = [np.zeros(words.shape, np.int64) for _, words in parts]
        for batch in batches:
            rows = np.asfortranarray(matrix(batch.column(0), dim))
            whole = np.floor(rows.astype(np.float64) * FIXED_POINT).astype(np.int64)
            for p, (at, words) in enumerate(parts):
                k = nearest(rows[:, at : at + words.shape[1]], words)
                counts[p] += np.bincount(k, minlength=len(words))
                np.add.at(sums[p], k, whole[:, at : at + words.shape[1]])
        for p, (_, words) in enumerate(parts):
            used = np.flatnonzero(counts[p])
            d, n = words.shape[1], len(used)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(n * d, p, np.int32)), pa.array(np.repeat(used, d).astype(np.int32)), pa.array(np.tile(np.arange(d, dtype=np.int32), n)),
                pa.array(np.repeat(counts[p][used], d)), pa.array(sums[p][used].ravel())], names=["part", "k", "j", "n", "total"])

    rows = vectors.select(vec_col).where(F.size(vec_col) >= dim).mapInArrow(run, "part int, k int, j int, n bigint, total bigint")
    return rows.groupBy("part", "k", "j").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def step_means(vectors: DataFrame, parts: list[Part], vec_col: str = "embedding") -> DataFrame:
    """(part, k, j, value): the words after a Lloyd step. A word without vectors stays as it is."""
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(parts)
    sizes = [words.size for _, words in parts]
    ends = np.cumsum(sizes)

    def old(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = np.concatenate([words.ravel() for _, words in shared.value]).astype(np.float32)
        width = np.array([words.shape[1] for _, words in shared.value])
        for batch in batches:
            at = batch.column(0).to_numpy()
            part = np.searchsorted(ends, at, side="right")
            k, j = np.divmod(at - (ends - sizes)[part], width[part])
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(k, pa.int32()), pa.array(j, pa.int32()), pa.array(flat[at])], names=["part", "k", "j", "old"])

    words = spark.range(sum(sizes)).mapInArrow(old, "part int, k int, j int, old float")
    mean = (F.col("total").cast("double") / F.col("n") / F.lit(float(FIXED_POINT))).cast("float")
    return words.join(step_sums(vectors, parts, vec_col), ["part", "k", "j"], "left").select("part", "k", "j", F.coalesce(mean, "old").alias("value"))


def parts_of(q: Quantizer) -> list[Part]:
    """The codebook's parts, then the centroids."""
    book = [(m * q.dsub, np.array(words, np.float32)) for m, words in enumerate(q.codebook)]
    return book + ([(0, np.array(q.centroids, np.float32))] if q.centroids else [])


def lloyd_step(vectors: DataFrame, centroids: list[list[float]], vec_col: str = "embedding") -> DataFrame:
    """(cluster_id, j, value) of the updated centroids."""
    return step_means(vectors, [(0, np.array(centroids, np.float32))], vec_col).select(F.col("k").alias("cluster_id"), "j", "value")


def pq_lloyd_step(vectors: DataFrame, codebook: list[list[list[float]]], vec_col: str = "embedding") -> DataFrame:
    """(m, k, j, value) of the updated codebook."""
    return step_means(vectors, parts_of(Quantizer([], codebook)), vec_col).select(F.col("part").alias("m"), "k", "j", "value")


def train(vectors: DataFrame, nlist: int, n_sub: int, ksub: int, iterations: int, vec_col: str = "embedding", start: Quantizer | None = None) -> Quantizer:
    """A quantizer after some Lloyd steps over all vectors from the seeds or another start, one pass for each step."""
    q = start or seeded_quantizer(vectors, nlist, n_sub, ksub)
    n_sub = q.n_sub
    for _ in range(iterations):
        parts = parts_of(q)
        rows = step_means(vectors, parts, vec_col).orderBy("part", "k", "j").toArrow()  # as many as the quantizer has floats
        flat, part = rows["value"].to_numpy(), rows["part"].to_numpy()
        fresh = [flat[part == p].reshape(words.shape).tolist() for p, (_, words) in enumerate(parts)]
        q = Quantizer(fresh[n_sub], fresh[:n_sub])
    return q


def fit(vectors: DataFrame, nlist: int, n_sub: int, ksub: int, iterations: int = 10, sample: int = SAMPLE, id_col: str = "vec_id", vec_col: str = "embedding") -> Quantizer:
    """A quantizer trained on the driver from `sample` vectors at most: those whose ids have the lowest hashes.

    The bound is a parameter, and only the parameters of the index depend on the sample; every vector is coded.
    Starts are the sample's first vectors.
    """
    chosen = vectors.select(F.col(id_col), F.col(vec_col).alias("_v")).where(F.col("_v").isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(sample).select("_v").toArrow()
    column = chosen["_v"].combine_chunks()
    dim = n_sub * (min((len(x) for x in column), default=0) // n_sub)
    rows = np.asfortranarray(matrix(column, dim))
    dsub = dim // n_sub

    def means(rows: np.ndarray, k: int) -> list[list[float]]:
        words = rows[:k].copy()
        for _ in range(iterations):
            at = nearest(rows, words)
            count, sums = np.bincount(at, minlength=len(words)), np.zeros(words.shape, np.float64)
            np.add.at(sums, at, rows.astype(np.float64))
            words[count > 0] = (sums[count > 0] / count[count > 0, None]).astype(np.float32)
        return words.tolist()

    return Quantizer(means(rows, nlist), [means(rows[:, m * dsub : (m + 1) * dsub], ksub) for m in range(n_sub)])


def number_within(rows: DataFrame, group: str, key: str, name: str) -> DataFrame:
    """Add the position from 0 of each row in its group by ascending key.

    Rows are stored by ranges of (group, key), each range is numbered by itself and begins where the group's earlier
    ranges end. Ranges hold about equally many rows whatever the keys are, so no task sees a whole large group.
    """
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(partitions_for(rows), group, key).sortWithinPartitions(group, key).withColumn("_range", F.spark_partition_id())
    path = shared_folder(spark, "ranges")
    ranged.write.parquet(path)
    stored = spark.read.schema(ranged.schema).parquet(path)
    counts = stored.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(group, "_range", F.coalesce(before, F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy(group, "_range").orderBy(key)) - 1
    joined = stored.withColumn("_within", within).join(starts, [group, "_range"])
    return joined.withColumn(name, (F.col("_start") + F.col("_within")).cast("long")).drop("_range", "_within", "_start")


def inverted_lists(vectors: DataFrame, q: Quantizer, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """cluster_id, vector_id, global_id and codes of all valid vectors."""
    return number_within(coded(vectors, q, id_col, vec_col), "cluster_id", "global_id", "vector_id").select("cluster_id", "vector_id", "global_id", "codes")


def save(lists: DataFrame, path: str) -> None:
    """Store an index with a folder for each cluster, so that a search prunes to the probed ones."""
    lists.repartition("cluster_id", F.floor(F.col("vector_id") / (1 << 20))).write.mode("overwrite").partitionBy("cluster_id").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("vector_id bigint, global_id bigint, codes array<int>, cluster_id int").parquet(path).select("cluster_id", "vector_id", "global_id", "codes")


def extents(spark: SparkSession, path: str) -> DataFrame:
    """Where a stored index's clusters lie: cluster_id, file, block_start, block_bytes and n_vectors of each file block read."""
    stored = spark.read.schema("vector_id bigint, cluster_id int").parquet(path)
    place = stored.select("cluster_id", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block_start"), F.col("_metadata.file_block_length").alias("block_bytes"))
    return place.groupBy("cluster_id", "file", "block_start", "block_bytes").agg(F.count("*").alias("n_vectors"))


def overwrite_clusters(lists: DataFrame, path: str) -> None:
    """Replace the clusters that occur in lists and leave the others as they are."""
    lists.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cluster_id").parquet(path)


def list_sizes(lists: DataFrame) -> DataFrame:
    return lists.groupBy("cluster_id").agg(F.count("*").alias("n_vectors"))


def reconstruct(codes: Column, codebook: list[list[list[float]]]) -> Column:
    """The vector that codes stand for."""
    return F.flatten(F.array(*[F.get(V.literal(codebook[m]), codes[m]) for m in range(len(codebook))]))
