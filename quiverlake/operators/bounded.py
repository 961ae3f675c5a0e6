"""Exact nearest neighbours through inverted lists, with triangle bounds.

Vectors are stored with a folder for each cluster, in the order of their reach, the distance
to the cluster's centroid. Beside a vector lie its code, a byte or half a byte for each
sub-quantizer, and its gap, the distance to what the code stands for; a table of clusters
holds sizes and the smallest and largest reach. A search has two rounds:

1. Each query is compared with its nearest clusters, as many as hold k vectors. The distance
   of the best k-th is its threshold.
2. A vector v of a cluster c is at least |d(q, c) - reach(v)| away from q, and at least
   d(q, code(v)) - gap(v). Clusters whose smallest bound is above the threshold aren't read
   at all (the plan's partition filter names the others). Of those that are, true distances
   are made for the vectors that neither bound excludes, and what lies within the threshold
   leaves the task: some k rows for each query, never the pairs that were compared.

Distances are squared L2 in float32; bounds are made in float64 and widened by the rounding
of a float32 sum, so no neighbour and no tie is lost: hits are those of the exhaustive
search, whatever the quantizer; a better one only leaves fewer candidates. Queries go in
blocks of bounded size; what a block broadcasts is its vectors and, for each cluster, the
numbers of the queries that scan it. A block's clusters are read once for all its queries.

Defined results: vectors and queries that are null, have null elements or are too short are
left out; longer ones are cut; fewer than k vectors give fewer hits; ties go to lower ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverlake.functions import arrays as A
from quiverlake.functions import vector as V
from quiverlake.operators import packed as P
from quiverlake.operators import search as S
from quiverlake.operators.index import Quantizer, partitions_for, valid
from quiverlake.sources.tables import shared_folder

STORED = "global_id bigint, reach double, gap double, code binary, vector array<float>, cluster_id int"
FIRST, MORE = 1, 2
CELLS = 1 << 18  # of a table of bounds made at once; some ten tables of 8 bytes each are held beside it
TINY = 1e-9  # more than the rounding of sums in float64, relative to their parts
HITS = "qid bigint, cluster_id int, vector_id bigint, distance float, scored bigint"


@dataclass(frozen=True)
class Store:
    """Vectors by cluster at path, and the clusters: sizes, smallest and largest reach (of empty ones 0, inf and -inf)."""

    path: str
    centroids: np.ndarray
    codebook: np.ndarray
    sizes: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @property
    def dim(self) -> int:
        return self.centroids.shape[1]

    def rows(self, spark: SparkSession, clusters: list[int]) -> DataFrame:
        """What is stored of these clusters; the filter is on the folders' column, so no other folder is read."""
        return spark.read.schema(STORED).parquet(self.path).where(F.col("cluster_id").isin(clusters))


def lengths(rows: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The distance of each row to each word, in float64."""
    out = np.empty((len(rows), len(words)))
    for k, word in enumerate(words.astype(np.float64)):
        out[:, k] = np.sqrt(np.square(rows - word).sum(axis=1))
    return out


def slack(dim: int) -> float:
    """What a float32 sum of squares may be below the true one, relative to it, with room for its factors' rounding."""
    return (2 * dim + 8) * 2.0**-24


def store(vectors: DataFrame, q: Quantizer, path: str | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> Store:
    """Store all valid vectors by their nearest centroid. A quantizer that was fitted to an empty table has no words; one of zeros stands in."""
    q = q if q.centroids else Quantizer([[0.0]], [[[0.0]]])
    spark, words, book = vectors.sparkSession, np.array(q.centroids, np.float32), np.array(q.codebook, np.float32)
    path, dim, nlist, dsub = path or shared_folder(spark, "bounded"), words.shape[1], len(words), q.dsub
    shared = spark.sparkContext.broadcast((words, book))  # nlist * D + M * ksub * dsub floats

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, book = shared.value
        for batch in batches:
            rows = np.asfortranarray(A.matrix(batch.column(1), dim))
            cluster = A.nearest(rows, words)
            reach = np.sqrt(np.square(rows.astype(np.float64) - words[cluster]).sum(axis=1))
            codes = np.stack([A.nearest(rows[:, m * dsub : (m + 1) * dsub], book[m]) for m in range(len(book))], axis=1)
            gap = np.sqrt(np.square(rows[:, : dsub * len(book)].astype(np.float64) - P.decoded(codes, book)).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(reach), pa.array(gap), P.binary(P.pack(codes, book.shape[1])), A.lists(rows), pa.array(cluster)], names=["global_id", "reach", "gap", "code", "vector", "cluster_id"])

    good = vectors.where(valid(vectors[vec_col], q)).select(vectors[id_col].cast("long"), vectors[vec_col])
    placed = good.mapInArrow(place, STORED)
    # by ranges of (cluster, reach): a large cluster is several files, each a ring around its centroid
    placed.repartitionByRange(partitions_for(placed), "cluster_id", "reach").sortWithinPartitions("cluster_id", "reach").write.partitionBy("cluster_id").parquet(path)
    rings = spark.read.schema(STORED).parquet(path).groupBy("cluster_id").agg(F.count("*").alias("n"), F.min("reach").alias("low"), F.max("reach").alias("high"))
    sizes, low, high = np.zeros(nlist, np.int64), np.full(nlist, np.inf), np.full(nlist, -np.inf)
    for r in rings.collect():  # a row for each cluster
        sizes[r.cluster_id], low[r.cluster_id], high[r.cluster_id] = r.n, r.low, r.high
    return Store(path, words, book, sizes, low, high)


def _asked(spark: SparkSession, at: Store, queries: DataFrame, k: int, limits: DataFrame | None) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """ids, vectors, thresholds (distances, inf in the first round) and the clusters each query scans in this round, of a block of queries."""
    shared, unbounded = spark.sparkContext.broadcast((at.centroids, at.sizes, at.low, at.high)), limits is None

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sizes, low, high = shared.value
        for batch in batches:
            rows = A.matrix(batch.column(1), words.shape[1])
            limit = batch.column(2).to_numpy()
            far = lengths(rows.astype(np.float64), words)
            order = np.argsort(far, axis=1, kind="stable")
            before = np.cumsum(sizes[order], axis=1) - sizes[order]  # vectors of nearer clusters
            first = np.zeros(far.shape, bool)
            np.put_along_axis(first, order, before < k, axis=1)
            bound = np.maximum(np.maximum(far - high, low - far), 0)
            wanted = (first if unbounded else ~first & (np.square(bound) * (1 - slack(words.shape[1])) <= limit[:, None])) & (sizes > 0)
            bits = pa.array([row.tobytes() for row in np.packbits(wanted, axis=1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), A.lists(rows), batch.column(2), bits], names=["qid", "qvec", "limit", "wanted"])

    good = queries.where((F.size("qvec") >= at.dim) & ~F.exists("qvec", lambda x: x.isNull()))
    bounded = good.withColumn("limit", F.lit(float("inf"))) if limits is None else good.join(limits, "qid", "left").fillna(float("inf"), ["limit"])
    asked = bounded.select("qid", "qvec", "limit").mapInArrow(choose, "qid bigint, qvec array<float>, limit double, wanted binary").toArrow().combine_chunks()  # one block
    rows = A.matrix(asked["qvec"].combine_chunks(), at.dim) if asked.num_rows else np.empty((0, at.dim), np.float32)
    bits = np.frombuffer(b"".join(asked["wanted"].to_pylist()), np.uint8).reshape(asked.num_rows, -(-len(at.sizes) // 8))
    wanted = np.unpackbits(bits, axis=1)[:, : len(at.sizes)].astype(bool) if asked.num_rows else np.zeros((0, len(at.sizes)), bool)
    return asked["qid"].to_pylist(), rows, asked["limit"].to_numpy(), wanted


def _nearest(spark: SparkSession, at: Store, asked: tuple, k: int) -> DataFrame:
    """First round, HITS: the best k of each task for each query and cluster by true distance, and in one row of these how many vectors were scored."""
    ids, rows, _, wanted = asked
    clusters = np.flatnonzero(wanted.any(axis=0)).tolist()
    shared = spark.sparkContext.broadcast((np.array(ids, np.int64), rows, {c: np.flatnonzero(wanted[:, c]) for c in clusters}))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, scans = shared.value
        for batch in batches:
            cluster, vec_id, out = batch.column(2).to_numpy(), batch.column(0).to_numpy(), []
            vectors = np.asfortranarray(A.matrix(batch.column(1), queries.shape[1]))
            for c in np.unique(cluster).tolist():
                here = np.flatnonzero(cluster == c)
                for who in _steps(scans[c], len(here)):
                    found = A.distances(V.L2, vectors[here], queries[who])
                    for j, q in enumerate(who.tolist()):
                        best = np.lexsort((vec_id[here], found[:, j]))[:k]
                        scored = np.zeros(len(best), np.int64)
                        scored[0] = len(here)
                        out.append((np.full(len(best), ids[q]), np.full(len(best), c, np.int32), vec_id[here[best]], found[best, j], scored))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["qid", "cluster_id", "vector_id", "distance", "scored"])

    return at.rows(spark, clusters).select("global_id", "vector", "cluster_id").mapInArrow(score, HITS)


def _steps(who: np.ndarray, rows: int) -> Iterator[np.ndarray]:
    """Queries in steps whose table of distances to so many rows is of bounded size."""
    step = max(1, CELLS // max(rows, 1))
    for lo in range(0, len(who), step):
        yield who[lo : lo + step]


def _closer(spark: SparkSession, at: Store, asked: tuple, k: int) -> DataFrame:
    """Second round, HITS: what lies within the thresholds, the best k of each batch of rows. Only vectors that no bound excludes are scored."""
    ids, rows, limits, wanted = asked
    clusters = np.flatnonzero(wanted.any(axis=0)).tolist()
    shared = spark.sparkContext.broadcast((np.array(ids, np.int64), rows, limits, {c: np.flatnonzero(wanted[:, c]) for c in clusters}, at.centroids, at.codebook))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, limits, scans, words, book = shared.value
        dim, wide = words.shape[1], book.shape[0] * book.shape[2]
        near = np.sqrt(limits / (1 - slack(dim))) + TINY  # by true distance
        exact = queries.astype(np.float64)
        for batch in batches:
            vec_id, reach, gap, cluster = (batch.column(i).to_numpy() for i in (0, 1, 2, 5))
            vectors = np.asfortranarray(A.matrix(batch.column(4), dim))
            stood, out = P.decoded(P.unpack(P.matrix(batch.column(3)), *book.shape[:2]), book), []
            for c in np.unique(cluster).tolist():
                here = np.flatnonzero(cluster == c)
                for who in _steps(scans[c], len(here)):
                    far = lengths(exact[who], words[c : c + 1])[:, 0]
                    ring = np.abs(reach[here, None] - far[None, :]) <= near[who]
                    some = np.flatnonzero(ring.any(axis=1))
                    mine, theirs = stood[here[some]], exact[who, :wide]
                    square = np.square(mine).sum(axis=1)[:, None] + np.square(theirs).sum(axis=1)[None, :] - 2 * (mine @ theirs.T)
                    to_code = np.sqrt(np.maximum(square, 0)) - TINY * (1 + np.abs(mine).max(initial=0) + np.abs(theirs).max(initial=0))
                    j, v = np.nonzero((ring[some] & (to_code - gap[here[some], None] <= near[who])).T)
                    v, q = here[some[v]], who[j]
                    distance = A.pairwise(vectors, v, queries, q)
                    good = distance <= limits[q]  # what is farther can't be among the best
                    scored = np.bincount(j, minlength=len(who))
                    order = np.lexsort((vec_id[v], distance, q))
                    order = order[good[order]]
                    order = order[_first(q[order], k)]
                    # the count of scored vectors rides on the query's first hit, or on a row without one
                    bare = np.flatnonzero((scored > 0) & ~np.isin(who, q[order]))
                    number = np.where(_first(q[order], 1), scored[np.searchsorted(who, q[order])], 0)
                    n = len(bare)
                    out.append((
                        np.concatenate([ids[q[order]], ids[who[bare]]]), np.full(len(order) + n, c, np.int32), np.concatenate([vec_id[v[order]], np.full(n, -1)]),
                        np.concatenate([distance[order], np.full(n, np.inf, np.float32)]), np.concatenate([number, scored[bare]])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["qid", "cluster_id", "vector_id", "distance", "scored"])

    return at.rows(spark, clusters).select("global_id", "reach", "gap", "code", "vector", "cluster_id").mapInArrow(score, HITS)


def _first(key: np.ndarray, k: int) -> np.ndarray:
    """Which rows are among the first k of their run of equal keys."""
    begins = np.ones(len(key), bool)
    begins[1:] = key[1:] != key[:-1]
    start = np.maximum.accumulate(np.where(begins, np.arange(len(key)), 0))
    return np.arange(len(key)) - start < k


def scans(queries: DataFrame, at: Store, k: int) -> tuple[DataFrame, DataFrame]:
    """Hits of both rounds (qid, vector_id, distance), the best k at least; and the work: (qid, round, cluster_id, scored).

    queries: qid and qvec.
    """
    spark, hits, work = queries.sparkSession, [], []

    def stored(rows: DataFrame) -> DataFrame:
        path = shared_folder(spark, "hits")
        rows.write.parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    for block in S.in_blocks(queries, 4 * at.dim + 8 * len(at.sizes)):
        found = stored(_nearest(spark, at, _asked(spark, at, block, k, None), k))  # some k rows for each query, cluster and task
        hits.append(found.select("qid", "vector_id", "distance"))
        work.append(found.groupBy("qid", "cluster_id").agg(F.sum("scored").alias("scored")).select("qid", F.lit(FIRST).alias("round"), "cluster_id", "scored"))
        best = S.ranked(found, k, "qid").groupBy("qid").agg(F.max("distance").cast("double").alias("limit"), F.count("*").alias("_n"))
        asked = _asked(spark, at, block, k, best.where(F.col("_n") >= k).drop("_n"))
        closer = stored(_closer(spark, at, asked, k))
        hits.append(closer.where(F.col("distance") < float("inf")).select("qid", "vector_id", "distance"))
        read = spark.createDataFrame([(q, c) for q, row in zip(asked[0], asked[3], strict=True) for c in np.flatnonzero(row).tolist()], "qid bigint, cluster_id int")
        counted = read.join(closer.groupBy("qid", "cluster_id").agg(F.sum("scored").alias("scored")), ["qid", "cluster_id"], "left").fillna(0)
        work.append(counted.select("qid", F.lit(MORE).alias("round"), "cluster_id", "scored"))
    return S.union(hits), S.union(work)


def search(queries: DataFrame, at: Store, k: int) -> DataFrame:
    """qid, rank, global_id, distance of the k nearest vectors by squared L2: what search.exact_topk gives."""
    hits, _ = scans(queries, at, k)
    return S.ranked(hits.withColumn("cluster_id", F.lit(0)), k, "qid").select("qid", "rank", F.col("vector_id").alias("global_id"), "distance")


def shares(queries: DataFrame, at: Store, k: int) -> DataFrame:
    """Of each query: clusters read and vectors scored in a search, by round, and the share of all vectors that were scored."""
    _, work = scans(queries, at, k)

    def total(what, round_: int):
        return F.coalesce(F.sum(F.when(F.col("round") == round_, what)), F.lit(0)).cast("long")

    return work.groupBy("qid").agg(
        total(F.lit(1), FIRST).alias("first_clusters"), total(F.col("scored"), FIRST).alias("first_vectors"), total(F.lit(1), MORE).alias("more_clusters"),
        total(F.col("scored"), MORE).alias("more_vectors"), (F.sum("scored") / F.lit(max(int(at.sizes.sum()), 1))).alias("share"))
