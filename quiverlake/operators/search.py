"""IVF-PQ search with asymmetric distances.

The plan: centroid distances pick each query's clusters; a lookup table of M * ksub
distances is computed once for each query; the coded vectors of the probed clusters meet
their queries by a join on cluster_id and are scored by M lookups each. The best k of
each cluster are kept before the shuffle (window group limit), so what is gathered for a
query is at most k rows from each task.

Lookup tables are broadcast in blocks of queries of bounded size; a query set that needs
more takes more passes, never a larger broadcast.

Order of hits: distance, then cluster_id, then vector_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from quiverlake.functions import arrays as A
from quiverlake.functions import vector as V
from quiverlake.functions.arrays import matrix
from quiverlake.operators.index import Quantizer
from quiverlake.sources.tables import shared_folder

MOST_RESULTS = 500
TABLE_BYTES = 64 << 20
EINVAL, ENOENT = -22, -2


def query_set(vectors: DataFrame, step: int = 50) -> DataFrame:
    """(qid, qvec): every vector whose id is divisible by step."""
    return vectors.where(F.col("vec_id") % step == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))


def in_blocks(queries: DataFrame, row_bytes: int, key: str = "qid", most: int = TABLE_BYTES, count: int | None = None) -> Iterator[DataFrame]:
    """The queries in blocks of about `most` bytes at row_bytes each; they are counted unless their number is known."""
    number = max(1, -(-(queries.count() if count is None else count) * row_bytes // most))
    for k in range(number):
        yield queries if number == 1 else queries.where(F.pmod(F.xxhash64(key), F.lit(number)) == k)


def union(parts: Iterator[DataFrame]) -> DataFrame:
    out = None
    for p in parts:
        out = p if out is None else out.unionAll(p)
    return out


def against_all(queries: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """Every query with every vector, block of queries by block."""
    return union(vectors.join(F.broadcast(block)) for block in in_blocks(queries, 4 * dim + 16))


def _to_centroids(queries: DataFrame, q: Quantizer, metric: str, kind: str, choose) -> DataFrame:
    """Rows (qid, ...) that choose makes of each batch's qids, vectors and distances to all centroids."""
    shared = queries.sparkSession.sparkContext.broadcast(np.array(q.centroids, np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for whole in batches:
            step = max(1, A.CELLS // max(len(words), 1))
            for lo in range(0, whole.num_rows, step):
                batch = whole.slice(lo, step)
                yield choose(batch, A.distances(metric, matrix(batch.column(1), words.shape[1]), words))

    return queries.select("qid", "qvec").where("qvec IS NOT NULL").mapInArrow(run, kind)


def centroid_distances(queries: DataFrame, q: Quantizer, metric: str) -> DataFrame:
    """(qid, cluster_id, distance) to every centroid."""

    def choose(batch: pa.RecordBatch, found: np.ndarray) -> pa.RecordBatch:
        n, k = found.shape
        qid = batch.column(0).take(pa.array(np.repeat(np.arange(n), k)))
        return pa.RecordBatch.from_arrays([qid, pa.array(np.tile(np.arange(k, dtype=np.int32), n)), pa.array(found.ravel())], names=["qid", "cluster_id", "distance"])

    return _to_centroids(queries, q, metric, "qid bigint, cluster_id int, distance float", choose)


def probes(queries: DataFrame, q: Quantizer, metric: str, nprobe: int) -> DataFrame:
    """(qid, qvec, rank, cluster_id, distance) of the nearest centroids; ties go to the lower cluster."""

    def choose(batch: pa.RecordBatch, found: np.ndarray) -> pa.RecordBatch:
        n, k = len(found), min(nprobe, found.shape[1])
        best = np.argsort(found, axis=1, kind="stable")[:, :k]
        rows = pa.array(np.repeat(np.arange(n), k))
        near = np.take_along_axis(found, best, axis=1).ravel()
        return pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.tile(np.arange(1, k + 1), n)), pa.array(best.ravel().astype(np.int32)), pa.array(near)], names=["qid", "qvec", "rank", "cluster_id", "distance"])

    return _to_centroids(queries, q, metric, "qid bigint, qvec array<float>, rank bigint, cluster_id int, distance float", choose)


def with_tables(requests: DataFrame, q: Quantizer, metric: str) -> DataFrame:
    """Add lut to rows with qvec of the index's dimension at least; the codebook is the same for all clusters."""
    shared = requests.sparkSession.sparkContext.broadcast(np.array(q.codebook, np.float32))
    at, names = requests.columns.index("qvec"), [*requests.columns, "lut"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                n, m, k = batch.num_rows, *book.shape[:2]
                flat = A.tables(metric, matrix(batch.column(at), m * book.shape[2]), book).ravel()
                rows = pa.ListArray.from_arrays(pa.array(np.arange(n * m + 1, dtype=np.int32) * k), pa.array(flat))
                lut = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * m), rows)
                yield pa.RecordBatch.from_arrays([*batch.columns, lut], names=names)

    return requests.mapInArrow(run, StructType([*requests.schema.fields, StructField("lut", ArrayType(ArrayType(FloatType())))]))


def scan(requests: DataFrame, lists: DataFrame, q: Quantizer) -> DataFrame:
    """Score every vector of each request's cluster. requests: qid, cluster_id, lut and others, small enough to broadcast."""
    joined = lists.join(F.broadcast(requests), "cluster_id")
    return joined.withColumn("distance", V.adc(F.col("lut"), F.col("codes"), q.n_sub)).drop("lut", "codes")


def ranked(scores: DataFrame, k: int, *group: str) -> DataFrame:
    """The best k of each group, with rank from 1."""
    order = Window.partitionBy(*group).orderBy("distance", "cluster_id", "vector_id")
    return scores.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def cluster_topk(queries: DataFrame, lists: DataFrame, q: Quantizer, metric: str, nprobe: int, k: int) -> DataFrame:
    """The best k of each probed cluster: qid, cluster_id, rank, vector_id, global_id, distance."""
    def part(block: DataFrame) -> DataFrame:
        requests = with_tables(probes(block, q, metric, nprobe).select("qid", "qvec", "cluster_id"), q, metric).drop("qvec")
        return ranked(scan(requests, lists, q), k, "qid", "cluster_id")

    return union(part(b) for b in in_blocks(queries, nprobe * q.n_sub * q.ksub * 4)).select("qid", "cluster_id", "rank", "vector_id", "global_id", "distance")


def gather(hits: DataFrame, k: int) -> DataFrame:
    """The best k of each query over its clusters."""
    return ranked(hits.drop("rank"), k, "qid").select("qid", "rank", "cluster_id", "vector_id", "global_id", "distance")


def search(queries: DataFrame, lists: DataFrame, q: Quantizer, metric: str = V.L2, nprobe: int = 1, k: int = 10, scorer=cluster_topk) -> DataFrame:
    """The whole search: qid, rank, cluster_id, vector_id, global_id, distance.

    scorer gives the best k of each probed cluster: expressions by default, or kernel.cluster_topk.
    """
    return gather(scorer(queries, lists, q, metric, nprobe, k), k)


def counted_search(queries: DataFrame, lists: DataFrame, q: Quantizer, metric: str = V.L2, nprobe: int = 1, k: int = 10) -> tuple[DataFrame, dict[str, int]]:
    """search(), run once and stored, and what it did: queries, probes (pairs of a query and a cluster), vectors scored, bytes of their codes (one for each sub-quantizer) and hits.

    Queries and probes are counted as they are collected for the kernel; the others are observed on the search's own plan while it runs.
    """
    spark, watched = queries.sparkSession, []

    def observed(rows: DataFrame, *counters: Column) -> DataFrame:
        watched.append(Observation())
        return rows.observe(watched[-1], *counters)

    from quiverlake.operators import kernel

    counters = dict.fromkeys(("queries", "probes", "vectors", "code_bytes", "hits"), 0)
    parts = []
    for part, n_queries, n_probes in kernel.best_of_probes(queries, lists, q, metric, nprobe, k, False):
        counters["queries"] += n_queries
        counters["probes"] += n_probes
        parts.append(observed(part, F.sum("scored").alias("vectors"), (F.sum("scored") * q.n_sub).alias("code_bytes")).drop("scored"))
    found = observed(gather(union(iter(parts)).withColumn("rank", F.lit(0)), k), F.count("*").alias("hits"))
    path = shared_folder(spark, "counted")
    found.write.parquet(path)
    for watch in watched:
        try:
            seen = watch.get
        except Py4JJavaError:  # Spark drops the node from a plan that it finds to be empty while it runs
            seen = {}
        for name, n in seen.items():
            counters[name] += n or 0
    return spark.read.schema(found.schema).parquet(path), counters


def exhaustive(queries: DataFrame, lists: DataFrame, q: Quantizer, metric: str, k: int) -> DataFrame:
    """The best k of all clusters."""
    return search(queries, lists, q, metric, len(q.centroids), k)


def status_of(dim: Column, loaded: Column, q: Quantizer, initialised: bool = True, missing: int = ENOENT) -> Column:
    """0, EINVAL (not initialised, no query or too short a one) or the code for a missing cluster."""
    if not initialised:
        return F.lit(EINVAL)
    return F.when(~loaded, missing).when(dim.isNull() | (dim < q.dim), EINVAL).otherwise(0)


def checked(requests: DataFrame, lists: DataFrame, q: Quantizer, missing: int = ENOENT) -> DataFrame:
    """Add status to requests (req, qid, qvec, cluster_id, top_k, metric).

    Only clusters that are asked for are looked up: a stored index is pruned to them, and their ids combine in each task.
    """
    asked = requests.select("cluster_id").distinct()
    present = lists.select("cluster_id").join(asked, "cluster_id", "left_semi").distinct().withColumn("_there", F.lit(True))
    joined = requests.join(present, "cluster_id", "left")
    dim = F.when(F.col("qvec").isNotNull(), F.size("qvec"))
    return joined.withColumn("status", status_of(dim, F.col("_there").isNotNull(), q, missing=missing)).drop("_there")


def device_search(requests: DataFrame, lists: DataFrame, q: Quantizer, limit: int | None = None, missing: int = ENOENT, scorer=None) -> DataFrame:
    """req, status, count, rank, vector_id, distance: a row for each hit, and one without a hit for requests that have none.

    Longer queries than the index's are cut; top_k is clamped to limit. scorer gives the best of each request's cluster from
    (requests, lists, quantizer, how many, name of the request): a join and expressions by default, or
    kernel.best_of_requests, which is for many requests of large clusters, since pairs don't leave its tasks.
    """
    judged = checked(requests, lists, q, missing)
    wanted = F.col("top_k") if limit is None else F.least(F.col("top_k"), F.lit(limit))
    good = judged.where("status = 0").withColumn("top_k", wanted)

    def part(metric: str, block: DataFrame) -> DataFrame:
        chosen = with_tables(block.where(V.metric_column(F.col("metric")) == metric), q, metric).select("req", "cluster_id", "top_k", "lut")
        scores = scan(chosen, lists, q) if scorer is None else scorer(chosen, lists, q, most, "req").join(F.broadcast(chosen.select("req", "top_k")), "req")
        return ranked(scores, most, "req").where(F.col("rank") <= F.col("top_k"))  # a fixed bound cuts before the shuffle

    number, largest, asked = good.agg(F.count("*"), F.max("top_k"), F.collect_set(V.metric_column(F.col("metric")))).first()
    most = limit if limit is not None else largest or 0
    kept = 24 * most if scorer is not None else 0  # of a request by the kernel's tasks
    blocks = list(in_blocks(good, q.n_sub * q.ksub * 4 + kept, "req", count=number))
    hits = union(part(metric, b) for metric in sorted(asked) or [V.L2] for b in blocks).select("req", "rank", "vector_id", "distance")
    counts = hits.groupBy("req").agg(F.count("*").alias("count"))
    return judged.select("req", "status").join(counts, "req", "left").join(hits, "req", "left").select("req", "status", F.coalesce("count", F.lit(0)).alias("count"), "rank", "vector_id", "distance")


def exact_topk(queries: DataFrame, vectors: DataFrame, metric: str, k: int, dim: int) -> DataFrame:
    """qid, rank, global_id, distance of the true neighbours."""
    from quiverlake.operators import kernel

    found = ranked(kernel.exact_topk(queries, vectors, metric, k, dim), k, "qid")
    return found.select("qid", "rank", F.col("vector_id").alias("global_id"), "distance")


def refined(queries: DataFrame, lists: DataFrame, vectors: DataFrame, q: Quantizer, metric: str, nprobe: int, k: int, factor: int) -> DataFrame:
    """The best k by true distance among the best k * factor by codes: qid, rank, global_id, distance.

    Hits meet their vectors, then their queries, by shuffles: left to itself, Spark broadcasts whichever of them it finds
    small while it runs, through the driver.
    """
    from quiverlake.operators import kernel

    close = kernel.search(queries, lists, q, metric, nprobe, k * factor).select("qid", "global_id")
    raw = close.join(vectors.select(F.col("vec_id").alias("global_id"), "embedding").hint("merge"), "global_id").join(queries.hint("merge"), "qid")
    scored = raw.select("qid", F.col("global_id").alias("vector_id"), F.lit(0).alias("cluster_id"), V.distance(metric, F.col("qvec"), F.col("embedding")).alias("distance"))
    return ranked(scored, k, "qid").select("qid", "rank", F.col("vector_id").alias("global_id"), "distance")


def compare(queries: DataFrame, codes: DataFrame, q: Quantizer, tolerance: float = 1e-6) -> DataFrame:
    """Looked-up L2 distances against those to the vectors that codes (global_id, codes) stand for: qid, max_gap, worst_id and whether they differ.

    Each task keeps a row for each query, so pairs never leave it.
    """
    spark, parts = queries.sparkSession, []
    book = spark.sparkContext.broadcast(np.array(q.codebook, np.float32))
    for block in in_blocks(queries, 4 * q.dim):
        asked = block.where(F.size("qvec") >= q.dim).select("qid", "qvec").toArrow().combine_chunks()  # of bounded size
        shared = spark.sparkContext.broadcast((asked["qid"].to_numpy(), matrix(asked["qvec"].combine_chunks(), q.dim) if asked.num_rows else np.zeros((0, q.dim), np.float32)))

        def gaps(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            (qids, vectors), words = shared.value, book.value
            most, worst = np.full(len(qids), -1, np.float32), np.zeros(len(qids), np.int64)
            luts = A.tables(V.L2, vectors, words)
            for batch in batches:
                ids = batch.column(0).to_numpy()
                each = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                stood = np.asfortranarray(np.concatenate([words[m][each[:, m]] for m in range(len(words))], axis=1))
                step = max(1, A.CELLS // max(len(ids), 1))
                for lo in range(0, len(qids), step):
                    direct, looked = A.distances(V.L2, stood, vectors[lo : lo + step]), np.zeros((len(ids), len(qids[lo : lo + step])), np.float32)
                    for m in range(len(words)):
                        looked += luts[lo : lo + step, m, :].T[each[:, m]]
                    gap = np.abs(looked - direct)
                    for j, column in enumerate(gap.T if len(ids) else ()):
                        top = column.max()
                        first = ids[column == top].min()
                        if top > most[lo + j] or (top == most[lo + j] and first < worst[lo + j]):
                            most[lo + j], worst[lo + j] = top, first
            seen = most >= 0
            yield pa.RecordBatch.from_arrays([pa.array(qids[seen]), pa.array(most[seen]), pa.array(worst[seen])], names=["qid", "gap", "global_id"])

        parts.append(codes.select("global_id", "codes").mapInArrow(gaps, "qid bigint, gap float, global_id bigint"))
    every = union(parts)
    return every.groupBy("qid").agg(F.max("gap").alias("max_gap"), F.min_by("global_id", F.struct(-F.col("gap"), "global_id")).alias("worst_id"), F.max(F.col("gap") > tolerance).alias("differs"))


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """qid and the share of its true neighbours that were found; they meet by a shuffle, like refined()'s."""
    hit = truth.select("qid", "global_id").join(found.select("qid", "global_id", F.lit(1).alias("_hit")).hint("merge"), ["qid", "global_id"], "left")
    return hit.groupBy("qid").agg((F.count("_hit") / F.count("*")).alias("recall"))
