"""The vector engine's queries over the driver's tables. Their SQL is in oracles.py.

The index has 4 clusters and 8 sub-quantizers of 16 codewords; its parameters are the
first 4 and the slices of the first 16 vectors, so that SQL can follow it. The refined
search fits its index (16 clusters, 32 sub-quantizers of 256 codewords) to a bounded
sample. Queries are all vectors whose id is divisible by 50, against all vectors.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverlake.functions import vector as V
from quiverlake.operators import bounded
from quiverlake.operators import cache as C
from quiverlake.operators import cells
from quiverlake.operators import index as I
from quiverlake.operators import kernel, packed
from quiverlake.operators import search as S
from quiverlake.operators import starts, tree
from quiverlake.plans.engine import API_VERSION, config_columns
from quiverlake.plans.oracles import ORACLES  # noqa: F401
from quiverlake.plans.oracles import BLOB_CASES, CONFIG_CASES
from quiverlake.sources import blob, manifest, raw
from quiverlake.sources.tables import shared_folder, table

NPROBE, K = 2, 10
FITTED = (16, 32, 256)  # clusters, sub-quantizers and codewords of the fitted index
CANDIDATES = 200
MOST_IN_LIST = 200


class Index:
    """What the queries share: vectors, the query set, the quantizer and the coded lists."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.vectors = table(spark, sf_dir, "embeddings")
        self.queries = S.query_set(self.vectors)
        self.q = I.seeded_quantizer(self.vectors)

    @cached_property
    def lists(self) -> DataFrame:
        return I.inverted_lists(self.vectors, self.q)  # numbered in a stored table, so built once

    def stored(self, spark: SparkSession) -> DataFrame:
        """The lists, saved by cluster and loaded again, so that scans prune to the probed clusters."""
        path = shared_folder(spark, "index")
        I.save(self.lists, path)
        return I.load(spark, path)


def vector_distance(metric: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        x = Index(spark, sf_dir)
        return kernel.pairs(x.queries, x.vectors, metric, x.q.dim)

    return run


def subvector_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Index(spark, sf_dir)
    parts = F.array(*[V.subvector(F.col("embedding"), m, x.q.dsub) for m in range(x.q.n_sub)])
    return x.vectors.select("vec_id", F.posexplode(parts).alias("m", "part"))


def centroid_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Index(spark, sf_dir)
    both = [S.centroid_distances(x.queries, x.q, metric).withColumnRenamed("distance", metric) for metric in (V.L2, V.IP)]
    return both[0].join(both[1], ["qid", "cluster_id"])


def centroid_select(metric: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        x = Index(spark, sf_dir)
        return S.probes(x.queries, x.q, metric, NPROBE).drop("qvec")

    return run


def centroid_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 4 nearest of 256 centroids (the first vectors) through a tree of them."""
    x = Index(spark, sf_dir)
    return tree.probes(x.queries, tree.build(I.seeds(x.vectors, 256), 16), 4).select("qid", "rank", "cluster_id", "distance")


def adc_lut(metric: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        x = Index(spark, sf_dir)
        tables = S.with_tables(x.queries, x.q, metric).select("qid", F.posexplode("lut").alias("m", "row"))
        return tables.select("qid", "m", F.posexplode("row").alias("k", "d"))

    return run


def adc_scan(metric: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        x = Index(spark, sf_dir)
        lists = x.lists

        def part(block: DataFrame) -> DataFrame:
            requests = S.with_tables(S.probes(block, x.q, metric, NPROBE).select("qid", "qvec", "cluster_id"), x.q, metric).drop("qvec")
            return S.scan(requests, lists, x.q)

        blocks = S.in_blocks(x.queries, NPROBE * x.q.n_sub * x.q.ksub * 4)
        return S.union(part(b) for b in blocks).select("qid", "cluster_id", "vector_id", "global_id", "distance")

    return run


def cluster_topk(metric: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        x = Index(spark, sf_dir)
        return kernel.cluster_topk(x.queries, x.lists, x.q, metric, NPROBE, K)

    return run


def ivfpq_search(metric: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        x = Index(spark, sf_dir)
        return kernel.search(x.queries, x.stored(spark), x.q, metric, NPROBE, K)

    return run


def kernel_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ivfpq_search_l2 by the best of each cluster."""
    x = Index(spark, sf_dir)
    return S.search(x.queries, x.stored(spark), x.q, V.L2, NPROBE, K, kernel.cluster_topk)


def scatter_gather_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Index(spark, sf_dir)
    return S.gather(kernel.cluster_topk(x.queries, x.lists, x.q, V.L2, NPROBE, K), K)


def adc_exhaustive_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Index(spark, sf_dir)
    return kernel.exhaustive(x.queries, x.lists, x.q, V.L2, K)


def requests(x: Index) -> DataFrame:
    """A request for each query: by its number n = qid / 50 it asks for cluster n % 5 (4 is missing) with odd sizes and metrics."""
    n = (F.col("qid") / 50).cast("int")
    return x.queries.select(
        F.col("qid").alias("req"), F.when(n % 7 == 3, F.slice("qvec", 1, 63)).when(n % 7 == 5, F.concat("qvec", F.array(F.lit(1.0).cast("float")))).when(n % 11 == 9, F.lit(None)).otherwise(F.col("qvec")).alias("qvec"),
        (n % 5).alias("cluster_id"), F.element_at(F.array(*map(F.lit, (10, 0, 3, 600))), n % 4 + 1).alias("top_k"), F.element_at(F.array(*map(F.lit, (0, 1, 7))), n % 3 + 1).alias("metric"))


def device_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Index(spark, sf_dir)
    return S.device_search(requests(x), x.stored(spark), x.q, scorer=kernel.best_of_requests)


def search_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Index(spark, sf_dir)
    return S.checked(requests(x), x.lists, x.q).select("req", "cluster_id", "top_k", "metric", "status")


def semantic_read(metric: str):
    """Each query reads its nearest cluster and asks for 600 hits; a cluster without an object is no valid object."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        x = Index(spark, sf_dir)
        asked = S.probes(x.queries, x.q, metric, 1).select(F.col("qid").alias("req"), "qvec", "cluster_id", F.lit(600).alias("top_k"), F.lit(1 if metric == V.IP else 0).alias("metric"))
        return S.device_search(asked, x.stored(spark), x.q, S.MOST_RESULTS, S.EINVAL, kernel.best_of_requests)

    return run


def topk_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors twice in one cluster, 600 hits asked for: 500 come."""
    x = Index(spark, sf_dir)
    twice = I.coded(x.vectors, x.q).select("global_id", "codes", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"))
    one = twice.select(F.lit(0).alias("cluster_id"), (2 * F.col("global_id") + F.col("copy")).alias("vector_id"), "global_id", "codes")
    asked = x.queries.select(F.col("qid").alias("req"), "qvec", F.lit(0).alias("cluster_id"), F.lit(600).alias("top_k"), F.lit(0).alias("metric"))
    return S.device_search(asked, one, x.q, S.MOST_RESULTS, scorer=kernel.best_of_requests).select("req", "count", "rank", "vector_id", "distance")


def ivf_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Index(spark, sf_dir)
    return I.coded(x.vectors, x.q).select(F.col("global_id").alias("vec_id"), "cluster_id")


def ivf_list_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Index(spark, sf_dir)
    return I.list_sizes(I.coded(x.vectors, x.q))


def bounded_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors in lists split until none has more than MOST_IN_LIST: how many vectors there are, and how many lists are too long."""
    x = Index(spark, sf_dir)
    at = cells.placed(x.vectors, cells.split(x.vectors, x.q.centroids, MOST_IN_LIST))
    sizes = at.groupBy("list").agg(F.count("*").alias("n"))
    return sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_vectors"), F.count_if(F.col("n") > MOST_IN_LIST).alias("too_long"))


def inverted_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Index(spark, sf_dir).lists


def pq_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Index(spark, sf_dir)
    return I.coded(x.vectors, x.q).select(F.col("global_id").alias("vec_id"), "codes")


def pq_code_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole codes, and parts of them of 0 to 8 codes (of every tenth vector none), packed and unpacked."""
    codes, n = F.col("codes"), F.when(F.col("vec_id") % 10 != 9, F.col("vec_id") % 9).cast("int")
    both = pq_encode(spark, sf_dir).select("vec_id", n.alias("n"), V.pack_nibbles(codes).alias("packed"), V.pack_nibbles(F.slice(codes, F.lit(1), n)).alias("part_packed"))
    return both.select("vec_id", "packed", V.unpack_nibbles(F.col("packed")).alias("codes"), "part_packed", V.unpack_nibbles(F.col("part_packed"), F.col("n")).alias("part_codes"))


def kmeans_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Index(spark, sf_dir)
    return I.lloyd_step(x.vectors, x.q.centroids)


def kmeans_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four starts by rounds of oversampling over all vectors: the order they were chosen in, what they weigh."""
    x = Index(spark, sf_dir)
    rows = [(k, i, n, v) for k, (i, n, v) in enumerate(starts.parallel_starts(x.vectors, 4, x.q.dim))]
    return spark.createDataFrame(rows, "cluster_id int, vec_id bigint, weight bigint, centroid array<float>")


def pq_train_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Index(spark, sf_dir)
    return I.pq_lloyd_step(x.vectors, x.q.codebook)


def cluster_object_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Index(spark, sf_dir)
    return ivf_list_sizes(spark, sf_dir).withColumn("object_bytes", blob.size_of(x.q.n_sub, x.q.ksub, x.q.dsub, F.col("n_vectors")))


def index_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Index(spark, sf_dir)
    counts = x.vectors.agg(F.count("*").alias("num_vectors"), F.count(F.when(F.col("vec_id") % 50 == 0, 1)).alias("num_queries"))
    lit = lambda v, name: F.lit(v).alias(name)
    return counts.select(F.to_json(F.struct(lit(x.q.n_sub, "M"), lit(x.q.ksub, "ksub"), lit(x.q.dim, "D"), lit(x.q.dsub, "dsub"), "num_vectors", "num_queries", lit(K, "top_k"), lit(0, "metric_type"))).alias("metadata"))


def blob_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = spark.createDataFrame([(k, None if h is None else bytes.fromhex(h)) for k, h in enumerate(BLOB_CASES)], "case_id int, content binary")
    return cases.select("case_id", blob.status(F.col("content")).alias("status"))


def blob_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Index(spark, sf_dir)
    return blob.coded_vectors(blob.objects(x.lists, x.q.codebook))


def blob_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Index(spark, sf_dir)
    path = shared_folder(spark, "objects")
    blob.write_lists(x.lists, x.q.codebook, path)
    return spark.read.format("ivfpq_blob").load(path)


def through_raw(rows: DataFrame, order: list[str], kind: str, width: int) -> DataFrame:
    """The rows, written as one raw array in an order and read again."""
    spark = rows.sparkSession
    path = shared_folder(spark, "raw")
    raw.register(spark)
    rows.orderBy(*order).write.format("raw_rows").options(kind=kind, width=width).mode("append").save(path)
    return spark.read.format("raw_rows").options(kind=kind, width=width).load(path)


def raw_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Index(spark, sf_dir)
    return through_raw(x.vectors.select("vec_id", F.col("embedding").alias("elements")), ["vec_id"], "f32", x.q.dim)


def raw_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Index(spark, sf_dir)
    return through_raw(pq_encode(spark, sf_dir).withColumnRenamed("codes", "elements"), ["vec_id"], "u8", x.q.n_sub)


def golden_topk_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file of the best hits of all queries; a query's number is its place among them."""
    hits = adc_exhaustive_topk(spark, sf_dir).select("qid", "rank", F.col("global_id").alias("vector_id"), "distance")
    return through_raw(hits, ["qid", "rank"], "topk", K)


def semantic_write_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store the index, replace cluster 2 by its vectors of even position, read it all."""
    x = Index(spark, sf_dir)
    path = shared_folder(spark, "index")
    I.save(x.lists, path)
    fresh = x.lists.where("cluster_id = 2 AND vector_id % 2 = 0").withColumn("vector_id", (F.col("vector_id") / 2).cast("long"))
    I.overwrite_clusters(fresh, path)
    return I.load(spark, path)


def versioned_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same change as a second version of the index: both versions, each read from its own snapshot."""
    x = Index(spark, sf_dir)
    path = shared_folder(spark, "versions")
    first = manifest.save(x.lists, path)
    fresh = x.lists.where("cluster_id = 2 AND vector_id % 2 = 0").withColumn("vector_id", (F.col("vector_id") / 2).cast("long"))
    second = manifest.overwrite_clusters(fresh, path)
    each = [manifest.load(spark, path, x.lists.schema, v).withColumn("version", F.lit(v.number)) for v in (first, second)]
    return each[0].unionByName(each[1])


def appended_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index built of three appended parts, by thirds of the ids, the first two folded into one: the rows of a rebuilt one."""
    x = Index(spark, sf_dir)
    path, codes = shared_folder(spark, "appended"), I.coded(x.vectors, x.q)
    low, high = x.vectors.agg(F.min("vec_id"), F.max("vec_id")).first()
    cuts = [low or 0, *((low or 0) + ((high or 0) - (low or 0)) * k // 3 for k in (1, 2)), (high or 0) + 1]
    for k in range(3):
        part = codes.where((F.col("global_id") >= cuts[k]) & (F.col("global_id") < cuts[k + 1]))
        fresh = I.number_within(part, "cluster_id", "global_id", "vector_id").select("cluster_id", "vector_id", "global_id", "codes")
        manifest.append(fresh, path)
        if k == 1:
            manifest.compact(spark, path, fresh.schema)
    return manifest.load(spark, path, fresh.schema)


def cluster_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of each cluster by the stored index's file blocks."""
    x = Index(spark, sf_dir)
    path = shared_folder(spark, "index")
    I.save(x.lists, path)
    return I.extents(spark, path).groupBy("cluster_id").agg(F.sum("n_vectors").alias("n_vectors"), (F.sum("block_bytes") > 0).alias("on_disk"))


def golden_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Looked-up distances against those to the reconstructed vectors, over all clusters."""
    x = Index(spark, sf_dir)
    return S.compare(x.queries, I.coded(x.vectors, x.q), x.q)


def metric_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Index(spark, sf_dir)
    a, b = (kernel.exhaustive(x.queries, x.lists, x.q, m, K).select("qid", "rank", F.col("global_id").alias(m)) for m in (V.L2, V.IP))
    return a.join(b, ["qid", "rank"]).groupBy("qid").agg(F.max(F.col(V.L2) != F.col(V.IP)).alias("differs"))


def exact_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Index(spark, sf_dir)
    return S.exact_topk(x.queries, x.vectors, V.L2, K, x.q.dim)


def fitted_search(spark: SparkSession, sf_dir: str) -> tuple[Index, DataFrame]:
    """Codes of a fitted quantizer find CANDIDATES vectors in all clusters, true distances rank them."""
    x = Index(spark, sf_dir)
    x.q = I.fit(x.vectors, *FITTED)
    return x, S.refined(x.queries, x.stored(spark), x.vectors, x.q, V.L2, FITTED[0], K, CANDIDATES // K)


def refined_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fitted_search(spark, sf_dir)[1]


def refined_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By query: the share of the true neighbours that refined_search finds."""
    x, found = fitted_search(spark, sf_dir)
    return S.recall(found, S.exact_topk(x.queries, x.vectors, V.L2, K, x.q.dim))


def search_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ivfpq_search does, by metric."""
    x = Index(spark, sf_dir)
    stored, names = x.stored(spark), ("queries", "probes", "vectors", "code_bytes", "hits")
    rows = []
    for metric in (V.L2, V.IP):
        _, counters = S.counted_search(x.queries, stored, x.q, metric, NPROBE, K)
        rows.append((metric, *(counters.get(n, 0) for n in names)))
    return spark.createDataFrame(rows, "metric string, " + ", ".join(f"{n} bigint" for n in names))


def packed_index(spark: SparkSession, x: Index) -> DataFrame:
    """The index with packed codes, stored and loaded."""
    path = shared_folder(spark, "packed")
    packed.save(packed.pack_lists(x.lists, x.q.ksub), path)
    return packed.load(spark, path)


def packed_search(metric: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """ivfpq_search over packed codes by 8-bit tables, re-ranked exactly."""
        x = Index(spark, sf_dir)
        return S.search(x.queries, packed_index(spark, x), x.q, metric, NPROBE, K, packed.cluster_topk)

    return run


def packed_code_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed.code_bytes(packed_index(spark, Index(spark, sf_dir)))


def bounded_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The true neighbours through a fitted index: bounds leave out clusters and vectors, never a neighbour."""
    x = Index(spark, sf_dir)
    return bounded.search(x.queries, bounded.store(x.vectors, I.fit(x.vectors, *FITTED)), K)


def bounded_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What such a search reads and scores with the seeded quantizer, by query."""
    x = Index(spark, sf_dir)
    return bounded.shares(x.queries, bounded.store(x.vectors, x.q), K)


def ivfpq_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By query: the share of the true neighbours that ivfpq_search_l2 finds with its seeded quantizer."""
    return S.recall(ivfpq_search(V.L2)(spark, sf_dir), exact_knn(spark, sf_dir))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.access_log(table(spark, sf_dir, "events"))


def lru_hit_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.replay(log(spark, sf_dir)).select("event_id", "shard", "cluster_id", "op", "hit")


def lru_evictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.replay(log(spark, sf_dir)).where("evicted IS NOT NULL").select("event_id", "shard", "cluster_id", "evicted")


def opwq_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.replay(log(spark, sf_dir)).select("event_id", "shard", "priority")


def cache_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.counters(C.replay(log(spark, sf_dir)))


def cache_resident_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.resident(log(spark, sf_dir)).drop("reload")


def codebook_reload_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.resident(log(spark, sf_dir)).drop("recency")


def last_cluster_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.last_cluster(log(spark, sf_dir))


def centroid_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replay of one cache of decoded centroids, keyed by index: each access needs those of its cluster's index."""
    log = C.access_log(table(spark, sf_dir, "events"), C.INDEXES, 1)
    return C.replay(log, C.CENTROID_SLOTS).select("event_id", F.col("cluster_id").alias("index_id"), "hit", F.col("evicted").alias("evicted_index"))


def config_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = spark.createDataFrame(list(enumerate(CONFIG_CASES)), "case_id int, config string")
    status, slots, path = config_columns(F.col("config"))
    return cases.select("case_id", status.alias("status"), slots.alias("max_cache_slots"), path.alias("hw_lib_path"))


def api_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1).select(F.lit(API_VERSION).alias("api_version"))


QUERIES = {
    "ivfpq_search_l2": ivfpq_search(V.L2), "ivfpq_search_ip": ivfpq_search(V.IP), "kernel_search": kernel_search,
    "vector_l2_distance": vector_distance(V.L2), "vector_ip_distance": vector_distance(V.IP), "subvector_split": subvector_split,
    "centroid_distances": centroid_distances, "centroid_select_l2": centroid_select(V.L2), "centroid_select_ip": centroid_select(V.IP),
    "centroid_tree": centroid_tree,
    "adc_lut_l2": adc_lut(V.L2), "adc_lut_ip": adc_lut(V.IP), "adc_scan_l2": adc_scan(V.L2), "adc_scan_ip": adc_scan(V.IP),
    "cluster_topk_l2": cluster_topk(V.L2), "cluster_topk_ip": cluster_topk(V.IP), "device_search": device_search, "topk_clamp": topk_clamp,
    "scatter_gather_topk": scatter_gather_topk, "semantic_read_l2": semantic_read(V.L2), "semantic_read_ip": semantic_read(V.IP),
    "adc_exhaustive_topk": adc_exhaustive_topk, "search_status": search_status,
    "ivf_assign": ivf_assign, "ivf_list_sizes": ivf_list_sizes, "inverted_lists": inverted_lists, "bounded_lists": bounded_lists, "pq_encode": pq_encode, "pq_code_unpack": pq_code_unpack,
    "kmeans_step": kmeans_step, "kmeans_starts": kmeans_starts, "pq_train_step": pq_train_step,
    "cluster_object_size": cluster_object_size, "index_metadata": index_metadata, "blob_validate": blob_validate, "blob_scan": blob_scan, "blob_roundtrip": blob_roundtrip, "semantic_write_overwrite": semantic_write_overwrite, "versioned_overwrite": versioned_overwrite, "appended_lists": appended_lists, "cluster_extents": cluster_extents,
    "raw_vectors": raw_vectors, "raw_codes": raw_codes, "golden_topk_records": golden_topk_records,
    "golden_compare": golden_compare, "metric_divergence": metric_divergence,
    "lru_hit_miss": lru_hit_miss, "lru_evictions": lru_evictions, "cache_resident_set": cache_resident_set, "last_cluster_id": last_cluster_id,
    "codebook_reload_flag": codebook_reload_flag, "opwq_priority": opwq_priority, "cache_counters": cache_counters, "centroid_cache": centroid_cache,
    "config_parse": config_parse, "api_version": api_version,
    "search_counters": search_counters, "packed_search_l2": packed_search(V.L2), "packed_search_ip": packed_search(V.IP), "packed_code_bytes": packed_code_bytes, "bounded_search": bounded_search, "bounded_shares": bounded_shares,
    "exact_knn": exact_knn, "refined_search": refined_search, "refined_recall": refined_recall, "ivfpq_recall": ivfpq_recall,
}
