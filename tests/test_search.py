import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiverlake.functions import arrays as A
from quiverlake.functions import vector as V
from quiverlake.operators import index as I
from quiverlake.operators import kernel as K
from quiverlake.operators import search as S

from . import twin


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(42)
    rows = [(i, [float(x) for x in rng.standard_normal(32).astype(np.float32)]) for i in range(105)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).cache()
    base = vectors.where("vec_id < 100")
    q = I.seeded_quantizer(base, nlist=4, n_sub=4, ksub=16)
    queries = vectors.where("vec_id >= 100").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    return dict(rows), base, queries, q, I.inverted_lists(base, q).cache()


def codes_by_cluster(rows, q):
    out = {}
    for i in range(100):
        out.setdefault(twin.nearest("l2", rows[i], q.centroids), []).append((i, twin.encode(rows[i], q.codebook)))
    return out


def test_lists_equal_the_scalar_build(data):
    rows, _, _, q, lists = data
    got = sorted(tuple(r) for r in lists.collect())
    assert got == sorted((c, k, i, codes) for c, members in codes_by_cluster(rows, q).items() for k, (i, codes) in enumerate(members))


@pytest.mark.parametrize("metric", ["l2", "ip"])
@pytest.mark.parametrize("nprobe", [1, 2, 4])
def test_search_equals_the_scalar_search(data, metric, nprobe):
    rows, _, queries, q, lists = data
    by = codes_by_cluster(rows, q)
    got = sorted(tuple(r) for r in S.search(queries, lists, q, metric, nprobe, 10).collect())
    want = []
    for qid in range(100, 105):
        near = sorted(range(4), key=lambda c: (twin.distance(metric, rows[qid], q.centroids[c]), c))[:nprobe]
        hits = sorted((d, c, i) for c in near for d, i in twin.topk(metric, rows[qid], [x for _, x in by[c]], q.codebook, 10))[:10]
        want += [(qid, r, c, i, by[c][i][0], d) for r, (d, c, i) in enumerate(hits, 1)]
    assert got == sorted(want)


def test_counters_of_a_search(data, monkeypatch):
    rows, _, queries, q, lists = data
    sizes = {r.cluster_id: r.n_vectors for r in I.list_sizes(lists).collect()}
    probed = S.probes(queries, q, "l2", 2).collect()
    want = {"queries": 5, "probes": 10, "vectors": (n := sum(sizes.get(r.cluster_id, 0) for r in probed)), "code_bytes": 4 * n, "hits": 35}
    found, counters = S.counted_search(queries, lists, q, "l2", 2, 7)
    assert counters == want and sorted(map(tuple, found.collect())) == sorted(map(tuple, S.search(queries, lists, q, "l2", 2, 7).collect()))
    monkeypatch.setattr(S, "in_blocks", lambda df, n: iter([df.where("qid % 2 = 0"), df.where("qid % 2 = 1")]))
    assert S.counted_search(queries, lists, q, "l2", 2, 7)[1] == want
    assert S.counted_search(queries.limit(0), lists, q, "l2", 2, 7)[1] == dict.fromkeys(want, 0)


def test_blocks_of_queries_change_nothing(data, monkeypatch):
    _, _, queries, q, lists = data
    whole = sorted(map(tuple, S.search(queries, lists, q, "l2", 2, 5).collect()))
    monkeypatch.setattr(S, "in_blocks", lambda df, n, key=None: iter([df.where("qid % 2 = 0"), df.where("qid % 2 = 1")]))
    assert sorted(map(tuple, S.search(queries, lists, q, "l2", 2, 5).collect())) == whole
    monkeypatch.undo()
    assert sum(b.count() for b in S.in_blocks(queries, 100, most=250)) == 5


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_both_scorers_agree_to_the_bit(data, metric):
    _, _, queries, q, lists = data
    native = sorted(map(tuple, S.search(queries, lists, q, metric, 2, 7).collect()))
    assert sorted(map(tuple, S.search(queries, lists, q, metric, 2, 7, K.cluster_topk).collect())) == native
    assert S.search(queries, lists.limit(0), q, metric, 2, 7, K.cluster_topk).count() == 0


def requests(spark, rows):
    cases = [
        (1, rows[100], 0, 10, 0), (2, rows[100], 0, 10, 1), (3, rows[100], 0, 10, 7), (4, rows[100][:31], 0, 10, 0), (5, [*rows[100], 9.0], 0, 10, 0),
        (6, rows[100], 99, 10, 0), (7, rows[100], 1, 0, 0), (8, None, 1, 5, 0), (9, rows[101], 1, 600, 0)]
    return spark.createDataFrame(cases, "req int, qvec array<float>, cluster_id int, top_k int, metric int")


def test_device_search_statuses(spark, data):
    rows, _, _, q, lists = data
    found = {}
    for r in S.device_search(requests(spark, rows), lists, q).collect():
        found.setdefault(r.req, []).append(r)
    status = {k: v[0].status for k, v in found.items()}
    assert status == {1: 0, 2: 0, 3: 0, 4: -22, 5: 0, 6: -2, 7: 0, 8: -22, 9: 0}
    hits = {k: sorted((r["rank"], r.vector_id, r.distance) for r in v if r["rank"]) for k, v in found.items()}
    assert hits[1] == hits[3] == hits[5] and hits[1] != hits[2] and len(hits[1]) == 10  # unknown metrics are L2, a longer query is cut
    assert not hits[4] and not hits[6] and not hits[7] and not hits[8] and found[7][0]["count"] == 0
    members = codes_by_cluster(rows, q)
    assert len(hits[9]) == min(600, len(members[1]))
    want = twin.topk("ip", rows[100], [x for _, x in members[0]], q.codebook, 10)
    assert [(d, i) for _, i, d in hits[2]] == want


def test_device_search_by_the_kernel(spark, data):
    rows, _, _, q, lists = data
    asked = requests(spark, rows)
    plain = sorted(map(str, S.device_search(asked, lists, q, S.MOST_RESULTS).collect()))
    assert sorted(map(str, S.device_search(asked, lists, q, S.MOST_RESULTS, scorer=K.best_of_requests).collect())) == plain
    assert S.device_search(asked.limit(0), lists, q, S.MOST_RESULTS, scorer=K.best_of_requests).count() == 0


def test_ties_go_to_the_lower_id_and_results_are_clamped(spark, data):
    rows, _, _, q, _ = data
    lists = spark.range(700).select(F.lit(0).alias("cluster_id"), F.col("id").alias("vector_id"), F.col("id").alias("global_id"), F.array(*[F.lit(3)] * 4).alias("codes"))
    asked = requests(spark, rows).where("req = 1").withColumn("top_k", F.lit(600))
    got = [r.vector_id for r in S.device_search(asked, lists, q, S.MOST_RESULTS).orderBy("rank").collect()]
    assert got == list(range(500))


def test_refined_search_recalls(spark, data):
    _, base, queries, q, lists = data
    truth = S.exact_topk(queries, base, "l2", 5, 32)
    found = S.refined(queries, lists, base, q, "l2", 4, 5, 10)
    assert S.recall(found, truth).agg(F.avg("recall")).first()[0] >= 0.9


def test_refinement_sends_no_table_through_the_driver(data):
    _, base, queries, q, lists = data
    found = S.refined(queries, lists, base, q, "l2", 4, 5, 10)
    assert found.count() == 25
    assert set(re.findall(r"(\w*Join) \[(?:qid|global_id)#\d+L?\], \[", plan(found))) == {"SortMergeJoin"}
    shares = S.recall(found, S.exact_topk(queries, base, "l2", 5, 32))
    assert shares.count() == 5 and "SortMergeJoin [qid" in plan(shares) and "BroadcastHashJoin [qid" not in plan(shares)


def test_invalid_vectors_are_told(spark, data):
    rows, base, _, q, lists = data
    odd = spark.createDataFrame([(200, None), (201, [1.0] * 31), (202, [*[1.0] * 31, None]), (203, [*rows[3], 5.0])], "vec_id long, embedding array<float>")
    both = base.unionAll(odd)
    assert sorted(map(tuple, I.invalid(both, q).collect())) == [(200, -22), (201, -22), (202, -22)]
    more = I.inverted_lists(both, q)
    assert more.count() == 101
    same = {r.global_id: (r.cluster_id, r.codes) for r in more.where("global_id IN (3, 203)").collect()}
    assert same[3] == same[203]


def test_kernel_and_expressions_code_alike(spark, data):
    _, base, _, q, _ = data
    native = base.select("vec_id", I.cluster_of(F.col("embedding"), q.centroids), I.encode(F.col("embedding"), q.codebook))
    assert sorted(map(tuple, I.coded(base, q).collect())) == sorted(map(tuple, native.collect()))


def test_numbering_and_empty_table(spark):
    rows = spark.range(20_000).select((F.col("id") * 37 % 20_000).alias("k"), (F.col("id") % 3).alias("g"))
    got = I.number_within(rows, "g", "k", "pos").collect()
    for g in range(3):
        ordered = sorted((r.k, r.pos) for r in got if r.g == g)
        assert [p for _, p in ordered] == list(range(len(ordered)))
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    q = I.Quantizer([[0.0, 0.0]], [[[0.0]], [[1.0]]])
    assert I.inverted_lists(none, q).count() == 0


def test_training_follows_lloyd(spark, data):
    rows, base, _, _, _ = data
    q = I.train(base, 3, 4, 4, 2)
    want = [rows[i] for i in range(3)]
    for _ in range(2):
        groups = [[rows[i] for i in range(100) if twin.nearest("l2", rows[i], want) == c] for c in range(3)]
        want = [[np.float32(sum(int(np.floor(np.float64(v[j]) * I.FIXED_POINT)) for v in g) / len(g) / I.FIXED_POINT) for j in range(32)] if g else w for g, w in zip(groups, want, strict=True)]
    assert np.array_equal(np.array(q.centroids, np.float32), np.array(want, np.float32))
    assert (q.n_sub, q.ksub, q.dsub) == (4, 4, 8)


def test_nibbles_and_metrics(spark):
    one = spark.range(1).select(F.array(*map(F.lit, (1, 15, 0, 7))).alias("c"))
    assert one.select(V.pack_nibbles(F.col("c"))).first()[0] == [241, 112]
    assert one.select(V.unpack_nibbles(V.pack_nibbles(F.col("c")))).first()[0] == [1, 15, 0, 7]
    codes = [[], [7], [1, 2, 3], None, [15] * 7, [0, 0]]
    odd = spark.createDataFrame([(c, None if c is None else len(c)) for c in codes], "c array<int>, n int")
    back = odd.select("c", V.pack_nibbles(F.col("c")).alias("p"), V.unpack_nibbles(V.pack_nibbles(F.col("c")), F.col("n")).alias("u")).collect()
    assert [r.u for r in back] == codes and [None if r.p is None else len(r.p) for r in back] == [0, 1, 2, None, 4, 1]
    assert back[2].p == [33, 3]
    assert [V.metric_of(x) for x in (0, 1, 7, None, "ip")] == ["l2", "ip", "l2", "l2", "ip"]
    with pytest.raises(ValueError):
        V.metric_of("cosine")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, data, tmp_path):
    _, _, queries, q, lists = data
    path = f"file://{tmp_path}/index"
    I.save(lists, path)
    found = plan(S.search(queries, I.load(spark, path), q, "l2", 2, 10))
    assert "dynamicpruning" in found.lower() and "WindowGroupLimit" in found and "BroadcastHashJoin" in found
    assert "CartesianProduct" not in found and "SortMergeJoin" not in found
    one = plan(I.load(spark, path).where("cluster_id = 2").select("codes"))
    assert "PartitionFilters: [isnotnull(cluster_id" in one and "vector_id" not in one.split("ReadSchema")[1]


def test_large_quantizers_make_small_plans(spark):
    rng = np.random.default_rng(1)
    centroids = rng.standard_normal((4096, 768)).astype(np.float32)
    q = I.Quantizer(centroids, centroids[:256].reshape(256, 96, 8).swapaxes(0, 1))
    one = spark.createDataFrame([(7, centroids[99].tolist())], "qid long, qvec array<float>")
    found = S.with_tables(S.probes(one, q, "l2", 3), q, "l2")
    assert len(found._jdf.queryExecution().toString()) < 20_000
    rows = found.collect()
    assert [r.cluster_id for r in rows][0] == 99 and rows[0].distance == 0.0 and np.array(rows[0].lut).shape == (96, 256)


def test_fitted_words_are_means(spark, data):
    _, base, _, _, _ = data
    q = I.fit(base, 3, 4, 8, 20)
    assert len(q.centroids) == 3 and (q.n_sub, q.ksub, q.dsub) == (4, 8, 8)
    seeded = I.fit(base, 3, 4, 8, 0)
    error = lambda q: base.select(V.l2(F.col("embedding"), I.reconstruct(I.encode(F.col("embedding"), q.codebook), q.codebook)).alias("d")).agg(F.avg("d")).first()[0]
    assert error(q) < 0.9 * error(seeded)
    assert I.fit(base, 3, 4, 8, 5) == I.fit(base.repartition(2), 3, 4, 8, 5)


def test_one_pass_of_training_is_a_step_of_each_part(spark, data):
    _, base, _, q, _ = data
    trained = I.train(base, 4, 4, 16, 1)
    steps = {(r.cluster_id, r.j): r.value for r in I.lloyd_step(base, q.centroids).collect()}
    assert trained.centroids == [[steps[k, j] for j in range(32)] for k in range(4)]
    steps = {(r.m, r.k, r.j): r.value for r in I.pq_lloyd_step(base, q.codebook).collect()}
    assert trained.codebook == [[[steps[m, k, j] for j in range(8)] for k in range(16)] for m in range(4)]


def test_sparse_ids_are_numbered_by_ranges(spark):
    rows = spark.range(500).select((F.col("id") % 3).cast("int").alias("g"), (F.xxhash64("id")).alias("key")).unionAll(spark.sql("SELECT 7 AS g, 5L AS key")).repartition(5)
    got = {}
    for r in I.number_within(rows, "g", "key", "at").collect():
        got.setdefault(r.g, []).append((r.key, r["at"]))
    assert {g: [a for _, a in sorted(x)] for g, x in got.items()} == {g: list(range(len(x))) for g, x in got.items()} and len(got) == 4


def test_pairs_do_not_leave_the_kernels_tasks(spark, data):
    _, base, queries, q, lists = data
    for metric in ("l2", "ip"):
        assert sorted(map(tuple, K.search(queries, lists, q, metric, 2, 7).collect())) == sorted(map(tuple, S.search(queries, lists, q, metric, 2, 7).collect()))
        assert sorted(map(tuple, K.exhaustive(queries, lists, q, metric, 3).collect())) == sorted(map(tuple, S.exhaustive(queries, lists, q, metric, 3).collect()))
    most = 3 * queries.count() * spark.sparkContext.defaultParallelism
    (part, _, _), = K.best_of_probes(queries, lists, q, "l2", 4, 3, False)
    assert part.count() <= most and K.exact_topk(queries, base, "l2", 3, 32).count() <= most


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_kernel_pairs_equal_the_expressions_on_odd_vectors(spark, metric):
    odd = [[1.0, 2.0, 3.0], None, [1.0, None, 3.0], [1.0, 2.0], [], [0.5, -0.0, 7.25]]
    vectors = spark.createDataFrame([(k, v) for k, v in enumerate(odd)], "vec_id long, embedding array<float>")
    queries = vectors.selectExpr("vec_id AS qid", "embedding AS qvec")
    plain = S.against_all(queries, vectors, 3).select("qid", "vec_id", V.distance(metric, F.col("qvec"), F.col("embedding")).alias("distance"))
    assert sorted(map(str, K.pairs(queries, vectors, metric, 3).collect())) == sorted(map(str, plain.collect()))
    assert K.pairs(queries, vectors.limit(0), metric, 3).count() == 0 == K.pairs(queries.limit(0), vectors, metric, 3).count()


def test_tasks_that_give_all_pairs_are_bounded(data, monkeypatch):
    _, base, queries, _, _ = data
    whole = sorted(map(tuple, K.pairs(queries, base, "ip", 32).collect()))
    monkeypatch.setattr(K, "PAIRS", 40, raising=False)
    many = K.pairs(queries, base, "ip", 32)
    assert sorted(map(tuple, many.collect())) == whole and len(whole) == 500
    assert max(r["count"] for r in many.groupBy(F.spark_partition_id()).count().collect()) <= 60


@pytest.mark.parametrize("metric", ["l2", "ip"])
@pytest.mark.parametrize("dsub", [0, 4])
def test_bounds_leave_out_pairs_but_no_hit(metric, dsub):
    rng = np.random.default_rng(7)
    rows = rng.standard_normal((6000, 16)).astype(np.float32)
    rows[3000:] = rows[:3000]  # ties
    rows[:500] *= np.float32(1e-22)  # squares underflow
    rows[500:700] += np.float32(1000)  # distances cancel
    odd = rows[:40].copy()
    odd[0], odd[1], odd[2, 3], odd[3] = np.nan, np.inf, 3e38, 0
    queries = np.concatenate([rng.standard_normal((300, 16)).astype(np.float32), rows[490:510], rows[:5], odd[:4]])
    for some in (rows, np.concatenate([odd, rows])):
        best, plain = K.Best(10), K.Best(10)
        bounds, slots, key = K.Bounds(metric, queries), np.arange(len(queries)), np.arange(len(some))
        with np.errstate(all="ignore"):
            for lo in range(0, len(some), 1500):
                part = some[lo : lo + 1500]
                for who, slot, at in bounds.close(part, slots, slots, best):
                    K._add(best, slot, A.pairwise(part, at, queries, who, metric, dsub), key[lo + at] % 3, key[lo + at], key[lo + at])
                for q in slots.tolist():
                    total = A.pairwise(part, np.arange(len(part)), queries, np.full(len(part), q), metric, dsub)
                    plain.add(q, total, key[lo : lo + 1500] % 3, key[lo : lo + 1500], key[lo : lo + 1500])
        for q in slots.tolist():
            assert all(np.array_equal(a, b, equal_nan=True) for a, b in zip(best.held[q], plain.held[q], strict=True))
    best = K.Best(10)
    some, slots = rng.standard_normal((6000, 16)).astype(np.float32), np.arange(300)
    compared = sum(len(who) for who, _, _ in K.Bounds(metric, queries[:300]).close(some, slots, slots, best))
    assert 300 * 10 <= compared < 300 * 20
