"""Packed codes and exact bounded search, against plain arrays and the exhaustive search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiverlake.operators import bounded as B
from quiverlake.operators import index as I
from quiverlake.operators import packed as P
from quiverlake.operators import search as S


def clustered(n, dim, centers, seed=1):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((centers, dim)) * 10
    return (middle[rng.integers(0, centers, n)] + rng.standard_normal((n, dim))).astype(np.float32)


@pytest.fixture(scope="module")
def data(spark):
    rows = clustered(1200, 16, 12)
    rows[700:760] = rows[5]  # ties
    vectors = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id long, embedding array<float>").repartition(3).cache()
    return vectors, vectors.where("vec_id % 40 = 5").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("n_sub,ksub", [(1, 2), (3, 16), (4, 16), (5, 200), (8, 256), (7, 5)])
def test_codes_round_trip_and_hits_are_exact(n_sub, ksub):
    rng = np.random.default_rng(n_sub)
    for n in (0, 1, 50, 3000):
        codes = rng.integers(0, ksub, (n, n_sub))
        packed = P.pack(codes, ksub)
        assert packed.shape == (n, P.width(n_sub, ksub)) and np.array_equal(P.unpack(packed, n_sub, ksub), codes)
        assert np.array_equal(P.matrix(P.binary(packed)), packed) or n == 0
        for lut in (rng.random((n_sub, ksub)), -1000 * rng.random((n_sub, ksub)) + 3, np.zeros((n_sub, ksub)), rng.random((n_sub, ksub)) ** 30 * [[1e6]]):
            lut = lut.astype(np.float32)
            total = np.zeros(n, np.float32)
            for m in range(n_sub):
                total += lut[m][codes[:, m]]
            vector = rng.permutation(n)
            want = np.lexsort((vector, total))[:10]
            rows, distance = P.best(packed, vector, lut, 10)
            assert rows.tolist() == want.tolist() and np.array_equal(distance, total[want])


def test_wider_codes_are_refused():
    with pytest.raises(ValueError):
        P.pack(np.zeros((1, 2), int), 257)


@pytest.mark.parametrize("metric", ["l2", "ip"])
@pytest.mark.parametrize("n_sub,ksub", [(4, 16), (8, 40)])
def test_packed_search_equals_the_plain_one(spark, data, metric, n_sub, ksub, tmp_path):
    vectors, queries = data
    q = I.seeded_quantizer(vectors, 5, n_sub, ksub)
    lists = I.inverted_lists(vectors, q)
    path = f"file://{tmp_path}/packed"
    P.save(P.pack_lists(lists, ksub), path)
    stored = P.load(spark, path)
    assert rows_of(S.search(queries, stored, q, metric, 3, 7, P.cluster_topk)) == rows_of(S.search(queries, lists, q, metric, 3, 7))
    assert stored.select(F.max(F.octet_length("code"))).first()[0] == P.width(n_sub, ksub)
    assert S.search(queries, stored.limit(0), q, metric, 3, 7, P.cluster_topk).count() == 0
    assert S.search(queries.limit(0), stored, q, metric, 3, 7, P.cluster_topk).count() == 0


@pytest.mark.parametrize("k", [1, 10, 300])
def test_bounded_search_is_exact_and_prunes(data, k):
    vectors, queries = data
    at = B.store(vectors, I.fit(vectors, 12, 4, 16))
    assert at.sizes.sum() == 1200 and rows_of(B.search(queries, at, k)) == rows_of(S.exact_topk(queries, vectors, "l2", k, 16))
    if k == 10:
        work = B.shares(queries, at, k).collect()
        assert len(work) == queries.count() and np.mean([r.share for r in work]) < 0.3
        assert np.mean([r.first_clusters + r.more_clusters for r in work]) < 6


def test_folders_of_other_clusters_are_not_read(spark, data):
    at = B.store(data[0], I.fit(data[0], 12, 4, 16))
    plan = at.rows(spark, [3, 4]).select("code")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cluster_id" in plan and "vector" not in plan.split("ReadSchema")[1]


def test_odd_vectors_and_few_of_them(spark, data):
    vectors, queries = data
    q = I.fit(vectors, 4, 4, 16)
    odd = spark.createDataFrame([(9000, None), (9001, [1.0] * 3), (9002, [None] + [1.0] * 15), (9003, [1.0] * 20)], "vec_id long, embedding array<float>")
    asked = queries.unionAll(odd.toDF("qid", "qvec"))
    few = vectors.where("vec_id < 6").unionAll(odd)
    got = B.search(asked, B.store(few, q), 10).collect()
    cut = lambda df, name: df.where(F.size(name) >= 16).where(~F.exists(name, lambda x: x.isNull())).withColumn(name, F.slice(name, 1, 16))
    assert sorted(map(tuple, got)) == rows_of(S.exact_topk(cut(asked, "qvec"), cut(few, "embedding"), "l2", 10, 16))
    assert {r.global_id for r in got} == {0, 1, 2, 3, 4, 5, 9003}
    assert B.search(asked, B.store(vectors.limit(0), q), 10).count() == 0 == B.search(queries.limit(0), B.store(few, q), 10).count()
    assert B.shares(queries, B.store(vectors.limit(0), q), 10).count() == 0 == B.search(queries, B.store(vectors.limit(0), I.Quantizer([], [])), 10).count()


def test_tables_of_bounds_are_small():
    who = np.arange(12_000)
    steps = list(B._steps(who, 10_000))
    assert max(len(s) for s in steps) * 10_000 <= 1 << 18 and np.array_equal(np.concatenate(steps), who)
    assert [len(s) for s in B._steps(who[:3], 1 << 20)] == [1, 1, 1]
