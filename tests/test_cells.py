"""Lists of bounded length, against a loop over plain rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiverlake.functions import arrays as A
from quiverlake.operators import cells as C
from quiverlake.operators import search as S


def table(spark, rows):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<float>").repartition(3).cache()


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    middle = rng.standard_normal((30, 8)) * 6
    out = (middle[rng.integers(0, 30, 2000)] + rng.standard_normal((2000, 8))).astype(np.float32)
    out[:900] = middle[0] + rng.standard_normal((900, 8)).astype(np.float32)  # a hot cluster
    out[900:1300] = out[7]  # equal vectors
    return out


def test_no_list_is_too_long_and_each_vector_is_where_the_centroids_say(spark, rows):
    vectors = table(spark, rows)
    cells = C.split(vectors, rows[[0, 1500, 1600, 1700]].tolist(), 100)
    at = {r.global_id: r.list for r in C.placed(vectors, cells).collect()}
    sizes = np.bincount(list(at.values()))
    assert len(at) == 2000 and sizes.max() <= 100 and cells.dealt
    for i, v in enumerate(rows):  # down the centroids, one by one
        nodes, parent = cells.roots, None
        while nodes:
            if parent in cells.dealt:
                assert at[i] in reach(cells, nodes)
                break
            d = [float(A.distances("l2", v[None], cells.centroids[k][None])[0, 0]) for k in nodes]
            parent = nodes[int(np.argmin(d))]
            nodes = cells.children.get(parent)
        else:
            assert at[i] == parent
    again = C.split(vectors.repartition(2), rows[[0, 1500, 1600, 1700]].tolist(), 100)
    assert [c.tolist() for c in again.centroids] == [c.tolist() for c in cells.centroids] and again.children == cells.children


def reach(cells, nodes):
    out, todo = set(), list(nodes)
    while todo:
        k = todo.pop()
        todo += cells.children.get(k, [])
        out.add(k)
    return out


def test_recall_is_not_lower_for_as_many_vectors(spark, rows):
    vectors = table(spark, rows)
    queries = vectors.where("vec_id % 40 = 3").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    truth = S.exact_topk(queries, vectors, "l2", 10, 8).select("qid", "global_id").cache()
    start = rows[[0, 1500, 1600, 1700]].tolist()

    def found(cells, budget):
        at = C.placed(vectors, cells).select("global_id", "list").cache()
        sizes = {r.list: r.n for r in at.groupBy("list").agg(F.count("*").alias("n")).collect()}
        probed, scanned, taken = C.probes(queries, cells, len(cells.leaves())).orderBy("qid", "rank").collect(), {}, []
        for r in probed:
            if scanned.get(r.qid, 0) < budget.get(r.qid, 1):
                scanned[r.qid] = scanned.get(r.qid, 0) + sizes.get(r.list, 0)
                taken.append((r.qid, r.list))
        pairs = spark.createDataFrame(taken, "qid long, list long")
        return truth.join(at, "global_id").join(pairs, ["qid", "list"]).count() / truth.count(), scanned

    whole, used = found(C.Cells([np.array(c, np.float32) for c in start], [0, 1, 2, 3]), {})
    cut, spent = found(C.split(vectors, start, 100), used)
    assert cut >= whole - 0.01 and max(spent[q] - used[q] for q in used) <= 100


def test_odd_tables(spark, rows):
    odd = spark.createDataFrame([(1, None), (2, [1.0]), (3, [1.0, None]), (4, [1.0, 2.0, 9.0])], "vec_id long, embedding array<float>")
    cells = C.split(odd, [[0.0, 0.0], [1.0, 2.0]], 1)
    assert [tuple(r) for r in C.placed(odd, cells).collect()] == [(4, 1, [1.0, 2.0])]
    assert C.placed(odd.limit(0), cells).count() == 0 and C.split(odd.limit(0), [], 5).leaves() == [] and C.placed(odd, C.Cells([], [])).count() == 0
    same = spark.createDataFrame([(i, [2.0, 2.0]) for i in range(300)], "vec_id long, embedding array<float>")
    lists = C.placed(same, C.split(same, [[0.0, 0.0]], 20)).groupBy("list").count().collect()
    assert max(r["count"] for r in lists) <= 20 and sum(r["count"] for r in lists) == 300
