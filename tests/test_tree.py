"""The tree of centroids against comparing all of them."""

import numpy as np
import pytest

from quiverlake.functions import arrays as A
from quiverlake.operators import index as I
from quiverlake.operators import search as S
from quiverlake.operators import tree as T


def grouped(n, dim, groups, seed=0):
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((groups, dim))[rng.integers(0, groups, n)] * 8 + rng.standard_normal((n, dim))).astype(np.float32)


def plain(centroids, query, n):
    found = A.distances("l2", query[None], centroids)[0]
    order = np.lexsort((np.arange(len(found)), found))[:n]
    return order.tolist(), found[order].tolist()


@pytest.mark.parametrize("n,dim,groups,width", [(1, 3, 1, 32), (31, 4, 3, 32), (700, 8, 20, 8), (700, 8, 700, 5), (300, 2, 1, 2)])
def test_same_as_all_centroids(n, dim, groups, width):
    centroids = grouped(n, dim, groups)
    centroids[n // 2 :: 7] = centroids[0]  # ties
    tree = T.build(centroids, width)
    assert sorted(np.concatenate(tree.members).tolist()) == list(range(n)) and max(map(len, tree.members)) <= width
    for query in [*grouped(40, dim, groups, 1), centroids[0], centroids[-1]]:
        for k in (1, 5, n + 3):
            found, distance, made = T.descend(tree, query, k)
            assert (found.tolist(), distance.tolist()) == plain(centroids, query, k) and made >= min(k, n)


def test_65536_centroids_take_few_distances():
    centroids = grouped(65_536, 16, 2000)
    tree = T.build(centroids)
    made = []
    for query in grouped(60, 16, 2000):  # of the same groups
        found, distance, count = T.descend(tree, query, 8)
        assert (found.tolist(), distance.tolist()) == plain(centroids, query, 8)
        made.append(count)
    assert np.mean(made) < 65_536 / 20
    beamed = [T.descend(tree, query, 8, beam=4) for query in grouped(60, 16, 2000)]
    assert max(count for *_, count in beamed) <= 32 * (1 + 4 * (max_depth(tree) + 1))
    assert np.mean([found[0] == plain(centroids, q, 1)[0][0] for (found, *_), q in zip(beamed, grouped(60, 16, 2000), strict=True)]) > 0.8


def max_depth(tree, v=0):
    return 1 + max((max_depth(tree, c) for c in tree.children[v]), default=0)


def test_probes_equal_the_flat_ones(spark):
    centroids = grouped(200, 8, 10).tolist()
    q = I.Quantizer(centroids, [[[0.0] * 8]])
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(grouped(50, 8, 10, 2))] + [(99, None), (100, [0.5] * 11)], "qid long, qvec array<float>").repartition(3)
    flat = S.probes(queries, q, "l2", 3).collect()
    tree = T.probes(queries, T.build(centroids, 8), 3).drop("made").collect()
    assert sorted(map(tuple, tree)) == sorted(map(tuple, flat))
    assert T.probes(queries.limit(0), T.build(centroids, 8), 3).count() == 0 == T.probes(queries, T.build([]), 3).count()
