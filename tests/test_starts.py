"""k-means|| starts against a loop over plain rows, and against starting from the first rows."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiverlake.functions import arrays as A
from quiverlake.operators import index as I
from quiverlake.operators import starts as K


def draw(round_, i):
    return int(hashlib.sha256(f"{round_}:{i}".encode()).hexdigest()[:8], 16)


def plain(rows, k, rounds, oversample):
    """rows: id to vector."""
    found = [min(rows, key=lambda i: (draw(0, i), i))]

    def costs():
        return {i: min(int(np.floor(np.float64(A.distances("l2", v[None], rows[c][None])[0, 0]) * I.FIXED_POINT)) for c in found) for i, v in rows.items()}

    for r in range(1, rounds + 1):
        cost = costs()
        whole = sum(cost.values())
        found += sorted(i for i, c in cost.items() if whole and draw(r, i) * float(whole) < float(c) * (oversample * k * 2**32))
    weight = dict.fromkeys(found, 0)
    for v in rows.values():
        weight[min(found, key=lambda c: (A.distances("l2", v[None], rows[c][None])[0, 0], found.index(c)))] += 1
    picks = []
    while len(picks) < k:
        gain = {c: weight[c] * min((float(A.distances("l2", rows[c][None], rows[p][None])[0, 0]) for p in picks), default=1.0) for c in found}
        best = max(found, key=lambda c: (gain[c], -c))
        if gain[best] <= 0:
            break
        picks.append(best)
    return [(c, weight[c]) for c in picks]


def table(spark, rows):
    return spark.createDataFrame([(i, v.tolist()) for i, v in rows.items()], "vec_id long, embedding array<float>").repartition(3)


@pytest.mark.parametrize("k,rounds,oversample", [(3, 2, 2.0), (6, 3, 1.0), (1, 1, 2.0)])
def test_starts_follow_the_definition(spark, k, rounds, oversample):
    rng = np.random.default_rng(k)
    rows = {int(i): v for i, v in zip(rng.permutation(1000)[:150], rng.standard_normal((150, 8)).astype(np.float32), strict=True)}
    rows |= {2000 + i: next(iter(rows.values())) for i in range(5)}
    got = K.parallel_starts(table(spark, rows), k, 8, rounds, oversample)
    assert [(i, n) for i, n, _ in got] == plain(rows, k, rounds, oversample)
    assert all(np.array_equal(np.float32(v), rows[i]) for i, _, v in got)


def test_lower_error_than_first_rows(spark):
    rng = np.random.default_rng(3)
    middle = rng.standard_normal((10, 8)) * 20
    rows = {i: (middle[min(i // 60, 9)] + rng.standard_normal(8)).astype(np.float32) for i in range(600)}  # the first rows are of one cluster
    vectors = table(spark, rows)
    error = {}
    for name, start in (("first", None), ("rounds", K.starting_quantizer(vectors, 10, 4, 16, 8, rounds=3))):
        q = I.train(vectors, 10, 4, 16, 3, start=start)
        error[name] = K.potential(vectors, q.centroids)
    assert error["rounds"] < 0.2 * error["first"]


def test_few_and_odd_vectors(spark):
    odd = spark.createDataFrame([(1, None), (2, [1.0]), (3, [1.0, None]), (4, [1.0, 2.0]), (5, [1.0, 2.0, 9.0]), (None, [3.0, 3.0])], "vec_id long, embedding array<float>")
    (one,) = K.parallel_starts(odd, 3, 2)
    assert one[0] in (4, 5) and one[1:] == (2, [1.0, 2.0])
    assert K.parallel_starts(odd.limit(0), 3, 2) == [] and K.parallel_starts(odd, 0, 2) == []
    twice = odd.where("vec_id >= 4").select("vec_id", F.transform("embedding", lambda x: x * F.col("vec_id")).alias("embedding"))
    assert sorted(i for i, *_ in K.parallel_starts(twice.unionAll(twice), 3, 2, rounds=8)) in ([4], [5], [4, 5])
