"""Starts for k-means by rounds of oversampling (k-means||).

A round measures the squared distance of every vector to the nearest of the candidates so
far and takes each vector with a chance in proportion to it, `oversample * k` in expectation; the draw is a
hash of round and id, so any engine draws the same. After the rounds each candidate weighs
as many vectors as it is nearest to, and k of the candidates are chosen: the heaviest, then
again and again that of the largest weight times squared distance to those chosen.

A round reads the vectors once, by a kernel with the candidates broadcast (some
oversample * k * rounds vectors), and stores an id and a whole number for each vector;
sums of whole numbers are the same in any order. No vector is shuffled.

Defined results: null, short and incomplete vectors are left out; ties go to lower ids; equal
vectors are chosen once, so fewer different vectors than k give fewer starts; rows that share
an id are drawn together; an empty table has no starts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiverlake.functions import arrays as A
from quiverlake.functions import vector as V
from quiverlake.operators.index import FIXED_POINT, Quantizer, split
from quiverlake.sources.tables import shared_folder

ROUNDS, OVERSAMPLE = 3, 2.0
SPREAD = 1 << 32


def draw(round_: int, ids: Column) -> Column:
    """The first 32 bits of SHA-256 of "round:id", as a double."""
    digest = F.sha2(F.concat(F.lit(f"{round_}:"), ids.cast("string")).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")


def _near(vectors: DataFrame, candidates: np.ndarray) -> DataFrame:
    """(id, cost, k): the fixed-point squared distance to the nearest candidate, and its number."""
    shared = vectors.sparkSession.sparkContext.broadcast(candidates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            rows = np.asfortranarray(A.matrix(batch.column(1), words.shape[1]))
            step, cost, near = max(1, A.CELLS // len(words)), [], []
            for lo in range(0, len(rows), step):
                found = A.distances(V.L2, rows[lo : lo + step], words)
                near.append(found.argmin(axis=1))
                cost.append(np.floor(found.min(axis=1).astype(np.float64) * FIXED_POINT).astype(np.int64))
            if cost:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(cost)), pa.array(np.concatenate(near))], names=["id", "cost", "k"])

    return vectors.mapInArrow(run, "id bigint, cost bigint, k bigint")


def parallel_starts(vectors: DataFrame, k: int, dim: int, rounds: int = ROUNDS, oversample: float = OVERSAMPLE, id_col: str = "vec_id", vec_col: str = "embedding") -> list[tuple[int, int, list[float]]]:
    """(id, weight, vector) of the k starts in the order they are chosen."""
    spark = vectors.sparkSession
    good = vectors.where((F.size(vec_col) >= dim) & ~F.exists(vec_col, lambda x: x.isNull())).select(F.col(id_col).cast("long").alias("id"), F.slice(vec_col, 1, dim).alias("vector")).where("id IS NOT NULL")
    known = [(r.id, list(r.vector)) for r in good.orderBy(draw(0, F.col("id")), "id").limit(1).collect()]
    if not known or k < 1:
        return []

    def measured() -> DataFrame:
        path = shared_folder(spark, "costs")
        _near(good, np.array([v for _, v in known], np.float32)).write.parquet(path)
        return spark.read.schema("id bigint, cost bigint, k bigint").parquet(path)

    for round_ in range(1, rounds + 1):
        costs = measured()
        whole = costs.agg(F.sum("cost")).first()[0]
        if not whole:
            break
        taken = costs.where(draw(round_, F.col("id")) * F.lit(float(whole)) < F.col("cost").cast("double") * F.lit(oversample * k * SPREAD)).select("id").distinct()
        known += [(r.id, list(r.vector)) for r in good.join(F.broadcast(taken), "id").groupBy("id").agg(F.min("vector").alias("vector")).orderBy("id").collect()]  # oversample * k in expectation
    weight = np.zeros(len(known))
    for r in measured().groupBy("k").agg(F.count("*").alias("n")).collect():
        weight[r.k] = r.n
    return [(known[i][0], int(weight[i]), known[i][1]) for i in chosen([i for i, _ in known], weight, np.array([v for _, v in known], np.float32), k)]


def chosen(ids: list[int], weight: np.ndarray, rows: np.ndarray, k: int) -> list[int]:
    """Places of k of the rows: the heaviest, then by weight times squared distance to those chosen."""
    gain, far, out = weight.astype(np.float64), np.full(len(rows), np.inf), []
    while len(out) < k and gain.max() > 0:
        at = min(np.flatnonzero(gain == gain.max()).tolist(), key=lambda i: ids[i])
        out.append(at)
        far = np.minimum(far, A.distances(V.L2, rows, rows[at : at + 1])[:, 0].astype(np.float64))
        gain = weight * far
    return out


def starting_quantizer(vectors: DataFrame, nlist: int, n_sub: int, ksub: int, dim: int, **options) -> Quantizer:
    """The first nlist starts as centroids, slices of the first ksub as codewords: what index.train can begin from."""
    found = [v for *_, v in parallel_starts(vectors, max(nlist, ksub), dim, **options)]
    return Quantizer(found[:nlist], split(found[:ksub], n_sub))


def potential(vectors: DataFrame, words: list[list[float]], id_col: str = "vec_id", vec_col: str = "embedding") -> int:
    """The sum of fixed-point squared distances to the nearest word: what k-means lowers."""
    rows = np.array(words, np.float32)
    good = vectors.where(F.size(vec_col) >= rows.shape[1]).select(F.col(id_col).cast("long"), vec_col)
    return _near(good, rows).agg(F.sum("cost")).first()[0] or 0
