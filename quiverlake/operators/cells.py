"""Lists of bounded length: clusters with too many vectors are split into cells with own centroids.

A vector goes to its nearest centroid, and as long as that one has cells to the nearest of
these; where it ends is its list. Lists longer than the bound are split again, round by
round, until none is. The centroids of a split are found from a bounded sample of the list
(the vectors whose ids have the lowest hashes); vectors that can't be told apart by distance are
dealt by a hash of the id. So a cluster with a third of all vectors becomes many lists, each
of them short enough for one task, and a search probes as many of them as it wants.

Each round reads the vectors once to count the lists and once for the samples of those that are
too long; nothing but counts and samples leaves the tasks. The centroids are parameters of the
index and go to tasks by broadcast.

Defined results: null, short and incomplete vectors are left out; ties go to the lower list; rows that share an
id are dealt together, so a list is as long at least as equal ids make it; an empty table has
empty lists.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiverlake.functions import arrays as A
from quiverlake.operators import tree as T
from quiverlake.operators.index import Quantizer, valid

SAMPLE, WIDTH, ROUNDS, MOST_LEVELS = 2048, 64, 8, 64


@dataclass
class Cells:
    """Nodes of a forest of centroids. Node k has the children children[k]; dealt nodes have equal centroids and choose by the id's hash."""

    centroids: list[np.ndarray]
    roots: list[int]
    children: dict[int, list[int]] = field(default_factory=dict)
    dealt: set[int] = field(default_factory=set)

    def leaves(self) -> list[int]:
        return [k for k in range(len(self.centroids)) if k not in self.children]

    def place(self, rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The list of each row."""
        at = np.full(len(rows), -1, np.int64)
        todo = [(self.roots, -1, np.arange(len(rows)))]
        while todo:
            nodes, parent, who = todo.pop()
            if not len(who) or not nodes:
                continue
            if parent in self.dealt:
                near = (hashes[who] >> np.uint64(parent % 7)) % np.uint64(len(nodes))
            else:
                near = A.nearest(np.asfortranarray(rows[who]), np.array([self.centroids[k] for k in nodes], np.float32))
            for j, k in enumerate(nodes):
                mine = who[near == j]
                if k in self.children:
                    todo.append((self.children[k], k, mine))
                else:
                    at[mine] = k
        return at


def placed(vectors: DataFrame, cells: Cells, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(global_id, list, vector) of the valid vectors."""
    dim = len(cells.centroids[0]) if cells.centroids else 0
    shared = vectors.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = A.matrix(batch.column(1), dim)
            at = shared.value.place(rows, batch.column(2).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at), A.lists(rows)], names=["global_id", "list", "vector"])

    good = vectors.where(valid(vectors[vec_col], Quantizer([c.tolist() for c in cells.centroids[:1]], [[[0.0]]])))
    rows = good.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col), F.xxhash64(F.col(id_col).cast("long")).alias("hash"))
    return rows.mapInArrow(run, "global_id bigint, list bigint, vector array<float>") if cells.centroids else rows.limit(0).selectExpr("id AS global_id", "hash AS list", f"`{vec_col}` AS vector")


def means(rows: np.ndarray, parts: int) -> np.ndarray:
    """Centroids of a sample by Lloyd steps from evenly spaced rows of it; only those that differ."""
    words = rows[np.linspace(0, len(rows) - 1, parts).astype(int)]
    for _ in range(ROUNDS):
        at = A.nearest(np.asfortranarray(rows), words)
        count = np.bincount(at, minlength=len(words))
        words = np.array([rows[at == k].mean(axis=0) if count[k] else words[k] for k in range(len(words))], np.float32)
    return np.unique(words, axis=0)


def split(vectors: DataFrame, centroids: list[list[float]], most: int, sample: int = SAMPLE, id_col: str = "vec_id", vec_col: str = "embedding") -> Cells:
    """Cells of which no list has more than `most` vectors."""
    cells = Cells([np.array(c, np.float32) for c in centroids], list(range(len(centroids))))
    sizes: dict[int, int] = {}
    parent: dict[int, int] = {}
    for _ in range(MOST_LEVELS):
        at = placed(vectors, cells, id_col, vec_col)
        found = {r.list: r.n for r in at.groupBy("list").agg(F.count("*").alias("n")).collect()}  # a row for each list
        long = {k: n for k, n in found.items() if n > most}
        if not long:
            return cells
        lowest = Window.partitionBy("list").orderBy(F.xxhash64("global_id"), "global_id")
        chosen = at.where(F.col("list").isin(list(long))).withColumn("_k", F.row_number().over(lowest)).where(F.col("_k") <= sample)
        rows: dict[int, list] = {}
        for r in chosen.orderBy("list", "_k").select("list", "vector").collect():  # `sample` rows for each long list
            rows.setdefault(r.list, []).append(r.vector)
        for k, n in sorted(long.items()):
            stuck = k in parent and sizes.get(parent[k]) == n and parent[k] not in cells.dealt  # its siblings got nothing
            words = means(np.array(rows[k], np.float32), min(WIDTH, -(-2 * n // most), len(rows[k])))
            if stuck or len(words) < 2:
                words = np.repeat(cells.centroids[k][None], min(WIDTH, -(-3 * n // (2 * most))), axis=0)
                cells.dealt.add(k)
            sizes[k] = n
            cells.children[k] = list(range(len(cells.centroids), len(cells.centroids) + len(words)))
            cells.centroids += list(words)
            parent |= dict.fromkeys(cells.children[k], k)
    return cells


def probes(queries: DataFrame, cells: Cells, nprobe: int) -> DataFrame:
    """(qid, rank, list, distance): the nearest lists of each query, by a tree over their centroids."""
    leaves = cells.leaves()
    found = T.probes(queries, T.build(np.array([cells.centroids[k] for k in leaves], np.float32)), nprobe)
    named = queries.sparkSession.createDataFrame(list(enumerate(leaves)), "cluster_id int, list bigint")  # a row for each list
    return found.join(F.broadcast(named), "cluster_id").select("qid", "rank", "list", "distance")
