"""Choosing clusters through a tree of centroids.

Centroids are themselves clustered: a node has a center and a radius, the distance of its
farthest centroid, and at most WIDTH children. A query descends best-first: the node with
the smallest lower bound, max(0, distance to its center - radius), is opened next, and the search
ends when no bound is below the distance of the best n-th centroid so far. So the result is
that of comparing all centroids, ties included, with fewer distances the better the
centroids are clustered. With a beam, only so many nodes of a level, those of the nearest centers, are
opened, which bounds the work but not the error.

The tree is a parameter of the index like the centroids: nlist * D floats and about nlist /
WIDTH centers, made once on the driver and sent by broadcast. Queries stay in their tasks.

Distances are squared L2 in float32, bounds are in float64 and widened by the rounding of a float32 sum.
Defined results: as search.probes: null queries have no rows, longer ones are cut.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quiverlake.functions import arrays as A
from quiverlake.functions import vector as V

WIDTH = 32
ROUNDS = 8  # of Lloyd steps for a node's children


@dataclass(frozen=True)
class Tree:
    """Nodes with centers and radii; children (nodes) or members (centroids) of each. Node 0 is the root."""

    centroids: np.ndarray
    centers: np.ndarray
    radii: np.ndarray
    children: list[list[int]]
    members: list[np.ndarray]


def build(centroids: list[list[float]] | np.ndarray, width: int = WIDTH) -> Tree:
    """Split the centroids into up to `width` groups, and each group again until it has no more than that many."""
    rows = np.array(centroids, np.float32) if len(centroids) else np.zeros((0, 0), np.float32)
    wide = rows.astype(np.float64)
    centers, radii, children, members = [], [], [], []

    def node(chosen: np.ndarray) -> int:
        centers.append(wide[chosen].mean(axis=0) if len(chosen) else np.zeros(rows.shape[1]))
        radii.append(float(np.sqrt(np.square(wide[chosen] - centers[-1]).sum(axis=1)).max(initial=0)))
        children.append([])
        members.append(chosen)
        return len(centers) - 1

    todo = [node(np.arange(len(rows)))]
    while todo:
        v = todo.pop()
        chosen = members[v]
        if len(chosen) <= width:
            continue
        words = rows[chosen[np.linspace(0, len(chosen) - 1, width).astype(int)]]
        for _ in range(ROUNDS):
            at = A.nearest(np.asfortranarray(rows[chosen]), words)
            count = np.bincount(at, minlength=width)
            words = np.array([rows[chosen[at == k]].mean(axis=0) if count[k] else words[k] for k in range(width)], np.float32)
        at = A.nearest(np.asfortranarray(rows[chosen]), words)
        if at.min() == at.max():  # equal centroids
            at = np.arange(len(chosen)) % width
        members[v] = chosen[:0]
        for k in np.unique(at).tolist():
            children[v].append(node(chosen[at == k]))
        todo += children[v]
    return Tree(rows, np.array(centers), np.array(radii), children, members)


def descend(tree: Tree, query: np.ndarray, n: int, beam: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """The n nearest centroids of a query by (distance, number), their float32 distances, and how many distances were made."""
    dim = tree.centroids.shape[1]
    wide, slack = query.astype(np.float64), (2 * dim + 8) * 2.0**-24
    best: list[tuple[float, int]] = []
    made, todo = 0, [(0.0, 0.0, 0)]  # bound, distance to the center, node

    def opened(v: int) -> list[tuple[float, float, int]]:
        """Compare a node's members, and give its children."""
        nonlocal best, made
        if len(tree.members[v]):
            found = A.distances(V.L2, query[None], tree.centroids[tree.members[v]])[0]
            made += len(found)
            best = sorted([*best, *zip(found.tolist(), tree.members[v].tolist(), strict=True)])[:n]
        kids = np.array(tree.children[v], np.int64)
        far = np.sqrt(np.square(tree.centers[kids] - wide).sum(axis=1))
        made += len(kids)
        bound = far - tree.radii[kids]
        return list(zip(np.maximum(bound - 1e-9 * (1 + np.abs(bound)), 0).tolist(), far.tolist(), kids.tolist(), strict=True))

    def beyond(bound: float) -> bool:
        return len(best) >= n and bound * bound * (1 - slack) > best[-1][0]

    while todo and beam is not None:  # level by level, the nearest centers first
        level = sorted((x for x in todo if not beyond(x[0])), key=lambda x: x[1:])[:beam]
        todo = [x for _, _, v in level for x in opened(v)]
    while todo:
        bound, _, v = heapq.heappop(todo)
        if beyond(bound):
            break  # none of the others can hold a nearer one
        for x in opened(v):
            heapq.heappush(todo, x)
    return np.array([c for _, c in best], np.int32), np.array([d for d, _ in best], np.float32), made


def probes(queries: DataFrame, tree: Tree, nprobe: int, beam: int | None = None) -> DataFrame:
    """(qid, qvec, rank, cluster_id, distance, made): the nearest centroids by squared L2, and how many distances a query took."""
    shared = queries.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for batch in batches:
            if not batch.num_rows or not len(tree.centroids):
                continue
            found = [descend(tree, row, nprobe, beam) for row in A.matrix(batch.column(1), tree.centroids.shape[1])]
            sizes = [len(c) for c, *_ in found]
            at = pa.array(np.repeat(np.arange(len(found)), sizes))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate([np.arange(1, n + 1) for n in sizes])), pa.array(np.concatenate([c for c, *_ in found])),
                pa.array(np.concatenate([d for _, d, _ in found])), pa.array(np.repeat([m for *_, m in found], sizes))], names=["qid", "qvec", "rank", "cluster_id", "distance", "made"])

    return queries.select("qid", "qvec").where("qvec IS NOT NULL").mapInArrow(run, "qid bigint, qvec array<float>, rank bigint, cluster_id int, distance float, made bigint")
