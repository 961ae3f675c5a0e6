"""The expressions of vector.py as NumPy kernels, with the same bits: float32 sums from left to right, starting at 0."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from quiverlake.functions.vector import IP

CELLS = 1 << 22  # of a table of distances made at once


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of float32 lists of at least dim elements, cut to dim."""
    bounds = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    if not len(column):
        return np.empty((0, dim), np.float32)
    return flat[bounds[:-1, None] + np.arange(dim)]


def lists(rows: np.ndarray) -> pa.Array:
    """A matrix as a column of lists."""
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(rows).ravel()))


def distances(metric: str, rows: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The distance of each row to each word."""
    total = np.zeros((len(rows), len(words)), np.float32)
    for j in range(words.shape[1]):
        if metric == IP:
            total += rows[:, j, None] * words[None, :, j]
        else:
            gap = rows[:, j, None] - words[None, :, j]
            total += gap * gap
    return -total if metric == IP else total


def pairwise(rows: np.ndarray, i: np.ndarray, words: np.ndarray, j: np.ndarray, metric: str = "l2", dsub: int = 0) -> np.ndarray:
    """The distance of row i[n] to word j[n] for each n; with dsub the sum, from 0, of those of sub-vectors."""
    parts, width = [], words.shape[1]
    for first in range(0, width, dsub or max(width, 1)):
        total = np.zeros(len(i), np.float32)
        for d in range(first, min(first + (dsub or width), width)):
            if metric == IP:
                total += rows[i, d] * words[j, d]
            else:
                gap = rows[i, d] - words[j, d]
                total += gap * gap
        parts.append(-total if metric == IP else total)
    if len(parts) == 1 and not dsub:
        return parts[0]
    out = np.zeros(len(i), np.float32)
    for part in parts:
        out += part
    return out


def nearest(rows: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Index of the nearest word of each row by L2, the lowest one of ties."""
    step = max(1, CELLS // max(len(words), 1))
    parts = [distances("l2", rows[lo : lo + step], words).argmin(axis=1) for lo in range(0, len(rows), step)]
    return np.concatenate(parts).astype(np.int32) if parts else np.empty(0, np.int32)


def tables(metric: str, rows: np.ndarray, codebook: np.ndarray) -> np.ndarray:
    """For each row and sub-quantizer the distances of its sub-vector to all codewords."""
    dsub = codebook.shape[2]
    return np.stack([distances(metric, rows[:, m * dsub : (m + 1) * dsub], words) for m, words in enumerate(codebook)], axis=1)
