"""Scalar float32 versions of the vector operators, for comparison."""

import numpy as np

f32 = np.float32


def distance(metric, a, b):
    total = f32(0)
    for x, y in zip(a, b, strict=True):
        x, y = f32(x), f32(y)
        total = f32(total + (f32(x * y) if metric == "ip" else f32(f32(x - y) * f32(x - y))))
    return -total if metric == "ip" else total


def tables(metric, query, codebook):
    dsub = len(codebook[0][0])
    return [[distance(metric, query[m * dsub : (m + 1) * dsub], c) for c in words] for m, words in enumerate(codebook)]


def adc(table, codes):
    total = f32(0)
    for row, c in zip(table, codes, strict=True):
        total = f32(total + row[c])
    return total


def nearest(metric, v, centroids):
    d = [distance(metric, v, c) for c in centroids]
    return d.index(min(d))


def encode(v, codebook):
    dsub = len(codebook[0][0])
    return [nearest("l2", v[m * dsub : (m + 1) * dsub], words) for m, words in enumerate(codebook)]


def topk(metric, query, codes, codebook, k):
    table = tables(metric, query, codebook)
    return sorted((float(adc(table, c)), i) for i, c in enumerate(codes))[:k]
