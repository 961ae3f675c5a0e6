"""Column expressions for float32 vectors.

Sums run from left to right in float32, starting at 0, so results are the same bits in
every plan. `l2` is squared; inner products are negated, so smaller is better for both.

Higher-order functions fall out of whole-stage code generation, so they are for small
sides (queries, centroids, lookup tables). What runs for every coded vector is `adc`, an
unrolled sum of array lookups that stays in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

L2, IP = "l2", "ip"
VECTOR = "array<float>"


def metric_of(code: int | str | None) -> str:
    """Numbers as the reference reads them: 1 is the inner product, any other L2. Names have to be known."""
    if isinstance(code, str):
        if code not in (L2, IP):
            raise ValueError(f"unknown metric {code!r}")
        return code
    return IP if code == 1 else L2


def metric_column(code: Column) -> Column:
    return F.when(code == 1, IP).otherwise(L2)


def zero() -> Column:
    return F.lit(0.0).cast("float")


def l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), zero(), lambda s, x: s + x)


def negated_ip(a: Column, b: Column) -> Column:
    return -F.aggregate(F.zip_with(a, b, lambda x, y: x * y), zero(), lambda s, x: s + x)


def distance(metric: str, a: Column, b: Column) -> Column:
    return negated_ip(a, b) if metric == IP else l2(a, b)


def subvector(v: Column, m: int, dsub: int) -> Column:
    return F.slice(v, m * dsub + 1, dsub)


def literal(values: list) -> Column:
    """Nested lists of floats as an array literal of float32."""
    if not values or isinstance(values[0], (int, float)):
        return F.array(*[F.lit(float(x)) for x in values]).cast(VECTOR)
    return F.array(*[literal(v) for v in values])


def lut(metric: str, query: Column, codebook: list[list[list[float]]]) -> Column:
    """For each sub-quantizer the distances of the query's sub-vector to all its codewords."""
    dsub = len(codebook[0][0])

    def table(m: int) -> Column:
        part = subvector(query, m, dsub)
        return F.transform(literal(codebook[m]), lambda c: distance(metric, part, c))

    return F.array(*[table(m) for m in range(len(codebook))])


def adc(table: Column, codes: Column, n_sub: int) -> Column:
    """Sum of the looked-up distances, over sub-quantizers in order."""
    total = zero()
    for m in range(n_sub):
        total = total + table[m][codes[m]]
    return total


def nearest(distances: Column) -> Column:
    """Index of the smallest entry; the lowest index wins ties."""
    return (F.array_position(distances, F.array_min(distances)) - 1).cast("int")


def pack_nibbles(codes: Column) -> Column:
    """Two 4-bit codes to a byte, the first in the low half; the last byte of an odd number of codes has an empty high half."""
    first = F.filter(codes, lambda c, i: i % 2 == 0)
    return F.transform(first, lambda c, i: c + 16 * F.coalesce(F.get(codes, 2 * i + 1), F.lit(0)))


def unpack_nibbles(packed: Column, number: Column | None = None) -> Column:
    """The codes of packed bytes: `number` of them, or two for each byte."""
    codes = F.flatten(F.transform(packed, lambda b: F.array(b.bitwiseAND(F.lit(15)), F.shiftright(b, 4))))
    return codes if number is None else F.slice(codes, F.lit(1), number)
