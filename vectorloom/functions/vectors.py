"""Vector functions as column expressions; everything is computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def doubles(v: Column | str) -> Column:
    return col(v).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column | str) -> Column:
    return F.sqrt(_sum(F.transform(doubles(v), lambda x: x * x)))


def mean(v: Column | str) -> Column:
    return _sum(doubles(v)) / F.size(col(v))


def std(v: Column | str) -> Column:
    """Population standard deviation."""
    return F.sqrt(F.greatest(F.lit(0.0), _sum(F.transform(doubles(v), lambda x: x * x)) / F.size(col(v)) - mean(v) * mean(v)))


def sparsity(v: Column | str, eps: float = 1e-6) -> Column:
    """The share of values that are nearly zero."""
    return F.size(F.filter(doubles(v), lambda x: F.abs(x) < eps)) / F.size(col(v))


def problem(v: Column | str, dimension: int) -> Column:
    """Why a vector breaks the embedding contract; null if it doesn't."""
    v = col(v)
    return (
        F.when(v.isNull() | (F.size(v) != dimension), "dimension")
        .when(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "not finite")
        .when(norm(v) == 0, "zero norm")
    )


def normalised(v: Column | str) -> Column:
    # the norm is an argument and not a part of the lambda, which would work it out again for each place
    return F.zip_with(doubles(v), F.array_repeat(norm(v), F.size(col(v))), lambda x, n: x / n)


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """Of unit vectors, 0 to 2."""
    return 1 - dot(a, b)


def cosine_similarity(a: Column | str, b: Column | str) -> Column:
    """Of any vectors; 0 if one is nearly zero."""
    na, nb = norm(a), norm(b)
    return F.when((na < 1e-8) | (nb < 1e-8), 0.0).otherwise(dot(a, b) / (na * nb))


def batch_cosine(a: Column | str, b: Column | str) -> Column:
    """The batch form, with 1e-8 added to each norm."""
    return dot(a, b) / ((norm(a) + 1e-8) * (norm(b) + 1e-8))


def euclidean(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(_sum(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))))


def levels(bits: int) -> int:
    if bits not in (4, 8):
        raise ValueError("bits must be 4 or 8")
    return (1 << bits) - 1


def quantize(v: Column | str, low: Column | str, high: Column | str, bits: int = 8) -> Column:
    """Whole levels, cut off rather than rounded."""
    most = levels(bits)
    scaled = F.zip_with(F.zip_with(doubles(v), doubles(low), lambda x, lo: x - lo), F.zip_with(doubles(high), doubles(low), lambda hi, lo: hi - lo), lambda x, r: x / r * most)
    return F.transform(scaled, lambda x: F.floor(F.least(F.greatest(x, F.lit(0.0)), F.lit(float(most)))).cast("short"))


def dequantize(q: Column | str, low: Column | str, high: Column | str, bits: int = 8) -> Column:
    most = levels(bits)
    ranges = F.zip_with(doubles(high), doubles(low), lambda hi, lo: hi - lo)
    return F.zip_with(F.zip_with(col(q), ranges, lambda x, r: x / most * r), doubles(low), lambda x, lo: x + lo)
