"""Quantized vectors as columns: struct<scale, q array<tinyint>, sig array<long>>.

A vector is divided by its length, each component is stored as a whole number
of 1/127ths of the largest, and its sign as one bit of ``sig``.
"""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import DimMismatch, Invalid


def fit_to_store(v: Column) -> Column:
    """True for vectors that can be quantized: finite components, not all zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & fine & F.exists(v, lambda x: x != 0)


def bound(value: Column, body) -> Column:
    """``body`` of a column that is computed once, not wherever it is named."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def quantize(v: Column) -> Column:
    """The stored form of an array of numbers; null where that has none."""

    def stored(d):
        length = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x))
        return bound(length, lambda n: bound(F.transform(d, lambda x: x / n), lambda u: bound(F.array_max(F.transform(u, lambda x: F.abs(x))) / 127, lambda s: F.struct(
            s.alias("scale"),
            F.transform(u, lambda x: F.round(x / s).cast("tinyint")).alias("q"),
            signature(u).alias("sig"),
        ))))

    return F.when(fit_to_store(v), bound(F.transform(v, lambda x: x.cast("double")), stored))


def quantized_literal(v: list[float]) -> Column:
    """``quantize`` of one vector of the driver's, as a constant."""
    v = [float(x) for x in v]
    length = math.sqrt(sum(x * x for x in v))
    scale = max(abs(x) / length for x in v) / 127
    away = lambda x: int(math.copysign(math.floor(abs(x) + 0.5), x))
    words = [sum((x >= 0) << i for i, x in enumerate(v[at : at + 64])) for at in range(0, len(v), 64)]
    words = [w - (1 << 64) if w >> 63 else w for w in words]
    return F.struct(
        F.lit(scale).alias("scale"),
        F.array(*[F.lit(away(x / length / scale)).cast("tinyint") for x in v]).alias("q"),
        F.array(*[F.lit(w).cast("long") for w in words]).alias("sig"),
    )


def signature(v: Column) -> Column:
    """Sign bits, 64 to a word; zero counts as not negative."""
    words = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / 64).cast("int"))
    bits = lambda w: F.reverse(F.slice(v, w * 64 + 1, F.lit(64)))
    return F.transform(words, lambda w: F.aggregate(bits(w), F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1).bitwiseOR((x >= 0).cast("long"))))


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two quantized vectors: whole-number product times both scales."""
    dot = F.aggregate(F.zip_with(a["q"], b["q"], lambda x, y: x.cast("int") * y.cast("int")), F.lit(0), lambda s, x: s + x)
    return a["scale"] * b["scale"] * dot


def check_vector(v, dim: int) -> list[float]:
    """A Python vector fit for a store of ``dim``, or an error."""
    v = [float(x) for x in v]
    if not dim:
        raise Invalid("this store holds no vectors")
    if len(v) != dim:
        raise DimMismatch(len(v), dim)
    if not all(map(math.isfinite, v)) or not any(v):
        raise Invalid("a vector must be finite and not zero")
    return v
