"""Vector expressions: everything stays in the JVM, in double precision, in index order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(values) -> Column:
    """A constant array of doubles."""
    return F.array(*[F.lit(float(v)) for v in values])


def distance_sq(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, t: s + t)


#: Lengths up to which the terms of a distance are written out, for code generation.
WRITTEN_OUT = 128


def distance_sq_of(a: Column, b: Column, dim: int) -> Column:
    """The same for vectors of a known length."""
    if not 0 < dim <= WRITTEN_OUT:
        return distance_sq(a, b)
    d = [F.get(a, F.lit(k)).cast("double") - F.get(b, F.lit(k)).cast("double") for k in range(dim)]
    return reduce(Column.__add__, [x * x for x in d])


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(distance_sq(a, b))


def mean(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(v)


def magnitude(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalize(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double") / magnitude(v))


def has_nan(v: Column) -> Column:
    return F.exists(v, lambda x: x.isNull() | F.isnan(x))


def bits(i: Column, width: int) -> Column:
    """Bits of an integer, most significant first."""
    return F.transform(F.sequence(F.lit(width - 1), F.lit(0), F.lit(-1)), lambda k: F.call_function("shiftright", i, k).bitwiseAND(F.lit(1)).cast("int"))


def sign_vectors(width: int) -> list[tuple[int, ...]]:
    """All vectors over {1, -1}, 1 first."""
    return [tuple(-1 if i >> (width - 1 - k) & 1 else 1 for k in range(width)) for i in range(1 << width)]
