"""Conditions in pivot space as equi joins on intervals of the axes, so that no pair is met that no interval holds.

Both sides have an array column of coordinates. Intervals that hold much of the data are left to the adaptive
skew join, which splits both sides.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pruning import EPS, axes

#: Axes whose intervals make the key of a conjunction; each doubles the rows of the left side at most.
KEY_AXES = 3
#: Intervals of an axis from 0 to the threshold of a sum.
STEPS = 16


def _interval(x: Column, width: float) -> Column:
    return F.floor(x / F.lit(width)).cast("long")


def within_all(left: DataFrame, a: str, right: DataFrame, b: str, dims: int, tau: float) -> DataFrame:
    """Pairs with every coordinate within tau."""
    reach = tau + EPS
    width, keys = 2 * reach, range(min(dims, KEY_AXES))
    for k in keys:
        at = F.get(a, F.lit(k))
        left = left.withColumn(f"__l{k}", F.explode(F.sequence(_interval(at - reach, width), _interval(at + reach, width))))
        right = right.withColumn(f"__r{k}", _interval(F.get(b, F.lit(k)), width))
    near = [F.abs(x - y) <= reach for x, y in zip(axes(a, dims), axes(b, dims), strict=True)]
    j = left.join(right, [F.col(f"__l{k}") == F.col(f"__r{k}") for k in keys]).where(reduce(Column.__and__, near))
    return j.drop(*[f"__{s}{k}" for s in "lr" for k in keys])


def _some(left: DataFrame, right: DataFrame, test: list[Column], reached: list[Column], own: list[Column]) -> DataFrame:
    """Pairs that pass the test on some axis: joined on (axis, interval), kept at the first axis that passes."""

    def entry(k: int):
        return lambda at: F.struct(F.lit(k).alias("axis"), at.alias("at"))

    left = left.withColumn("__l", F.explode(F.flatten(F.array(*[F.transform(r, entry(k)) for k, r in enumerate(reached)]))))
    right = right.withColumn("__r", F.explode(F.array(*[entry(k)(i) for k, i in enumerate(own)])))
    j = left.join(right, (F.col("__l.axis") == F.col("__r.axis")) & (F.col("__l.at") == F.col("__r.at")))
    first = []
    for k, t in enumerate(test):
        first.append(reduce(Column.__and__, [(F.col("__l.axis") == k) & t, *[~u for u in test[:k]]]))
    return j.where(reduce(or_, first)).drop("__l", "__r")


def within_some(left: DataFrame, a: str, right: DataFrame, b: str, dims: int, tau: float) -> DataFrame:
    """Pairs with some coordinate within tau."""
    reach, x, y = tau + EPS, axes(a, dims), axes(b, dims)
    reached = [F.sequence(_interval(p - reach, 2 * reach), _interval(p + reach, 2 * reach)) for p in x]
    return _some(left, right, [F.abs(p - q) <= reach for p, q in zip(x, y, strict=True)], reached, [_interval(q, 2 * reach) for q in y])


def sum_some(left: DataFrame, a: str, right: DataFrame, b: str, dims: int, tau: float) -> DataFrame:
    """Pairs with some coordinate pair, both not negative, whose sum is at most tau."""
    width, x, y = max(tau / STEPS, EPS), axes(a, dims), axes(b, dims)
    # One interval more, so that rounding at a border loses nothing.
    reached = [F.when(p <= tau, F.sequence(F.lit(0).cast("long"), _interval(tau - p, width) + 1)).otherwise(F.array().cast("array<long>")) for p in x]
    return _some(left, right, [p + q <= tau for p, q in zip(x, y, strict=True)], reached, [_interval(q, width) for q in y])
