"""Pruning and accepting conditions in pivot space.

q, x: pivot coordinates of a query vector and a lake vector; lo, hi: least and greatest coordinates of the
vectors in a cell. All conditions are sound: what is pruned cannot match, what is accepted must. `EPS`
widens pruning bounds only, never the final test of the distance. Coordinates are an array column, or a list
of plain columns, which code generation handles better.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6


Coordinates = Column | list[Column]


def axes(column: str, dims: int) -> list[Column]:
    """An array column's elements as plain columns."""
    return [F.get(column, F.lit(k)) for k in range(dims)]


def _all(a: Coordinates, b: Coordinates, test) -> Column:
    if isinstance(a, list):
        return reduce(and_, map(test, a, b))
    return F.forall(F.zip_with(a, b, test), lambda x: x)


def _any(a: Coordinates, b: Coordinates, test) -> Column:
    if isinstance(a, list):
        return reduce(or_, map(test, a, b))
    return F.exists(F.zip_with(a, b, test), lambda x: x)


def in_square(x: Coordinates, q: Coordinates, tau: float, eps: float = EPS) -> Column:
    """Every coordinate within tau."""
    return _all(q, x, lambda a, b: F.abs(a - b) <= tau + eps)


def in_rectangle(x: Column, pivot: int, radius: Column) -> Column:
    return F.get(x, F.lit(pivot)) <= radius


def point_filter(q: Coordinates, x: Coordinates, tau: float, eps: float = EPS) -> Column:
    """Keep: all pivots within the band."""
    return in_square(x, q, tau, eps)


def point_filter_weak(q: Coordinates, x: Coordinates, tau: float, eps: float = EPS) -> Column:
    """Keep: some pivot within the band."""
    return _any(q, x, lambda a, b: F.abs(a - b) <= tau + eps)


def point_match(q: Coordinates, x: Coordinates, tau: float) -> Column:
    """Accept: some pivot is so close to both that they must match."""
    return _any(q, x, lambda a, b: a + b <= tau)


def cell_filter(q: Coordinates, lo: Coordinates, hi: Coordinates, tau: float, eps: float = EPS) -> Column:
    """Keep a cell for a query vector: its box meets the square around q."""
    return _all(q, lo, lambda a, b: b <= a + tau + eps) & _all(q, hi, lambda a, b: b >= a - tau - eps)


def cell_cell_filter(q_lo: Coordinates, q_hi: Coordinates, lo: Coordinates, hi: Coordinates, tau: float, eps: float = EPS) -> Column:
    """Keep a pair of cells: their boxes are within tau on every axis."""
    return _all(q_hi, lo, lambda a, b: b <= a + tau + eps) & _all(q_lo, hi, lambda a, b: b >= a - tau - eps)


def cell_match(q: Coordinates, hi: Coordinates, tau: float) -> Column:
    """Accept a whole cell for a query vector."""
    return _any(q, hi, lambda a, b: a + b <= tau)


def cell_cell_match(q_hi: Coordinates, hi: Coordinates, tau: float) -> Column:
    """Accept a pair of cells: every query vector with every lake vector."""
    return _any(q_hi, hi, lambda a, b: a + b <= tau)


def least_reach(q: Column, tau: float) -> Column:
    """Smallest non-negative tau - q_p, null where there is none."""
    return F.array_min(F.filter(F.transform(q, lambda a: F.lit(tau) - a), lambda r: r >= 0))
