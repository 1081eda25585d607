"""Pivot selection: farthest-first candidates, then the axes with the largest loadings of their principal components.

Both work on a bounded sample on the driver (`SAMPLE` vectors, smallest id hash first); pivots decide the speed of
a search and never its result. `farthest_first_distributed` runs the same rounds over a whole table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grid import extremity
from ..functions.vectors import distance, literal

SAMPLE = 20_000


def sample(lake: DataFrame, most: int = SAMPLE) -> np.ndarray:
    keys = ("table_id", "set_id", "pos")
    rows = lake.select(F.xxhash64(*keys).alias("h"), *keys, "values").orderBy("h", *keys).limit(most).select("values").toArrow()
    return np.array(rows.column("values").to_pylist(), float).reshape(rows.num_rows, -1)


def farthest_first(x: np.ndarray, count: int, seed: int = 42) -> np.ndarray:
    """Indexes of count vectors, each the farthest from those before; the first is the farthest from a random one."""
    count = min(count, len(x))
    if not count:
        return np.zeros(0, int)
    start = x[np.random.default_rng(seed).integers(len(x))]
    chosen = [int(((x - start) ** 2).sum(1).argmax())]
    near = ((x - x[chosen[0]]) ** 2).sum(1)
    near[chosen[0]] = -1
    while len(chosen) < count:
        i = int(near.argmax())
        chosen.append(i)
        near = np.minimum(near, ((x - x[i]) ** 2).sum(1))
        near[chosen] = -1
    return np.array(chosen)


def farthest_first_distributed(lake: DataFrame, count: int, start: list[float]) -> list[list[float]]:
    """The same over all rows: one aggregation a round, with the distances to all chosen vectors in one expression."""
    chosen: list[list[float]] = []
    ids: list[tuple] = []
    key = F.struct("table_id", "set_id", "pos")
    for _ in range(count):
        near = F.least(*[distance(F.col("values"), literal(c)) for c in chosen]) if len(chosen) > 1 else distance(F.col("values"), literal(chosen[0] if chosen else start))
        left = lake
        for t, s, p in ids:
            left = left.where(~((F.col("table_id") == t) & (F.col("set_id") == s) & (F.col("pos") == p)))
        r = left.agg(F.max_by(F.struct(key.alias("k"), "values"), F.struct(near, -F.xxhash64(key))).alias("m")).first()["m"]
        if r is None:
            break
        chosen.append([float(v) for v in r["values"]])
        ids.append(tuple(r["k"]))
    return chosen


def principal_axes(x: np.ndarray, count: int, steps: int = 20, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, loadings) of the leading principal components by expectation-maximisation, largest first."""
    d = (x - x.mean(0)).T
    c = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(d), min(count, len(d)))))[0]
    for _ in range(steps):
        hidden = np.linalg.pinv(c.T @ c) @ (c.T @ d)
        c = (d @ hidden.T) @ np.linalg.pinv(hidden @ hidden.T)
    u = np.linalg.svd(c, full_matrices=False)[0]
    values, turn = np.linalg.eigh(np.atleast_2d(np.cov(u.T @ d)))
    order = np.argsort(-values)
    return values[order], u @ turn[:, order]


def by_loading(loadings: np.ndarray, count: int) -> list[int]:
    """For each component the axis with the largest loading that no earlier one took."""
    out: list[int] = []
    for j in range(count):
        column = np.abs(loadings[:, min(j, loadings.shape[1] - 1)])
        out.append(next(int(i) for i in np.argsort(-column, kind="stable") if int(i) not in out))
    return out


@dataclass(frozen=True)
class PivotChoice:
    pivots: tuple[tuple[float, ...], ...]
    extremity: float
    scale: int


def select_pivots(x: np.ndarray, count: int, scale: int = 13, seed: int = 42) -> PivotChoice:
    """count pivots out of count * scale farthest-first candidates."""
    candidates = x[farthest_first(x, count * scale, seed)]
    if len(candidates) < count:
        raise ValueError(f"{count} pivots need as many vectors")
    apart = np.sqrt(((candidates[:, None] - candidates[None]) ** 2).sum(2))
    chosen = candidates[by_loading(principal_axes(apart, count, seed=seed)[1], count)]
    return PivotChoice(tuple(tuple(map(float, p)) for p in chosen), extremity(chosen), scale)


def select_best(x: np.ndarray, count: int, max_scale: int = 30, tries: int = 5, seed: int = 42) -> PivotChoice:
    """The choice with the largest extremity over scales and seeds."""
    return max((select_pivots(x, count, c, seed + i) for c in range(1, max_scale + 1) for i in range(tries)), key=lambda p: p.extremity)


def rank_and_determinant(x: np.ndarray) -> tuple[int, float]:
    """Rank of a matrix, and its determinant (nan if it is not square): tells whether pivots are independent."""
    square = x.shape[0] == x.shape[1]
    return int(np.linalg.matrix_rank(x)), float(np.linalg.det(x)) if square else float("nan")
