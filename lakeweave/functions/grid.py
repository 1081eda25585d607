"""Pivot space and its grid of cells, as expressions.

A vector maps to its distances to P pivots. The cube [0, extremity]^P is halved m times per axis; a cell
of level l is the first P * l bits of the leaf id, so levels need no table. Cells count from the far end of each
axis, the first axis in the most significant bit of a level. What lies outside the cube goes to the border.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import distance, literal


@dataclass(frozen=True)
class GridSettings:
    pivots: tuple[tuple[float, ...], ...]
    levels: int = 3
    extremity: float | None = None

    def __post_init__(self):
        if self.levels < 1 or not self.pivots:
            raise ValueError("a grid needs a level and a pivot")
        if len(self.pivots) * self.levels > 62:
            raise ValueError("leaf ids need at most 62 bits")
        if self.extremity is None:
            object.__setattr__(self, "extremity", extremity(np.array(self.pivots)))

    @property
    def dims(self) -> int:
        return len(self.pivots)

    @property
    def leaf_cells(self) -> int:
        return 1 << self.dims * self.levels

    @property
    def volume(self) -> float:
        return self.extremity**self.dims

    def edge(self, level: int | None = None) -> float:
        return self.extremity / (1 << (self.levels if level is None else level))


def extremity(pivots: np.ndarray) -> float:
    """Largest distance between two pivots."""
    return float(max(np.sqrt(((pivots - p) ** 2).sum(1)).max() for p in pivots))


def pivot_map(v: Column, g: GridSettings) -> Column:
    return F.array(*[distance(v, literal(p)) for p in g.pivots])


def outside(ps: Column, g: GridSettings) -> Column:
    return F.exists(ps, lambda x: x > g.extremity)


def axis_cell(x: Column, g: GridSettings, level: int | None = None) -> Column:
    """Number of the interval along an axis, from 0, border cells taking what is outside."""
    most = (1 << (g.levels if level is None else level)) - 1
    if not g.extremity:
        return F.lit(0).cast("long")
    return F.greatest(F.lit(0), F.least(F.lit(most), F.floor(x / F.lit(g.edge(level))))).cast("long")


def interleave(axes: list[Column], levels: int) -> Column:
    """Cell id from per-axis numbers counted from the far end."""
    out, p = F.lit(0).cast("long"), len(axes)
    for level in range(levels):
        for k, a in enumerate(axes):
            bit = F.shiftright(a, levels - 1 - level).bitwiseAND(F.lit(1).cast("long"))
            out = out + F.shiftleft(bit, p * (levels - 1 - level) + p - 1 - k)
    return out


def cell_id(ps: Column, g: GridSettings) -> Column:
    most = F.lit((1 << g.levels) - 1).cast("long")
    return interleave([most - axis_cell(F.get(ps, F.lit(k)), g) for k in range(g.dims)], g.levels)


def prefix(cell: Column, g: GridSettings, level: int) -> Column:
    return F.shiftright(cell, g.dims * (g.levels - level))


def cell_center(cell: int, g: GridSettings, level: int | None = None) -> tuple[float, ...]:
    level = g.levels if level is None else level
    out = []
    for k in range(g.dims):
        r = 0
        for b in range(level):
            r = r << 1 | cell >> (g.dims * (level - 1 - b) + g.dims - 1 - k) & 1
        out.append(((1 << level) - 1 - r + 0.5) * g.edge(level))
    return tuple(out)


def children(cell: int, g: GridSettings) -> range:
    return range(cell << g.dims, (cell + 1) << g.dims)


def cell_name(cell: int, g: GridSettings, level: int | None = None) -> str:
    """Text form of a cell: level, edge, center."""
    level = g.levels if level is None else level
    return f"{level:02d}_{g.edge(level):g}_({','.join(f'{c:g}' for c in cell_center(cell, g, level))})"


def covered_cells(ps: Column, g: GridSettings, tau: float, level: int, hi: Column | None = None) -> Column:
    """Ids of the level's cells that meet [ps - tau, ps + tau], or [ps - tau, hi + tau] of a box from ps to hi.

    Sound also outside the cube, as clamping keeps order.
    """
    hi = ps if hi is None else hi
    most = F.lit((1 << level) - 1).cast("long")
    axes = [F.sequence(axis_cell(F.get(ps, F.lit(k)) - tau, g, level), axis_cell(F.get(hi, F.lit(k)) + tau, g, level)) for k in range(g.dims)]
    combos = F.transform(axes[0], lambda x: F.array(x))
    for a in axes[1:]:
        combos = F.flatten(_extend(combos, a))
    return F.transform(combos, lambda c: interleave([most - F.get(c, F.lit(k)) for k in range(g.dims)], level))


def _extend(combos: Column, axis: Column) -> Column:
    return F.transform(combos, lambda c: F.transform(axis, lambda x: F.concat(c, F.array(x))))
