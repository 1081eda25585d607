"""Joinable column search: one similarity join, a distinct count, a threshold.

Three plans give the same pairs. `blocks`: lake vectors pass once through an Arrow kernel that holds the query
vectors; queries beyond `QUERY_BYTES` go in several passes, so what is broadcast is bounded. `cells`: each
query vector visits the grid cells that its square covers, an equi join on cell ids, and the band and the distance
decide. `index`: zone maps choose the cells of each query vector, cells that must match are counted from the inverted
index, and the other cells' vectors meet their query vectors in tiles. Query vectors of one pass suit blocks, a stored
index or more of them the index, small thresholds in low dimension cells.
"""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pruning as P
from ..functions.grid import GridSettings, covered_cells, prefix
from ..functions.vectors import distance_sq_of
from . import pivots
from .index import GridIndex, build_index, with_cells

QUERY_BYTES = 64 << 20
#: Cells a query vector may visit before the blocks plan is taken.
MOST_CELLS = 64
KEYS = ["q_table", "q_set", "q_pos", "s_table", "s_set"]


def _sides(queries: DataFrame, lake: DataFrame, extra: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    name = lambda df, p: df.select(F.col("table_id").alias(f"{p}_table"), F.col("set_id").alias(f"{p}_set"), F.col("pos").alias(f"{p}_pos"), *[F.col(c).alias(f"{p}_{c}") for c in ("values", *extra)])
    return name(queries, "q"), name(lake, "s")


def other_column() -> Column:
    return ~((F.col("q_table") == F.col("s_table")) & (F.col("q_set") == F.col("s_set")))


def _matching(q: np.ndarray, ids: list[np.ndarray], x: np.ndarray, sets: np.ndarray, limit: float, exclude_self: bool) -> pa.RecordBatch:
    """(keys, pairs) of query vectors q and lake vectors x; sets: the columns (table, set) of x."""
    if not len(q) or not len(x):
        return pa.RecordBatch.from_arrays([pa.array([], t) for t in _TYPES], [*KEYS, "pairs"])
    if x.shape[1] != q.shape[1]:
        raise ValueError("vectors of different lengths")
    sets, member = np.unique(sets, axis=0, return_inverse=True)
    member, q_sq, x_sq, found = member.ravel(), (q**2).sum(1), (x**2).sum(1), []
    for a in range(0, len(q), 512):
        near = q_sq[a : a + 512, None] + x_sq[None] - 2 * q[a : a + 512] @ x.T
        i, j = np.nonzero(near <= limit + 1e-6 * (1 + limit))
        i += a
        # What the fast form leaves near the limit is decided on the differences.
        keep = np.concatenate([((q[i[b : b + 65536]] - x[j[b : b + 65536]]) ** 2).sum(1) <= limit for b in range(0, len(i), 65536)] or [np.zeros(0, bool)])
        found.append(np.stack(np.unique(i[keep] * len(sets) + member[j[keep]], return_counts=True)))
    code, count = np.concatenate(found, 1)
    i, s = code // len(sets), sets[code % len(sets)]
    if exclude_self:
        other = (ids[0][i] != s[:, 0]) | (ids[1][i] != s[:, 1])
        i, s, count = i[other], s[other], count[other]
    columns = [ids[0][i], ids[1][i], ids[2][i], s[:, 0], s[:, 1], count]
    return pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(columns, _TYPES, strict=True)], [*KEYS, "pairs"])


_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
_SCHEMA = "q_table int, q_set int, q_pos long, s_table int, s_set int, pairs long"


def _vectors(column) -> np.ndarray:
    """An Arrow list column as a matrix; lists differ in length: an error."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(np.asarray(column.offsets))
    if len(set(sizes.tolist())) > 1:
        raise ValueError("vectors of different lengths")
    return np.asarray(column.flatten()).astype(float).reshape(len(column), int(sizes[0]) if len(sizes) else 0)


def _ids(columns) -> list[np.ndarray]:
    return [np.asarray(c) for c in columns]


def _per_pass(queries: DataFrame) -> tuple[int, int]:
    """Query vectors, and how many of them a broadcast of QUERY_BYTES holds."""
    seen = queries.agg(F.max(F.size("values")).alias("d"), F.count("*").alias("n")).first()
    return seen["n"], max(1, QUERY_BYTES // (8 * (seen["d"] or 1) + 16))


def _in_blocks(queries: DataFrame, lake: DataFrame, limit: float, exclude_self: bool) -> DataFrame:
    """(keys, pairs): for each query vector and lake column, matching lake vectors of a batch."""
    n, per_pass = _per_pass(queries)
    passes = max(1, math.ceil(n / per_pass))
    part = F.pmod(F.xxhash64("table_id", "set_id", "pos"), F.lit(passes))
    out = None
    for i in range(passes):
        rows = queries.where(part == i).select("table_id", "set_id", "pos", "values").toArrow()
        shared = lake.sparkSession.sparkContext.broadcast((_vectors(rows.column("values")), _ids(rows.columns[:3])))

        def run(batches, shared=shared):
            q, ids = shared.value
            for batch in batches:
                if batch.num_rows:
                    yield _matching(q, ids, _vectors(batch.column("values")), np.stack(_ids(batch.columns[:2]), 1), limit, exclude_self)

        got = lake.select("table_id", "set_id", "values").mapInArrow(run, _SCHEMA)
        out = got if out is None else out.union(got)
    return out.groupBy(*KEYS).agg(F.sum("pairs").alias("pairs"))


#: Vectors of a cell, on each side, that meet in one task.
TILE = 4096
#: First-level cells up to which they are named to the scan of a stored index.
MOST_TOPS = 4096


def _pruned(queries: DataFrame, i: GridIndex, limit: float, exclude_self: bool, ratio: str | float | None) -> DataFrame:
    """(keys, pairs) through the index.

    Cells that must match whole are counted from the inverted index alone; of the others the vectors meet
    the query vectors that reach them, in tiles of about TILE by TILE. With a ratio, only columns whose candidate
    cells reach the need are looked at. Nothing passes through the driver but the names of first-level cells.
    """
    g, tau = i.grid, math.sqrt(limit)
    reach = candidate_pairs(queries, i, g, tau, ("values",))
    if ratio is not None:
        allowed = _bounds(reach, i, queries, ratio).where("keep").select("q_table", "q_set", "s_table", "s_set")
        holds = i.inverted.select("cell_id", F.col("table_id").alias("s_table"), F.col("set_id").alias("s_set"))
        open_ = allowed.join(holds, ["s_table", "s_set"]).select("q_table", "q_set", "cell_id").distinct()
        reach = reach.join(open_, ["q_table", "q_set", "cell_id"], "left_semi")
    whole = reach.where("kind = 'match'").join(i.inverted, "cell_id").select("q_table", "q_set", "q_pos", F.col("table_id").alias("s_table"), F.col("set_id").alias("s_set"), F.col("vector_count").alias("pairs"))
    if exclude_self:
        whole = whole.where(other_column())
    check = reach.where("kind = 'candidate'")
    vectors = i.vectors
    if i.stored and 1 << g.dims <= MOST_TOPS:
        tops = [r[0] for r in check.select(prefix(F.col("cell_id"), g, 1)).distinct().collect()]
        vectors = vectors.where(F.col("cell_l1").isin(tops))
    asked = check.groupBy("cell_id").agg(F.count("*").alias("nq"))
    shape = asked.join(i.zones.select("cell_id", "n"), "cell_id").select(F.col("cell_id").alias("c"), F.ceil(F.col("nq") / TILE).alias("q_parts"), F.ceil(F.col("n") / TILE).alias("s_parts"))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    of = lambda c, *by: F.pmod(F.xxhash64(*by), F.col(c))
    q = check.join(shape, F.col("cell_id") == F.col("c")).withColumn("q_part", of("q_parts", "q_table", "q_set", "q_pos")).withColumn("s_part", every("s_parts"))
    x = vectors.join(shape, F.col("cell_id") == F.col("c")).withColumn("s_part", of("s_parts", "table_id", "set_id", "pos")).withColumn("q_part", every("q_parts"))
    by = ("cell_id", "q_part", "s_part")
    tile = lambda df, side, *more: df.select(*[F.col(c).alias(f"{side}_{c}") for c in by], *more).groupBy(*[f"{side}_{c}" for c in by])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        q, x = _vectors(left.column("q_values")), _vectors(right.column("values"))
        return pa.Table.from_batches([_matching(q, _ids(left.columns[3:6]), x, np.stack(_ids(right.columns[3:5]), 1), limit, exclude_self)])

    found = tile(q, "left", "q_table", "q_set", "q_pos", "q_values").cogroup(tile(x, "right", "table_id", "set_id", "values")).applyInArrow(run, _SCHEMA)
    out = whole.select(*KEYS, "pairs").union(found).groupBy(*KEYS).agg(F.sum("pairs").alias("pairs"))
    return out if ratio is None else out.join(allowed, ["q_table", "q_set", "s_table", "s_set"], "left_semi")


def cell_level(g: GridSettings, tau: float) -> int:
    """Deepest level at which a query's square covers at most MOST_CELLS cells; 0: none."""
    for level in range(g.levels, 0, -1):
        if (math.floor(2 * tau / g.edge(level)) + 2) ** g.dims <= MOST_CELLS:
            return level
    return 0


def pairs_by_cells(queries: DataFrame, lake: DataFrame, g: GridSettings, tau: float, level: int | None = None) -> DataFrame:
    """All matching pairs of vectors through the grid: (q_*, s_*, dist_sq)."""
    level = cell_level(g, tau) or 1 if level is None else level
    q, x = _sides(with_cells(queries, g), with_cells(lake, g), ("ps", "cell_id"))
    q = q.withColumn("cell", F.explode(covered_cells(F.col("q_ps"), g, tau + P.EPS, level)))
    x = x.withColumn("at", prefix(F.col("s_cell_id"), g, level))
    j = q.join(x, F.col("cell") == F.col("at")).where(P.point_filter(F.col("q_ps"), F.col("s_ps"), tau))
    d = distance_sq_of(F.col("q_values"), F.col("s_values"), len(g.pivots[0]))
    return j.withColumn("dist_sq", d).where(F.col("dist_sq") <= tau * tau).select("q_table", "q_set", "q_pos", "s_table", "s_set", "s_pos", "dist_sq")


def similarity_counts(queries: DataFrame, lake: DataFrame | GridIndex, tau: float, grid: GridSettings | None = None, plan: str = "auto", exclude_self: bool = False, verify_radius: str = "tau", ratio: str | float | None = None) -> DataFrame:
    """(q_table, q_set, q_pos, s_table, s_set, pairs) with pairs >= 1.

    verify_radius "sqrt2tau" accepts distances up to sqrt(2 tau). A ratio lets the index plan leave out columns that
    cannot be joinable; the other plans return them all.
    """
    limit = 2 * tau if verify_radius == "sqrt2tau" else tau * tau
    indexed = isinstance(lake, GridIndex)
    if plan == "auto":
        cells = grid is not None and verify_radius == "tau" and cell_level(grid, tau)
        n, per_pass = (0, 1) if indexed or cells else _per_pass(queries)
        plan = "index" if indexed or n > per_pass else "cells" if cells else "blocks"
    if plan == "index":
        if not indexed:
            grid = grid or GridSettings(pivots.select_pivots(pivots.sample(lake), INDEX_PIVOTS).pivots, INDEX_LEVELS)
        return _pruned(queries, lake if indexed else build_index(lake, grid), limit, exclude_self, ratio)
    lake = lake.vectors if indexed else lake
    if plan == "blocks":
        return _in_blocks(queries, lake, limit, exclude_self)
    if grid is None or verify_radius != "tau":
        raise ValueError("the cells plan needs a grid and the threshold tau")
    pairs = pairs_by_cells(queries, lake, grid, tau)
    return (pairs.where(other_column()) if exclude_self else pairs).groupBy(*KEYS).agg(F.count("*").alias("pairs"))


#: Grid of the index plan where none is given.
INDEX_PIVOTS, INDEX_LEVELS = 3, 3


def needed(size: Column, ratio: str | float) -> Column:
    """ceil(T * |Q|), exactly: T as a decimal."""
    t = Decimal(str(ratio))
    if not 0 <= t <= 1:
        raise ValueError("T is between 0 and 1")
    whole = int(t.scaleb(9).to_integral_value())
    return F.call_function("div", F.lit(whole).cast("long") * size + F.lit(999_999_999), F.lit(1_000_000_000))


def match_map(counts: DataFrame, queries: DataFrame, lake: DataFrame, zeros: bool = False) -> DataFrame:
    """Per pair of columns with a match: matched and unmatched query vectors, matching and other pairs.

    zeros gives pairs of columns without a match, too: as many rows as query columns times lake columns.
    """
    sizes = lambda df, p: df.groupBy("table_id", "set_id").agg(F.count("*").alias(f"{p}_size")).withColumnsRenamed({"table_id": f"{p}_t", "set_id": f"{p}_s"})
    found = counts.groupBy("q_table", "q_set", "s_table", "s_set").agg(F.count("*").alias("matched"), F.sum("pairs").alias("pairs"))
    if zeros:
        every = sizes(queries, "q").crossJoin(sizes(lake, "s"))
        j = every.join(found, (F.col("q_table") == F.col("q_t")) & (F.col("q_set") == F.col("q_s")) & (F.col("s_table") == F.col("s_t")) & (F.col("s_set") == F.col("s_s")), "left")
        j = j.withColumns({"q_table": F.col("q_t"), "q_set": F.col("q_s"), "s_table": F.col("s_t"), "s_set": F.col("s_s")}).fillna(0, ["matched", "pairs"])
    else:
        j = found.join(sizes(queries, "q"), (F.col("q_table") == F.col("q_t")) & (F.col("q_set") == F.col("q_s")))
        j = j.join(sizes(lake, "s"), (F.col("s_table") == F.col("s_t")) & (F.col("s_set") == F.col("s_s")))
    return j.select("q_table", "q_set", "s_table", "s_set", "q_size", "s_size", "matched", "pairs", (F.col("q_size") - F.col("matched")).alias("nooverlap"), (F.col("q_size") * F.col("s_size") - F.col("pairs")).alias("mismatched"))


def joinable(found: DataFrame, ratio: str | float, count_mode: str = "distinct") -> DataFrame:
    """Adds need and joinable; count_mode "pairs" counts matching pairs instead of query vectors."""
    have = F.col("pairs") if count_mode == "pairs" else F.col("matched")
    return found.withColumn("need", needed(F.col("q_size"), ratio)).withColumn("joinable", have >= F.col("need"))


def search(queries: DataFrame, lake: DataFrame | GridIndex, ratio: str | float, tau: float | None = None, tau_pct: float | None = None, grid: GridSettings | None = None, plan: str = "auto", count_mode: str = "distinct", exclude_self: bool = False, verify_radius: str = "tau", only_joinable: bool = False) -> DataFrame:
    """Lake columns with at least one match for each query column, and whether they are joinable.

    lake is a table of vectors or an index. tau is a distance; tau_pct is a share of the largest distance between unit
    vectors, 2. only_joinable returns joinable columns only; the index plan then leaves out the others early.
    """
    if (tau is None) == (tau_pct is None):
        raise ValueError("give tau or tau_pct")
    if tau_pct is not None and not 0 <= tau_pct <= 1:
        raise ValueError("tau_pct is between 0 and 1")
    tau = 2 * tau_pct if tau is None else tau
    if tau < 0:
        raise ValueError("tau is not negative")
    early = ratio if only_joinable and count_mode == "distinct" else None
    counts = similarity_counts(queries, lake, tau, grid, plan, exclude_self, verify_radius, early)
    found = joinable(match_map(counts, queries, lake.vectors if isinstance(lake, GridIndex) else lake), ratio, count_mode)
    return found.where("joinable") if only_joinable else found


def candidate_pairs(queries: DataFrame, lake: DataFrame | GridIndex, g: GridSettings, tau: float, carry: tuple[str, ...] = ()) -> DataFrame:
    """(q_*, cell_id, kind): for each query vector, cells accepted whole ('match') or left to check ('candidate').

    Joins each query vector's covered first-level cells with the zone map, whose size is the number of filled cells.
    """
    zones = (lake if isinstance(lake, GridIndex) else build_index(lake, g)).zones
    q = with_cells(queries, g).select(F.col("table_id").alias("q_table"), F.col("set_id").alias("q_set"), F.col("pos").alias("q_pos"), F.col("ps").alias("q_ps"), *[F.col(c).alias(f"q_{c}") for c in carry])
    reach = q.withColumn("top", F.explode(covered_cells(F.col("q_ps"), g, tau + P.EPS, 1)))
    x, lo, hi = (P.axes(c, g.dims) for c in ("q_ps", "lo", "hi"))
    j = reach.join(zones.withColumn("at", prefix(F.col("cell_id"), g, 1)), F.col("top") == F.col("at")).where(P.cell_filter(x, lo, hi, tau))
    return j.select("q_table", "q_set", "q_pos", "cell_id", F.when(P.cell_match(x, hi, tau), "match").otherwise("candidate").alias("kind"), *[f"q_{c}" for c in carry])


def candidate_cell_pairs(queries: DataFrame, lake: DataFrame, g: GridSettings, tau: float) -> DataFrame:
    """(q_table, q_set, q_cell, cell_id) of query cells and lake cells whose boxes are within tau."""
    q = build_index(queries, g).vectors.groupBy("table_id", "set_id", "cell_id").agg(*[F.array(*[f(a) for a in P.axes("ps", g.dims)]).alias(n) for f, n in ((F.min, "q_lo"), (F.max, "q_hi"))])
    q = q.select(F.col("table_id").alias("q_table"), F.col("set_id").alias("q_set"), F.col("cell_id").alias("q_cell"), "q_lo", "q_hi")
    reach = q.withColumn("top", F.explode(covered_cells(F.col("q_lo"), g, tau + P.EPS, 1, F.col("q_hi"))))
    zones = build_index(lake, g).zones.withColumn("at", prefix(F.col("cell_id"), g, 1))
    q_lo, q_hi, lo, hi = (P.axes(c, g.dims) for c in ("q_lo", "q_hi", "lo", "hi"))
    return reach.join(zones, F.col("top") == F.col("at")).where(P.cell_cell_filter(q_lo, q_hi, lo, hi, tau)).select("q_table", "q_set", "q_cell", "cell_id")


def quick_browse(queries: DataFrame, lake: DataFrame, g: GridSettings) -> DataFrame:
    """Query vectors and filled lake cells with the same leaf id."""
    cells = with_cells(lake, g).select("cell_id").distinct()
    q = with_cells(queries, g).select(F.col("table_id").alias("q_table"), F.col("set_id").alias("q_set"), F.col("pos").alias("q_pos"), "cell_id")
    return q.join(cells, "cell_id")


def _bounds(reach: DataFrame, i: GridIndex, queries: DataFrame, ratio: str | float) -> DataFrame:
    """Columns held by the cells that query vectors reach: query vectors that can still match, against the need."""
    possible = reach.join(i.inverted, "cell_id").groupBy("q_table", "q_set", F.col("table_id").alias("s_table"), F.col("set_id").alias("s_set")).agg(F.countDistinct("q_pos").alias("bound"))
    size = queries.groupBy(F.col("table_id").alias("t"), F.col("set_id").alias("s")).agg(F.count("*").alias("q_size"))
    j = possible.join(size, (F.col("q_table") == F.col("t")) & (F.col("q_set") == F.col("s"))).drop("t", "s")
    return j.withColumn("keep", F.col("bound") >= needed(F.col("q_size"), ratio))


def upper_bound(queries: DataFrame, lake: DataFrame, g: GridSettings, tau: float, ratio: str | float) -> DataFrame:
    """Columns that can still be joinable: query vectors with a candidate cell that holds the column, against the need."""
    i = build_index(lake, g)
    return _bounds(candidate_pairs(queries, i, g, tau), i, queries, ratio)
