"""Pruning counters and run metrics."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pruning as P
from ..functions.grid import GridSettings
from ..functions.vectors import distance_sq_of
from .index import build_index, with_cells
from .pairs import within_all
from .search import _sides, candidate_pairs


def _band(queries: DataFrame, lake: DataFrame, g: GridSettings, tau: float, *more: str) -> DataFrame:
    """Pairs of vectors within the band: query column, lemma2 (accepted without a distance), near (a match)."""
    q = with_cells(queries, g)
    q, x = _sides(q, q, ("ps",))[0], _sides(lake, lake, ("ps", *more))[1]
    j = within_all(q, "q_ps", x, "s_ps", g.dims, tau)
    near = distance_sq_of(F.col("q_values"), F.col("s_values"), len(g.pivots[0])) <= tau * tau
    sure = P.point_match(P.axes("q_ps", g.dims), P.axes("s_ps", g.dims), tau)
    return j.withColumns({"lemma2": sure, "near": near})


def _one_row(*parts: DataFrame) -> DataFrame:
    """One-row counters side by side, without a join."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.agg(*[F.max(c).alias(c) for c in out.columns])


def pruning_stats(queries: DataFrame, lake: DataFrame, g: GridSettings, tau: float) -> DataFrame:
    """One row: all pairs, pairs left by the band, pairs accepted without a distance, matching pairs, cells by kind."""
    band = _band(queries, with_cells(lake, g), g, tau).agg(F.count("*").alias("band_pairs"), F.count_if("lemma2").alias("accepted_pairs"), F.count_if("near").alias("matching_pairs"))
    cells = candidate_pairs(queries, lake, g, tau).agg(F.count_if(F.col("kind") == "candidate").alias("candidate_cells"), F.count_if(F.col("kind") == "match").alias("matching_cells"))
    found = _one_row(queries.agg(F.count("*").alias("nq")), lake.agg(F.count("*").alias("nx")), band, cells)
    return found.select((F.col("nq") * F.col("nx")).alias("all_pairs"), "band_pairs", "accepted_pairs", "candidate_cells", "matching_cells", "matching_pairs")


COUNTERS = ["query_vectors", "candidate_cells", "matching_cells", "whole_cell_pairs", "checked_pairs", "lemma1_left", "lemma2_accepted", "distances", "matching_pairs"]


def query_counters(queries: DataFrame, lake: DataFrame, g: GridSettings, tau: float) -> DataFrame:
    """Per query column, what each condition does.

    candidate_cells and matching_cells: cells left to check and accepted whole, over its vectors;
    whole_cell_pairs and checked_pairs: pairs with the vectors of these; of the checked ones lemma1_left are within
    the band, lemma2_accepted need no distance, and distances are computed; matching_pairs counts all matches.
    """
    i = build_index(lake, g)
    kind = lambda k: F.col("kind") == k
    cells = candidate_pairs(queries, i, g, tau).join(i.zones.select("cell_id", "n"), "cell_id").groupBy("q_table", "q_set").agg(
        F.count_if(kind("candidate")).alias("candidate_cells"), F.count_if(kind("match")).alias("matching_cells"),
        F.sum(F.when(kind("match"), F.col("n")).otherwise(0)).alias("whole_cell_pairs"), F.sum(F.when(kind("candidate"), F.col("n")).otherwise(0)).alias("checked_pairs"),
    )
    x = i.vectors.join(i.zones.select("cell_id", "hi"), "cell_id")
    checked = ~P.cell_match(P.axes("q_ps", g.dims), P.axes("s_hi", g.dims), tau)
    pairs = _band(queries, x, g, tau, "hi").groupBy("q_table", "q_set").agg(
        F.count_if(checked).alias("lemma1_left"), F.count_if(checked & F.col("lemma2")).alias("lemma2_accepted"),
        F.count_if(checked & ~F.col("lemma2")).alias("distances"), F.count_if("near").alias("matching_pairs"),
    )
    base = queries.groupBy(F.col("table_id").alias("q_table"), F.col("set_id").alias("q_set")).agg(F.count("*").alias("query_vectors"))
    return base.join(cells, ["q_table", "q_set"], "left").join(pairs, ["q_table", "q_set"], "left").fillna(0).select("q_table", "q_set", *COUNTERS)


def timed(action):
    """(result, seconds) of a call that runs an action."""
    start = time.perf_counter()
    return action(), time.perf_counter() - start


def run_metrics(queries: DataFrame, found: DataFrame, seconds: float, tau: float, ratio: str | float) -> DataFrame:
    """One row for each query column: its name, size, thresholds, joinable columns, and the run's seconds."""
    size = queries.groupBy(F.col("table_id").alias("q_table"), F.col("set_id").alias("q_set")).agg(F.count("*").alias("q_size"))
    hits = found.groupBy("q_table", "q_set").agg(F.count_if("joinable").alias("joinable_sets"), F.sum("pairs").alias("pairs"))
    j = size.join(hits, ["q_table", "q_set"], "left").fillna(0, ["joinable_sets", "pairs"])
    return j.select(F.format_string("t%dc%d", "q_table", "q_set").alias("query"), "q_size", F.lit(float(tau)).alias("tau"), F.lit(float(ratio)).alias("join_threshold"), "joinable_sets", "pairs", F.lit(float(seconds)).alias("run_seconds"))


def unpivot_stats(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Wide counters to (keys, counter, value)."""
    return stats.unpivot(keys, [c for c in stats.columns if c not in keys], "counter", "value")
