"""Building an index and searching it in one call."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..functions.grid import GridSettings
from . import pivots
from .index import open_index, with_cells, write_index
from .search import INDEX_LEVELS, INDEX_PIVOTS, search
from .stats import run_metrics, timed

#: What a run does.
BUILD, SEARCH, BUILD_AND_SEARCH = 0, 1, 2


@dataclass(frozen=True)
class Run:
    """Results and metrics (None where nothing was searched), and seconds of both steps."""

    found: DataFrame | None
    metrics: DataFrame | None
    build_seconds: float
    search_seconds: float


def build_and_search(path: str, lake: DataFrame | None = None, queries: DataFrame | None = None, mode: int = BUILD_AND_SEARCH, ratio: str | float = "0.6", tau: float = 0.0, num_pivots: int = INDEX_PIVOTS, levels: int = INDEX_LEVELS, **options) -> Run:
    """mode 0 stores the lake's index under path, 1 searches the stored index, 2 does both.

    An existing index is an error to modes 0 and 2. Metrics are counted from results written beside the index.
    """
    if mode not in (BUILD, SEARCH, BUILD_AND_SEARCH):
        raise ValueError("mode is 0, 1 or 2")
    if mode != SEARCH and lake is None or mode != BUILD and queries is None:
        raise ValueError("building needs a lake, searching needs queries")
    spark, build_s = (lake if lake is not None else queries).sparkSession, 0.0
    if mode != SEARCH:

        def build():
            g = GridSettings(pivots.select_pivots(pivots.sample(lake), num_pivots).pivots, levels)
            write_index(with_cells(lake, g), g, path)

        _, build_s = timed(build)
    if mode == BUILD:
        return Run(None, None, build_s, 0.0)

    def find():
        search(queries, open_index(spark, path), ratio, tau, **options).write.mode("overwrite").parquet(f"{path}/results")
        return spark.read.parquet(f"{path}/results")

    found, search_s = timed(find)
    return Run(found, run_metrics(queries, found, search_s, tau, ratio), build_s, search_s)
