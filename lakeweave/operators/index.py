"""Grid index of a lake: pivot coordinates, cell ids, zone maps and the cell -> set lists."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grid import GridSettings, cell_id, outside, pivot_map, prefix
from ..functions.pruning import axes


@dataclass(frozen=True)
class GridIndex:
    """Vectors with ps, cell_id and cell_l1, zone maps of the filled cells, and the inverted index."""

    vectors: DataFrame
    zones: DataFrame
    inverted: DataFrame
    grid: GridSettings
    stored: bool = False


def with_pivot_space(lake: DataFrame, g: GridSettings) -> DataFrame:
    """Adds ps, the distances to the pivots."""
    return lake.withColumn("ps", pivot_map(F.col("values"), g))


def with_cells(lake: DataFrame, g: GridSettings) -> DataFrame:
    """Adds ps and cell_id."""
    mapped = lake if "ps" in lake.columns else with_pivot_space(lake, g)
    return mapped.withColumn("cell_id", cell_id(F.col("ps"), g))


def out_of_space(indexed: DataFrame, g: GridSettings) -> DataFrame:
    return indexed.agg(F.count_if(outside(F.col("ps"), g)).alias("out_of_space"), F.count("*").alias("vectors"))


def level_histogram(indexed: DataFrame, g: GridSettings) -> DataFrame:
    """Vectors of each non-empty cell of every level; all levels from one aggregation of the leaves."""
    leaves = indexed.groupBy("cell_id").agg(F.count("*").alias("n"))
    levels = F.explode(F.array(*[F.struct(F.lit(i).alias("level"), prefix(F.col("cell_id"), g, i).alias("cell")) for i in range(1, g.levels + 1)]))
    return leaves.select(levels.alias("c"), "n").select("c.*", "n").groupBy("level", "cell").agg(F.sum("n").alias("vectors"))


def empty_leaves(indexed: DataFrame, g: GridSettings) -> DataFrame:
    sizes = indexed.groupBy("cell_id").agg(F.count("*").alias("n"))
    return sizes.agg((F.lit(g.leaf_cells) - F.count("*")).alias("empty"), F.count("*").alias("filled"), F.max("n").alias("largest"))


def inverted_index(indexed: DataFrame) -> DataFrame:
    return indexed.groupBy("cell_id", "table_id", "set_id").agg(F.count("*").alias("vector_count"))


def zone_map(indexed: DataFrame, g: GridSettings, by: tuple[str, ...] = ("cell_id",)) -> DataFrame:
    """Least and greatest pivot coordinates of each cell's vectors, and their number."""
    at = axes("ps", g.dims)
    return indexed.groupBy(*by).agg(F.array(*[F.min(a) for a in at]).alias("lo"), F.array(*[F.max(a) for a in at]).alias("hi"), F.count("*").alias("n"))


def build_index(lake: DataFrame, g: GridSettings) -> GridIndex:
    """The index of a lake as plans; nothing is stored."""
    x = with_cells(lake, g).withColumn("cell_l1", prefix(F.col("cell_id"), g, 1))
    return GridIndex(x, zone_map(x, g), inverted_index(x), g)


def write_index(indexed: DataFrame, g: GridSettings, path: str) -> None:
    """Vectors by first-level cell, the inverted index, zone maps, and settings as one row."""
    spark = indexed.sparkSession
    indexed.withColumn("cell_l1", prefix(F.col("cell_id"), g, 1)).write.mode("errorifexists").partitionBy("cell_l1").parquet(f"{path}/vectors")
    stored = spark.read.parquet(f"{path}/vectors")
    inverted_index(stored).write.parquet(f"{path}/inverted")
    zone_map(stored, g).write.parquet(f"{path}/zones")
    settings = json.dumps({"pivots": g.pivots, "levels": g.levels, "extremity": g.extremity})
    spark.createDataFrame([(settings,)], "settings string").coalesce(1).write.parquet(f"{path}/settings")


def open_index(spark: SparkSession, path: str) -> GridIndex:
    """A stored index; fails where the inverted index and the zone maps do not count the same vectors."""
    s = json.loads(spark.read.parquet(f"{path}/settings").first()["settings"])
    g = GridSettings(tuple(map(tuple, s["pivots"])), s["levels"], s["extremity"])
    vectors, zones, inverted = (spark.read.parquet(f"{path}/{name}") for name in ("vectors", "zones", "inverted"))
    counted = [df.agg(F.sum(c).alias("n")).first()["n"] or 0 for df, c in ((zones, "n"), (inverted, "vector_count"))]
    if len({*counted, vectors.count()}) > 1:
        raise ValueError("the inverted index and the vectors do not agree")
    return GridIndex(vectors, zones, inverted, g, True)


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, GridSettings]:
    """Stored vectors and settings."""
    i = open_index(spark, path)
    return i.vectors, i.grid


def read_cells(i: GridIndex, cells: list[int], level: int | None = None) -> DataFrame:
    """Vectors of the given cells of a level, and so of whole subtrees; only their first-level cells' files are read."""
    level = i.grid.levels if level is None else level
    tops = sorted({c >> i.grid.dims * (level - 1) for c in cells}) if level else []
    found = i.vectors.where(F.col("cell_l1").isin(tops)) if level else i.vectors
    return found.where(prefix(F.col("cell_id"), i.grid, level).isin(cells))


def read_tuples(i: GridIndex, cells: list[int], level: int | None = None) -> DataFrame:
    """Vectors of cells with their pivot coordinates and places: (cell_id, table_id, set_id, pos, values, ps)."""
    return read_cells(i, cells, level).select("cell_id", "table_id", "set_id", "pos", "values", "ps")
