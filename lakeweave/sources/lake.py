"""Vector lakes: rows (table_id, set_id, pos, values), from Parquet or from the binary column format.

A binary file holds one table: for each set a uint32 count and count x dim little-endian float32; number of
vectors, table id, sets and dim are in its name, data_size<N>_t<table>c<sets>_len<dim>_noznorm.bin.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import has_nan, normalize

#: Fixed value: the form of a lake file's name.
NAME = re.compile(r"data_size(\d+)_t(\d+)c(\d+)_len(\d+)_noznorm\.bin$")
SCHEMA = "table_id int, set_id int, pos int, set_size int, values array<float>"


def file_name(vectors: int, table_id: int, sets: int, dim: int) -> str:
    return f"data_size{vectors}_t{table_id}c{sets}_len{dim}_noznorm.bin"


def encode_table(sets: list[np.ndarray]) -> bytes:
    return b"".join(struct.pack("<I", len(s)) + np.asarray(s, "<f4").tobytes() for s in sets)


def decode_table(content: bytes, dim: int):
    """(set, vectors) of one file."""
    at, number = 0, 0
    while at < len(content):
        (n,) = struct.unpack_from("<I", content, at)
        end = at + 4 + 4 * n * dim
        if end > len(content):
            raise ValueError("the file ends inside a set")
        yield number, np.frombuffer(content, "<f4", n * dim, at + 4).reshape(n, dim)
        at, number = end, number + 1


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """All .bin files of a folder; files are decoded on the executors, one row per vector."""

    def decode(frames):
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                m = NAME.search(path)
                if not m:
                    raise ValueError(f"not a lake file name: {path}")
                for number, x in decode_table(content, int(m[4])):
                    if len(x):
                        yield pd.DataFrame({"table_id": int(m[2]), "set_id": number, "pos": range(len(x)), "set_size": len(x), "values": list(x)})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(path).select("path", "content")
    return files.mapInPandas(decode, SCHEMA)


def from_table(df: DataFrame, set_id: str, pos: str, values: str, table_id: int = 0, unit: bool = False) -> DataFrame:
    """A lake from any table with a vector column; rows without a full vector are left out."""
    v = F.col(values)
    good = df.where(v.isNotNull() & ~has_nan(v))
    return good.select(F.lit(table_id).alias("table_id"), F.col(set_id).cast("int").alias("set_id"), F.col(pos).cast("long").alias("pos"), (normalize(v) if unit else v).alias("values"))


def nan_vectors(df: DataFrame, values: str) -> DataFrame:
    return df.where(F.col(values).isNull() | has_nan(F.col(values)))


def set_catalog(lake: DataFrame) -> DataFrame:
    return lake.groupBy("table_id", "set_id").agg(F.count("*").alias("set_size"))


def lake_info(lake: DataFrame) -> DataFrame:
    """One row: tables, sets, vectors, least and greatest dimension (different ones are an error to a search)."""
    d = F.size("values").cast("long")
    return lake.agg(F.countDistinct("table_id").alias("tables"), F.countDistinct("table_id", "set_id").alias("sets"), F.count("*").alias("vectors"), F.min(d).alias("min_dim"), F.max(d).alias("max_dim"))


def first_tables(lake: DataFrame, n: int) -> DataFrame:
    """The n tables with the smallest ids."""
    return lake.join(lake.select("table_id").distinct().orderBy("table_id").limit(n), "table_id", "left_semi")


def select_queries(lake: DataFrame, min_size: int = 0, max_size: int | None = None, number: int | None = None) -> DataFrame:
    """Sets with min_size <= size <= max_size, the first `number` of them by id."""
    s = set_catalog(lake).where(F.col("set_size") >= min_size)
    if max_size is not None and max_size >= 0:
        s = s.where(F.col("set_size") <= max_size)
    if number is not None and number >= 0:
        s = s.orderBy("table_id", "set_id").limit(number)
    return s


def columns_of(df: DataFrame, table_id: int, names: list[str]) -> DataFrame:
    """String columns as value sets (table_id, set_id, value), for overlap at distance zero."""
    stacked = F.explode(F.array(*[F.struct(F.lit(i).alias("set_id"), F.col(c).cast("string").alias("value")) for i, c in enumerate(names)]))
    return df.select(F.lit(table_id).alias("table_id"), stacked.alias("s")).select("table_id", "s.*").where(F.col("value").isNotNull())
