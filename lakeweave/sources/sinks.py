"""Result sinks.

Fixed values of the result format: column names tqq, tss, nooverlap; names of the form t<table>c<set>;
folders query_results and query_time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def labels(result: DataFrame) -> DataFrame:
    """Query and lake columns in the form t<table>c<set>, and query vectors without a match."""
    return result.select(F.format_string("t%dc%d", "q_table", "q_set").alias("tqq"), F.format_string("t%dc%d", "s_table", "s_set").alias("tss"), F.col("nooverlap"))


def ordered(result: DataFrame) -> DataFrame:
    """Rows by query column, each in one task and in the order of the lake columns, so that reruns write the same files."""
    keys = ["q_table", "q_set"]
    return result.repartition(*keys).sortWithinPartitions(*keys, "s_table", "s_set")


def write_results(result: DataFrame, path: str, mode: str = "append") -> None:
    """CSV of joinable columns, one folder per query column, rows in order."""
    rows = ordered(result.where("joinable")).withColumn("query", F.format_string("t%dc%d", "q_table", "q_set"))
    rows.write.mode(mode).partitionBy("query").option("header", True).csv(path)


def write_log(result: DataFrame, path: str, tau: float, ratio: float, seconds: float) -> None:
    """query_results and query_time, appended, with the parameters really used."""
    labels(ordered(result.where("joinable"))).write.mode("append").option("header", True).csv(f"{path}/query_results")
    spark = result.sparkSession
    spark.createDataFrame([(tau, ratio, seconds)], "tau double, join_threshold double, querytime double").coalesce(1).write.mode("append").option("header", True).csv(f"{path}/query_time")


def merge_results(spark: SparkSession, paths: list[str], target: str, mode: str = "errorifexists") -> None:
    """Result files of several runs as one CSV table; columns that a run lacks are empty."""
    out = None
    for path in paths:
        rows = spark.read.option("header", True).csv(path)
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise ValueError("no results to merge")
    out.write.mode(mode).option("header", True).csv(target)
