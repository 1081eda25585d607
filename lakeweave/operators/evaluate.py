"""Scores of a result against a truth, and mean times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall_precision(result: DataFrame, truth: DataFrame, query: list[str], found: list[str]) -> DataFrame:
    """Per query with a truth: truth_size, result_size, hits, recall, precision (null without results)."""
    r, t = result.select(*query, *found).distinct(), truth.select(*query, *found).distinct()
    hits = r.intersect(t).groupBy(*query).agg(F.count("*").alias("hits"))
    t = t.groupBy(*query).agg(F.count("*").alias("truth_size"))
    r = r.groupBy(*query).agg(F.count("*").alias("result_size"))
    j = t.join(r, query, "left").join(hits, query, "left").fillna(0, ["result_size", "hits"])
    return j.withColumn("recall", F.col("hits") / F.col("truth_size")).withColumn("precision", F.when(F.col("result_size") > 0, F.col("hits") / F.col("result_size")))


def macro_average(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg("recall").alias("recall"), F.avg("precision").alias("precision"), F.count("*").alias("queries"))


def mean_time(times: DataFrame, by: list[str], seconds: str = "seconds") -> DataFrame:
    return times.groupBy(*by).agg(F.avg(seconds).alias("mean_seconds"), F.min(seconds).alias("min_seconds"), F.max(seconds).alias("max_seconds"), F.count("*").alias("runs"))
