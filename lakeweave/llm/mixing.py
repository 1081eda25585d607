"""Mixing sources to target weights by entropy balancing.

Targets: sources in code point order (null last) share a multiple of all tokens by weight;
a target stops at a multiple of its source, and what is above is shared again.

Rates: among all document weights that meet a source's token target, those closest to one
in relative entropy are r = min(cap, exp(lambda * z)), z being the document's size over its
source's mean size. The dual is one convex function with a separate coordinate per source;
Newton steps (kept inside a bracket) run for all sources at once, each step one aggregation
over the table of distinct (source, size) with their counts.

Copies: within a source, documents are dealt to buckets of about `bucket_rows` by a hash of id and text (rows that
are equal in both, where there are more of them, by their number); in a
bucket, from the largest document to the smallest, the rounding error is carried on. A bucket
ends within about half its smallest document of what its rates ask for.

Defined results: null text has size 0 and is never taken; null source is a source of its own;
repeated rows are mixed as separate documents; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, checkpointed, small_side, table, written


def source_order(sources: DataFrame) -> DataFrame:
    """Adds `position`, the place of each source in code point order, null last; no single task sees all rows."""
    ordered = checkpointed(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("row", F.monotonically_increasing_id()))
    part = F.shiftright("row", 33)
    counts = sorted((r["p"], r["n"]) for r in ordered.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    before, offsets = 0, []
    for p, n in counts:
        offsets += [F.lit(p), F.lit(before)]
        before += n
    offset = F.element_at(F.create_map(*offsets), part.cast("int")) if offsets else F.lit(0)
    return ordered.withColumn("position", F.col("row").bitwiseAND(F.lit((1 << 33) - 1)) + offset).drop("row")


def water_level(sources: DataFrame, share: float, cap: float) -> DataFrame:
    """Adds `target` to (source, source_size, weight): least(level * weight, cap * source_size)."""
    room = cap * F.col("source_size")
    first = sources.agg(F.sum("source_size").alias("s"), F.sum("weight").alias("w")).first()
    wanted = share * float(first["s"] or 0)
    level, capped = (wanted / first["w"] if first["w"] else 0.0), 0
    while True:
        above = level * F.col("weight") > room
        r = sources.agg(F.sum(F.when(above, room)).alias("full"), F.sum(F.when(~above, F.col("weight"))).alias("w"), F.count_if(above).alias("n")).first()
        if r["n"] == capped or not r["w"]:
            break
        capped, level = r["n"], (wanted - r["full"]) / r["w"]
    return sources.withColumn("target", F.least(F.lit(level) * F.col("weight"), room))


def balance(histogram: DataFrame, sources: DataFrame, cap: float, tolerance: float = 1e-10) -> DataFrame:
    """Adds `tilt` to sources (source, source_size, rows, target): Newton on the dual, all sources at once.

    histogram: (source, size, n), size > 0. A target at the cap has tilt null (every rate is the cap),
    as has a target of zero (every rate is zero). Steps go on until every source is met within the tolerance, or its
    bracket holds no further number.
    """
    easy = (F.col("target") <= 0) | (F.col("target") >= cap * F.col("source_size") * (1 - 1e-12))
    state = sources.withColumn("done", easy)
    state = state.withColumn("tilt", F.when(~easy, F.log(F.col("target") / F.col("source_size"))))
    state = written(state.withColumns({"low": F.lit(None).cast("double"), "high": F.lit(None).cast("double")}))
    while not state.where(~F.col("done")).isEmpty():
        open_ = state.where(~F.col("done")).select("source", "tilt", "source_size", "rows")
        tilt_z = F.col("tilt") * F.col("size") * F.col("rows") / F.col("source_size")
        capped = tilt_z >= math.log(cap)
        mass = F.col("n") * F.col("size")
        rate = F.when(capped, F.lit(float(cap))).otherwise(F.exp(F.least(tilt_z, F.lit(math.log(cap)))))
        slope = F.when(capped, F.lit(0.0)).otherwise(mass * rate * F.col("size") * F.col("rows") / F.col("source_size"))
        sums = histogram.join(open_, histogram["source"].eqNullSafe(open_["source"])).select(open_["source"], (mass * rate).alias("got"), slope.alias("slope"))
        sums = sums.groupBy("source").agg(F.sum("got").alias("got"), F.sum("slope").alias("slope")).withColumnRenamed("source", "s")
        j = state.join(sums, state["source"].eqNullSafe(sums["s"]) & ~F.col("done"), "left").drop("s")
        over = F.col("got") - F.col("target")
        close = F.col("done") | (F.abs(over) <= tolerance * F.col("target"))
        low, high = F.when(over < 0, F.col("tilt")).otherwise(F.col("low")), F.when(over >= 0, F.col("tilt")).otherwise(F.col("high"))
        step = F.when(F.col("slope") > 0, F.col("tilt") - over / F.col("slope")).otherwise(F.col("tilt") - 1)
        j = j.withColumns({"low": low, "high": high, "step": step, "close": close})
        inside = F.when((F.col("step") <= F.col("low")) | (F.col("step") >= F.col("high")), (F.col("low") + F.col("high")) / 2)
        after = F.when(F.col("close"), F.col("tilt")).otherwise(F.coalesce(inside, F.col("step")))
        stuck = after.eqNullSafe(F.col("low")) | after.eqNullSafe(F.col("high")) | after.eqNullSafe(F.col("tilt"))
        state = written(j.select("source", "source_size", "rows", "weight", "target", (F.col("close") | stuck).alias("done"), after.alias("tilt"), "low", "high"))
    return state.drop("done", "low", "high")


def _round(group: pd.DataFrame, cap: int) -> pd.DataFrame:
    group = group.sort_values(["size", "salt", "doc_id"], ascending=[False, True, True], kind="stable")
    carry, out = 0.0, np.zeros(len(group), np.int64)
    for i, (size, rate) in enumerate(zip(group["size"].tolist(), group["rate"].tolist(), strict=True)):
        if size:
            carry += rate * size
            copies = min(cap, max(0, math.floor(carry / size + 0.5)))
            carry -= copies * size
            out[i] = copies
    return group.assign(copies=out)[["doc_id", "size", "source_size", "target", "rate", "copies"]]


def mix(docs: DataFrame, share: float = 1.5, cap: int = 2, weights: tuple[int, ...] = (5, 2, 1), bucket_rows: int = 1024) -> DataFrame:
    """Per row of docs (doc_id, source, text): doc_id, size, source_size, target, rate, copies."""
    sizes = written(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("doc_id", "text").alias("salt")))
    # Rows that are equal in id and text share a salt; where they fill a bucket, their number spreads them.
    crowded = written(sizes.groupBy(F.col("salt").alias("crowd")).agg(F.count("*").alias("n")).where(F.col("n") > bucket_rows).select("crowd"))
    sizes = sizes.withColumn("row", F.monotonically_increasing_id()).join(small_side(crowded), F.col("salt") == F.col("crowd"), "left")
    sizes = sizes.withColumn("salt", F.when(F.col("crowd").isNull(), F.col("salt")).otherwise(F.xxhash64("salt", "row"))).drop("row", "crowd")
    histogram = written(sizes.groupBy("source", "size").agg(F.count("*").alias("n")))
    sources = histogram.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("rows"))
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), (F.col("position") % len(weights)).cast("int"))
    sources = checkpointed(source_order(sources).withColumn("weight", w))
    state = balance(histogram.where("size > 0"), water_level(sources, share, float(cap)).drop("position"), float(cap))
    state = state.withColumnRenamed("source", "s")
    z = F.col("size") * F.col("rows") / F.col("source_size")
    rate = F.when(F.col("target") <= 0, 0.0).when(F.col("tilt").isNull(), float(cap)).otherwise(F.least(F.lit(float(cap)), F.exp(F.least(F.col("tilt") * z, F.lit(50.0)))))
    dealt = sizes.join(state, sizes["source"].eqNullSafe(state["s"])).select(
        "doc_id", "size", "source_size", "target", "source", rate.alias("rate"), "salt",
        F.pmod("salt", F.ceil(F.col("rows") / F.lit(bucket_rows))).alias("bucket"),
    )
    schema = "doc_id long, size long, source_size long, target double, rate double, copies long"
    return dealt.groupBy("source", "bucket").applyInPandas(lambda g: _round(g, cap), schema)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "rate", "copies")
