"""Joinable columns at distance zero: equal values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Holders of a value that are met in one place.
HOLDERS = 1024


def exact_overlap(values: DataFrame) -> DataFrame:
    """(table_id, set_id, value) -> per ordered pair of columns with a common value: distinct sizes and overlap.

    A value's holders are columns, not rows. Holders beyond `HOLDERS` are dealt to parts and the others visit
    each part, so a common value is many keys; pairs are counted before the shuffle.
    """
    own = values.select("table_id", "set_id", "value").distinct()
    sizes = own.groupBy("table_id", "set_id").agg(F.count("*").alias("size"))
    shared = own.groupBy("value").agg(F.count("*").alias("n")).where("n > 1").select(F.col("value").alias("v"), F.ceil(F.col("n") / F.lit(HOLDERS)).alias("parts"))
    held = own.join(shared, F.col("value") == F.col("v"))
    side = lambda p, part: held.select(F.col("table_id").alias(f"{p}_table"), F.col("set_id").alias(f"{p}_set"), F.col("v").alias(f"{p}_v"), part.alias(f"{p}_part"))
    q = side("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    s = side("s", F.pmod(F.xxhash64("table_id", "set_id"), F.col("parts")))
    met = q.join(s, (F.col("q_v") == F.col("s_v")) & (F.col("q_part") == F.col("s_part"))).where((F.col("q_table") != F.col("s_table")) | (F.col("q_set") != F.col("s_set")))
    counted = met.groupBy("q_table", "q_set", "s_table", "s_set").agg(F.count("*").alias("overlap"))
    z = sizes.withColumnsRenamed({"table_id": "t", "set_id": "s", "size": "q_size"})
    return counted.join(z, (F.col("q_table") == F.col("t")) & (F.col("q_set") == F.col("s"))).drop("t", "s")
