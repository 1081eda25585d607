"""Sharding by a lookup table that shards fill in turns.

Every shard has its own permutation of the slots of a prime-sized table (a start and a step from
its name) and, in turns, claims the next free slot of its order. A row's key hashes to a slot,
and the slot names the shard. Shards get equal numbers of slots within one, and a change of the
shard list moves few slots.

Defined results: the key is the hash of the key column; null keys share one slot; rows with equal
keys go to the same shard; an empty table gives an empty result; a column named shard is replaced, all others stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: A prime well above 100 times the number of shards keeps shares even. It also bounds the broadcast.
TABLE_SIZE = 65537
SHARDS = tuple(f"shard-{i:04d}" for i in range(128))


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE) -> np.ndarray:
    """Slot -> index of the shard that claimed it. size must be prime, so that every step visits all slots."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names")
    if not _is_prime(size) or size < len(shards):
        raise ValueError("the table needs a prime size of at least the number of shards")
    at = [xxhash.xxh64_intdigest(s, seed=1) % size for s in shards]
    step = [xxhash.xxh64_intdigest(s, seed=2) % (size - 1) + 1 for s in shards]
    owner, left = [-1] * size, size
    while left:
        for i in range(len(shards)):
            slot = at[i]
            while owner[slot] >= 0:
                slot = (slot + step[i]) % size
            owner[slot], at[i] = i, (slot + step[i]) % size
            left -= 1
            if not left:
                break
    return np.array(owner, np.int32)


def place(rows: DataFrame, key: str = "doc_id", shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """rows with `shard` added: one broadcast join with the table, whose size is fixed by `size`."""
    owner = lookup_table(shards, size)
    slot = "slot" + "_" * (1 + max(map(len, rows.columns)))  # no column has this name
    slots = rows.sparkSession.createDataFrame(pa.table({slot: np.arange(size, dtype=np.int64), "shard": owner}))
    keyed = rows.drop("shard").withColumn(slot, F.pmod(F.xxhash64(key), F.lit(size)))
    return keyed.join(F.broadcast(slots), slot).drop(slot)


def write_shards(placed: DataFrame, path: str, files_per_shard: int = 1) -> None:
    """One folder per shard; files_per_shard spreads a shard over so many writers."""
    spread = placed.withColumn("__file", F.pmod(F.xxhash64(*[c for c in placed.columns if c != "shard"]), F.lit(files_per_shard)))
    spread.repartition("shard", "__file").drop("__file").write.partitionBy("shard").parquet(path)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"))
    return place(docs).select("doc_id", "shard", "n_bytes")
