"""Shared helpers: reading tables, cutting lineage, and vectorised word finding.

Words are runs of bytes outside 0x20 and 0x09-0x0D; A-Z is lowered in place.
All array work happens on slices of bounded size, so memory does not follow
the number of rows in an Arrow batch.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and Python spelling of one word.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text handled at once by the array code.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(column):
    return F.translate(column, UPPER, LOWER)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the session's own setting where there is one.

    Without a setting, a local master gets a temporary folder (one machine holds
    all tasks there) and any other master a folder beside the warehouse, which
    all executors share.
    """
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if context.master.startswith("local[") or context.master == "local":
            folder = tempfile.mkdtemp(prefix="lakeweave-")
        else:
            folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    context.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared checkpoint folder, so that its size is known to the planner."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder by Hadoop's file system, so in whatever store it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class Scratch:
    """Written tables of one computation, deleted as soon as nothing that is still to be computed reads them.

    Names are used again and again: a table goes when `close` is called, or when a newer one takes its name
    (after that one has been written, since it may be made from the older one).
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.made = spark, f"{ensure_checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}", {}

    def write(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        self.drop(name)
        self.made[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.made:
                remove(self.spark, self.made.pop(name))

    def keep(self, df: DataFrame) -> DataFrame:
        """df written outside the scratch folder, which goes with all its tables."""
        out = written(df)
        self.close()
        return out

    def close(self) -> None:
        self.made.clear()
        remove(self.spark, self.base)


def stable(df: DataFrame) -> DataFrame:
    """df, written first if its rows come out of a shuffle: these may fall elsewhere when it runs again."""
    return written(df) if "Exchange" in df._jdf.queryExecution().executedPlan().toString() else df


def numbered(df: DataFrame, name: str = "row") -> DataFrame:
    """df with a number for each row, the same however often df is read and whichever columns are used.

    The number is a function of the file and the place in it, or of the place in what `stable` has written.
    """
    return stable(df).withColumn(name, F.monotonically_increasing_id())


#: Rows of a few numbers that may be broadcast; more are joined by a shuffle that hashes them.
BROADCAST_ROWS = 300_000


def small_side(rows: DataFrame) -> DataFrame:
    """A written table of a few numbers per row as the small side of a join: broadcast if its counted size allows."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows.hint("shuffle_hash")


#: Bytes of a list of places that one step may copy.
PLACES = 2048


def places(text: Column, pattern: Column, measure, keep, show) -> Column:
    """A comma before each show(start, end) of the matches in text for which keep(match) holds, as one string.

    split() gives what lies between the matches that regexp_extract_all() lists; a running sum of measure() over both
    gives each place. The last gap has no match. The list is built in pieces, so that a text with very many
    matches costs no more for each than one with few.
    """
    gaps, hits = F.split(text, pattern, F.lit(-1)), F.regexp_extract_all(text, pattern, F.lit(0))

    def step(acc, pair):
        start = acc["at"] + measure(pair["gap"])
        end = start + measure(pair["hit"])
        full = F.octet_length(acc["piece"]) > PLACES
        piece, done = F.when(full, F.lit("")).otherwise(acc["piece"]), F.when(full, F.concat(acc["done"], F.array(acc["piece"]))).otherwise(acc["done"])
        kept = pair["hit"].isNotNull() & keep(pair["hit"])
        return F.struct(end.alias("at"), F.when(kept, F.concat(piece, F.lit(","), show(start, end))).otherwise(piece).alias("piece"), done.alias("done"))

    none = F.struct(F.lit(0).alias("at"), F.lit("").alias("piece"), F.array().cast("array<string>").alias("done"))
    paired = F.zip_with(gaps, hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    return F.aggregate(paired, none, step, lambda acc: F.concat(F.array_join(acc["done"], ""), acc["piece"]))


# ---------------------------------------------------------------- word finding

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def _power_table(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            have = np.concatenate(([np.uint64(1)], np.cumprod(np.full(max(n, 1 << 16), base, np.uint64))))
        if n <= 4 * SLICE_BYTES:
            _powers[int(base)] = have
    return have[:n]


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xFF51AFD7ED558CCD)
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


class Words(NamedTuple):
    """Words of a slice: bytes (folded), word starts and ends, and word offsets per document."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray

    def hashes(self) -> np.ndarray:
        """One 64-bit hash per word, equal for equal bytes."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        n = len(self.data)
        with np.errstate(over="ignore"):
            total = np.zeros(n + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * _power_table(_PRIME, n), out=total[1:])
            h = (total[self.ends] - total[self.starts]) * _power_table(_INVERSE, n)[self.starts]
            return mix64(h + (self.ends - self.starts).astype(np.uint64) * _PRIME)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def text_slices(column: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, byte offsets) of consecutive rows of about `most` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        end = min(end, n)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words_of(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _SEPARATOR) -> Words:
    data = _FOLD[data]
    inside = ~separator[data]
    if not len(data):
        zero = np.zeros(0, np.int64)
        return Words(data, zero, zero, np.zeros(len(offsets), np.int64))
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    filled = np.flatnonzero(np.diff(offsets))
    before[offsets[filled]] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[offsets[filled + 1] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets, side="left"))
