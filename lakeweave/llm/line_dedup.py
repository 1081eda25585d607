"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of `WINDOW` neighbouring lines chooses where a chunk ends, so that
boundaries move with the lines when a text is shifted. A line of at least `long_words` words is a
chunk by itself (its own content sets both boundaries) and counts as a repeatable passage; other
chunks are repeatable from two lines on. Of repeatable chunks with equal bytes anywhere in the corpus
the first (smallest doc_id, then row, then place) stays and the others go.

Chunk hashes meet first, without texts, summed before the shuffle. Only chunks whose hash repeats are
fetched, and each is compared with the bytes of the first one before it is removed.

Defined results: null text stays null with 0 lines; an empty text is one empty line; rows with equal
doc_id are separate texts; null doc_id comes after all others; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

WINDOW = 2
#: A chunk ends after one line in so many.
SPREAD = 3
LONG_WORDS = 50


def chunk_lines(lines: list[str], spread: int = SPREAD, long_words: int = LONG_WORDS) -> list[tuple[int, int, bool]]:
    """(first line, end line, repeatable) of each chunk."""
    out, start, size = [], 0, len(lines)
    hashes = [xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in lines]
    long = [len(x) > 2 * long_words - 2 and len(x.split()) >= long_words for x in lines]
    for i in range(size):
        window = hashes[max(0, i - WINDOW + 1) : i + 1]
        roll = 0
        for h in window:
            roll = (roll * 0x9E3779B97F4A7C15 + h) & 0xFFFFFFFFFFFFFFFF
        roll ^= roll >> 29
        if i + 1 == size or long[i] or long[i + 1] or (roll * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF) >> 33 & 0x3FFFFFFF < 0x40000000 // spread:
            out.append((start, i + 1, i + 1 - start > 1 or long[start]))
            start = i + 1
    return out


def _occurrences(docs: DataFrame) -> DataFrame:
    """(hash, doc_id, row, place) of each repeatable chunk of (row, doc_id, text)."""

    def run(batches):
        for batch in batches:
            hashes, docs_, rows, places = [], [], [], []
            for row, doc, text in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                if text.is_valid:
                    lines = text.as_py().split("\n")
                    for place, (a, b, repeatable) in enumerate(chunk_lines(lines)):
                        if repeatable:
                            hashes.append(xxhash.xxh3_64_intdigest("\n".join(lines[a:b]).encode("utf-8", "surrogatepass")) - (1 << 63))
                            docs_.append(doc)
                            rows.append(row)
                            places.append(place)
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(docs_, pa.int64()), pa.array(rows, pa.int64()), pa.array(places, pa.int32())], ["hash", "doc_id", "row", "place"])

    return docs.mapInArrow(run, "hash long, doc_id long, row long, place int")


def _fetch(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(hash, row, place, first, chunk) of the chunks in wanted (row, place, hash, first)."""
    lists = wanted.groupBy("row").agg(F.collect_list(F.struct("place", "hash", "first")).alias("wanted")).withColumnRenamed("row", "r")

    def run(batches):
        for batch in batches:
            out = {"hash": [], "row": [], "place": [], "first": [], "chunk": []}
            for row, text, want in zip(batch.column("row").to_pylist(), batch.column("text"), batch.column("wanted").to_pylist(), strict=True):
                lines = text.as_py().split("\n")
                chunks = chunk_lines(lines)
                for w in want:
                    a, b, _ = chunks[w["place"]]
                    out["hash"].append(w["hash"])
                    out["row"].append(row)
                    out["place"].append(w["place"])
                    out["first"].append(w["first"])
                    out["chunk"].append("\n".join(lines[a:b]).encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("hash", pa.int64()), ("row", pa.int64()), ("place", pa.int32()), ("first", pa.bool_()), ("chunk", pa.binary())]))

    j = docs.select("row", "text").join(lists.hint("shuffle_hash"), F.col("row") == F.col("r"))
    return j.select("row", "text", "wanted").mapInArrow(run, "hash long, row long, place int, first boolean, chunk binary")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> one row each: row, doc_id, text without removed chunks, n_lines, n_removed."""
    docs = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = written(_occurrences(docs))
    order = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("d"), "row", "place")
    repeated = written(seen.groupBy("hash").agg(F.count("*").alias("n"), F.min(order).alias("f")).where("n > 1").select(F.col("hash").alias("h"), F.col("f.row").alias("first_row"), F.col("f.place").alias("first_place")))
    hits = seen.join(repeated, F.col("hash") == F.col("h")).select("row", "place", "hash", ((F.col("row") == F.col("first_row")) & (F.col("place") == F.col("first_place"))).alias("first"))
    chunks = written(_fetch(docs, hits))
    firsts = chunks.where("first").select(F.col("hash").alias("h"), F.col("chunk").alias("kept"))
    same = chunks.where(~F.col("first")).join(firsts, (F.col("hash") == F.col("h")) & (F.col("chunk") == F.col("kept")))
    removed = same.groupBy("row").agg(F.collect_list("place").alias("removed")).withColumnRenamed("row", "r")

    def run(batches):
        for batch in batches:
            texts, n_lines, n_removed = [], [], []
            for text, places in zip(batch.column("text"), batch.column("removed").to_pylist(), strict=True):
                if not text.is_valid:
                    texts.append(None), n_lines.append(0), n_removed.append(0)
                    continue
                whole = text.as_py()
                lines = whole.split("\n")
                gone, kept = set(places or ()), lines
                if gone:
                    kept = [x for place, (a, b, _) in enumerate(chunk_lines(lines)) if place not in gone for x in lines[a:b]]
                    whole = "\n".join(kept)
                texts.append(whole), n_lines.append(len(lines)), n_removed.append(len(lines) - len(kept))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64())], ["row", "doc_id", "text", "n_lines", "n_removed"])

    j = docs.join(removed.hint("shuffle_hash"), F.col("row") == F.col("r"), "left").select("row", "doc_id", "text", "removed")
    return j.mapInArrow(run, "row long, doc_id long, text string, n_lines long, n_removed long")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("row")
