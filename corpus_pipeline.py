"""Corpus pipeline: language ID, near-duplicate join, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.

Decisions are made per row: stages number the rows of their input, so repeated doc_ids and extra columns
pass through. The number is a function of the file and the place in it, so a task that runs again gives
the same one; an input that comes out of a shuffle is written first.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.llm import decontaminate as leaks
from lakeweave.llm import language, mixing, ngram_join, sharding
from lakeweave.llm.common import ensure_checkpoint_dir, remove, small_side, stable, written

#: Documents whose best language covers less than this share of their letters are rejected.
LEAST_SCORE = 0.5
ROW = "__row"


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.withColumn(ROW, F.monotonically_increasing_id())


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs without the numbered rows."""
    return _numbered(docs).join(small_side(written(rows.select(F.col("row").alias(ROW)))), ROW, "left_anti").select(*docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters, and those of no clear known language."""
    docs = stable(docs)
    model = language.train_languages(docs.select("doc_id", "text", "lang"))
    numbered = _numbered(docs)
    found = language.identify(numbered.select(F.col(ROW).alias("doc_id"), "text"), model)
    return _without(docs, found.where((F.col("lang_pred") == "und") | (F.col("score") < LEAST_SCORE)).select(F.col("doc_id").alias("row")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five words, 0.8): the one with the smallest doc_id, then row.

    Documents without words are linked with nothing and stay.
    """
    docs = stable(docs)
    joined = ngram_join.join_components(docs.select("doc_id", "text"), n=5, percent=80, groups=True)
    first = joined.where("n_shingles > 0").groupBy("group").agg(F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)), "row")).alias("f"))
    kept = first.select(F.col("f.row").alias("row"))
    return _without(docs, joined.where("n_shingles > 0").select("row").join(kept, "row", "left_anti"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that hold a benchmark item or a paraphrase of one."""
    docs = stable(docs)
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _without(docs, leaks.find_leaks(numbered, leaks.benchmark_items(spark, sf_dir)).select("row").distinct())


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    numbered = _numbered(stable(docs))
    mixed = mixing.mix(numbered.select(F.col(ROW).alias("doc_id"), "source", "text"))
    taken = written(mixed.where("copies > 0").select(F.col("doc_id").alias(ROW), F.col("copies").cast("int").alias("__copies")))
    repeated = numbered.join(small_side(taken), ROW)
    return repeated.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the shard of each row."""
    return sharding.place(docs)


STAGES = [
    ("language_id", language_stage),
    ("ngram_join", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: Language models, similarity groups and carried rounding are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; a table goes once the next one stands."""
    base = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if before:
            remove(spark, before)
        before = f"{base}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
