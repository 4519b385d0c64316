"""Corpus pipeline: stages over ``documents``, each written and read again.

All stages but the last return the columns of ``documents``. Every stage works
on all that its predecessor kept.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litscreen.llm import decontamination, line_dedup, near_dedup, packing, quality
from litscreen.llm.common import stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

BATCH_BYTES = 4 << 20


def small_batches(stage: Stage) -> Stage:
    """The stage with batches of at most ``BATCH_BYTES`` for Python workers, from here on in its session.

    Workers of all stages live side by side in an executor, and each task holds
    a batch several times over.
    """

    @wraps(stage)
    def with_small_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return with_small_batches


@small_batches
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; empty texts are scored like any other."""
    model = quality.fitted(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model).where("predicted = 1").select("row.*")


@small_batches
def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeated runs of lines; ``n_chars`` follows.

    A document of which nothing but blanks is left is a repetition as a whole
    and goes; one that was empty before stays.
    """
    done = line_dedup.drop_repeated_lines(docs)
    left = F.regexp_count("text", F.lit(r"\S")) > 0
    done = done.where((F.col("removed") == 0) | left)
    changed = F.col("removed") > 0
    columns = {c: F.col(f"row.`{c}`") for c in docs.columns if c != "text"} | {"text": F.col("text")}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(changed, F.length("text").cast("long")).otherwise(columns["n_chars"])
    return done.select(*(columns[c].alias(c) for c in docs.columns))


@small_batches
def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every near-duplicate group, and those without words.

    Rows that repeat id and text are one document.
    """
    found = near_dedup.near_duplicates(docs).select("group", F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    best = F.min(F.struct(F.col("_id").isNull(), "_id", "_hash")).alias("_best")
    grouped = found.where("group IS NOT NULL").groupBy("group").agg(best).select("_best._id", "_best._hash")
    keep = grouped.union(found.where("group IS NULL").select("_id", "_hash"))
    # One row per id and text: rows that repeat both are cut to one before they are shuffled.
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_text"))
    once = Window.partitionBy("_doc", "_text").orderBy("_text")
    rows = rows.withColumn("_copy", F.row_number().over(once)).where("_copy = 1")
    same = rows["_doc"].eqNullSafe(keep["_id"]) & (rows["_text"] == keep["_hash"])
    return rows.join(keep, same, "left_semi").select("row.*")


@small_batches
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark passage."""
    found = decontamination.find_benchmark(docs, table(spark, sf_dir, "benchmark"))
    columns = {c: F.col(f"row.`{c}`") for c in docs.columns if c != "text"} | {"text": F.col("text")}
    return found.where(F.size("spans") == 0).select(*(columns[c].alias(c) for c in docs.columns))


@small_batches
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_deduplication),
    ("MinHash near-dedup", minhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]

#: SQL can express neither the training of a classifier nor a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
