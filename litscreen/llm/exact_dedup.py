"""Exact deduplication as a stateful stream.

The stream keys every record by the SHA-256 of its text (A-Z lower-cased). The
state of a digest, kept on disk by RocksDB and never expired, is the stable
identifier that stays (the largest), the locator of its content (file and row)
and the number of records seen. Records are combined before they are shuffled,
so a text that a third of all rows share is one state row per task.

A digest seen twice is a hit, and hits are checked on their full bytes: their
texts are fetched and compared with the text at the locator of the state. Texts
that share a digest without being equal are grouped by the texts themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from litscreen.llm.common import stored
from litscreen.session import scratch_path

BYTES_PER_BATCH = 4 << 30
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # many small stores: no disk space ahead of need
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha256_hex(normalised: bytes) -> str:
    return hashlib.sha256(normalised).hexdigest()


def _normalised(text: str | None) -> bytes:
    return (text or "").encode().lower()  # bytes.lower() changes A-Z only


def digest_of(digest: Callable[[bytes], str]):
    @F.pandas_udf(StringType())
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([digest(_normalised(t)) for t in texts], dtype=object)

    return of


@F.pandas_udf(BooleanType())
def _same_text(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([_normalised(a) == _normalised(b) for a, b in zip(left, right)], dtype=bool)


def _with_locator(files: DataFrame, id_col: str, text_col: str, digest) -> DataFrame:
    """``id, file, row, digest, text``; only these of the files' columns take part."""
    return files.select(
        F.col(id_col).alias("id"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
        digest_of(digest)(F.col(text_col)).alias("digest"),
        F.col(text_col).alias("text"),
    )


def _newest(group: DataFrame) -> DataFrame:
    keep = F.max(F.struct("id", "file", "row")).alias("keep")
    return group.agg(keep, F.count(F.lit(1)).alias("group_size"))


def stream_state(
    spark: SparkSession, path: str, id_col: str, text_col: str, digest=sha256_hex, bytes_per_batch: int = BYTES_PER_BATCH
) -> DataFrame:
    """Run the stream over all Parquet files of ``path`` and read its state: ``digest, keep, group_size``.

    ``bytes_per_batch`` bounds a micro-batch. The state has as many partitions
    as ``spark.sql.shuffle.partitions``. The stream's checkpoint lies below the
    shared checkpoint folder; a lost executor's state is read from there.
    """
    schema = spark.read.parquet(path).schema
    pattern = f"{path[:-1]}[{path[-1]}]"  # a pattern, unlike a plain path, may also name a single file
    files = spark.readStream.schema(schema).option("maxBytesPerTrigger", bytes_per_batch).parquet(pattern)
    keyed = _with_locator(files, id_col, text_col, digest).drop("text")
    checkpoint = scratch_path(spark, "dedup-state")
    before = {name: spark.conf.get(name, None) for name in STATE_SETTINGS}
    try:
        for name, value in STATE_SETTINGS.items():
            spark.conf.set(name, value)
        query = (
            _newest(keyed.groupBy("digest"))
            .writeStream.format("noop")
            .outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        state = spark.read.format("statestore").load(checkpoint)
        columns = state.schema["value"].dataType.names
        return stored(
            state.select(
                F.col("key").getField(state.schema["key"].dataType.names[0]).alias("digest"),
                F.col("value").getField(columns[0]).alias("keep"),
                F.col("value").getField(columns[1]).alias("group_size"),
            ),
            "dedup-groups",
        )
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def deduplicate_files(
    spark: SparkSession,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest=sha256_hex,
    bytes_per_batch: int = BYTES_PER_BATCH,
) -> DataFrame:
    """One row per record of the Parquet files at ``path``: ``id, keep_id, group_size, kept, digest``.

    A null text counts as empty. Of equal texts the largest id stays; of rows
    that repeat the same id and text, one (the last by file and row); a null id
    is smaller than any other. An empty table gives no rows.
    """
    state = stream_state(spark, path, id_col, text_col, digest, bytes_per_batch)
    records = _with_locator(spark.read.parquet(path), id_col, text_col, digest)

    # Hits: every record of a digest seen twice, with its text.
    repeated = state.where("group_size > 1").select("digest", "keep")
    hits = stored(records.join(repeated, "digest"), "dedup-hits")
    retained = hits.where((F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row")))
    retained = retained.select("digest", F.col("text").alias("kept_text"))
    differs = ~_same_text(F.col("text"), F.col("kept_text"))
    clashing = stored(hits.join(retained, "digest").where(differs).select("digest").distinct(), "dedup-clashes")

    # Digests with unequal texts: group by the text itself.
    texts = hits.drop("keep").join(clashing, "digest").withColumn("text", _text_of(F.col("text")))
    regrouped = texts.join(_newest(texts.groupBy("digest", "text")), ["digest", "text"]).drop("text")

    plain = records.drop("text").join(clashing, "digest", "left_anti").join(state, "digest")
    both = plain.unionByName(regrouped)
    kept = (F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))
    return both.select("id", F.col("keep.id").alias("keep_id"), "group_size", kept.alias("kept"), "digest")


@F.pandas_udf(StringType())
def _text_of(texts: pd.Series) -> pd.Series:
    return pd.Series([_normalised(t).decode() for t in texts], dtype=object)


def op5_exact_dedup(spark, sf_dir):
    found = deduplicate_files(spark, f"{sf_dir}/documents.parquet")
    return found.withColumnsRenamed({"id": "doc_id", "digest": "text_sha256"})


ORACLE_SQL = """
    WITH normal AS (
        SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                        'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
        FROM documents)
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, text_sha256
    FROM normal WINDOW same AS (PARTITION BY text_sha256)"""
