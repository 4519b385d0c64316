"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litscreen.session import scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back.

    Cuts the lineage: what follows reads the files, whichever executors are lost.
    ``partition_by`` names a column with few values; each gets a folder.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path, partitionBy=partition_by)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z, and only those, lower-cased; for short strings."""
    return F.translate(text, UPPER, LOWER)


def numbered_within(rows: DataFrame, group: str, order: list[str], name: str, buckets: int = 256) -> DataFrame:
    """Add ``name``: a number from 0 without gaps within each value of ``group``.

    ``rows`` must be a stored table whose ``order`` columns identify a row.
    Rows are dealt to hash buckets inside their group, numbered there, and
    shifted by the rows of the buckets before; no task sees a whole group.
    ``buckets`` is the number of buckets per group.
    """
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        F.col(group).alias("_group"),
        F.col("_bucket").alias("_of"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"),
    )
    inside = Window.partitionBy(group, "_bucket").orderBy(*order)
    ranked = dealt.withColumn("_rank", F.row_number().over(inside))
    joined = ranked.join(starts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_bucket") == F.col("_of")))
    return joined.select(*rows.columns, (F.col("_start") + F.col("_rank") - 1).cast("long").alias(name))


def byte_slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts hold ``most`` bytes at most, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    upto = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        before = upto[start] - sizes[start]
        stop = max(int(np.searchsorted(upto, before + most, "right")), start + 1)
        yield batch.slice(start, stop - start)
        start = stop
