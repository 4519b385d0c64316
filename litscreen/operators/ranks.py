"""Exact positions in a total order without a single-task window.

``ordered_positions`` range-partitions the rows (Spark samples the keys, so a
dense stretch of keys is split like any other), numbers them inside their
partition and adds the number of rows in earlier partitions. The numbered rows
are checkpointed once, because the numbers of a partition and the offset of
that partition must come from the same run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litscreen.session import ensure_checkpoint_dir


def _numbered(df: DataFrame, order_cols: list) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    row_bits = (1 << 33) - 1  # low bits of monotonically_increasing_id are the row number
    return (
        df.orderBy(*order_cols)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit(row_bits)))
        .checkpoint()
    )


def _offsets(numbered: DataFrame, weight) -> DataFrame:
    """Weight of all earlier partitions and of all together; one row per partition of the sort."""
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per_part = numbered.groupBy("_part").agg(F.sum(weight).alias("_weight"))
    return per_part.select(
        "_part",
        F.coalesce(F.sum("_weight").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_weight").over(everything).alias("_total"),
    )


def nth_text(texts: DataFrame, column: str, n: int) -> str | None:
    """The ``n``-th text (from 1) of a column of distinct texts in their order; None for 0.

    Counts of leading characters tell where it lies; only the texts that begin
    alike are looked at more closely, until one is left. A count has one row per
    next character. ``texts`` is read once per character of the answer at most,
    so it should be kept in memory.
    """
    if n <= 0:
        return None
    known = ""
    while True:
        begins = texts.where(F.startswith(F.col(column), F.lit(known))) if known else texts
        prefix: Column = F.substring(column, 1, len(known) + 1)
        counts = begins.groupBy(prefix.alias("prefix")).agg(F.count("*").alias("n"), F.min(column).alias("least"))
        for row in sorted(counts.collect(), key=lambda r: r["prefix"].encode()):
            if n <= row["n"]:
                break
            n -= row["n"]
        if row["n"] == 1 or n == 1:
            return row["least"]
        known = row["prefix"]


def ordered_positions(df: DataFrame, order_cols: list, name: str, total: str) -> DataFrame:
    """Add the 0-based position of each row in the order of ``order_cols`` and the number of rows.

    The order must be total (ties are split arbitrarily, but only once).
    """
    numbered = _numbered(df, order_cols)
    offsets = F.broadcast(_offsets(numbered, F.lit(1)))  # one row per sort partition
    return (
        numbered.join(offsets, "_part")
        .withColumn(name, (F.col("_before") + F.col("_pos")).cast("long"))
        .withColumnRenamed("_total", total)
        .drop("_part", "_pos", "_before")
    )


def running_weight(df: DataFrame, order_cols: list, weight: str, name: str, total: str) -> DataFrame:
    """Add the sum of ``weight`` over all rows up to and including this one, and over all rows."""
    numbered = _numbered(df, order_cols)
    offsets = F.broadcast(_offsets(numbered, F.col(weight)))
    inside = Window.partitionBy("_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    return (
        numbered.withColumn("_inside", F.sum(weight).over(inside))
        .join(offsets, "_part")
        .withColumn(name, (F.col("_before") + F.col("_inside")).cast("long"))
        .withColumnRenamed("_total", total)
        .drop("_part", "_pos", "_before", "_inside")
    )
