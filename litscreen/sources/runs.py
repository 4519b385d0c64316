"""The append-only log of experiment runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def append_run(records: DataFrame, path: str) -> None:
    """Add records of metrics and settings to the log at ``path``."""
    records.write.mode("append").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The whole log; settings that came later are NULL in earlier records."""
    return spark.read.option("mergeSchema", True).parquet(path)


def collect_run_history(
    history: DataFrame, run: str, step: str, losses: list[str], part_size: int = 100_000
) -> DataFrame:
    """One row per run and part: the loss vectors in step order.

    A part holds ``part_size`` records of its run, the last one the rest, so
    that no cell grows without limit; their step numbers may repeat or leave
    gaps. Records of one step go by their losses. Each vector leaves out the
    records where its loss was not logged.
    """
    order = [step, *losses]
    rows = history.select(run, *order, F.floor(F.col(step) / part_size).alias("_stretch"))
    # two levels: records of earlier stretches of steps, then the place inside the stretch
    before = Window.partitionBy(run).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(run, "_stretch").agg(F.count("*").alias("_n"))
    starts = sizes.select(
        F.col(run).alias("_run"), F.col("_stretch").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy(run, "_stretch").orderBy(*order)
    same = F.col(run).eqNullSafe(F.col("_run")) & F.col("_stretch").eqNullSafe(F.col("_of"))
    placed = rows.withColumn("_rank", F.row_number().over(inside)).join(starts, same)
    place = F.col("_start") + F.col("_rank") - 1
    placed = placed.select(run, *losses, place.alias("_place"), F.floor(place / part_size).alias("part"))
    vectors = []
    for loss in losses:
        logged = F.when(F.col(loss).isNotNull(), F.struct(F.col("_place"), F.col(loss).alias("loss")))
        in_order = F.array_sort(F.collect_list(logged))
        vectors.append(F.transform(in_order, lambda entry: entry["loss"]).alias(loss))
    return placed.groupBy(run, "part").agg(*vectors)
