"""Counts, shares, profiles and summaries. All of them combine on the map side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litscreen.operators.quantiles import counted_values, moments_of, quantiles_of


def label_distribution(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, NULL being a value; largest first."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return counts.orderBy(F.col("n").desc(), F.col(column))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per non-null value; largest first."""
    return label_distribution(df.where(F.col(column).isNotNull()), column)


def label_shares(df: DataFrame, column: str) -> DataFrame:
    """Share of each non-null value in all rows, NULL rows included in the total."""
    # the NULL group has to be counted for the total, so filter after counting
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("n")).scalar()  # of the counts, whose shuffle is reused
    return counts.where(F.col(column).isNotNull()).select(
        column, (F.col("n").cast("double") / total).alias("share")
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def duplicate_count(df: DataFrame, column: str) -> DataFrame:
    """Non-null values minus distinct non-null values."""
    return df.agg(
        F.count(column).alias("n_values"),
        (F.count(column) - F.count_distinct(F.col(column))).alias("n_duplicates"),
    )


def profile_columns(df: DataFrame) -> DataFrame:
    """Per column: name, type, non-null count; one pass over the table."""
    counts = df.agg(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("column_name"),
                    F.lit(kind).alias("data_type"),
                    F.count(F.col(f"`{name}`")).alias("non_null"),
                )
                for name, kind in df.dtypes
            ]
        ).alias("profile")
    )
    return counts.select(F.inline("profile"))


def describe_numeric(df: DataFrame, column: str) -> DataFrame:
    """count, mean, sample std, min, quartiles, max of the non-null values; one row, from one table of counted values."""
    probs = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    counted = counted_values(df, [], column)
    row = F.struct(F.col("count").alias("n"), "mean", "std", "min", "max")
    moments = moments_of(counted, []).select(row.alias("row")).scalar()
    quartiles = quantiles_of(counted, [], probs).select(F.struct(*probs).alias("row")).scalar()
    # a row also where there is no value
    described = df.sparkSession.range(1).select(moments.alias("_moments"), quartiles.alias("_quartiles"))
    names = ["mean", "std", "min", "max"]
    n = F.coalesce("_moments.n", F.lit(0).cast("long")).alias("n")
    return described.select(n, *[f"_moments.{c}" for c in names], *[f"_quartiles.{c}" for c in probs])


def mean_word_count(df: DataFrame, column: str) -> DataFrame:
    from litscreen.functions.text import word_count

    return df.agg(F.avg(word_count(F.col(column))).alias("mean_words"))
