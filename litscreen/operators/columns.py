"""Column selection, renaming and value repair on whole tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litscreen.functions.labels import whole_id
from litscreen.operators.checks import require_columns
from litscreen.operators.enrich import left_join_known


def reduce_columns(df: DataFrame, keep: Sequence[str], drop_duplicates: bool = False) -> DataFrame:
    """Keep the listed columns in the listed order, optionally without duplicate rows."""
    require_columns(df, keep)
    kept = df.select(*[F.col(f"`{c}`") for c in keep])
    return kept.dropDuplicates() if drop_duplicates else kept


def lower_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def add_null_column(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.lit(None).cast("string"))


def feature_label_view(df: DataFrame, target: str, features: Sequence[str] | None = None) -> DataFrame:
    """Features and, under the name ``labels``, the target of the same row."""
    require_columns(df, [target, *(features or [])])
    view = df.withColumnRenamed(target, "labels")
    return view.select(*features, "labels") if features else view


def ensure_labels(df: DataFrame, target: str | None = None) -> DataFrame:
    """Make sure there is a ``labels`` column: the target, an existing one, or -1 throughout."""
    if not isinstance(df, DataFrame):
        raise TypeError("ensure_labels needs a DataFrame")
    if target is not None:
        return feature_label_view(df, target)
    return df if "labels" in df.columns else df.withColumn("labels", F.lit(-1))


def model_input_columns(df: DataFrame) -> DataFrame:
    """Only the columns a model reads; ``labels`` if there are any."""
    require_columns(df, ["input_ids", "attention_mask"])
    labels = ["labels"] if "labels" in df.columns else []
    return df.select("input_ids", "attention_mask", *labels)


def replace_ids(df: DataFrame, column: str, corrections: Mapping[str, str] | DataFrame) -> DataFrame:
    """Corrections of single ids; all other values stay.

    A mapping is for a handful of literals. A table ``old, new`` of any size is
    joined; of an id that it has twice the smallest correction counts.
    """
    if not isinstance(corrections, DataFrame):
        return df.replace(dict(corrections), subset=[column])
    known = corrections.where("old IS NOT NULL").groupBy(F.col("old").alias("_old")).agg(F.min("new").alias("_new"))
    keyed = left_join_known(df.withColumn("_old", F.col(column)), known, "_old")
    return keyed.withColumn(column, F.coalesce("_new", column)).select(*df.columns)


def fill_flag(df: DataFrame, column: str) -> DataFrame:
    """NULL flags become false, if the table has that column at all."""
    return df.na.fill(False, [column]) if column in df.columns else df


def normalise_ids(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """``(ids, rejected)``: distinct ids as plain integer text, and distinct values that are none."""
    require_columns(df, [column])
    values = df.select(F.col(column).cast("string").alias("value")).where("value is not null")
    number = whole_id(F.col("value"))
    ids = values.select(number.cast("string").alias(column)).where(F.col(column).isNotNull()).distinct()
    rejected = values.where(number.isNull()).distinct()
    return ids, rejected
