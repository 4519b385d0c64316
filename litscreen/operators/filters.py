"""Row filters that hand back both what they keep and what they drop."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litscreen.operators.checks import require_columns


def drop_missing(df: DataFrame, subset: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """``(kept, dropped)``: a row goes if any of ``subset`` (default: all columns) is NULL."""
    columns = list(df.columns if subset is None else subset)
    require_columns(df, columns)
    missing = reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNull() for c in columns], F.lit(False))
    return df.where(~missing), df.where(missing)


def drop_values(df: DataFrame, column: str, value) -> tuple[DataFrame, DataFrame]:
    """``(kept, dropped)``: rows equal to ``value`` go, NULL rows stay."""
    require_columns(df, [column])
    hit = F.col(f"`{column}`").eqNullSafe(F.lit(value))
    return df.where(~hit), df.where(hit)


def rejected_ledger(**dropped: DataFrame) -> DataFrame:
    """All dropped branches under each other, with the keyword as ``reason_dropped``."""
    tagged = [df.withColumn("reason_dropped", F.lit(name)) for name, df in dropped.items()]
    return reduce(lambda a, b: a.unionByName(b), tagged)


def mark_rejections(
    df: DataFrame, missing: Sequence[str] = (), excluded: Mapping[str, object] | None = None
) -> DataFrame:
    """Add ``reason_dropped``: ``missing``, ``excluded`` or, for rows that stay, NULL.

    The same as dropping rows with missing values first and rows with excluded
    values then, but kept rows and ledger come from one pass over the input.
    """
    excluded = excluded or {}
    require_columns(df, [*missing, *excluded])
    lacks = reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNull() for c in missing], F.lit(False))
    hit = reduce(lambda a, b: a | b, [F.col(f"`{c}`").eqNullSafe(F.lit(x)) for c, x in excluded.items()], F.lit(False))
    return df.withColumn("reason_dropped", F.when(lacks, "missing").when(hit, "excluded"))


def split_labelled(df: DataFrame, label: str, classes: Sequence[int] = (0, 1)) -> DataFrame:
    """Add ``split``: ``train`` for rows of a known class, ``test`` for all others and NULL."""
    require_columns(df, [label])
    known = F.coalesce(F.col(f"`{label}`").isin(*classes), F.lit(False))
    return df.withColumn("split", F.when(known, "train").otherwise("test"))


def empty_reference_count(df: DataFrame, column: str) -> DataFrame:
    """Rows whose reference text is NULL, blank or an empty list; count and share."""
    text = F.trim(F.col(column))
    empty = text.isNull() | text.isin("", "[]")
    return df.agg(
        F.count_if(empty).alias("n_empty"),
        F.count("*").alias("n_rows"),
        F.try_divide(F.count_if(empty).cast("double"), F.count("*")).alias("share_empty"),
    )


def malformed_ids(df: DataFrame, column: str) -> DataFrame:
    """Rows whose id holds a Latin letter."""
    return df.where(F.col(column).isNotNull() & F.col(column).cast("string").rlike("[a-zA-Z]"))


def predicted_positives(df: DataFrame, column: str = "predicted_label") -> DataFrame:
    return df.where(F.col(column) == 1)
