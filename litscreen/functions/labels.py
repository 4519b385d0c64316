"""Label columns: mapping, casting, arg-max and threshold decisions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column
from pyspark.sql import functions as F


def map_values(col: Column, mapping: Mapping, default=None) -> Column:
    """Replace by a literal map; what it does not name becomes ``default`` (NULL if none)."""
    result = F.lit(default)
    for source, target in mapping.items():
        result = F.when(col == F.lit(source), F.lit(target)).otherwise(result)
    return result


def map_labels(col: Column, mapping: Mapping[str, int], default: int | None = -1) -> Column:
    """Class number of a label text; unknown texts and NULL give ``default``."""
    return map_values(col, mapping, default).cast("int")


def bool_label(col: Column) -> Column:
    """``False`` 0, ``True`` 1, NULL stays NULL."""
    return col.cast("int")


def argmax_label(logits: Column) -> Column:
    """Index of the largest member of an array, the first one on ties."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def threshold_label(probability: Column, threshold: float) -> Column:
    """1 where P(class 1) of a probability vector reaches ``threshold``."""
    return (F.get(vector_to_array(probability), F.lit(1)) >= F.lit(threshold)).cast("int")


def numeric_id(col: Column) -> Column:
    """Text to integer id; a fraction is cut off, what is no number becomes NULL."""
    text = col.cast("string")
    return F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint"))


def whole_id(col: Column) -> Column:
    """Like :func:`numeric_id`, but a number with a fraction is no id: NULL."""
    number = numeric_id(col)
    as_double = col.cast("string").try_cast("double")
    return F.when(number.cast("double") == as_double, number)
