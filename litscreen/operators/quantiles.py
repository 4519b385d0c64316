"""Exact, linearly interpolated quantiles per group, by selection on the digits of the values.

Equal values are counted first, combined before the shuffle; that table is all
that is read from there on. A value is turned into a 64-bit number of the same
order and looked at 16 bits at a time: the counts of the leading digits tell in
which digit the wanted rank lies, and only values with that digit go into the
next count. Nothing is sorted but counts of digits, and a group that holds most
of the rows, or one value that does, is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

DIGIT_BITS = 16
LEVELS = 64 // DIGIT_BITS


def counted_values(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``keys, _value, _n``: the values of each group as doubles and how often they occur.

    A NULL counts 0 times, so that its group is known. All that reads the table
    reads it whole, so Spark shuffles it once.
    """
    number = (F.col(value).cast("double") + F.lit(0.0)).alias("_value")  # -0.0 becomes 0.0
    return df.groupBy(*keys, number).agg(F.count(F.col(value)).alias("_n"))


@F.arrow_udf(LongType())
def _ordered_bits(values: pa.Array) -> pa.Array:
    """A number of the same order as the double; NaN comes last."""
    bits = np.ascontiguousarray(values.to_numpy(zero_copy_only=False), np.float64).view(np.int64)
    return pa.array(np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits))


@F.arrow_udf(DoubleType())
def _value_of_bits(numbers: pa.Array) -> pa.Array:
    bits = np.ascontiguousarray(numbers.to_numpy(zero_copy_only=False), np.int64)
    return pa.array(np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits).view(np.float64))


def _group_of(keys: Sequence[str]) -> Column:
    """The keys as one value; a NULL key is a group like any other."""
    return F.struct(*[F.col(k) for k in keys] or [F.lit(0).alias("all")])


def quantiles_of(counted: DataFrame, keys: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    """One row per group of a table of counted values: ``keys`` and one column per entry of ``probs``."""
    rows = counted.select(_group_of(keys).alias("_group"), _ordered_bits("_value").alias("_bits"), "_n")
    sizes = counted.groupBy(_group_of(keys).alias("_group")).agg(F.sum("_n").alias("_rows"))
    ranks = []
    for number, prob in enumerate(probs.values()):
        at = F.lit(float(prob)) * (F.col("_rows") - 1)
        share = (at - F.floor(at)).alias("share")
        for side, rank in enumerate((F.floor(at), F.ceil(at))):
            ranks.append(F.struct(F.lit(number).alias("_prob"), F.lit(side).alias("_side"), rank.alias("_rank"), share))
    # groups x probs x 2 rows, narrowed down digit by digit
    targets = sizes.select("_group", F.lit(0).cast("long").alias("_prefix"), F.inline(F.array(*ranks)))
    names = ["_prob", "_side", "share"]
    # a NULL has no digits and counts 0 times, so no rank falls on it
    for level in range(LEVELS):
        known = DIGIT_BITS * level
        digit = F.shiftright("_bits", 64 - known - DIGIT_BITS)  # with all digits before it
        prefix = F.shiftright("_bits", 64 - known) if level else F.lit(0).cast("long")
        inside = rows.withColumn("_prefix", prefix)
        if level:
            inside = inside.join(targets.select("_group", "_prefix").distinct(), ["_group", "_prefix"], "left_semi")
        counts = inside.groupBy("_group", "_prefix", digit.alias("_digit")).agg(F.sum("_n").alias("_here"))
        upto = F.sum("_here").over(Window.partitionBy("_group", "_prefix").orderBy("_digit"))  # 65 536 digits at most
        placed = counts.withColumn("_upto", upto)
        found = targets.join(placed, ["_group", "_prefix"])
        found = found.where((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_here")))
        targets = found.select(
            "_group", F.col("_digit").alias("_prefix"), *names, (F.col("_rank") - F.col("_upto") + F.col("_here")).alias("_rank")
        )
    values = targets.where("_prefix IS NOT NULL").withColumn("_value", _value_of_bits("_prefix"))
    outputs = []
    for number, name in enumerate(probs):
        low, high = (F.max(F.when((F.col("_prob") == number) & (F.col("_side") == side), F.col("_value"))) for side in (0, 1))
        share = F.max(F.when(F.col("_prob") == number, F.col("share")))
        # equal neighbours as they are: their difference is no number if they are infinite
        outputs.append(F.when(low == high, low).otherwise(low + (high - low) * share).alias(name))
    return values.groupBy("_group").agg(*outputs).select(*[F.col(f"_group.`{k}`") for k in keys], *probs)


def moments_of(counted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per group ``keys, mean, std, count, min, max`` (sample std) of a table of counted values."""
    named = counted.withColumn("_group", _group_of(keys))
    total, n = F.sum(F.col("_value") * F.col("_n")), F.sum("_n")
    first = named.groupBy("_group").agg(
        F.try_divide(total, n).alias("mean"), n.alias("count"), F.min("_value").alias("min"), F.max("_value").alias("max")
    )
    away = (F.col("_value") - F.col("mean")) ** 2 * F.col("_n")
    spread = named.join(first.select("_group", "mean"), "_group").groupBy("_group").agg(F.sum(away).alias("_away"))
    std = F.when(F.col("count") > 1, F.sqrt(F.col("_away") / (F.col("count") - 1)))
    out = first.join(spread, "_group").withColumn("std", std)
    return out.select(*[F.col(f"_group.`{k}`") for k in keys], "mean", "std", "count", "min", "max")


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """One row per group: ``keys`` plus one column per entry of ``probs``.

    Groups without a non-null value are absent.
    """
    return quantiles_of(counted_values(df, keys, value), keys, probs)
