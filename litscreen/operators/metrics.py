"""Class weights, classification metrics, loss."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Metric names and the prefixes of the three evaluations.
BINARY_METRICS = ["accuracy", "precision", "recall", "f1"]
SPLIT_PREFIXES = {"train": "best_train", "val": "best_val", "test": "test"}


def _ratio(part: Column, whole: Column) -> Column:
    """``part / whole``, 0 where the denominator is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """``label, weight`` with weight = n / (number of classes * rows of the class)."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    totals = counts.agg(F.struct(F.sum("n").alias("n"), F.count("*").alias("k")).alias("t")).scalar()
    return counts.select(label, (totals["n"].cast("double") / (totals["k"] * F.col("n"))).alias("weight"))


def balanced_class_weights(df: DataFrame, label: str, train: Column | None = None) -> DataFrame:
    """Add ``weight``, computed on the rows where ``train`` holds (default: all)."""
    base = df if train is None else df.where(train)
    return df.join(class_weights(base, label), label, "left")


def binary_metric_columns(label: Column, prediction: Column) -> dict[str, Column]:
    """Aggregates for accuracy and for precision, recall and F1 of class 1."""
    tp = F.count_if((label == 1) & (prediction == 1))
    predicted = F.count_if(prediction == 1)
    actual = F.count_if(label == 1)
    return {
        "accuracy": _ratio(F.count_if(label == prediction), F.count("*")),
        "precision": _ratio(tp, predicted),
        "recall": _ratio(tp, actual),
        "f1": _ratio(2 * tp, predicted + actual),
    }


def binary_metrics(df: DataFrame, label: str, prediction: str, *groups: str) -> DataFrame:
    """The four metrics over all rows, or per group; one pass."""
    columns = [c.alias(name) for name, c in binary_metric_columns(F.col(label), F.col(prediction)).items()]
    return df.groupBy(*groups).agg(*columns)


def evaluate_splits(df: DataFrame, label: str, prediction: str, split: str = "split") -> DataFrame:
    """One row per split with its metrics."""
    return binary_metrics(df, label, prediction, split)


def prefix_metrics(
    evaluation: DataFrame, split: str = "split", prefixes: Mapping[str, str] = SPLIT_PREFIXES
) -> DataFrame:
    """The rows of :func:`evaluate_splits` as one record with prefixed metric names."""
    columns = [
        F.max(F.when(F.col(split) == name, F.col(metric))).alias(f"{prefix}_{metric}")
        for name, prefix in prefixes.items()
        for metric in BINARY_METRICS
    ]
    return evaluation.agg(*columns)


def classification_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Rows per class, then accuracy, macro and weighted average: precision, recall, f1, support."""
    cells = df.groupBy(F.col(label).alias("l"), F.col(prediction).alias("p")).agg(F.count("*").alias("n"))
    # each cell counts for its true class and for its predicted class
    sides = F.array(
        F.struct(F.col("l").alias("c"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("predicted"),
                 F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("p").alias("c"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("predicted"),
                 F.lit(0).cast("long").alias("hit")),
    )
    classes = cells.select(F.inline(sides)).groupBy("c").agg(
        F.sum("actual").alias("actual"), F.sum("predicted").alias("predicted"), F.sum("hit").alias("hit")
    )
    scored = classes.select(
        F.col("c").cast("string").alias("class_name"),
        _ratio(F.col("hit"), F.col("predicted")).alias("precision"),
        _ratio(F.col("hit"), F.col("actual")).alias("recall"),
        _ratio(2 * F.col("hit"), F.col("predicted") + F.col("actual")).alias("f1"),
        F.col("actual").alias("support"),
        "hit",
    )
    names = ["precision", "recall", "f1"]
    support = F.sum("support")
    no_value = F.lit(None).cast("double")
    totals = scored.agg(
        F.array(
            F.struct(F.lit("accuracy").alias("class_name"), no_value.alias("precision"), no_value.alias("recall"),
                     _ratio(F.sum("hit"), support).alias("f1"), support.alias("support")),
            F.struct(F.lit("macro avg").alias("class_name"), *[F.avg(m).alias(m) for m in names],
                     support.alias("support")),
            F.struct(F.lit("weighted avg").alias("class_name"),
                     *[_ratio(F.sum(F.col(m) * F.col("support")), support).alias(m) for m in names],
                     support.alias("support")),
        ).alias("rows")
    )
    return scored.drop("hit").unionByName(totals.select(F.inline("rows")))


def log_softmax(logits: Column, index: Column) -> Column:
    """Log-probability of one class, computed from the largest logit downwards."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda acc, z: acc + F.exp(z - top))
    return F.get(logits, index) - top - F.log(total)


def weighted_cross_entropy(df: DataFrame, logits: str, label: str, weights: Sequence[float]) -> DataFrame:
    """Weighted mean of -log softmax of the true class; one row."""
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col(label))
    loss = -log_softmax(F.col(logits), F.col(label))
    return df.agg(F.try_divide(F.sum(weight * loss), F.sum(weight)).alias("loss"))
