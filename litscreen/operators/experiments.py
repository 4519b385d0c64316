"""Experiment logs: display keys, grouped summaries, best rows, loss curves."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litscreen.operators.checks import require_columns
from litscreen.operators.quantiles import counted_values, moments_of, quantiles_of

# The configuration columns and metrics of the experiment summary.
GROUP_COLUMNS = [
    "model",
    "learning_rate",
    "unfreeze_last_k_layers",
    "title_abstract_journal",
    "seq_max_length",
    "weight_decay",
]
METRICS = ["best_train_f1", "best_val_f1", "best_val_precision", "best_val_recall", "test_f1"]
STD_METRICS = ["best_val_f1", "test_f1"]
RECORDS_PER_GROUP = 5


def run_label(learning_rate: str = "learning_rate", layers: str = "unfreeze_last_k_layers") -> Column:
    """``LR: 2e-05, Layers: 6``; the rate is a text, so that it shows as it was written."""
    return F.format_string("LR: %s, Layers: %d", F.col(learning_rate), F.col(layers).cast("long"))


def run_name(
    model: Column, learning_rate: Column, layers: Column, max_length: Column, seed: Column, fold: Column | None = None
) -> Column:
    """Name of a run; a fold of a cross-validation gets ``title_`` in front and ``_cv{i}`` behind."""
    shown = F.coalesce(model, F.lit("None"))
    name = F.format_string("%s_lr%s_unfreeze%d__ml%d__seed%d", shown, learning_rate, layers, max_length, seed)
    return name if fold is None else F.concat(F.lit("title_"), name, F.lit("_cv"), fold.cast("string"))


def _with_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that have every grouping key; NULL keys form no group."""
    return df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))


# ---- grouped summaries ----------------------------------------------------------------------


def run_group_summary(df: DataFrame, group: str, metric: str) -> DataFrame:
    """Per group: mean, quartiles 1 and 3, sample std, count, min, max; best mean first."""
    counted = counted_values(_with_keys(df, [group]), [group], metric)
    kind = dict(df.dtypes)[metric]
    moments = moments_of(counted, [group]).withColumns({c: F.col(c).cast(kind) for c in ("min", "max")})
    quartiles = quantiles_of(counted, [group], {"q1": 0.25, "q3": 0.75})
    summary = moments.join(quartiles, group, "left").select(
        group, "mean", "q1", "q3", "std", "count", "min", "max"
    )
    return summary.orderBy(F.col("mean").desc_nulls_last(), group)


def group_mean_order(df: DataFrame, group: str, metric: str) -> DataFrame:
    """Groups by mean metric, best first."""
    means = _with_keys(df, [group]).groupBy(group).agg(F.avg(metric).alias("mean"))
    return means.orderBy(F.col("mean").desc_nulls_last(), group)


def experiment_summary(
    df: DataFrame, keys: Sequence[str] = GROUP_COLUMNS, metrics: Sequence[str] = METRICS, digits: int = 4
) -> DataFrame:
    """Means of all metrics and the std of two of them per configuration, rounded half to even."""
    require_columns(df, [*keys, *metrics])
    means = [F.bround(F.avg(m), digits).alias(m) for m in metrics]
    stds = [F.bround(F.stddev_samp(m), digits).alias(f"{m}_std") for m in STD_METRICS if m in metrics]
    return _with_keys(df, keys).groupBy(*keys).agg(*means, *stds)


def top_experiments(summary: DataFrame, metric: str, keys: Sequence[str], n: int | None = 10) -> DataFrame:
    """Configurations by a metric, best first; only the best ``n`` unless that is None."""
    ordered = summary.orderBy(F.col(metric).desc_nulls_last(), *keys)
    return ordered if n is None else ordered.limit(n)


def fold_count_check(df: DataFrame, keys: Sequence[str], metric: str, expected: int = RECORDS_PER_GROUP) -> DataFrame:
    """How many groups have how many records, and whether that is the expected number."""
    counts = _with_keys(df, keys).groupBy(*keys).agg(F.count(metric).alias("n_records"))
    spread = counts.groupBy("n_records").agg(F.count("*").alias("n_groups"))
    return spread.withColumn("as_expected", F.col("n_records") == expected)


def group_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return _with_keys(df, keys).select(*keys).distinct().agg(F.count("*").alias("n_groups"))


# ---- box plots ------------------------------------------------------------------------------

_BOX = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def _fenced(df: DataFrame, group: str, metric: str, whisker: float) -> DataFrame:
    """Distinct values with their count and the box of their group."""
    counted = counted_values(_with_keys(df, [group, metric]), [group], metric)
    boxes = quantiles_of(counted, [group], _BOX)
    values = counted.select(group, F.col("_value").cast(dict(df.dtypes)[metric]).alias(metric), F.col("_n").alias("n"))
    reach = whisker * (F.col("q3") - F.col("q1"))
    inside = F.col(metric).between(F.col("q1") - reach, F.col("q3") + reach)
    return values.join(boxes, group).withColumn("inside", inside)


def boxplot_stats(df: DataFrame, group: str, metric: str, whisker: float = 1.5) -> DataFrame:
    """Per group: box, whiskers (outermost values within 1.5 box lengths) and number of outliers."""
    inside = F.when(F.col("inside"), F.col(metric))
    return _fenced(df, group, metric, whisker).groupBy(group, *_BOX).agg(
        F.least(F.min(inside), F.col("q1")).alias("whisker_low"),
        F.greatest(F.max(inside), F.col("q3")).alias("whisker_high"),
        F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).cast("long").alias("n_outliers"),
    )


def boxplot_outliers(df: DataFrame, group: str, metric: str, whisker: float = 1.5) -> DataFrame:
    """Values beyond the whiskers with the number of times they occur, one row per value."""
    outside = _fenced(df, group, metric, whisker).where(~F.col("inside"))
    return outside.select(group, F.col(metric).alias("outlier"), "n")


# ---- grid results ---------------------------------------------------------------------------


def grid_results(folds: DataFrame, params: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Per candidate the mean and the population std of each metric over its folds."""
    stats = [
        stat(m).alias(f"{prefix}_test_{m}") for m in metrics for prefix, stat in [("mean", F.avg), ("std", F.stddev_pop)]
    ]
    return folds.groupBy(*params).agg(*stats)


def select_grid_point(results: DataFrame, point: Mapping[str, object], columns: Sequence[str]) -> DataFrame:
    """Rows that equal the given parameter values in every one of them."""
    require_columns(results, [*point, *columns])
    return results.where(reduce(lambda a, b: a & b, [F.col(p) == F.lit(x) for p, x in point.items()])).select(*columns)


def number_candidates(results: DataFrame, grid: Mapping[str, Sequence]) -> DataFrame:
    """Add ``candidate``: the place of a row's values among all combinations of ``grid``.

    Parameters go by name, the last one changing fastest, each in the order of its values.
    """
    number = F.lit(0)
    for name in sorted(grid):
        place = reduce(lambda rest, k: F.when(F.col(name) == F.lit(grid[name][k]), k).otherwise(rest), range(len(grid[name])), F.lit(None))
        number = number * len(grid[name]) + place
    return results.withColumn("candidate", number.cast("int"))


def top_grid_points(
    results: DataFrame, n: int = 2, metric: str = "mean_test_f1", candidate: str = "candidate"
) -> DataFrame:
    """The ``n`` candidates with the highest mean; on ties the smaller candidate number."""
    return results.orderBy(F.col(metric).desc_nulls_last(), candidate).limit(n)


def best_grid_point(results: DataFrame, metric: str = "mean_test_f1", candidate: str = "candidate") -> DataFrame:
    """The candidate with the highest mean; on ties the first candidate."""
    return top_grid_points(results, 1, metric, candidate)


def best_checkpoint(epochs: DataFrame, run: str = "run_id", epoch: str = "epoch", metric: str = "f1") -> DataFrame:
    """Per run the epoch with the highest metric, the earliest on ties."""
    best = Window.partitionBy(run).orderBy(F.col(metric).desc_nulls_last(), F.col(epoch))
    return epochs.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").drop("_rank")


# ---- loss curves ----------------------------------------------------------------------------


def loss_curve_points(df: DataFrame, losses: str, *keys: str) -> DataFrame:
    """Loss vectors as rows ``keys, step, loss``, steps from 1."""
    points = df.select(*keys, F.posexplode(losses).alias("_pos", "loss"))
    return points.select(*keys, (F.col("_pos") + 1).alias("step"), F.col("loss").cast("double").alias("loss"))


def check_equal_lengths(df: DataFrame, model: str, losses: str) -> None:
    """Raise ``ValueError`` if the runs of a model differ in length."""
    lengths = df.groupBy(model).agg(F.min(F.size(losses)).alias("low"), F.max(F.size(losses)).alias("high"))
    uneven = lengths.where("low <> high").limit(5).collect()
    if uneven:
        raise ValueError(f"runs of unequal length: {[row[model] for row in uneven]}")


def loss_curve_band(df: DataFrame, model: str, losses: str) -> DataFrame:
    """Per model and step: mean and quartiles 1 and 3 over the runs; NULL models form no group."""
    rows = _with_keys(df, [model])
    check_equal_lengths(rows, model, losses)
    keys = [model, "step"]
    counted = counted_values(loss_curve_points(rows, losses, model), keys, "loss")
    means = counted.groupBy(*keys).agg(F.try_divide(F.sum(F.col("_value") * F.col("_n")), F.sum("_n")).alias("mean"))
    return means.join(quantiles_of(counted, keys, {"q1": 0.25, "q3": 0.75}), keys, "left")
