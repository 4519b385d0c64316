"""The deployment plan: from curated labels and fetched articles to a train/test table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litscreen.functions.labels import map_labels
from litscreen.operators.columns import reduce_columns
from litscreen.operators.enrich import enrich_articles
from litscreen.operators.filters import drop_missing, drop_values, predicted_positives, split_labelled
from litscreen.operators.metrics import evaluate_splits, prefix_metrics
from litscreen.operators.models import TextModel, fit_text_model
from litscreen.operators.splits import three_way_split
from litscreen.sources.delimited import read_delimited, write_delimited
from litscreen.sources.runs import append_run

# Label texts and their class numbers, and the reason that excludes an article.
LABEL_CLASSES = {"Rejected": 0, "Useful": 1}
REVIEW_REASON = "Review article"


def screen_articles(
    raw: DataFrame,
    fetched: DataFrame,
    key: str,
    label: str,
    reason: str,
    text: str = "Abstract",
    excluded_reason: str = REVIEW_REASON,
    classes: Mapping[str, int] = LABEL_CLASSES,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Reduce, enrich, drop rows without text and excluded rows, map labels, mark the split."""
    reduced = reduce_columns(raw, keep or [key, label, reason])
    merged = enrich_articles(reduced, fetched, key)
    with_text, _ = drop_missing(merged, [text])
    candidates, _ = drop_values(with_text, reason, excluded_reason)
    mapped = candidates.withColumn(label, map_labels(F.col(f"`{label}`"), classes))
    return split_labelled(mapped, label, sorted(classes.values()))


def write_predictions(scored: DataFrame, folder: str, column: str = "predicted_label") -> dict[str, str]:
    """Write all predictions and those of class 1 as delimited files below ``folder``; the paths by part.

    The written predictions are read for the positives, so that nothing is scored twice.
    """
    paths = {part: f"{folder}/{part}.csv" for part in ("all", "positives")}
    write_delimited(scored, paths["all"])
    schema = ", ".join(f"`{name}` {kind}" for name, kind in scored.dtypes)
    written = read_delimited(scored.sparkSession, paths["all"], schema)
    write_delimited(predicted_positives(written, column), paths["positives"])
    return paths


def experiment_run(
    rows: DataFrame, key: str, text: str, label: str, spec: TextModel, log: str, settings: Mapping[str, object]
) -> DataFrame:
    """Split, fit, evaluate on train, validation and test rows, and append one record to the run log at ``log``.

    ``rows`` have ``key``, ``text`` and a class number in ``label``. The record
    has the prefixed metrics and the settings; it is returned as well.
    """
    parts = three_way_split(rows, label, key)
    model = fit_text_model(parts.where("split = 'train'"), text, label, spec)
    scored = model.transform(parts)
    metrics = prefix_metrics(evaluate_splits(scored, label, "prediction"))
    record = metrics.withColumns({name: F.lit(value) for name, value in settings.items()}).coalesce(1)
    append_run(record, log)
    return record
