"""Queries that train and apply text classifiers on the labelled documents.

Iterative fits have no SQL form; their parts (vocabulary, TF-IDF, weights,
metrics, grid aggregation) are checked against SQL under their own names.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from litscreen.functions import text as tx
from litscreen.functions.labels import threshold_label as at_threshold
from litscreen.operators import many_models as mm
from litscreen.operators import models as md
from litscreen.operators import splits as sp
from litscreen.operators.scoring import predict_labels
from litscreen.plans import screening
from litscreen.plans import views as v
from litscreen.plans.registry import query
from litscreen.plans.texts import LEMMAS
from litscreen.session import scratch_path
from litscreen.sources import runs as log

_SPEC = md.TextModel(C=0.1)
_TFIDF = md.TextModel(weighting="tfidf")
# the only candidate of the forest's grid
(_FOREST,) = md.candidates(md.TextModel(weighting="tfidf", classifier="forest", lemmas=LEMMAS), md.FOREST_GRID)


def _holdout(spark, d):
    """Labelled documents with ``split`` and ``fold``."""
    return sp.holdout_then_kfold(v.labelled(spark, d), "label", "doc_id", seed=1)


def _train_test(spark, d):
    rows = _holdout(spark, d)
    return rows.where("split = 'cv'"), rows.where("split = 'test'")


@query("train_logreg")
def train_logreg(spark, d):
    train, test = _train_test(spark, d)
    model = md.fit_text_model(train, "text", "label", _SPEC)
    return model.transform(test).select("doc_id", "label", F.col("prediction").cast("int").alias("prediction"))


@query("train_forest")
def train_forest(spark, d):
    train, test = _train_test(spark, d)
    model = md.fit_text_model(train, "text", "label", _FOREST)
    return model.transform(test).select("doc_id", "label", F.col("prediction").cast("int").alias("prediction"))


@query("model_threshold_label")
def model_threshold_label(spark, d):
    train, test = _train_test(spark, d)
    scored = md.fit_text_model(train, "text", "label", _SPEC).transform(test)
    thresholds = {t: f"at_{t}" for t in (20, 50, 80)}
    return scored.select(
        "doc_id", *[at_threshold(F.col("probability"), t / 100).alias(name) for t, name in thresholds.items()]
    )


@query("text_models")
def text_models(spark, d):
    """Metrics of the five kinds of text models on the hold-out, each saved and loaded again."""
    train, test = _train_test(spark, d)
    reports = []
    for name, variant in md.VARIANTS.items():
        lemmas = LEMMAS if name.endswith("lemmas") else {}
        spec = replace(variant, lemmas=lemmas)
        path = scratch_path(spark, name)
        md.fit_text_model(train, "text", "label", spec).write().save(path)
        reports.append(md.evaluate_model(PipelineModel.load(path), test, variant=name))
    return reduce(lambda a, b: a.unionByName(b), reports)


@query("grid_search")
def grid_search(spark, d):
    """Results of the 18 candidates on TF-IDF vectors."""
    train, _ = _train_test(spark, d)
    return md.grid_search(train, "text", "label", _TFIDF, md.TFIDF_GRID)[0]


@query("grid_search_counts")
def grid_search_counts(spark, d):
    """Results of the 48 candidates on counts."""
    train, _ = _train_test(spark, d)
    return md.grid_search(train, "text", "label", md.TextModel(), md.COUNT_GRID)[0]


@query(
    "grid_search_optima",
    """
    SELECT CAST(6 * c.i + 2 * m.i + n.i AS INTEGER) AS candidate, c.v AS C, CAST(m.v AS INTEGER) AS max_features,
        CAST(n.v AS INTEGER) AS ngram_max, CAST(fold AS INTEGER) AS fold, true AS at_optimum
    FROM (VALUES (0, CAST(0.1 AS DOUBLE)), (1, CAST(1.0 AS DOUBLE)), (2, CAST(10.0 AS DOUBLE))) c(i, v),
        (VALUES (0, 1000), (1, 2000), (2, 5000)) m(i, v), (VALUES (0, 1), (1, 2)) n(i, v), range(5) f(fold)
    """,
)
def grid_search_optima(spark, d):
    """Every model of the search on TF-IDF vectors, and whether its gradient vanishes."""
    train, _ = _train_test(spark, d)
    folds = md.search_folds(train, "text", "label", _TFIDF, md.TFIDF_GRID)
    return folds.select("candidate", *sorted(md.TFIDF_GRID), "fold", (F.col("gradient") <= mm.TOLERANCE).alias("at_optimum"))


@query("cv_run")
def cv_run(spark, d):
    path = scratch_path(spark, "cv-runs")
    log.append_run(md.cv_run(_holdout(spark, d), "text", "label", _SPEC), path)
    return log.read_runs(spark, path)


@query("experiment_run")
def experiment_run(spark, d):
    """From articles with labels to one record in the run log, read again."""
    rows = v.table(spark, d, "documents").join(v.labelled(spark, d).select("doc_id", "label"), "doc_id")
    title = F.substring_index("text", "\n", 1)
    text = tx.mark_keywords(tx.compose_input_text(title, F.col("source"), F.col("text")), ["the", "de"])
    path = scratch_path(spark, "experiment-runs")
    settings = {"max_features": _SPEC.max_features, "C": _SPEC.C}
    screening.experiment_run(rows.select("doc_id", "label", text.alias("text")), "doc_id", "text", "label", _SPEC, path, settings)
    return log.read_runs(spark, path)


@query("refit_and_test")
def refit_and_test(spark, d):
    """Report on the hold-out of the winner of the search on TF-IDF vectors, fitted on all other rows."""
    train, test = _train_test(spark, d)
    _, best = md.grid_search(train, "text", "label", _TFIDF, md.TFIDF_GRID)
    return md.refit_and_test(train, test, "text", "label", best)


@query("top_features")
def top_features(spark, d):
    train, _ = _train_test(spark, d)
    return md.top_features(md.fit_text_model(train, "text", "label", _SPEC), spark)


@query("predict_labels")
def predict_labels_query(spark, d):
    """Labels for the documents that have none, by a stored model trained on those that have one."""
    path = scratch_path(spark, "model")
    md.fit_text_model(v.labelled(spark, d), "text", "label", _SPEC).write().save(path)
    model = PipelineModel.load(path)
    open_rows = v.table(spark, d, "documents").join(v.table(spark, d, "labels"), "doc_id", "left_anti")
    return predict_labels(open_rows.select("doc_id", "text"), "doc_id", model)
