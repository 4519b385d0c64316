"""Queries on predictions: labels from logits, metrics, weights, batch scoring."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from litscreen.functions.labels import argmax_label, threshold_label
from litscreen.operators import filters as flt
from litscreen.operators import metrics as mt
from litscreen.operators.scoring import batch_predict
from litscreen.plans import views as v
from litscreen.plans.registry import query
from litscreen.plans.screening import write_predictions
from litscreen.session import scratch_path
from litscreen.sources import delimited


def _scored(spark, d):
    return v.scores(spark, d).withColumn("predicted_label", argmax_label(F.col("logits")))


@query("argmax_label", """SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER)
                          AS predicted_label FROM embeddings""")
def argmax_label_query(spark, d):
    return v.table(spark, d, "embeddings").select("vec_id", argmax_label(F.col("embedding")).alias("predicted_label"))


@query(
    "threshold_label",
    v.with_views(
        "scores",
        """SELECT vec_id, CAST(1 / (1 + exp(z0 - z1)) >= 0.2 AS INTEGER) AS at_20,
                  CAST(1 / (1 + exp(z0 - z1)) >= 0.5 AS INTEGER) AS at_50 FROM scores""",
    ),
)
def threshold_label_query(spark, d):
    p = 1 / (1 + F.exp(F.col("logits")[0] - F.col("logits")[1]))
    scored = v.scores(spark, d).select("vec_id", array_to_vector(F.array(1 - p, p)).alias("probability"))
    probability = F.col("probability")
    return scored.select(
        "vec_id", threshold_label(probability, 0.2).alias("at_20"), threshold_label(probability, 0.5).alias("at_50")
    )


@query("predicted_positives", v.with_views("scores", "SELECT vec_id, predicted_label FROM scores WHERE predicted_label = 1"))
def predicted_positives(spark, d):
    return flt.predicted_positives(_scored(spark, d).select("vec_id", "predicted_label"))


@query(
    "balanced_class_weights",
    v.with_views(
        "scores",
        """SELECT s.vec_id, s.labels, round(w.weight, 9) AS weight FROM scores s
           JOIN (SELECT labels, sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS weight
                 FROM scores WHERE split = 'train' GROUP BY labels) w ON s.labels = w.labels""",
    ),
)
def balanced_class_weights(spark, d):
    weighted = mt.balanced_class_weights(v.scores(spark, d), "labels", F.col("split") == "train")
    return weighted.select("vec_id", "labels", F.round("weight", 9).alias("weight"))


_COUNTS = """count(*) FILTER (WHERE labels = 1 AND predicted_label = 1) AS tp,
    count(*) FILTER (WHERE predicted_label = 1) AS predicted, count(*) FILTER (WHERE labels = 1) AS actual,
    count(*) FILTER (WHERE labels = predicted_label) AS hits, count(*) AS n"""
_METRICS = """round(hits / n, 9) AS accuracy, round(coalesce(tp / nullif(predicted, 0), 0), 9) AS precision,
    round(coalesce(tp / nullif(actual, 0), 0), 9) AS recall,
    round(coalesce(2 * tp / nullif(predicted + actual, 0), 0), 9) AS f1"""


def _rounded(df):
    return df.select(*[F.round(c, 9).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


@query("binary_metrics", v.with_views("scores", f"SELECT {_METRICS} FROM (SELECT {_COUNTS} FROM scores)"))
def binary_metrics(spark, d):
    return _rounded(mt.binary_metrics(_scored(spark, d), "labels", "predicted_label"))


_BY_SPLIT = f"SELECT split, {_METRICS} FROM (SELECT split, {_COUNTS} FROM scores GROUP BY split)"


@query("evaluate_splits", v.with_views("scores", _BY_SPLIT))
def evaluate_splits(spark, d):
    return _rounded(mt.evaluate_splits(_scored(spark, d), "labels", "predicted_label"))


_PREFIXED = ", ".join(
    f"max({m}) FILTER (WHERE split = '{name}') AS {prefix}_{m}"
    for name, prefix in mt.SPLIT_PREFIXES.items()
    for m in mt.BINARY_METRICS
)


@query("prefix_metrics", v.with_views("scores", f"SELECT {_PREFIXED} FROM ({_BY_SPLIT})"))
def prefix_metrics(spark, d):
    return _rounded(mt.prefix_metrics(mt.evaluate_splits(_scored(spark, d), "labels", "predicted_label")))


@query(
    "classification_report",
    """WITH s AS (SELECT label AS l, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS p
                  FROM embeddings),
        classes AS (SELECT l AS c FROM s UNION SELECT p FROM s),
        counts AS (SELECT c, (SELECT count(*) FROM s WHERE l = c) AS actual, (SELECT count(*) FROM s WHERE p = c) AS predicted,
                          (SELECT count(*) FROM s WHERE l = c AND p = c) AS hit FROM classes),
        scored AS (SELECT CAST(c AS VARCHAR) AS class_name, coalesce(hit / nullif(predicted, 0), 0) AS precision,
                          coalesce(hit / nullif(actual, 0), 0) AS recall,
                          coalesce(2 * hit / nullif(predicted + actual, 0), 0) AS f1, actual AS support, hit FROM counts),
        report AS (
            SELECT class_name, precision, recall, f1, support FROM scored
            UNION ALL SELECT 'accuracy', NULL, NULL, sum(hit) / sum(support), sum(support) FROM scored
            UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM scored
            UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support),
                             sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM scored)
        SELECT class_name, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1,
               CAST(support AS BIGINT) AS support FROM report""",
)
def classification_report(spark, d):
    scored = v.table(spark, d, "embeddings").select("label", argmax_label(F.col("embedding")).alias("p"))
    return _rounded(mt.classification_report(scored, "label", "p"))


_WEIGHTS = [0.8, 1.4]


@query(
    "weighted_cross_entropy",
    v.with_views(
        "scores",
        f""", terms AS (SELECT CASE labels WHEN 0 THEN {_WEIGHTS[0]}::DOUBLE ELSE {_WEIGHTS[1]} END AS w,
                               ln(exp(z0) + exp(z1)) - CASE labels WHEN 0 THEN z0 ELSE z1 END AS loss FROM scores)
            SELECT round(sum(w * loss) / sum(w), 9) AS loss FROM terms""",
    ),
)
def weighted_cross_entropy(spark, d):
    return _rounded(mt.weighted_cross_entropy(v.scores(spark, d), "logits", "labels", _WEIGHTS))


def _halves_model():
    """Stand-in for a loaded model: logits from fixed weights, one half of the features each."""
    weights = np.zeros((64, 2))
    weights[:32, 0] = 1.0
    weights[32:, 1] = 1.0
    return lambda features: features.astype("float64") @ weights


@query(
    "batch_predict",
    """WITH z AS (SELECT vec_id, list_sum(list_transform(embedding[1:32], lambda x: CAST(x AS DOUBLE))) AS z0,
                         list_sum(list_transform(embedding[33:64], lambda x: CAST(x AS DOUBLE))) AS z1 FROM embeddings)
       SELECT vec_id, CAST(CASE WHEN z1 > z0 THEN 1 ELSE 0 END AS INTEGER) AS predicted_label FROM z""",
)
def batch_predict_query(spark, d):
    return batch_predict(v.table(spark, d, "embeddings"), "vec_id", "embedding", _halves_model, width=64)


@query(
    "write_predictions",
    """WITH z AS (SELECT vec_id, list_sum(list_transform(embedding[1:32], lambda x: CAST(x AS DOUBLE))) AS z0,
                         list_sum(list_transform(embedding[33:64], lambda x: CAST(x AS DOUBLE))) AS z1 FROM embeddings),
            p AS (SELECT vec_id, CAST(CASE WHEN z1 > z0 THEN 1 ELSE 0 END AS INTEGER) AS predicted_label FROM z)
       SELECT 'all' AS part, vec_id, predicted_label FROM p
       UNION ALL SELECT 'positives', vec_id, predicted_label FROM p WHERE predicted_label = 1""",
)
def write_predictions_query(spark, d):
    """The end of the deployment: predictions and their positives, written and read again."""
    rows = v.table(spark, d, "embeddings")
    scored = batch_predict(rows, "vec_id", "embedding", _halves_model, width=64)
    folder = scratch_path(spark, "predictions")
    paths = write_predictions(scored, folder)
    parts = [
        delimited.read_delimited(spark, path, "vec_id bigint, predicted_label int", multi_line=False).select(
            F.lit(name).alias("part"), "vec_id", "predicted_label"
        )
        for name, path in paths.items()
    ]
    return parts[0].unionByName(parts[1])
