"""Scoring of unlabelled rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litscreen.functions.labels import argmax_label


def batch_predict(
    df: DataFrame, key: str, features: str, load_model: Callable, width: int, batch_size: int = 1024
) -> DataFrame:
    """``key, predicted_label`` from an external model that turns a feature batch into logits.

    ``load_model`` runs once per Python worker and returns a function from a
    ``(rows, width)`` array to a ``(rows, classes)`` array.
    """
    logits = predict_batch_udf(
        load_model, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size, input_tensor_shapes=[[width]]
    )
    scored = df.select(key, logits(F.col(features)).alias("logits"))
    return scored.select(key, argmax_label(F.col("logits")).alias("predicted_label"))


def predict_labels(df: DataFrame, key: str, model: PipelineModel) -> DataFrame:
    """``key, predicted_label`` from a fitted Spark model."""
    return model.transform(df).select(key, F.col("prediction").cast("int").alias("predicted_label"))
