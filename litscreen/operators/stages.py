"""Custom ML stages: text cleaning, lemmas, n-grams, logistic scores, thresholded prediction.

All of them are column expressions without state and can be saved with the
pipeline they belong to.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasInputCols, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litscreen.functions import text as tx
from litscreen.functions.labels import threshold_label


class _ColumnStage(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """A stage that adds one column computed from another."""

    def _expression(self, col):
        raise NotImplementedError

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getOutputCol(), self._expression(F.col(self.getInputCol())))


class TextCleaner(_ColumnStage):
    """``clean_text`` as a stage."""

    lower = Param(Params._dummy(), "lower", "lower-case first", TypeConverters.toBoolean)
    removeDigits = Param(Params._dummy(), "removeDigits", "drop digits", TypeConverters.toBoolean)
    removePunct = Param(Params._dummy(), "removePunct", "drop punctuation", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, lower=True, removeDigits=True, removePunct=True):
        super().__init__()
        self._setDefault(lower=True, removeDigits=True, removePunct=True)
        self._set(**self._input_kwargs)

    def _expression(self, col):
        return tx.clean_text(
            col,
            self.getOrDefault(self.lower),
            self.getOrDefault(self.removeDigits),
            self.getOrDefault(self.removePunct),
        )


class Lemmatiser(_ColumnStage):
    """Replace tokens by lemmas of a bounded table, given as two lists of equal length."""

    tokens = Param(Params._dummy(), "tokens", "tokens that have a lemma", TypeConverters.toListString)
    lemmas = Param(Params._dummy(), "lemmas", "the lemma of each token", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, tokens=None, lemmas=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _expression(self, col):
        from litscreen.operators.features import lemma_text

        return lemma_text(col, dict(zip(self.getOrDefault(self.tokens), self.getOrDefault(self.lemmas))))


class NgramTokens(_ColumnStage):
    """Word tokens of the vectoriser and their n-grams up to ``nMax``."""

    nMax = Param(Params._dummy(), "nMax", "longest n-gram", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, nMax=1):
        super().__init__()
        self._setDefault(nMax=1)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        words = f"{self.getOutputCol()}_words"
        tokens = dataset.withColumn(words, tx.word_tokens(F.coalesce(F.col(self.getInputCol()), F.lit(""))))
        grams = tx.word_ngrams(F.col(words), 1, self.getOrDefault(self.nMax))
        return tokens.withColumn(self.getOutputCol(), grams).drop(words)


def _margin(vector: Column, weights: np.ndarray, bias: float) -> Column:
    """The weighted sum of a sparse vector's entries plus ``bias``, vector by vector."""

    @F.arrow_udf("double")
    def run(vectors: pa.Array) -> pa.Array:
        # flattened fields know which vectors are null
        fields = dict(zip((f.name for f in vectors.type), vectors.flatten()))
        lists = fields["values"]
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        of = np.repeat(np.arange(len(lists)), sizes)
        places = fields["indices"].flatten().to_numpy(zero_copy_only=False)
        sums = np.bincount(of, lists.flatten().to_numpy(zero_copy_only=False) * weights[places], len(lists))
        return pa.array(sums + bias, mask=vectors.is_null().to_numpy(zero_copy_only=False))

    return run(vector)


class LogisticScorer(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Fitted logistic model: adds ``rawPrediction``, ``probability`` and ``prediction`` to rows with sparse ``features``."""

    weights = Param(Params._dummy(), "weights", "coefficient of each feature", TypeConverters.toListFloat)
    bias = Param(Params._dummy(), "bias", "intercept", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, weights=None, bias=0.0):
        super().__init__()
        self._setDefault(bias=0.0)
        self._set(**self._input_kwargs)

    @property
    def coefficients(self) -> DenseVector:
        return DenseVector(self.getOrDefault(self.weights))

    @property
    def intercept(self) -> float:
        return self.getOrDefault(self.bias)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        weights = np.array(self.getOrDefault(self.weights), float)
        margin, p = F.col("_margin"), 1 / (1 + F.exp(-F.col("_margin")))
        scored = dataset.withColumn("_margin", _margin(F.unwrap_udt("features"), weights, self.intercept))
        outputs = {
            "rawPrediction": array_to_vector(F.array(-margin, margin)),
            "probability": array_to_vector(F.array(1 - p, p)),
            "prediction": (margin > 0).cast("double"),
        }
        return scored.withColumns(outputs).drop("_margin")


class VoteSum(Transformer, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Parts of one forest vote together: their vote columns become ``rawPrediction``, ``probability`` and ``prediction``."""

    @keyword_only
    def __init__(self, *, inputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        arrays = [vector_to_array(name) for name in self.getInputCols()]
        votes, total = F.col("_votes"), F.aggregate("_votes", F.lit(0.0), lambda a, b: a + b)
        summed = dataset.withColumn("_votes", reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), arrays))
        outputs = {
            "rawPrediction": array_to_vector(votes),
            "probability": array_to_vector(F.transform(votes, lambda v: v / total)),
            "prediction": (F.array_position(votes, F.array_max(votes)) - 1).cast("double"),
        }
        return summed.withColumns(outputs).drop("_votes", *self.getInputCols())


class ThresholdPrediction(_ColumnStage):
    """1 where the probability of class 1 reaches ``threshold``."""

    threshold = Param(Params._dummy(), "threshold", "least probability of class 1", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCol="probability", outputCol="prediction", threshold=0.5):
        super().__init__()
        self._setDefault(inputCol="probability", outputCol="prediction", threshold=0.5)
        self._set(**self._input_kwargs)

    def _expression(self, col):
        return threshold_label(col, self.getOrDefault(self.threshold)).cast("double")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return super()._transform(dataset.drop(self.getOutputCol()))
