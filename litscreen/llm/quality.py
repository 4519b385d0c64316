"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text train a logistic model that minimises
the non-negative unbiased risk ``pi * E_p[l(+)] + max(0, E_u[l(-)] - pi * E_p[l(-)])``
with the estimated class prior ``pi``. Features are taken from the whole text:
shares of its characters and statistics of its words and lines.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from litscreen.llm.common import byte_slices, table

#: bounds of the sample that the model is fitted on, in rows
SAMPLE_ROWS = 8_000
THRESHOLD = 0.3
SLICE_BYTES = 4 << 20  # texts that are scored at a time
_STATISTICS = 14
FEATURES = 129 + _STATISTICS


def text_features(data: bytes | None) -> np.ndarray:
    """Numbers that describe the whole text; none counts as empty."""
    data = data or b""
    out = np.zeros(FEATURES)
    if not data:
        return out
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    out[:128] = np.log1p(100 * counts[:128] / len(data))
    out[128] = np.log1p(100 * counts[128:].sum() / len(data))
    words = data.split()
    lines = [line for line in data.split(b"\n") if line.strip()]
    n = max(len(words), 1)
    distinct = len(set(words)) / n
    letters = counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum()
    out[129:] = (
        np.log1p(len(words)),
        len(data) / n,
        distinct,
        distinct * np.log1p(len(words)),
        letters / len(data),
        counts[65:91].sum() / max(letters, 1),
        counts[48:58].sum() / len(data),
        len(set(lines)) / max(len(lines), 1),
        np.log1p(len(words) / max(len(lines), 1)),
        sum(map(bytes.isupper, words)) / n,
        np.log1p(max(map(len, words), default=0)),
        sum(w[-1:] in (b".", b",", b"!", b"?", b":", b";") for w in words) / n,
        sum(map(eq, words, words[1:])) / n,
        sum(map(eq, words, words[2:])) / n,
    )
    return out


class Model(NamedTuple):
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, features: np.ndarray) -> np.ndarray:
        # row by row, so that a score does not depend on the rows beside it
        return _sigmoid((np.clip((features - self.centre) / self.scale, -8, 8) * self.weights).sum(1) + self.bias)


def _scaled(positive: np.ndarray, unlabelled: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Centre and scale of the unlabelled rows, and both samples by them, with a column of ones."""
    centre, scale = unlabelled.mean(0), np.maximum(unlabelled.std(0), 1e-3)
    p, u = (np.clip((x - centre) / scale, -8, 8) for x in (positive, unlabelled))
    return centre, scale, *(np.hstack([x, np.ones((len(x), 1))]) for x in (p, u))


def _descend(w: np.ndarray, gradient_at: Callable[[np.ndarray], np.ndarray], steps: int, rate: float, decay: float) -> np.ndarray:
    """Adam from ``w`` on; no randomness."""
    m, v = np.zeros(len(w)), np.zeros(len(w))
    for step in range(1, steps + 1):
        gradient = gradient_at(w) + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def fit_nnpu(
    positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 800, rate: float = 0.03, decay: float = 1e-3
) -> Model:
    """Minimise the non-negative risk with logistic loss.

    When the estimated risk of the negatives falls below zero, the step goes
    against it, as in the non-negative estimator. Without positives or
    unlabelled rows every score is the prior.
    """
    size = positive.shape[1] if positive.size else unlabelled.shape[1]
    bias = np.log(prior / (1 - prior))
    if not len(positive) or not len(unlabelled):
        zero = np.zeros(size)
        return Model(zero, np.ones(size), zero, float(bias), prior)
    centre, scale, p, u = _scaled(positive, unlabelled)

    def gradient_at(w: np.ndarray) -> np.ndarray:
        sp, su = _sigmoid(p @ w), _sigmoid(u @ w)
        on_positive = prior * ((sp - 1) @ p) / len(p)
        negative = su @ u / len(u) - prior * (sp @ p) / len(p)
        risk = -np.log1p(-np.minimum(su, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-12)).mean()
        return on_positive + negative if risk >= 0 else -negative

    w = _descend(np.append(np.zeros(size), bias), gradient_at, steps, rate, decay)
    return Model(centre, scale, w[:-1], float(w[-1]), prior)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Estimated share of positives among the unlabelled rows, from 0.05 to 0.95; 0.5 without rows of either kind.

    A model is fitted on one half of each sample. Above any cut of its scores the
    unlabelled rows of the other half are at least the prior times as frequent
    as the positives, and about so where hardly a negative is left. Of the cuts
    that leave half to nearly all of the positives, the one is taken at which
    the ratio of both shares plus its standard error is least; the ratio there is
    the estimate.
    """
    if len(positive) < 2 or len(unlabelled) < 2:
        return 0.5
    model = fit_nnpu(positive[::2], unlabelled[::2], 0.5)
    on_p, on_u = model.score(positive[1::2]), np.sort(model.score(unlabelled[1::2]))
    shares = np.linspace(0.5, 0.99, 50)
    above = 1 - np.searchsorted(on_u, np.quantile(on_p, 1 - shares)) / len(on_u)
    ratio = above / shares
    error = np.sqrt(above * (1 - above) / len(on_u)) / shares + ratio * np.sqrt((1 - shares) / (shares * len(on_p)))
    return float(np.clip(ratio[np.argmin(ratio + error)], 0.05, 0.95))


def _bytes_of(texts: pa.Array) -> Iterator[list[bytes]]:
    """The texts in lists of bounded size; a null text counts as empty."""
    batch = pa.RecordBatch.from_arrays([texts], ["text"])
    for part in byte_slices(batch, "text", SLICE_BYTES):
        yield [t or b"" for t in part.column(0).cast(pa.binary()).to_pylist()]


def score_udf(model: Model):
    @F.arrow_udf(DoubleType())
    def of(texts: pa.Array) -> pa.Array:
        scores = [model.score(np.array([text_features(t) for t in part])) for part in _bytes_of(texts)]
        return pa.array(np.concatenate([np.zeros(0), *scores]))

    return of


def _features_udf():
    @F.arrow_udf(ArrayType(DoubleType()))
    def of(texts: pa.Array) -> pa.Array:
        rows = [text_features(t) for part in _bytes_of(texts) for t in part]
        flat = np.concatenate([np.zeros(0), *rows])
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, FEATURES, dtype=np.int32)), pa.array(flat))

    return of


def train_quality(
    docs: DataFrame,
    positives: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample_rows: int = SAMPLE_ROWS,
) -> Model:
    """Fit the model on at most ``sample_rows`` positives and as many unlabelled rows.

    ``positives`` has the ids (``id_col``) of trusted positives. Both samples are
    the rows whose hashed ids are smallest, so they depend on the ids alone, and
    only their features, not their texts, reach the driver. The class prior is
    estimated from the same two samples; no negative label is read.
    """
    ids = F.col(id_col)

    def sampled(rows: DataFrame, kind: int) -> DataFrame:
        chosen = rows.select(ids).where(ids.isNotNull()).orderBy(F.xxhash64(ids, F.lit(kind)), ids).limit(sample_rows)
        return chosen.distinct().select(ids.alias("_id"), F.lit(kind).alias("_kind"))

    samples = sampled(positives, 1).unionByName(sampled(docs, 0))  # at most twice sample_rows ids
    found = docs.select(ids, F.col(text_col)).join(F.broadcast(samples), ids == F.col("_id"))
    rows = found.select("_kind", "_id", _features_udf()(F.col(text_col)).alias("_features"))

    def fetched(kind: int) -> np.ndarray:
        mine = rows.where(F.col("_kind") == kind).orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
        table_of = mine.select("_features").toArrow()
        flat = table_of.column(0).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(-1, FEATURES)

    positive, unlabelled = fetched(1), fetched(0)
    return fit_nnpu(positive, unlabelled, class_prior(positive, unlabelled))


def held_out(doc_id: Column) -> Column:
    """True for the rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % 5 == 0


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    """Model from the positive labels of the rows that are not held out; null labels are no labels."""
    positives = labels.where(~held_out(F.col("doc_id")) & (F.col("quality") == 1)).select("doc_id")
    return train_quality(docs.where(~held_out(F.col("doc_id"))), positives)


def score_quality(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``row`` (struct of all columns), ``score`` and ``predicted`` for every row, whole texts.

    Null and empty texts are scored like any other, with features of zero;
    repeated rows get equal scores; the text is the only input of a score. Very
    long texts are whole; an empty table gives no rows; other columns may have
    any names.
    """
    scored = docs.select(F.struct("*").alias("row"), score_udf(model)(F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op4_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, fitted(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        F.col("row.doc_id").alias("doc_id"), held_out(F.col("row.doc_id")).alias("held_out"), "score", "predicted"
    )
