"""The most frequent terms of a corpus with their document frequencies, in two passes of bounded memory.

The first pass counts hash buckets of terms. A term comes up at most as often
as its bucket, so only the terms of full buckets can be among the most
frequent; the second pass counts those, exactly. If the last wanted count does
not reach what was taken for a full bucket, that pass is made anew with less.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 19
PARTS = 16  # of the buckets, for their sums
TASKS_A_CORE = 4  # that count buckets
CAPACITY = 1 << 18  # terms that a task holds; the rarest leave it with their counts, and are added up after the shuffle
FRESH_TERMS = 1 << 16  # counts of slices that wait to be added to those of the task
SENT_TERMS = 1 << 13  # of a task's counts in one batch
SLICE_ROWS = 2_000


class Vocabulary(NamedTuple):
    """Terms in alphabetical order, their numbers of occurrences and of documents, and the number of all documents."""

    terms: Sequence[str]
    counts: Sequence[int]
    documents: Sequence[int]
    n_documents: int

    def inverse_document_frequency(self) -> np.ndarray:
        """ln((1 + n) / (1 + df)) + 1 of every term."""
        return np.log((1 + self.n_documents) / (1 + np.array(self.documents, float))) + 1


def _slice_counts(lists: pa.Array, wanted: np.ndarray, groups: np.ndarray | None, n_groups: int) -> pa.Table:
    """``term, n, df`` of the wanted places of a few rows; with ``groups`` (one per row) also ``n_0 ...``, the occurrences by group."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(lists)
    known = flat.is_valid().to_numpy(zero_copy_only=False) & wanted
    of = np.repeat(np.arange(len(lists)), sizes)[known]
    encoded = flat.filter(pa.array(known)).dictionary_encode()
    codes, width = encoded.indices.to_numpy().astype(np.int64), len(encoded.dictionary)
    held = np.bincount(np.unique(of * max(width, 1) + codes) % max(width, 1), minlength=width)
    columns = {"term": encoded.dictionary, "n": np.bincount(codes, minlength=width), "df": held}
    for group in range(n_groups):
        columns[f"n_{group}"] = np.bincount(codes[groups[of] == group], minlength=width)
    return pa.table(columns)


def _hashed(tokens: DataFrame, column: str, group: str | None) -> DataFrame:
    return tokens.select(F.transform(column, lambda term: F.hash(term)).alias("hashes"), F.col(column).alias("terms"), *[group] * bool(group))


def _groups(batch: pa.RecordBatch, group: str | None) -> np.ndarray | None:
    return batch.column(group).fill_null(-1).to_numpy(zero_copy_only=False) if group else None


def _bucket_counts(hashed: DataFrame, buckets: int, group: str | None, n_groups: int) -> np.ndarray:
    """How often the terms of every bucket come up, in all rows and then by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((1 + n_groups, buckets), np.int64)
        for batch in batches:
            lists, groups = batch.column("hashes"), _groups(batch, group)
            codes = np.mod(pc.list_flatten(lists).to_numpy(zero_copy_only=False), buckets).astype(np.int64)
            # a batch has few terms for the buckets there are
            np.add.at(sums[0], codes, 1)
            if group:
                sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                of = np.repeat(groups, sizes)
                for number in range(n_groups):
                    np.add.at(sums[1 + number], codes[of == number], 1)
        for number, part in enumerate(np.array_split(sums.ravel(), PARTS)):
            yield pa.RecordBatch.from_pydict({"part": pa.array([number], pa.int32()), "sums": pa.array([part.tobytes()], pa.binary())})

    # every task gives all buckets, so there are no more tasks than keep the cores busy
    tasks = TASKS_A_CORE * hashed.sparkSession.sparkContext.defaultParallelism
    found = hashed.select("hashes", *[group] * bool(group)).coalesce(tasks).mapInArrow(run, "part int, sums binary").rdd
    added = found.map(lambda row: (row[0], np.frombuffer(row[1], np.int64))).reduceByKey(lambda a, b: a + b, PARTS).collectAsMap()
    if not added:
        return np.zeros((1 + n_groups, buckets), np.int64)
    return np.concatenate([added[part] for part in range(PARTS)]).reshape(1 + n_groups, buckets)


def _partial_counts(hashed: DataFrame, wanted: np.ndarray, capacity: int, group: str | None = None, n_groups: int = 0) -> DataFrame:
    """Counts of the terms of wanted buckets as they leave the tasks, a term possibly more than once; the row without term has the rows as ``df``."""
    bits, buckets = np.packbits(wanted).tobytes(), len(wanted)
    names = ["n", "df", *[f"n_{g}" for g in range(n_groups)]]

    def rarest_out(counts: pa.Table) -> tuple[pa.Table, pa.Table]:
        n = counts.column("n").to_numpy()
        order = np.argpartition(n, len(n) - capacity // 2)
        frequent = order[len(n) - capacity // 2 :]
        return counts.take(pa.array(frequent)), counts.take(pa.array(order[: len(n) - capacity // 2]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, fresh, n_rows = None, [], 0
        full = np.unpackbits(np.frombuffer(bits, np.uint8), count=buckets).astype(bool)

        def merged() -> pa.Table:
            both = pa.concat_tables([counts, *fresh] if counts is not None else fresh).group_by("term", use_threads=False)
            return both.aggregate([(name, "sum") for name in names]).rename_columns(["term", *names])

        for batch in batches:
            n_rows += batch.num_rows
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                codes = np.mod(pc.list_flatten(part.column("hashes")).to_numpy(zero_copy_only=False), buckets)
                fresh.append(_slice_counts(part.column("terms"), full[codes], _groups(part, group), n_groups))
            if sum(new.num_rows for new in fresh) > FRESH_TERMS:
                counts, fresh = merged(), []
                if counts.num_rows > capacity:
                    counts, rare = rarest_out(counts)
                    yield from rare.combine_chunks().to_batches(SENT_TERMS)
        if fresh:
            counts = merged()
        if counts is not None:
            yield from counts.combine_chunks().to_batches(SENT_TERMS)
        whole = {"term": pa.array([None], pa.string())} | {name: pa.array([n_rows * (name == "df")], pa.int64()) for name in names}
        yield pa.RecordBatch.from_pydict(whole)

    schema = ", ".join(["term string", *[f"{name} long" for name in names]])
    return hashed.mapInArrow(run, schema)


def _most_frequent(tokens: DataFrame, column: str, most: int, buckets: int, group: str | None = None, n_groups: int = 0) -> list[list]:
    """Rows ``term, n, df`` of the most frequent terms, the row without term among them; with a group, per group those of all other rows."""
    hashed = _hashed(tokens, column, group)
    sums = _bucket_counts(hashed, buckets, group, n_groups)
    rest = [sums[0] - own for own in sums[1:]] if group else [sums[0]]
    # half the count of the bucket in the place of the last wanted term
    least = [int(np.partition(r, -most)[-most]) // 2 if most < buckets else 0 for r in rest]
    while True:
        wanted = np.logical_or.reduce([r >= max(at, 1) for r, at in zip(rest, least)])
        parts = _partial_counts(hashed, wanted, CAPACITY, group, n_groups)
        names = ["n", "df", *[f"n_{g}" for g in range(n_groups)]]
        counts = parts.groupBy("term").agg(*[F.sum(name).alias(name) for name in names]).persist()
        try:
            tops = []
            for number in range(len(rest)):
                n = F.col("n") - F.col(f"n_{number}") if group else F.col("n")
                # every task keeps its best terms alone; nothing is sorted as a whole
                best = counts.select("term", n.alias("n"), "df").where("term IS NULL OR n > 0")
                tops.append(best.orderBy(F.col("term").isNotNull(), F.col("n").desc(), "term").limit(most + 1).collect())
        finally:
            counts.unpersist()
        last = [top[-1]["n"] if len(top) > most else 0 for top in tops]
        if all(at <= 1 or n >= at for at, n in zip(least, last)):
            return tops
        least = [at // 4 for at in least]


def learn_vocabulary(tokens: DataFrame, column: str, max_features: int, buckets: int = BUCKETS) -> Vocabulary:
    """The ``max_features`` most frequent terms of a list column.

    Ties in frequency go to the alphabetically first term. NULL terms are none;
    a NULL list is a document without terms. ``max_features`` rows and the
    counts of the buckets reach the driver.
    """
    (top,) = _most_frequent(tokens, column, max_features, buckets)
    n_rows = sum(row["df"] for row in top if row["term"] is None)
    rows = sorted((row for row in top if row["term"] is not None), key=lambda row: row["term"].encode())
    return Vocabulary([r["term"] for r in rows], [r["n"] for r in rows], [r["df"] for r in rows], n_rows)


def fold_vocabularies(tokens: DataFrame, column: str, n_folds: int, max_features: int, buckets: int = BUCKETS) -> list[list[str]]:
    """Per fold the top terms of its training rows, the most frequent first, from one count over all rows with a ``fold``.

    A term's count on the training rows is its total without the fold's own
    count. Ties go to the alphabetically first term. At most ``max_features``
    terms per fold reach the driver.
    """
    tops = _most_frequent(tokens.where("fold IS NOT NULL"), column, max_features, buckets, "fold", n_folds)
    return [[r["term"] for r in sorted((r for r in top if r["term"] is not None), key=lambda r: (-r["n"], r["term"].encode()))] for top in tops]
