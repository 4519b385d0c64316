"""Records of delimited text whose quoted values hold line breaks, read by many tasks per file.

Whether a line break ends a record depends on the number of quotes before it in
the file. So every split of a file counts its quotes first; sums over the
splits before tell whether a split begins inside a value. Each task then joins
its own lines to records. What a record leaves to the next splits is put
together from one fragment at the head and one at the tail of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_HEAD, _INSIDE, _TAIL = 0, 1, 2  # a fragment ends a record, stands inside one, or begins one
_PIECES = "file string, block long, kind int, text string"


class _Split:
    """The lines of one split of a file, joined to records batch by batch."""

    def __init__(self, file: str, block: int, inside: int):
        self.file, self.block = file, block
        self.inside = inside  # whether the next line begins inside a value
        self.began = not inside  # whether the open record begins in this split
        self.open: list[str] = []  # its lines
        self.header = block == 0  # whether the header is still to come

    def add(self, lines: pa.Array) -> Iterator[tuple[int | None, list[str]]]:
        """``(None, records)`` and the fragment at the head of the split."""
        odd = pc.count_substring(lines, '"').to_numpy(zero_copy_only=False) & 1
        after = (self.inside + np.cumsum(odd)) & 1
        before = after ^ odd
        self.inside = int(after[-1])
        start = 0
        if self.header:
            closed = np.flatnonzero(after == 0)
            if not len(closed):
                return
            self.header, start = False, int(closed[0]) + 1
        whole = (before == 0) & (after == 0)
        whole[:start] = False
        records = lines.filter(pa.array(whole)).to_pylist()
        for i in np.flatnonzero(~whole[start:]) + start:
            self.open.append(lines[int(i)].as_py())
            if not after[i]:
                text, self.open = "\n".join(self.open), []
                if self.began:
                    records.append(text)
                else:
                    yield _HEAD, [text]
                self.began = True
        yield None, records

    def end(self) -> Iterator[tuple[int, list[str]]]:
        """The fragment at the tail, or a split that lies inside one record."""
        if self.open:
            yield (_TAIL if self.began else _INSIDE), ["\n".join(self.open)]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    split = None

    def rows(found: Iterator[tuple[int | None, list[str]]]) -> Iterator[pa.RecordBatch]:
        for kind, texts in found:
            n = len(texts)
            columns = [
                pa.array([split.file] * n, pa.string()),
                pa.array([split.block] * n, pa.int64()),
                pa.array([kind] * n, pa.int32()),
                pa.array(texts, pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["file", "block", "kind", "text"])

    for batch in batches:
        if not batch.num_rows:
            continue
        files, blocks = batch.column("file"), batch.column("block").to_numpy()
        other = (blocks[1:] != blocks[:-1]) | pc.not_equal(files[1:], files[:-1]).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(other) + 1).tolist(), batch.num_rows]
        for start, stop in zip(edges, edges[1:]):
            at = (files[start].as_py(), int(blocks[start]))
            if split is None or (split.file, split.block) != at:
                if split is not None:
                    yield from rows(split.end())
                split = _Split(*at, batch.column("inside")[start].as_py())
            yield from rows(split.add(batch.column("value").slice(start, stop - start)))
    if split is not None:
        yield from rows(split.end())


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """``record``: every record of the files at ``path`` but their headers and blank lines, as it is written.

    Line breaks are ``\\n`` or ``\\r\\n``. A quote may stand in a quoted value only,
    there doubled, as in every file whose writer quotes such values.
    """
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    counts = lines.groupBy("file", "block").agg((F.sum(quotes) % 2).alias("odd"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = (F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2).cast("int")
    # one row per split; a broadcast keeps the lines in their order
    placed = lines.join(F.broadcast(counts.select("file", "block", inside.alias("inside"))), ["file", "block"])
    pieces = placed.select("file", "block", "inside", "value").mapInArrow(_joined, _PIECES)

    # at most two fragments per split
    fragments = pieces.where("kind IS NOT NULL")
    upto = Window.partitionBy("file").orderBy("block", "kind")
    numbered = fragments.withColumn("number", F.count_if(F.col("kind") == _TAIL).over(upto))
    parts = F.array_sort(F.collect_list(F.struct("block", "kind", "text")))
    stitched = numbered.groupBy("file", "number").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))
    records = pieces.where("kind IS NULL").select("text").union(stitched.select("text"))
    return records.select(F.regexp_replace("text", r"\r\z", "").alias("record")).where("record <> ''")
