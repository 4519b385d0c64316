"""Best-fit packing of tokenised documents by exact complements.

The plan is made on the number of pieces per length (at most ``capacity``
numbers), not on pieces: a sequence layout is a list of lengths, used as often
as the counts allow. From the longest length down, the gap of a piece is filled
exactly by one length, else by a pair, else by a triple from the indexes of
sums, in bulk. What no combination fills exactly is packed best-fit, longest
first. Pieces are then numbered within their length, and a number is looked up
in the plan's intervals: that is a join of two bounded tables, whatever the
number of documents.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litscreen.llm.common import byte_slices, numbered_within, stored, table
from litscreen.llm.tokens import CachedTokenizer, in_worker

CAPACITY = 2048
END_ID = 0
BUCKET_ROWS = 200_000  # pieces of the most frequent length that a task numbers
SLICE_BYTES = 1 << 20  # of texts whose ids a worker holds at a time
TOKENIZER = "byte_bpe_50k.json"
PIECES = "row long, doc_id {}, piece int, start long, length long, ids_crc32 long, ids binary"

Layout = tuple[tuple[int, ...], int]


def exact_layouts(counts: np.ndarray, most: int = 3, even: bool = False) -> list[Layout]:
    """Layouts that fill a sequence exactly; takes what they use out of ``counts`` (by length, 0 to capacity).

    A gap is filled by ``most`` pieces at most. Of the pairs of one sum the most
    uneven is taken first, or with ``even`` the most even.
    """
    capacity = len(counts) - 1
    layouts: list[Layout] = []

    def take(lengths: tuple[int, ...]) -> None:
        need = np.bincount(lengths, minlength=capacity + 1)
        used = np.flatnonzero(need)
        times = int((counts[used] // need[used]).min())
        counts[used] -= need[used] * times
        layouts.append((lengths, times))

    def enough(lengths: tuple[int, ...]) -> bool:
        return all(counts[x] >= lengths.count(x) for x in lengths)

    def pair(total: int, first: int) -> tuple[int, int] | None:
        """Two available lengths of that sum, besides one piece of ``first``."""
        larger = np.arange(total - 1, (total - 1) // 2, -1)[:: -1 if even else 1]
        larger = larger[larger <= capacity]
        good = larger[(counts[larger] > 0) & (counts[total - larger] > 0)]
        for x in good:
            if enough((first, int(x), total - int(x))):
                return int(x), total - int(x)
        return None

    for length in range(capacity, 0, -1):
        while counts[length]:
            gap = capacity - length
            if not gap:
                take((length,))
            elif most and enough((length, gap)):
                take((length, gap))
            elif most > 1 and (found := pair(gap, length)):
                take((length, *found))
            elif most < 3:
                break
            else:
                for third in np.flatnonzero(counts[1 : max(gap - 1, 1)])[::-1] + 1:
                    third = int(third)
                    found = pair(gap - third, length)
                    if found and enough((length, third, *found)):
                        take((length, third, *found))
                        break
                else:
                    break
    return layouts


def best_fit_layouts(counts: np.ndarray) -> list[Layout]:
    """Longest first, each piece into the open sequence that it fills most; empties ``counts``."""
    capacity = len(counts) - 1
    open_by_gap: dict[int, list[Layout]] = {}
    gaps: list[int] = []

    def add(gap: int, layout: Layout) -> None:
        if gap not in open_by_gap:
            insort(gaps, gap)
            open_by_gap[gap] = []
        open_by_gap[gap].append(layout)

    for length in range(capacity, 0, -1):
        left = int(counts[length])
        counts[length] = 0
        while left:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                fit = min(capacity // length, left)
                times = left // fit
                add(capacity - fit * length, ((length,) * fit, times))
                left -= fit * times
                continue
            gap = gaps[at]
            lengths, times = open_by_gap[gap].pop()
            if not open_by_gap[gap]:
                del open_by_gap[gap], gaps[at]
            used = min(times, left)
            if times > used:
                add(gap, (lengths, times - used))
            add(gap - length, ((*lengths, length), used))
            left -= used
    return [layout for layouts in open_by_gap.values() for layout in layouts]


def plan_layouts(counts: np.ndarray) -> list[Layout]:
    """Layouts for ``counts`` pieces of every length from 0 to the capacity.

    Exact fillings first, then best fit. Fillings of up to three, two and one
    pieces are tried, and the plan with the fewest sequences is taken; one that
    meets the lower bound ends the search.
    """
    capacity = len(counts) - 1
    lengths = np.arange(capacity + 1)
    least = max(-(-int(counts @ lengths) // capacity), int(counts[2 * lengths > capacity].sum()))
    best, fewest = [], None
    for most, even in ((3, False), (3, True), (2, True), (2, False), (1, False)):
        left = counts.copy()
        layouts = [layout for layout in exact_layouts(left, most, even) + best_fit_layouts(left) if layout[1]]
        total = sum(times for _, times in layouts)
        if fewest is None or total < fewest:
            best, fewest = layouts, total
        if fewest == least:
            break
    return best


def plan_intervals(layouts: list[Layout], capacity: int) -> dict[int, np.ndarray]:
    """Per length: rows ``first number, first sequence, offset`` of consecutive pieces, by number."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    used = dict.fromkeys(range(capacity + 1), 0)
    sequence = 0
    for lengths, times in layouts:
        offset = 0
        for length in lengths:
            rows.setdefault(length, []).append((used[length], sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    return {length: np.array(r, np.int64) for length, r in rows.items()}


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a stored table of ``row, piece, length`` and other columns.

    Every piece (length 1 to ``capacity``) gets a place; the pieces of a
    sequence stand one after the other from 0. ``row`` and ``piece`` name a piece.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().toLocalIterator():  # at most ``capacity`` rows
        counts[length] = n
    intervals = plan_intervals(plan_layouts(counts), capacity)
    shared = pieces.sparkSession.sparkContext.broadcast(intervals)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for batch in batches:
            lengths = batch.column("length").to_numpy(zero_copy_only=False)
            numbers = batch.column("_number").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for length in np.unique(lengths):
                mine = lengths == length
                rows = plan[int(length)]
                at = np.searchsorted(rows[:, 0], numbers[mine], "right") - 1
                sequence[mine] = rows[at, 1] + numbers[mine] - rows[at, 0]
                offset[mine] = rows[at, 2]
            kept = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "_number"]
            names = [name for name in batch.schema.names if name != "_number"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    buckets = 64 + int(counts.max()) // BUCKET_ROWS
    numbered = numbered_within(pieces, "length", ["row", "piece"], "_number", buckets)
    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"
    return numbered.mapInArrow(place, schema)


def _tokenizer(path: str | None) -> CachedTokenizer:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    return in_worker(f"tokenizer {path}", lambda: CachedTokenizer(path))


def tokenize_pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    tokenizer_path: str | None = None,
    end_id: int = END_ID,
    with_ids: bool = True,
) -> DataFrame:
    """Pieces of every document: ``row, doc_id, piece, start, length, ids_crc32, ids``.

    A document is the ids of its whole text and ``end_id``. One longer than
    ``capacity`` is cut into full pieces, the first of which may be shorter.
    ``ids`` are little-endian unsigned 32-bit numbers (null without
    ``with_ids``). ``row`` numbers the rows of ``docs``, so repeated rows and null
    ids are documents of their own. A null text counts as empty: ``end_id`` alone.
    ``tokenizer_path`` must name the file on every executor; without it, each
    takes the one of its installed package.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(tokenizer_path)
        end = np.array([end_id], "<u4")
        for batch in (part for whole in batches for part in byte_slices(whole, "text", SLICE_BYTES)):
            texts = [b"" if t is None else t.encode() for t in batch.column("text").to_pylist()]
            at, piece, start, length, crc, data = [], [], [], [], [], []
            for i, ids in enumerate(tokenizer.encode_all(texts)):
                ids = np.concatenate((ids.astype("<u4", copy=False), end))
                first = (len(ids) - 1) % capacity + 1
                lower = 0
                for number, upper in enumerate(range(first, len(ids) + 1, capacity)):
                    raw = ids[lower:upper].tobytes()
                    at.append(i)
                    piece.append(number)
                    start.append(lower)
                    length.append(upper - lower)
                    crc.append(zlib.crc32(raw))
                    data.append(raw if with_ids else None)
                    lower = upper
            columns = [
                batch.column("row").take(pa.array(at, pa.int64())),
                batch.column("doc_id").take(pa.array(at, pa.int64())),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()),
                pa.array(data, pa.binary()),
            ]
            names = ["row", "doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")
    )
    return rows.mapInArrow(cut, PIECES.format(rows.schema["doc_id"].dataType.simpleString()))


def pack_documents(docs: DataFrame, with_ids: bool = True, **options) -> DataFrame:
    """``tokenize_pieces`` with the place of every piece: ``sequence_id`` and ``offset``.

    Texts are tokenised once; their pieces are stored below the shared
    checkpoint folder. Places are found without the ids. An empty table gives no rows.
    """
    pieces = tokenize_pieces(docs, with_ids=with_ids, **options)
    pieces = stored(pieces if with_ids else pieces.drop("ids"), "pieces")
    placed = pack_pieces(pieces.drop("ids"), options.get("capacity", CAPACITY))
    if with_ids:  # ids are shuffled once, to their places
        placed = placed.join(pieces.select("row", "piece", "ids"), ["row", "piece"])
    return placed.drop("row")


def op10_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), with_ids=False)
