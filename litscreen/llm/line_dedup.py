"""Deduplication of repeated lines by winnowing.

A passage need not begin or end where a line does, so every word begins a line:
the ``min_words // 2`` or so words from it on. A window is a run of ``min_words``
words; it selects the smallest hash of the lines in it (of equal ones the last)
as its fingerprint, so equal windows select equal lines: any repeated run of
that many words is sure to share a fingerprint, though few lines are selected.

Only positions of selected lines leave the texts, and only those whose
fingerprint occurs twice. Such a position extends both ways to the first and
the last window that select it; the words of that stretch are compared by a
128-bit digest of their bytes, with a seed that is drawn per run. Positions with equal stretches are joined with
the first of them. Where stretches around one fingerprint differ, the windows
of the first position of every stretch are compared one by one. What stands
earlier is deleted where it stands later.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from secrets import randbits
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType
from xxhash import xxh3_128_digest

from litscreen.llm.common import byte_slices, stored, table

MIN_WORDS = 30
GROUP_BYTES = 1 << 20  # bytes of text that are worked on at a time
MOST_BITS = 1 << 28  # of a bitmap
BITS_EACH = 64  # of a bitmap, per hash that it holds
MARKS_HELD = 1 << 21  # fingerprints that a task packs at a time
CHUNK = 1 << 16  # bytes of a bitmap that travel as one row
LONG_WORD = 64  # bytes; longer words are hashed one by one
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_BLANKS = bytes(32 if c in (*range(9, 14), 32) else c for c in range(256))
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_KNOWN_POWERS: dict[int, np.ndarray] = {}
PLACE = ["doc_id", "text_hash", "at"]
DIGEST = ["high", "low"]


class Words(NamedTuple):
    """Words of several texts joined by line breaks: bytes, where words begin and end, the texts' starts and first words."""

    data: bytes
    begin: np.ndarray
    end: np.ndarray
    starts: np.ndarray
    bounds: np.ndarray


class Positions(NamedTuple):
    """Selected lines: fingerprint, text, first word of the first window that selects it, number of windows that do."""

    marks: np.ndarray
    text: np.ndarray
    word: np.ndarray
    count: np.ndarray


def _powers(step: np.uint64, count: int) -> np.ndarray:
    """The first powers of ``step``; those for the usual size are computed once."""
    known = _KNOWN_POWERS.get(int(step))
    if known is None or len(known) < count:
        size = max(count, GROUP_BYTES)
        known = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(size - 1, step, np.uint64))))
        if size == GROUP_BYTES:
            _KNOWN_POWERS[int(step)] = known
    return known[:count]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def split_words(texts: list[bytes]) -> Words:
    """Words stand between blanks; in scripts without blanks (Chinese, Japanese, Thai, Lao) every character is one."""
    data = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(data, np.uint8)
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])
    blank = (raw - np.uint8(9) < 5) | (raw == 32)
    change = np.empty(len(raw), bool)
    change[0] = not blank[0]
    np.not_equal(blank[1:], blank[:-1], out=change[1:])
    edges = np.flatnonzero(change)  # in turn where words begin and end
    begin, end = edges[::2], edges[1::2]
    high = np.flatnonzero(raw >= 0xE0)
    lead, second = raw[high], raw[np.minimum(high + 1, len(raw) - 1)]
    # first bytes, of three, of U+3000 to U+9FFF and U+0E00 to U+0EFF
    alone = high[((lead >= 0xE3) & (lead <= 0xE9)) | ((lead == 0xE0) & (second >= 0xB8) & (second <= 0xBB))]
    if len(alone):
        inside = alone[~blank[np.maximum(alone - 1, 0)] & (alone > 0)]  # behind a character that is no blank
        behind = alone + 3
        behind = behind[~blank[behind]]  # a blank follows every text
        cuts = np.union1d(inside, behind)
        cuts = cuts[~np.isin(cuts, begin)]
        begin, end = np.union1d(begin, cuts), np.union1d(end, cuts)
    return Words(data, begin, end, starts, np.searchsorted(begin, starts))


def word_hashes(words: Words) -> np.ndarray:
    """A hash of the bytes of every word, eight at a time."""
    eights = np.ndarray(len(words.data) + 1, "<u8", words.data + bytes(8), 0, (1,))  # eight bytes from each on
    size = words.end - words.begin
    hashes = size.astype(np.uint64)
    left, done = np.flatnonzero(size <= LONG_WORD), 0
    while len(left):
        some = eights[words.begin[left] + done] & _MASKS[np.minimum(size[left] - done, 8)]
        some = (hashes[left] ^ some) * _STEP
        hashes[left] = some ^ (some >> np.uint64(32))
        done += 8
        left = left[size[left] > done]
    for i in np.flatnonzero(size > LONG_WORD):
        digest = blake2b(words.data[words.begin[i] : words.end[i]], digest_size=8).digest()
        hashes[i] = np.uint64(int.from_bytes(digest, "little"))
    return hashes


def _line_hashes(words: Words, size: int) -> np.ndarray:
    """A hash of the ``size`` words from each word on, from sums of the words' hashes times powers."""
    hashes = word_hashes(words)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * _powers(_STEP, len(hashes)), dtype=np.uint64)))
    count = max(len(hashes) - size + 1, 0)
    return _mixed((sums[size : size + count] - sums[:count]) * _powers(_BACK, count))


def positions(words: Words, min_words: int) -> Positions:
    """The lines that windows of ``min_words`` words select; windows that select one line follow one another."""
    lines = 1 << ((min_words + 2) // 2).bit_length() - 1  # lines of a window, a power of two
    least = _line_hashes(words, min_words - lines + 1)
    chosen, hashes, step = np.arange(len(least)), least, 1
    while step < lines:
        better = least[step:] <= least[:-step]
        chosen = np.where(better, chosen[step:], chosen[:-step])
        least = np.where(better, least[step:], least[:-step])
        step *= 2
    text = np.repeat(np.arange(len(words.bounds) - 1), np.diff(words.bounds))
    inside = np.flatnonzero(text[: len(chosen)] == text[min_words - 1 :][: len(chosen)])  # windows of one text
    chosen, of = chosen[inside], text[inside]
    first = np.flatnonzero((np.diff(chosen, prepend=-1) != 0) | (np.diff(of, prepend=-1) != 0))
    return Positions(hashes[chosen[first]], of[first], inside[first], np.diff(np.append(first, len(inside))))


class _Digests:
    """Digests of stretches of words; the number and kind of the blanks between them do not count."""

    def __init__(self, words: Words, seed: int):
        self.seed = seed
        self.words, self.data = words, words.data.translate(_BLANKS)
        bounds = words.starts.tolist()
        self.uneven = np.array([self.data.find(b"  ", a, b - 1) >= 0 for a, b in zip(bounds, bounds[1:])], bool)

    def of(self, first: np.ndarray, behind: np.ndarray, text: np.ndarray) -> list[pa.Array]:
        """Two numbers for the words from each ``first`` on up to the one before ``behind``."""
        out = bytearray()
        begin, end = self.words.begin[first].tolist(), self.words.end[behind - 1].tolist()
        for b, e, uneven in zip(begin, end, self.uneven[text].tolist()):
            stretch = self.data[b:e]
            out += xxh3_128_digest(b" ".join(stretch.split()) if uneven else stretch, self.seed)
        pairs = np.frombuffer(bytes(out), np.int64).reshape(-1, 2)
        return [pa.array(np.ascontiguousarray(pairs[:, i])) for i in (0, 1)]


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of about ``GROUP_BYTES`` of text with their texts; a null text counts as empty."""
    for part in byte_slices(batch, "text", GROUP_BYTES):
        yield part, [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _repeated_marks(docs: DataFrame, min_words: int) -> DataFrame:
    """``mark``: the hashes of selected lines that stand in two places or more.

    They travel as packed arrays, one per range of hashes; a task that adds them
    up holds the hashes of its ranges, eight bytes each. A hash that stands in
    many places leaves a task twice at most.
    """
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def packed(marks: list[np.ndarray]) -> pa.RecordBatch:
        found, counts = np.unique(np.concatenate(marks), return_counts=True)
        found = np.repeat(found, np.minimum(counts, 2))
        bucket = ((found >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)  # ascending like the hashes
        edges = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
        full = np.flatnonzero(np.diff(edges))
        blobs = [found[edges[i] : edges[i + 1]].tobytes() for i in full.tolist()]
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "marks"])

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for _, texts in _groups(batch):
                marks.append(positions(split_words(texts), min_words).marks)
                held += len(marks[-1])
                if held > MARKS_HELD:
                    yield packed(marks)
                    marks, held = [], 0
        if marks:
            yield packed(marks)

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = [np.frombuffer(m, np.uint64) for batch in batches for m in batch.column("marks").to_pylist()]
        if marks:
            found, counts = np.unique(np.concatenate(marks), return_counts=True)
            yield pa.RecordBatch.from_arrays([_signed(found[counts > 1])], ["mark"])

    dealt = docs.select("text").mapInArrow(select, "bucket long, marks binary").repartition("bucket")
    return dealt.mapInArrow(repeated, "mark long")


def _place_key(text_hash: np.ndarray, at: np.ndarray) -> np.ndarray:
    return _mixed(text_hash.view(np.uint64) * _STEP + at.astype(np.uint64))


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """Bits at the low ends of a stored column of hashes, 32 MB at most: whatever is not set is not in the column.

    Every task sets the bits of its rows; the pieces are united by their number.
    """
    bits = min(max(1 << (BITS_EACH * hashes.count() // 2).bit_length(), 8 * CHUNK), MOST_BITS)

    def pieces(bitmap: np.ndarray) -> Iterator[pa.RecordBatch]:
        for number, piece in enumerate(bitmap.reshape(-1, CHUNK)):
            if piece.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int32()), pa.array([piece.tobytes()], pa.binary())], ["number", "piece"]
                )

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            at = batch.column(0).to_numpy() & (bits - 1)
            np.bitwise_or.at(bitmap, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        yield from pieces(bitmap)

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for number, piece in zip(*(column.to_pylist() for column in batch.columns)):
                bitmap[number * CHUNK : (number + 1) * CHUNK] |= np.frombuffer(piece, np.uint8)
        yield from pieces(bitmap)

    schema = "number int, piece binary"
    united = hashes.mapInArrow(set_bits, schema).repartition("number").mapInArrow(unite, schema)
    bitmap = np.zeros(bits // 8, np.uint8)
    for row in united.collect():  # MOST_BITS at most
        bitmap[row["number"] * CHUNK : (row["number"] + 1) * CHUNK] |= np.frombuffer(row["piece"], np.uint8)
    return bitmap


def _is_set(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes.view(np.int64) & (8 * len(bitmap) - 1)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _may_hold(bitmap: np.ndarray, spark):
    """Whether a column of hashes may be in the bitmap, as a function on columns."""
    shared = spark.sparkContext.broadcast(bitmap)

    @F.pandas_udf(BooleanType())
    def test(hashes: pd.Series) -> pd.Series:
        return pd.Series(_is_set(shared.value, hashes.to_numpy()))

    return test


def _places(part: pa.RecordBatch, words: Words, text: np.ndarray, first: np.ndarray) -> list[pa.Array]:
    of = pa.array(text, pa.int64())
    at = pa.array((first - words.bounds[text]).astype(np.int32))
    return [part.column("doc_id").take(of), part.column("text_hash").take(of), at]


def _stretches(docs: DataFrame, min_words: int, seed: int, repeated: np.ndarray) -> DataFrame:
    """``mark``, digest, ``n`` and place of the positions whose fingerprint may be in ``repeated``.

    The digest is that of the words from the first window to the last, ``n`` the number of windows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(repeated)

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _groups(batch):
                words = split_words(texts)
                found = positions(words, min_words)
                kept = np.flatnonzero(_is_set(shared.value, found.marks))
                marks, text, first, n = (column[kept] for column in found)
                digests = _Digests(words, seed).of(first, first + n + min_words - 1, text)
                columns = [_signed(marks), *digests, pa.array(n.astype(np.int32)), *_places(part, words, text, first)]
                yield pa.RecordBatch.from_arrays(columns, ["mark", *DIGEST, "n", *PLACE])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"mark long, high long, low long, n int, doc_id {kind}, text_hash long, at int"
    return docs.select("doc_id", "text_hash", "text").mapInArrow(select, schema)


def _windows(docs: DataFrame, min_words: int, seed: int, varied: np.ndarray, texts_of: np.ndarray, places: np.ndarray) -> DataFrame:
    """Digest and place of the windows of the positions whose fingerprint, text and place may be in the bitmaps."""
    shared = docs.sparkSession.sparkContext.broadcast((varied, texts_of, places))

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        varied, texts_of, places = shared.value
        for batch in batches:
            batch = batch.filter(pa.array(_is_set(texts_of, batch.column("text_hash").to_numpy())))
            for part, texts in _groups(batch):
                words = split_words(texts)
                found = positions(words, min_words)
                hashes = part.column("text_hash").to_numpy()
                key = _place_key(hashes[found.text], found.word - words.bounds[found.text])
                kept = np.flatnonzero(_is_set(varied, found.marks) & _is_set(places, key))
                n = found.count[kept]
                first = np.repeat(found.word[kept] - np.cumsum(n) + n, n) + np.arange(n.sum())
                text = np.repeat(found.text[kept], n)
                digests = _Digests(words, seed).of(first, first + min_words, text)
                yield pa.RecordBatch.from_arrays([*digests, *_places(part, words, text, first)], [*DIGEST, *PLACE])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"high long, low long, doc_id {kind}, text_hash long, at int"
    return docs.select("doc_id", "text_hash", "text").mapInArrow(select, schema)


def _place_keys(places: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([_signed(_place_key(*(c.to_numpy() for c in batch.columns)))], ["key"])

    return places.select("text_hash", "at").mapInArrow(run, "key long")


def _later(rows: DataFrame, groups: DataFrame, n: Column) -> DataFrame:
    """``doc_id, text_hash, match`` of every place in ``rows`` that is not the first with its digest.

    ``groups`` has first and last place and the number of places per digest. Of
    two places the last is the later one; only those of larger groups are joined.
    """
    spark = rows.sparkSession
    place = F.struct(*PLACE)
    two = groups.where("_count = 2 AND _last > _first").select(F.col("_last").alias("_place"), "_first", F.col("_n").alias("n"))
    many = stored(groups.where("_count > 2").select(*DIGEST, "_first"), "groups")
    held = _may_hold(_bitmap(many.select("high")), spark)
    joined = rows.where(held("high")).join(many, DIGEST).select(place.alias("_place"), "_first", n.alias("n"))
    both = joined.where("_place > _first").unionByName(two)
    same = F.col("_place.doc_id").eqNullSafe(F.col("_first.doc_id")) & (F.col("_place.text_hash") == F.col("_first.text_hash"))
    own = F.when(same, F.col("_first.at")).otherwise(-1)
    match = F.struct(F.col("_place.at").alias("at"), F.col("n").alias("n"), own.alias("own"))
    return both.select("_place.doc_id", "_place.text_hash", match.alias("match"))


def repeated_stretches(docs: DataFrame, min_words: int) -> DataFrame:
    """``doc_id, text_hash, found``: per text its windows that stand earlier already, as ``without_lines`` takes them.

    Earlier is the smaller id, then the smaller hash of the text, then the place
    in the text. Bitmaps only keep what cannot be repeated out of the shuffles.
    """
    seed = randbits(63)  # nobody can prepare texts whose digests meet
    repeated = _bitmap(stored(_repeated_marks(docs, min_words), "marks"))
    shared = stored(_stretches(docs, min_words, seed, repeated), "stretches")
    place = F.struct(*PLACE)
    ends = [F.min(place).alias("_first"), F.max(place).alias("_last"), F.count(F.lit(1)).alias("_count")]
    # equal digests have equal fingerprints
    classes = stored(shared.groupBy(*DIGEST).agg(*ends, F.max("n").alias("_n"), F.max("mark").alias("mark")), "classes")
    whole = _later(shared, classes, F.col("n"))
    # around one fingerprint different stretches: the windows of the first position of each
    varied = classes.groupBy("mark").agg(F.count(F.lit(1)).alias("_classes")).where("_classes > 1").select("mark")
    varied = _bitmap(stored(varied, "varied"))
    firsts = classes.where(_may_hold(varied, docs.sparkSession)("mark")).select("_first.text_hash", "_first.at")
    firsts = stored(firsts, "firsts")
    bitmaps = varied, _bitmap(firsts.select("text_hash")), _bitmap(_place_keys(firsts))
    windows = stored(_windows(docs, min_words, seed, *bitmaps), "windows")
    groups = windows.groupBy(*DIGEST).agg(*ends).withColumn("_n", F.lit(1)).where("_count > 1")
    single = _later(windows, stored(groups, "repeated"), F.lit(1))
    return whole.unionByName(single).groupBy("doc_id", "text_hash").agg(F.collect_list("match").alias("found"))


def without_lines(texts: list[bytes], matches: list[np.ndarray], min_words: int) -> list[bytes]:
    """The texts without the words of their matched windows.

    ``matches`` has, per text, rows ``at, n, own``: ``n`` windows from word ``at``
    on stand earlier; ``own`` is where the earlier ones begin, if that is in the
    same text, else -1. Of a window that overlaps the earlier one what lies
    behind that goes.
    """
    words = split_words(texts)
    at, n, own = np.concatenate(matches).T
    base = words.bounds[:-1][np.repeat(np.arange(len(texts)), [len(m) for m in matches])]
    # as a whole: of the first window what lies behind the earlier one, of every other one word more
    start = np.where(own >= 0, np.maximum(at, own + min_words), at)
    behind = at + n + min_words - 1
    some = start < behind
    change = np.zeros(len(words.begin) + 1, np.int32)
    np.add.at(change, (base + start)[some], 1)
    np.add.at(change, (base + behind)[some], -1)
    gone = np.cumsum(change[:-1]) > 0
    out = []
    for i, text in enumerate(texts):
        low, high = words.bounds[i], words.bounds[i + 1]
        edges = np.append(words.begin[low:high], words.starts[i + 1] - 1) - words.starts[i]  # a word goes up to the next one
        turns = np.flatnonzero(np.diff(gone[low:high], prepend=False, append=False))
        places = [0, *edges[turns].tolist(), len(text)]
        out.append(b"".join(text[a:b] for a, b in zip(places[::2], places[1::2])))
    return out


def drop_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS
) -> DataFrame:
    """``row`` (struct of the other columns), ``text`` and ``removed`` (bytes) for every row of ``docs``.

    Words are deleted that stand in a run of ``min_words`` words or more of which
    an equal run stands earlier, in another text or before in the same one,
    wherever it begins. Runs are equal if their bytes agree but for the kind and
    number of blanks between words. In scripts without blanks every character
    counts as a word. Shorter repeated lines stay, however frequent. Rows that
    agree in id and text are one text and get the same result; which row is
    earlier depends on id and text alone. Null and empty texts stay as they are,
    and so does every text without a repeated run, byte for byte. Very long texts
    are whole; an empty table gives no rows; other columns may have any names.

    ``docs`` must read a table, as it is evaluated five times.
    """
    text = F.col(text_col)
    others = [F.col(c) for c in docs.columns if c != text_col]
    rows = docs.select(
        F.struct(*others).alias("row"), F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")
    )
    found = stored(repeated_stretches(rows.drop("row"), min_words), "found").select(
        F.col("doc_id").alias("_doc_id"), F.col("text_hash").alias("_text_hash"), "found"
    )
    changes = _may_hold(_bitmap(found.select("_text_hash")), docs.sparkSession)

    same = rows["doc_id"].eqNullSafe(found["_doc_id"]) & (rows["text_hash"] == found["_text_hash"])
    # texts without a match are not shuffled
    joined = rows.where(changes("text_hash")).join(found, same, "left").select("row", "text", "found")
    rest = rows.where(~changes("text_hash")).select("row", "text", F.lit(None).cast(joined.schema["found"].dataType).alias("found"))
    joined = joined.unionByName(rest)

    def delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _groups(batch):
                found = part.column("found")
                changed = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
                removed = np.zeros(part.num_rows, np.int64)
                text = part.column("text")
                if len(changed):
                    matches = []
                    for i in changed.tolist():
                        entries = found[i].values
                        matches.append(np.column_stack([entries.field(j).to_numpy() for j in range(3)]).astype(np.int64))
                    before = [texts[i] for i in changed.tolist()]
                    after = without_lines(before, matches, min_words)
                    removed[changed] = [len(a) - len(b) for a, b in zip(before, after)]
                    mask = pa.array(found.is_valid())
                    text = pc.replace_with_mask(text, mask, pa.array([a.decode() for a in after], text.type))
                yield pa.RecordBatch.from_arrays([part.column("row"), text, pa.array(removed)], ["row", "text", "removed"])

    schema = StructType([joined.schema["row"], StructField("text", StringType()), StructField("removed", LongType())])
    return joined.mapInArrow(delete, schema)


def op3_line_dedup(spark, sf_dir):
    """All documents without their later repeated runs: new text, its size and how much went.

    Python workers get batches of 4 MB, from here on in the session.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    done = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        F.col("row.doc_id").alias("doc_id"),
        "text",
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"),
        F.col("removed").alias("removed_bytes"),
    )
