"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The test strings are windows of consecutive benchmark words. For each length of
window there is a shift table over blocks of two words: how far the search may
jump when a block ends at the current position. A block that ends a window has
shift 0; its suffix bucket lists the windows to compare word by word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litscreen.llm.common import stored, table

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: every byte that stands in no word becomes a blank, upper case becomes lower case
_BLANKED = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 32
    for c in range(256)
)
WINDOW = 10
#: bytes of benchmark text that one pass over the documents searches for
PASS_BYTES = 16 << 20


def words_of(text: str | None) -> list[bytes]:
    """The words of ``WORD`` in the text with A-Z lower-cased; a null text has none."""
    return text.encode().translate(_BLANKED).split() if text else []


class Patterns:
    """Tables for the windows of one length."""

    def __init__(self, length: int):
        self.length = length
        self.block = min(2, length)
        self.most = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], dict[tuple[bytes, ...], set[int]]] = {}

    def add(self, window: tuple[bytes, ...], item: int) -> None:
        n, b = self.length, self.block
        for end in range(b, n + 1):
            key = window[end - b : end]
            self.shift[key] = min(self.shift.get(key, self.most), n - end)
        self.bucket.setdefault(window[n - b :], {}).setdefault(window, set()).add(item)

    def search(self, words: list[bytes]) -> Iterator[tuple[int, set[int]]]:
        """Start and items of every occurrence."""
        n, b, most = self.length, self.block, self.most
        shift, at = self.shift.get, n
        if b == 1:
            blocks = [(w,) for w in words]
        else:
            blocks = [(), *zip(words, words[1:])]
        while at <= len(words):
            jump = shift(blocks[at - 1], most)
            if jump:
                at += jump
                continue
            items = self.bucket[blocks[at - 1]].get(tuple(words[at - n : at]))
            if items:
                yield at - n, items
            at += 1


def build_patterns(items: list[tuple[int, str | None]], window: int) -> list[Patterns]:
    """Tables per window length. ``items``: number and text of each item."""
    by_length: dict[int, Patterns] = {}
    for number, text in items:
        words = words_of(text)
        n = min(window, len(words))
        for start in range(len(words) - n + 1 if n else 0):
            by_length.setdefault(n, Patterns(n)).add(tuple(words[start : start + n]), number)
    return list(by_length.values())


def find_windows(text: str | None, patterns: list[Patterns]) -> tuple[int, list[tuple[int, int]], set[int]]:
    """Number of words, hit spans of words (sorted, disjoint) and items found."""
    words = words_of(text)
    spans, found = [], set()
    for tables in patterns:
        for start, items in tables.search(words):
            spans.append((start, start + tables.length))
            found |= items
    return len(words), merged(spans), found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def _item_passes(benchmark: DataFrame, id_col: str, text_col: str, pass_bytes: int) -> Iterator[list[tuple]]:
    """Lists of ``(id, text)``, each of a text total of about ``pass_bytes`` at most."""
    items, size = [], 0
    for row in benchmark.select(F.col(id_col).cast("string"), F.col(text_col)).distinct().toLocalIterator():
        items.append((row[0], row[1]))
        size += len(row[1] or "") + 64
        if size >= pass_bytes:
            yield items
            items, size = [], 0
    if items:
        yield items


SPANS = "array<struct<start:int,end:int>>"


def find_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    pass_bytes: int = PASS_BYTES,
    with_text: bool = True,
) -> DataFrame:
    """``row, text, n_words, spans, items`` for every row of ``docs``.

    ``row`` is a struct of the other columns, whatever their names. ``text`` is
    left out without ``with_text``. A window is ``window`` consecutive words of
    an item; an item of fewer words, but not none, is one window. ``spans`` are
    the hit words (from 0, end exclusive), ``items`` the ids, as sorted strings,
    of the items that occur; a null id counts as the string ''.

    The driver holds two passes of benchmark text at most; a larger benchmark
    takes more passes over the documents, each stored, which stay row by row (no
    shuffle). Null and empty texts have no words; very long ones are searched
    whole. Repeated rows are searched alike, and repeated items found once.
    Without items nothing is hit; an empty table gives no rows.
    """
    others = [F.col(c) for c in docs.columns if c != text_col]
    rows = docs.select(
        (F.struct(*others) if others else F.struct(F.lit(None).alias("none"))).alias("row"),
        F.col(text_col).alias("text"),
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast(SPANS).alias("spans"),
        F.array().cast("array<string>").alias("items"),
    )
    passes = _item_passes(benchmark, item_id, item_text, pass_bytes)
    items, after = next(passes, []), next(passes, None)
    while after is not None:
        # stored, so that no task holds the tables of two passes
        rows = stored(_search(rows, items, window, True), "searched")
        items, after = after, next(passes, None)
    return _search(rows, items, window, with_text)


def _search(rows: DataFrame, items: list[tuple], window: int, with_text: bool) -> DataFrame:
    names = [name or "" for name, _ in items]
    shared = rows.sparkSession.sparkContext.broadcast(
        build_patterns([(k, text) for k, (_, text) in enumerate(items)], window)
    )
    left_out = () if with_text else ("text",)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = shared.value
        for batch in batches:
            columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            counts, spans, found = [], [], []
            old_spans, old_items = columns["spans"].to_pylist(), columns["items"].to_pylist()
            for text, old, before in zip(columns["text"], old_spans, old_items):
                n, hit, numbers = find_windows(text.as_py(), patterns)
                counts.append(n)
                spans.append([{"start": a, "end": b} for a, b in merged(hit + [(s["start"], s["end"]) for s in old])])
                found.append(sorted({*before, *(names[k] for k in numbers)}))
            columns["n_words"] = pa.array(counts, pa.int64())
            columns["spans"] = pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            columns["items"] = pa.array(found, pa.list_(pa.string()))
            out = {name: column for name, column in columns.items() if name not in left_out}
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return rows.mapInArrow(search, rows.drop(*left_out).schema)


def op8_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_benchmark(docs, table(spark, sf_dir, "benchmark"), with_text=False)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


_WORDS = """string_split_regex(trim(regexp_replace(translate(coalesce({0}, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g')), ' ')"""
_NO_EMPTY = "list_filter({0}, lambda x: x <> '')"
ORACLE_SQL = f"""
    WITH doc AS (SELECT row_number() OVER () AS r, doc_id, {_NO_EMPTY.format(_WORDS.format("text"))} AS w FROM documents),
    item AS (SELECT item_id, {_NO_EMPTY.format(_WORDS.format("text"))} AS w FROM benchmark),
    pattern AS (
        SELECT DISTINCT item_id, n, array_to_string(w[i + 1 : i + n], ' ') AS p
        FROM (SELECT item_id, w, n, unnest(range(0, len(w) - n + 1)) AS i
              FROM (SELECT item_id, w, least(10, len(w)) AS n FROM item WHERE len(w) > 0))),
    place AS (
        SELECT r, n, i, array_to_string(w[i + 1 : i + n], ' ') AS p
        FROM (SELECT r, w, n, unnest(range(0, len(w) - n + 1)) AS i
              FROM doc, (SELECT DISTINCT n FROM pattern) WHERE len(w) >= n)),
    hit AS (SELECT r, place.n, i, item_id FROM place JOIN pattern ON place.p = pattern.p AND place.n = pattern.n),
    hit_words AS (
        SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM hit) GROUP BY r),
    hit_items AS (
        SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM doc LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)"""
