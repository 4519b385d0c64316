"""Rows for edge cases that every operator must take."""

from __future__ import annotations

from collections import Counter

LONG = "word number 7, and so on. " * 40_000
CLASHING = "row long, node long, component string, shard int, slot string, text_hash string, piece int, kept int"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"


def documents(spark, rows):
    """``(doc_id, text)`` rows as documents with further columns, some named like operators' own."""
    full = [(i, t, "en", None, None if t is None else len(t), 1, 2, "c", 3, "s", "h", 4, 5) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


#: null and repeated ids, null, empty and very long texts, repeated rows
EDGES = [
    (1, "One text. It has two sentences."),
    (1, "One text. It has two sentences."),
    (2, None),
    (2, None),
    (3, ""),
    (None, "a text without an id"),
    (None, None),
    (4, "ONE text. it has two sentences."),
    (4, "another text under the same id"),
    (5, LONG),
    (6, LONG + "x"),
    (7, " \t\n "),
    (8, "été ẞ 日本語 𝄞 <|endoftext|> \x00 end"),
]


def rows_of(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())
