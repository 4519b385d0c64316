"""Licence scan with a positional index of rare words, with DataFrame functions only.

Every template's rarest words (highest inverse document frequency over the
templates) are indexed with their positions. The words of a file that the index
knows are its highest-IDF licence words; each gives candidate starts (its place
less its position in the template), and a template's candidates are the
intersection over its indexed words. A candidate counts if the mandatory key
phrases stand at their places and enough of the template's words do. All of it
stays inside the row: no join, no shuffle.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litscreen.llm.common import table


class Template(NamedTuple):
    """``text`` in lower-case words; ``keys``: phrases of it that must stand there in full."""

    label: str
    text: str
    keys: tuple[str, ...]
    base: bool = False


# The base phrases, then the usual wording of public licences.
TEMPLATES = (
    Template("mit", "mit license", ("mit license",), base=True),
    Template("apache", "apache license", ("apache license",), base=True),
    Template("gpl", "general public license", ("general public license",), base=True),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
        ("hereby granted free of charge",),
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted",
        ("source and binary forms",),
    ),
    Template("bsd", "bsd license", ("bsd license",)),
    Template("bsd", "bsd 2 clause", ("bsd 2 clause",)),
    Template("bsd", "bsd 3 clause", ("bsd 3 clause",)),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee",
        ("distribute this software for any purpose",),
    ),
    Template("lgpl", "lesser general public license", ("lesser general public license",)),
    Template("agpl", "affero general public license", ("affero general public license",)),
    Template("mpl", "mozilla public license", ("mozilla public license",)),
    Template("epl", "eclipse public license", ("eclipse public license",)),
    Template("cc-by", "cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-sa", "cc by sa 4 0", ("cc by sa",)),
    Template("cc-by-nc", "cc by nc 4 0", ("cc by nc",)),
    Template("cc-by", "creative commons attribution 4 0", ("creative commons attribution 4 0",)),
    Template("cc0", "cc0 1 0 universal", ("cc0 1 0",)),
    Template(
        "unlicense",
        "this is free and unencumbered software released into the public domain",
        ("free and unencumbered software",),
    ),
    Template("all-rights-reserved", "all rights reserved", ("all rights reserved",)),
)
MIN_COVERAGE = 0.8
#: every byte of these stands between words, once A-Z are lower-cased
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class _Indexed(NamedTuple):
    template: Template
    words: list[str]
    anchors: list[tuple[str, int]]
    keys: list[tuple[int, list[str]]]


def build_index(templates: Sequence[Template], anchors: int = 3) -> list[_Indexed]:
    """Templates with their ``anchors`` rarest words (of equally rare ones the longest), one if under five words."""
    words = [t.text.split() for t in templates]
    frequency = Counter(w for ws in words for w in set(ws))
    idf = {w: math.log(len(templates) / n) for w, n in frequency.items()}
    out = []
    for template, ws in zip(templates, words):
        places = {w: i for i, w in reversed(list(enumerate(ws))) if ws.count(w) == 1}
        rarest = sorted(places, key=lambda w: (-idf[w], -len(w), places[w]))[: anchors if len(ws) >= 5 else 1]
        keys = []
        for key in template.keys:
            k = key.split()
            at = next((i for i in range(len(ws)) if ws[i : i + len(k)] == k), None)
            if at is None:
                raise ValueError(f"key phrase {key!r} is not in its template")
            keys.append((at, k))
        out.append(_Indexed(template, ws, [(w, places[w]) for w in rarest], keys))
    return out


def text_words(text: Column) -> Column:
    """Words of the text, A-Z lower-cased; what follows the last one may be an empty string.

    ``lower`` also changes other letters, which licence words do not hold: the
    one sign that it would turn into a licence letter (Kelvin) is taken out first.
    """
    plain = F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ"))
    return F.split(F.lower(plain), _BETWEEN)


def _literals(words: Sequence[str]) -> Column:
    return F.array(*(F.lit(w) for w in words))


def _places(indexed: _Indexed, words: Column, hits: Column, least: float) -> Column:
    """Array of matches of one template."""
    starts = None
    for word, at in indexed.anchors:
        mine = F.transform(F.filter(hits, lambda h: h["word"] == word), lambda h: h["at"] - at)
        starts = mine if starts is None else F.array_intersect(starts, mine)
    n = len(indexed.words)

    def verified(start: Column) -> Column:
        right = start >= 0
        for at, key in indexed.keys:
            there = F.slice(words, F.greatest(start, F.lit(0)) + at + 1, len(key))
            right = right & (there == _literals(key))
        return right

    def match(start: Column) -> Column:
        same = F.zip_with(F.slice(words, start + 1, n), _literals(indexed.words), lambda a, b: a.eqNullSafe(b))
        return F.struct(
            F.lit(indexed.template.label).alias("label"),
            F.lit(indexed.template.base).alias("base"),
            start.alias("start"),
            F.lit(n).alias("length"),
            (F.size(F.filter(same, lambda x: x)) / F.lit(float(n))).alias("coverage"),
        )

    found = F.transform(F.filter(starts, verified), match)
    return F.filter(found, lambda m: m["coverage"] >= least)


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: Sequence[Template] = TEMPLATES,
    min_coverage: float = MIN_COVERAGE,
) -> DataFrame:
    """``id, n_words, matches`` of every row, whole texts.

    ``matches`` has a struct per place: ``label, base, start`` (word from 0),
    ``length`` (words) and ``coverage`` (share of the template's words that
    stand there). Null and empty texts have no words. Repeated rows are scanned
    alike; other columns are left out. Templates must not hold the letter of a
    case that ``text_words`` takes out.
    """
    index = build_index(templates)
    known = sorted({word for indexed in index for word, _ in indexed.anchors})
    split = docs.select(F.col(id_col).alias(id_col), text_words(F.col(text_col)).alias("_split"))
    lead, last = F.col("_split")[0] == "", F.element_at("_split", -1) == ""
    n_words = F.size("_split") - lead.cast("int") - ((F.size("_split") > 1) & last).cast("int")
    words = F.when(lead, F.slice("_split", 2, F.greatest(F.size("_split") - 1, F.lit(0)))).otherwise(F.col("_split"))
    worded = split.select(id_col, n_words.cast("long").alias("n_words"), words.alias("_words"))
    marked = F.transform(
        "_words", lambda w, i: F.when(w.isin(*known), F.struct(w.alias("word"), i.alias("at")))
    )
    hit = worded.withColumn("_hits", F.filter(marked, lambda h: h.isNotNull()))
    places = F.concat(*(_places(i, F.col("_words"), F.col("_hits"), min_coverage) for i in index))
    matches = F.when(F.size("_hits") > 0, places).otherwise(F.array().cast(MATCHES))
    return hit.select(id_col, "n_words", matches.alias("matches"))


MATCHES = "array<struct<label:string,base:boolean,start:int,length:int,coverage:double>>"


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def op2_licenses(spark, sf_dir):
    scanned = scan_licenses(table(spark, sf_dir, "documents"))
    base = F.filter("matches", lambda m: m["base"])
    return scanned.withColumn("_base", base).select(
        "doc_id",
        "n_words",
        F.size("_base").cast("long").alias("n_base"),
        F.array_min("_base.start").cast("long").alias("first_word"),
        F.array_max("_base.start").cast("long").alias("last_word"),
        _joined(F.col("_base.label")).alias("base_labels"),
        _joined(F.col("matches.label")).alias("labels"),
        F.coalesce(F.array_max("matches.coverage"), F.lit(0.0)).alias("score"),
    )


def _oracle() -> str:
    branches = []
    for indexed in build_index(TEMPLATES):
        n = len(indexed.words)
        checks = [f"w[i + {at + 1}] = '{word}'" for word, at in indexed.anchors]
        checks += [f"w[i + {at + k + 1}] = '{word}'" for at, key in indexed.keys for k, word in enumerate(key)]
        same = " + ".join(f"CAST(coalesce(w[i + {k + 1}] = '{word}', false) AS INTEGER)" for k, word in enumerate(indexed.words))
        branches.append(f"""
            SELECT r, i, '{indexed.template.label}' AS label, {str(indexed.template.base).lower()} AS base,
                   ({same}) / CAST({n} AS DOUBLE) AS coverage
            FROM (SELECT r, w, unnest(range(0, len(w))) AS i FROM doc WHERE list_contains(w, '{indexed.anchors[0][0]}'))
            WHERE {" AND ".join(checks)}""")
    return f"""
        WITH doc AS (
            SELECT row_number() OVER () AS r, doc_id,
                   list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                       'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w
            FROM documents),
        place AS (SELECT * FROM ({" UNION ALL ".join(branches)}) WHERE coverage >= {MIN_COVERAGE}),
        found AS (
            SELECT r, count(*) FILTER (WHERE base) AS n_base, min(i) FILTER (WHERE base) AS first_word,
                   max(i) FILTER (WHERE base) AS last_word,
                   string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels,
                   string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(coverage) AS score
            FROM place GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
               coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
        FROM doc LEFT JOIN found USING (r)"""


ORACLE_SQL = _oracle()
