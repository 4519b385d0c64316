"""Markup in text columns: HTML entities, XML elements with mixed content."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litscreen.functions.text import collapse_whitespace

# The usual named entities, the ampersand last.
ENTITIES = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®", "middot": "·",
    "deg": "°", "plusmn": "±", "micro": "µ", "times": "×", "ndash": "–", "mdash": "—", "hellip": "…",
    "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "agrave": "à", "ccedil": "ç", "eacute": "é",
    "egrave": "è", "auml": "ä", "ouml": "ö", "uuml": "ü", "szlig": "ß", "alpha": "α", "beta": "β", "gamma": "γ",
    "amp": "&",
}
_RARE = rf"&(?=[#A-Za-z])(?!(?:{'|'.join(ENTITIES)});)"


@F.pandas_udf(T.StringType())
def _html_unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def unescape_html(col: Column) -> Column:
    """Decode named and numbered HTML entities, each once.

    The usual named ones are replaced natively; only a text that holds another
    entity, or an ampersand before a letter, goes to Python.
    """
    plain = col
    for name, sign in ENTITIES.items():
        plain = F.replace(plain, F.lit(f"&{name};"), F.lit(sign))
    rare = col.rlike(_RARE)
    decoded = F.when(rare, _html_unescape(F.when(rare, col))).otherwise(plain)
    return F.when(col.contains("&"), decoded).otherwise(col)


# ---- article XML ----------------------------------------------------------------------------

CITATION_TYPE = """
    MedlineCitation struct<
        PMID: struct<_VALUE: string, _Version: string>,
        Article: struct<
            Journal: struct<Title: string>,
            AuthorList: struct<Author: array<struct<LastName: string, Initials: string, CollectiveName: string>>>>>,
    _corrupt_record string"""

# Signs around the elements whose texts are taken from the whole text of the article.
_MARKS = {"ArticleTitle": ("\ue000", "\ue001"), "AbstractText": ("\ue002", "\ue003")}


def citation(payload: Column) -> Column:
    """Citation of an article XML by its declared schema; what cannot be read fills ``_corrupt_record``."""
    options = {"mode": "PERMISSIVE", "ignoreSurroundingSpaces": "false"}
    return F.from_xml(payload, CITATION_TYPE, options)


def is_article(cited: Column) -> Column:
    """Whether :func:`citation` found a readable payload with an article."""
    found = cited["_corrupt_record"].isNull() & cited["MedlineCitation"]["Article"].isNotNull()
    return F.coalesce(found, F.lit(False))


def marked_text(payload: Column) -> Column:
    """Whole text of the article, tags left out, with signs around title and abstract parts.

    Text right behind an element counts as its own. The payload must be well-formed. Nested tags, coded characters, CDATA and
    comments are the XML parser's business.
    """
    marked = F.regexp_replace(payload, "[\ue000-\ue003]", "")
    for tag, (start, end) in _MARKS.items():
        opened = F.regexp_replace(marked, rf"<{tag}(?=[\s/>])", f"{start}<{tag}")
        marked = F.regexp_replace(opened, f"(</{tag}>[^<\ue000-\ue003]*)", f"$1{end}")
    return F.xpath_string(marked, F.lit("/*/MedlineCitation/Article"))


def title_text(marked: Column) -> Column:
    """Title, doubly coded entities decoded, white space collapsed; empty if there is none."""
    start, end = _MARKS["ArticleTitle"]
    return collapse_whitespace(unescape_html(F.regexp_extract(marked, f"{start}([^{end}]*){end}", 1)))


def abstract_text(marked: Column) -> Column:
    """Parts of the abstract that are not blank, joined by a blank.

    Parts are joined before they are decoded: none can end amid an entity of the next.
    """
    start, end = _MARKS["AbstractText"]
    parts = F.regexp_extract_all(marked, F.lit(f"{start}([^{start}{end}]*){end}"), F.lit(1))
    return collapse_whitespace(unescape_html(F.array_join(parts, " ")))


def author_names(cited: Column) -> Column:
    """``Last Initials`` of every author who has both, else the collective name; others are left out."""

    def name(author: Column) -> Column:
        whole = (F.length(author["LastName"]) > 0) & (F.length(author["Initials"]) > 0)
        person = F.when(whole, F.concat(author["LastName"], F.lit(" "), author["Initials"]))
        return F.coalesce(person, F.nullif(author["CollectiveName"], F.lit("")))

    authors = cited["MedlineCitation"]["Article"]["AuthorList"]["Author"]
    return F.coalesce(F.array_compact(F.transform(authors, name)), F.array().cast("array<string>"))


def reference_ids(payload: Column) -> Column:
    """Ids of the type ``pubmed`` in the reference lists, nested to any depth; an outer list before those inside it."""

    def ids(where: str) -> Column:
        return F.xpath(payload, F.lit(f'//ReferenceList{where}/Reference//ArticleId[@IdType="pubmed"]/text()'))

    levels = [ids(f"[count(ancestor::ReferenceList) {depth}]") for depth in ("= 0", "= 1", "> 1")]
    nested = F.regexp_count(payload, F.lit(r"<ReferenceList[\s>]")) > 1
    return F.when(nested, F.concat(*levels)).otherwise(ids(""))
