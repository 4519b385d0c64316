"""Landed JSON payloads of bibliographic services."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litscreen.functions.text import last_path_segment

_WORK_SCHEMA = "ids struct<pmid: string>, doi string, referenced_works array<string>"


def _segments(urls: Column) -> Column:
    return F.transform(urls, last_path_segment)


def _empty_list() -> Column:
    return F.array().cast("array<string>")


def _null_value(payload: Column, parsed: Column, name: str) -> Column:
    """True where the key is present but holds null (or nothing usable)."""
    return F.array_contains(F.json_object_keys(payload), name) & parsed[name].isNull()


def _has_null(items: Column) -> Column:
    return F.coalesce(F.exists(items, lambda x: x.isNull()), F.lit(False))


def parse_work_refs(df: DataFrame, payload: str, key: str, output: str = "references") -> DataFrame:
    """``key, references`` of landed works; whatever cannot be read gives an empty list."""
    parsed = df.select(key, F.from_json(payload, _WORK_SCHEMA).alias("w"))
    urls = F.col("w.referenced_works")
    readable = urls.isNotNull() & ~_has_null(urls)
    return parsed.select(key, F.when(readable, _segments(urls)).otherwise(_empty_list()).alias(output))


def parse_works(df: DataFrame, payload: str, key: str = "openalex_id") -> DataFrame:
    """``key, pmid, doi, references`` of landed works.

    Missing parts are NULL or empty. A payload that is no JSON object, or that
    holds an explicit null for ``ids``, ``referenced_works`` or a list member,
    counts as unreadable and gives ``NULL, NULL, []``.
    """
    parsed = df.select(key, F.col(payload).alias("p"), F.from_json(payload, _WORK_SCHEMA).alias("w"))
    urls = F.col("w.referenced_works")
    broken = (
        F.json_object_keys("p").isNull()
        | _null_value(F.col("p"), F.col("w"), "ids")
        | _null_value(F.col("p"), F.col("w"), "referenced_works")
        | _has_null(urls)
    )
    readable = F.col("w").isNotNull() & ~F.coalesce(broken, F.lit(True))
    pmid = last_path_segment(F.nullif(F.col("w.ids.pmid"), F.lit("")))
    return parsed.select(
        key,
        F.when(readable, pmid).alias("pmid"),
        F.when(readable, F.col("w.doi")).alias("doi"),
        F.when(readable, F.coalesce(_segments(urls), _empty_list())).otherwise(_empty_list()).alias("references"),
    )


def parse_esearch(payload: Column) -> Column:
    """First id of a search answer, NULL if there is none."""
    answer = F.from_json(payload, "esearchresult struct<idlist: array<string>>")
    return F.get(answer["esearchresult"]["idlist"], F.lit(0))
