"""Joins of labels, articles and reference tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litscreen.functions.labels import whole_id
from litscreen.functions.text import normalise_doi
from litscreen.operators.checks import require_columns
from litscreen.operators.lists import content_hash


def left_join_known(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join on ``key`` in which rows without a key do not meet in one task.

    They can match nothing. A second key, the same for all other rows, spreads
    them over the tasks of a shuffle; both inputs are evaluated once. It comes
    from the values of the row, so a repeated task deals its rows alike.
    """
    spread = F.when(F.col(key).isNull(), content_hash(left)).otherwise(0)
    return (
        left.withColumn("_spread", spread)
        .join(right.withColumn("_spread", F.lit(0).cast("long")), [key, "_spread"], "left")
        .drop("_spread")
    )


def enrich_articles(labels: DataFrame, fetched: DataFrame, key: str = "PMID") -> DataFrame:
    """Left join of curated rows with fetched articles on the integer form of ``key``.

    Ids may come as number or text on either side. A row whose key is NULL or
    unknown keeps NULLs; an article fetched twice gives two rows.
    """
    require_columns(labels, [key], "label table")
    require_columns(fetched, [key], "fetched table")

    def with_number(df: DataFrame) -> DataFrame:
        if dict(df.dtypes)[key] in ("bigint", "int"):
            return df.withColumn(key, F.col(key).cast("bigint"))
        return df.withColumn(key, whole_id(F.col(key)))

    return left_join_known(with_number(labels), with_number(fetched), key)


def merge_reference_tables(articles: DataFrame, references: DataFrame, key: str = "pmid") -> DataFrame:
    """Left join of article rows with cleaned references; shared names get the suffix ``_article``."""
    shared = {c: f"{c}_article" for c in articles.columns if c in references.columns and c != key}
    return left_join_known(articles.withColumnsRenamed(shared), references, key)


def fill_pmid_by_doi(works: DataFrame, doi_index: DataFrame) -> DataFrame:
    """Fill a missing ``pmid`` by looking the bare DOI up in ``doi_index(doi, found_pmid)``.

    Only rows that lack a pmid have a key to join on; an index that lists a
    DOI twice counts with its smallest pmid.
    """
    index = doi_index.where("doi IS NOT NULL").groupBy(F.col("doi").alias("_key"))
    found = index.agg(F.min("found_pmid").alias("_found"))
    searched = works.withColumn("_key", F.when(F.col("pmid").isNull(), normalise_doi(F.col("doi"))))
    joined = left_join_known(searched, found, "_key")
    return joined.withColumn("pmid", F.coalesce("pmid", "_found")).drop("_key", "_found")
