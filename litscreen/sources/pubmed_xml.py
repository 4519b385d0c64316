"""Landed article XML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litscreen.functions import markup

_ARTICLE_END = "</PubmedArticle>"
ARTICLE_COLUMNS = ("PMID", "Title", "Abstract", "Authors", "Journal", "References")


def read_pubmed_xml(spark: SparkSession, path: str) -> DataFrame:
    """One row ``payload`` per ``PubmedArticle`` of the landed files.

    Files are cut at the closing tag, so that one large file is read by many
    tasks. Book articles and the frame of the file are left out.
    """
    pieces = spark.read.option("lineSep", _ARTICLE_END).text(path)
    start = F.regexp_extract("value", r"(?s)<PubmedArticle[\s>].*", 0)
    return pieces.select(start.alias("start")).where("start <> ''").select(
        F.concat("start", F.lit(_ARTICLE_END)).alias("payload")
    )


def mark_pubmed_xml(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Add ``PMID, Title, Abstract, Authors, Journal, References`` and ``rejected`` in one pass.

    A payload that is no XML or has no citation with an article is rejected;
    its fields are NULL. Every field is an expression of its own, so that only
    the fields that are used are computed.
    """
    text = F.col(payload)
    # out of a list of one, so that a payload is parsed once for all fields and the filter on them
    parsed = df.select("*", F.explode(F.array(markup.citation(text))).alias("_cited"))
    cited = parsed.withColumn("_found", markup.is_article(F.col("_cited")))
    # XPath only sees payloads that have been read without an error
    seen = cited.withColumn("_marked", F.when(F.col("_found"), markup.marked_text(text)))
    article = F.col("_cited.MedlineCitation.Article")
    fields = {
        "PMID": F.col("_cited.MedlineCitation.PMID._VALUE"),
        "Title": markup.title_text(F.col("_marked")),
        "Abstract": markup.abstract_text(F.col("_marked")),
        "Authors": F.when(F.col("_found"), markup.author_names(F.col("_cited"))),
        "Journal": F.when(F.col("_found"), F.coalesce(article["Journal"]["Title"], F.lit(""))),
        "References": F.when(F.col("_found"), markup.reference_ids(text)),
        "rejected": ~F.col("_found"),
    }
    return seen.withColumns(fields).drop("_cited", "_found", "_marked")


def parse_pubmed_xml(df: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """``(articles, rejected)`` of landed ``PubmedArticle`` payloads, see :func:`mark_pubmed_xml`."""
    marked = mark_pubmed_xml(df, payload)
    articles = marked.where(~F.col("rejected")).select(*ARTICLE_COLUMNS)
    return articles, marked.where("rejected").select(*df.columns)
