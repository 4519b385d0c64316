"""Queries on landed article XML, built around the documents and parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F

from litscreen.functions import markup
from litscreen.plans import views as v
from litscreen.plans.registry import query
from litscreen.session import scratch_path
from litscreen.sources.pubmed_xml import parse_pubmed_xml as parse
from litscreen.sources.pubmed_xml import read_pubmed_xml

_SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]"


def _escaped(col):
    for char, entity in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")]:
        col = F.replace(col, F.lit(char), F.lit(entity))
    return col


def _tag(name, content, attributes=""):
    return F.concat(F.lit(f"<{name}{attributes}>"), content, F.lit(f"</{name}>"))


def _landed(spark, d):
    """One ``PubmedArticle`` per document: two abstract parts, nested tags, doubly coded entities.

    German titles carry a numbered entity.
    The numbers in a text are its references.
    """
    doc = v.table(spark, d, "documents")
    title = F.substring_index("text", "\n", 1)
    rest = F.substring(F.col("text"), F.length(title) + 1, F.col("n_chars").cast("int"))
    suffix = F.when(F.col("lang") == "de", F.lit(" &#x3b5;")).otherwise(F.lit(" &amp;lt;&amp;eacute;"))
    article_ids = F.transform(
        F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)),
        lambda n: _tag(
            "Reference",
            _tag(
                "ArticleIdList",
                F.concat(_tag("ArticleId", n, ' IdType="pubmed"'), _tag("ArticleId", n, ' IdType="doi"')),
            ),
        ),
    )
    citation = _tag(
        "MedlineCitation",
        F.concat(
            _tag("PMID", F.col("doc_id").cast("string"), ' Version="1"'),
            _tag(
                "Article",
                F.concat(
                    _tag("Journal", _tag("Title", F.col("source"))),
                    _tag("ArticleTitle", F.concat(_tag("i", _escaped(title)), suffix)),
                    _tag(
                        "Abstract",
                        F.concat(
                            _tag("AbstractText", _escaped(title), ' Label="A"'),
                            F.lit("<AbstractText/>"),
                            _tag("AbstractText", _escaped(rest)),
                        ),
                    ),
                    _tag(
                        "AuthorList",
                        F.concat(
                            _tag("Author", F.concat(_tag("LastName", F.col("lang")), _tag("Initials", F.lit("AB")))),
                            _tag("Author", _tag("CollectiveName", F.col("source"))),
                            _tag("Author", _tag("LastName", F.col("lang"))),
                        ),
                    ),
                ),
            ),
        ),
    )
    references = _tag("PubmedData", _tag("ReferenceList", F.array_join(article_ids, "")))
    return doc.select(_tag("PubmedArticle", F.concat(citation, references)).alias("payload"))


def _articles(spark, d):
    return parse(_landed(spark, d))[0]


def _collapsed(text: str) -> str:
    return f"trim(regexp_replace({text}, '{_SPACE}+', ' ', 'g'))"


_TITLE = _collapsed("split_part(text, chr(10), 1) || CASE WHEN lang = 'de' THEN ' ε' ELSE ' <é' END")
_AUTHORS = "lang || ' AB|' || source"
_REFERENCES = "array_to_string(regexp_extract_all(text, '[0-9]+'), '|')"


@query(
    "parse_pubmed_xml",
    f"""SELECT CAST(doc_id AS VARCHAR) AS PMID, {_TITLE} AS Title, {_collapsed('text')} AS Abstract,
               {_AUTHORS} AS Authors, source AS Journal, {_REFERENCES} AS "References" FROM documents""",
)
def parse_pubmed_xml(spark, d):
    """Through landed files: the payloads are written as text and read as article files."""
    path = scratch_path(spark, "pubmed")
    _landed(spark, d).write.text(path)
    articles = parse(read_pubmed_xml(spark, path))[0]
    return articles.withColumns({c: F.array_join(c, "|") for c in ("Authors", "References")})


@query("parse_pubmed_xml_rejects", "SELECT CAST(doc_id AS VARCHAR) AS PMID FROM documents WHERE lang <> 'de'")
def parse_pubmed_xml_rejects(spark, d):
    """Payloads that are cut off, or whose article is missing; German ones are whole."""
    payload, language = F.col("payload"), F.regexp_extract("payload", "<LastName>(..)</LastName>", 1)
    cut = F.when(language == "en", F.left(payload, F.length("payload") - 20))
    cut = cut.when(language != "de", F.replace(F.replace(payload, F.lit("<Article>"), F.lit("<Book>")), F.lit("</Article>"), F.lit("</Book>")))
    rejected = parse(_landed(spark, d).select(cut.otherwise(payload).alias("payload")))[1]
    return rejected.select(F.regexp_extract("payload", "<PMID[^>]*>([0-9]+)<", 1).alias("PMID"))


@query("xml_text", f"SELECT {_TITLE} AS title, count(*) AS n FROM documents GROUP BY ALL")
def xml_text(spark, d):
    return _articles(spark, d).groupBy(F.col("Title").alias("title")).agg(F.count("*").alias("n"))


@query("xml_abstract", f"SELECT CAST(doc_id AS VARCHAR) AS PMID, {_collapsed('text')} AS abstract FROM documents")
def xml_abstract(spark, d):
    return _articles(spark, d).select("PMID", F.col("Abstract").alias("abstract"))


@query("xml_authors", f"SELECT CAST(doc_id AS VARCHAR) AS PMID, {_AUTHORS} AS authors FROM documents")
def xml_authors(spark, d):
    return _articles(spark, d).select("PMID", F.array_join("Authors", "|").alias("authors"))


@query("xml_journal", "SELECT CAST(doc_id AS VARCHAR) AS PMID, source AS journal FROM documents")
def xml_journal(spark, d):
    return _articles(spark, d).select("PMID", F.col("Journal").alias("journal"))


@query("xml_references", f"SELECT CAST(doc_id AS VARCHAR) AS PMID, {_REFERENCES} AS refs FROM documents")
def xml_references(spark, d):
    return _articles(spark, d).select("PMID", F.array_join("References", "|").alias("refs"))


@query("xml_pmid", "SELECT CAST(doc_id AS VARCHAR) AS PMID FROM documents")
def xml_pmid(spark, d):
    return _articles(spark, d).select("PMID")


# all entities of the pages, and an ampersand that lost its semicolon
_UNESCAPED = "replace(replace(replace(replace(html, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', chr(1))"
_UNESCAPED = f"replace(replace({_UNESCAPED}, '&amp', '&'), chr(1), '&')"


@query("unescape_html", f"SELECT page_id, {_UNESCAPED} AS html FROM pages")
def unescape_html(spark, d):
    return v.table(spark, d, "pages").select("page_id", markup.unescape_html(F.col("html")).alias("html"))
