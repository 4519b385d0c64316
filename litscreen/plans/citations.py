"""Queries on citation lists, id repair and landed JSON payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from litscreen.functions import text as tx
from litscreen.functions.labels import numeric_id
from litscreen.operators import citations as ct
from litscreen.operators import columns as cols
from litscreen.operators import filters as flt
from litscreen.operators.enrich import fill_pmid_by_doi as fill_by_doi
from litscreen.operators.enrich import merge_reference_tables as merge_tables
from litscreen.plans import views as v
from litscreen.plans.registry import query
from litscreen.sources import payloads
from litscreen.sources.delimited import decode_list_literal as decode_list
from litscreen.sources.delimited import decode_lists

_LISTS = "work_members work_lists"

# ---- lists in text form ---------------------------------------------------------------------


def _list_text(refs):
    """A list of ids as a file shows it: ``['W1', 'W2']``, ``[]`` if empty."""
    quoted = F.transform(refs, lambda x: F.concat(F.lit("'"), x, F.lit("'")))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


@query(
    "decode_list_literal",
    v.with_views(
        _LISTS,
        """SELECT coalesce(w.pmid, e.vec_id) AS pmid, array_to_string(w.refs, '|') AS refs,
                  round(list_sum(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE))), 6) AS loss_sum
           FROM work_lists w FULL JOIN embeddings e ON w.pmid = e.vec_id""",
    ),
)
def decode_list_literal(spark, d):
    lists = v.work_lists(spark, d).select("pmid", _list_text(F.col("refs")).alias("refs"))
    floats = F.transform("embedding", lambda x: x.cast("double").cast("string"))
    losses = v.table(spark, d, "embeddings").select(
        F.col("vec_id").alias("pmid"), F.concat(F.lit("["), F.array_join(floats, ", "), F.lit("]")).alias("losses")
    )
    total = F.aggregate(decode_list(F.col("losses"), "double"), F.lit(0.0), lambda acc, x: acc + x)
    return lists.join(losses, "pmid", "full").select(
        "pmid",
        F.array_join(decode_list(F.col("refs")), "|").alias("refs"),
        F.round(total, 6).alias("loss_sum"),
    )


@query(
    "empty_reference_count",
    v.with_views(
        _LISTS,
        """SELECT count(*) FILTER (WHERE len(refs) = 0) AS n_empty, count(*) AS n_rows,
                  count(*) FILTER (WHERE len(refs) = 0) / count(*) AS share_empty FROM work_lists""",
    ),
)
def empty_reference_count(spark, d):
    texts = v.work_lists(spark, d).select(_list_text(F.col("refs")).alias("refs"))
    return flt.empty_reference_count(texts, "refs")


# ---- ids ------------------------------------------------------------------------------------


@query(
    "malformed_ids",
    v.with_views("lookup", "SELECT openalex_id, pmid FROM lookup WHERE regexp_matches(pmid, '[a-zA-Z]')"),
)
def malformed_ids(spark, d):
    return flt.malformed_ids(v.lookup(spark, d), "pmid").select("openalex_id", "pmid")


# Corrections of wrongly filed ids.
ID_CORRECTIONS = {
    "PMC3251548": "22152337",
    "PMC3087597": "19302484",
    "PMC3575529": "23420871",
    "PMC2904811": "20536124",
    "PMC4339351": "25716838",
}
_SMALL_CORRECTIONS = {"Brand#7": "Brand#70", "Brand#11": "Brand#110"}


@query(
    "replace_ids",
    """SELECT p_partkey, CASE p_brand WHEN 'Brand#7' THEN 'Brand#70' WHEN 'Brand#11' THEN 'Brand#110'
                         ELSE p_brand END AS p_brand FROM part""",
)
def replace_ids(spark, d):
    return cols.replace_ids(v.table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", _SMALL_CORRECTIONS)


@query(
    "replace_ids_table",
    """SELECT l_orderkey, l_linenumber,
              coalesce(c.new, 'W' || l_partkey) AS ref
       FROM lineitem LEFT JOIN (
            SELECT 'W' || p_partkey AS old, 'X' || p_partkey AS new FROM part WHERE p_size = 13) c
         ON c.old = 'W' || l_partkey""",
)
def replace_ids_table(spark, d):
    """Corrections from a table that has every id twice."""
    part, line = v.table(spark, d, "part").where("p_size = 13"), v.table(spark, d, "lineitem")
    old = F.concat(F.lit("W"), "p_partkey").alias("old")
    corrections = part.select(old, F.concat(F.lit("X"), "p_partkey").alias("new"))
    later = part.select(old, F.concat(F.lit("Y"), "p_partkey").alias("new"))
    refs = line.select("l_orderkey", "l_linenumber", F.concat(F.lit("W"), "l_partkey").alias("ref"))
    return cols.replace_ids(refs, "ref", corrections.union(later))


@query(
    "numeric_id",
    v.with_views("lookup", "SELECT openalex_id, CAST(TRY_CAST(pmid AS DOUBLE) AS BIGINT) AS pmid FROM lookup"),
)
def numeric_id_query(spark, d):
    return v.lookup(spark, d).select("openalex_id", numeric_id(F.col("pmid")).alias("pmid"))


@query("last_path_segment", "SELECT page_id, regexp_extract(url, '[^/]*$') AS tail FROM pages")
def last_path_segment(spark, d):
    return v.table(spark, d, "pages").select("page_id", tx.last_path_segment(F.col("url")).alias("tail"))


@query("normalise_doi", v.with_views("lookup", "SELECT seq, string_split(doi, 'doi.org/')[-1] AS doi FROM lookup"))
def normalise_doi(spark, d):
    return v.lookup(spark, d).select("seq", tx.normalise_doi(F.col("doi")).alias("doi"))


# ---- mapping lists to pmids -----------------------------------------------------------------

_KNOWN = """known AS (SELECT openalex_id, pmid FROM lookup WHERE pmid IS NOT NULL
                      QUALIFY row_number() OVER (PARTITION BY openalex_id ORDER BY seq DESC) = 1)"""
_MAPPED = f"""{_KNOWN},
    mapped AS (SELECT w.pmid, list(k.pmid ORDER BY m.pos, m.part) FILTER (WHERE k.pmid IS NOT NULL) AS pmids
               FROM work_lists w LEFT JOIN work_members m ON w.pmid = m.work
               LEFT JOIN known k ON k.openalex_id = 'W' || m.part GROUP BY w.pmid)"""


@query(
    "map_references",
    v.with_views(
        f"{_LISTS} lookup",
        """, works AS (
            SELECT row_number() OVER () AS r, pmid, refs
            FROM (SELECT pmid, refs FROM work_lists UNION ALL SELECT NULL, refs FROM work_lists
                  UNION ALL SELECT pmid, list_reverse(refs) FROM work_lists WHERE len(refs) > 3)),
        doubled AS (
            SELECT openalex_id, pmid, seq FROM lookup UNION ALL
            SELECT openalex_id, CASE WHEN seq % 10 <> 0 THEN CAST(seq + 500000 AS VARCHAR) END, seq + 10000000
            FROM lookup WHERE seq % 5 = 0),
        known AS (SELECT openalex_id, pmid FROM doubled WHERE pmid IS NOT NULL
                  QUALIFY row_number() OVER (PARTITION BY openalex_id ORDER BY seq DESC) = 1),
        members AS (SELECT r, i, refs[i] AS ref FROM (SELECT r, refs, unnest(range(1, len(refs) + 1)) AS i FROM works)),
        mapped AS (SELECT r, string_agg(k.pmid, '|' ORDER BY i) AS pmids
                   FROM members JOIN known k ON k.openalex_id = ref GROUP BY r)
        SELECT works.pmid, coalesce(pmids, '') AS pmids FROM works LEFT JOIN mapped USING (r)""",
    ),
)
def map_references(spark, d):
    """Lists under repeated and null keys, and a lookup that has ids twice."""
    lists, lookup = v.work_lists(spark, d), v.lookup(spark, d).select("openalex_id", "pmid", "seq")
    unnamed = lists.select(F.lit(None).cast("long").alias("pmid"), "refs")
    again = lists.where(F.size("refs") > 3).select("pmid", F.reverse("refs").alias("refs"))
    later = lookup.where("seq % 5 = 0").select(
        "openalex_id",
        F.when(F.col("seq") % 10 != 0, (F.col("seq") + 500000).cast("string")).alias("pmid"),
        F.col("seq") + 10000000,
    )
    mapped = ct.map_references(lists.union(unnamed).union(again), lookup.union(later))
    return mapped.select("pmid", F.array_join("pmids", "|").alias("pmids"))


@query(
    "known_reference_filter",
    v.with_views(
        "lookup edges",
        f", {_KNOWN} SELECT e.pmid AS source, e.pos, e.ref, k.pmid FROM edges e JOIN known k ON e.ref = k.openalex_id",
    ),
)
def known_reference_filter(spark, d):
    edges = v.edges(spark, d).withColumnRenamed("pmid", "source")
    return ct.known_references(edges, ct.last_known_pmid(v.lookup(spark, d), "seq"))


@query("num_refs", v.with_views(_LISTS, "SELECT pmid, CAST(len(refs) AS INTEGER) AS num_refs FROM work_lists"))
def num_refs(spark, d):
    return ct.num_refs(v.work_lists(spark, d), "refs").select("pmid", "num_refs")


# the second reference table: the same lists under ids that are partly missing or malformed
_BY_WORK = """by_work AS (SELECT CASE e.label WHEN 3 THEN NULL WHEN 5 THEN 'PMC' || e.vec_id
                                 ELSE CAST(e.vec_id * 2 AS VARCHAR) END AS pmid_text, e.vec_id AS seq
                          FROM (SELECT pmid AS vec_id, pmid % 10 AS label FROM work_lists) e)"""


def _by_work(spark, d):
    work = F.col("pmid")
    kind = work % 10
    pmid = F.when(kind == 5, F.concat(F.lit("PMC"), work)).when(kind != 3, (work * 2).cast("string"))
    return v.work_lists(spark, d).select(work.alias("seq"), pmid.alias("pmid"), "refs")


_CLEAN = f"""{_MAPPED}, {_BY_WORK},
    stacked AS (SELECT pmid, pmids, 0 AS priority, pmid AS seq FROM mapped
                UNION ALL
                SELECT CAST(TRY_CAST(b.pmid_text AS DOUBLE) AS BIGINT), m.pmids, 1, b.seq
                FROM by_work b JOIN mapped m ON b.seq = m.pmid),
    cleaned AS (SELECT pmid, coalesce(pmids, []) AS pmids FROM stacked WHERE pmid IS NOT NULL
                QUALIFY row_number() OVER (PARTITION BY pmid ORDER BY priority, seq) = 1)"""


def _cleaned(spark, d):
    by_pmid = v.work_lists(spark, d).withColumn("seq", F.col("pmid"))
    return ct.clean_reference_table(by_pmid, _by_work(spark, d), v.lookup(spark, d), ID_CORRECTIONS)


@query(
    "clean_reference_table",
    v.with_views(
        f"{_LISTS} lookup",
        f""", {_CLEAN} SELECT pmid, array_to_string(pmids, '|') AS refs,
                              CAST(len(pmids) AS INTEGER) AS num_of_refs FROM cleaned""",
    ),
)
def clean_reference_table(spark, d):
    return _cleaned(spark, d).select("pmid", F.array_join("references", "|").alias("refs"), "num_of_refs")


@query(
    "merge_reference_tables",
    v.with_views(
        f"raw_labels fetched merged {_LISTS} lookup",
        f""", {_CLEAN} SELECT m.PMID AS pmid, m.Journal AS journal, CAST(len(c.pmids) AS INTEGER) AS num_of_refs
                       FROM merged m LEFT JOIN cleaned c ON m.PMID = c.pmid""",
    ),
)
def merge_reference_tables(spark, d):
    from litscreen.operators.enrich import enrich_articles

    articles = cols.lower_columns(enrich_articles(v.raw_labels(spark, d), v.fetched(spark, d)))
    return merge_tables(articles, _cleaned(spark, d)).select("pmid", "journal", "num_of_refs")


@query(
    "empty_list_share",
    v.with_views(
        f"{_LISTS} lookup",
        f""", {_CLEAN},
            joined AS (SELECT len(w.refs) AS num_of_ref, len(c.pmids) AS num_of_refs
                       FROM work_lists w LEFT JOIN cleaned c ON c.pmid = w.pmid * 3)
            SELECT 'pubmed' AS source, count(*) FILTER (WHERE num_of_ref = 0) AS n_empty,
                   count(*) FILTER (WHERE num_of_ref = 0) / count(*) AS share_empty FROM joined
            UNION ALL
            SELECT 'openalex', count(*) FILTER (WHERE num_of_refs = 0),
                   count(*) FILTER (WHERE num_of_refs = 0) / count(*) FROM joined""",
    ),
)
def empty_list_share(spark, d):
    pubmed = ct.num_refs(v.work_lists(spark, d), "refs", "num_of_ref").withColumn("pmid", F.col("pmid") * 3)
    joined = merge_tables(pubmed.select("pmid", "num_of_ref"), _cleaned(spark, d))
    return ct.empty_list_share(joined, {"pubmed": "num_of_ref", "openalex": "num_of_refs"})


@query(
    "fill_pmid_by_doi",
    v.with_views(
        "lookup",
        """SELECT l.openalex_id, l.doi, coalesce(l.pmid, i.found_pmid) AS pmid
           FROM lookup l LEFT JOIN (SELECT '10.1/' || p_partkey AS doi, CAST(p_partkey + 900000 AS VARCHAR) AS found_pmid
                                    FROM part) i
           ON l.pmid IS NULL AND i.doi = string_split(l.doi, 'doi.org/')[-1]""",
    ),
)
def fill_pmid_by_doi(spark, d):
    index = v.table(spark, d, "part").select(
        F.concat(F.lit("10.1/"), "p_partkey").alias("doi"),
        (F.col("p_partkey") + 900000).cast("string").alias("found_pmid"),
    )
    return fill_by_doi(v.lookup(spark, d), index).select("openalex_id", "doi", "pmid")


@query(
    "decode_lists_rejects",
    v.with_views(_LISTS, "SELECT pmid, array_to_string(refs, '; ') AS refs FROM work_lists WHERE len(refs) % 2 = 1"),
)
def decode_lists_rejects(spark, d):
    """Lists with an odd number of members are written without brackets."""
    written = F.when(F.size("refs") % 2 == 1, F.array_join("refs", "; ")).otherwise(_list_text(F.col("refs")))
    return decode_lists(v.work_lists(spark, d).select("pmid", written.alias("refs")), "refs", "list")[1]


# ---- sets of ids, batches -------------------------------------------------------------------


@query("unique_reference_count", v.with_views("edges", "SELECT count(DISTINCT ref) AS n_unique FROM edges"))
def unique_reference_count(spark, d):
    return ct.unique_reference_count(v.edges(spark, d))


@query("unique_reference_ids", v.with_views(_LISTS, "SELECT DISTINCT 'W' || part AS ref FROM work_members"))
def unique_reference_ids(spark, d):
    return ct.unique_reference_ids(ct.exploded_references(v.work_lists(spark, d), "refs"))


_HALVES = """, u AS (SELECT DISTINCT ref FROM edges),
    p AS (SELECT ref, row_number() OVER (ORDER BY ref) - 1 AS position, count(*) OVER () AS n FROM u)"""


@query(
    "halve_ids",
    v.with_views(
        "edges", f"{_HALVES} SELECT ref, CAST(CASE WHEN position < n // 2 THEN 1 ELSE 2 END AS INTEGER) AS half FROM p"
    ),
)
def halve_ids(spark, d):
    return ct.halve_ids(v.edges(spark, d), "ref")


_BATCHES = """p AS (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 200 AS batch
                    FROM (SELECT DISTINCT o_orderkey FROM orders))"""


@query("assign_batches", f"WITH {_BATCHES} SELECT o_orderkey, batch FROM p")
def assign_batches(spark, d):
    return ct.assign_batches(v.table(spark, d, "orders"), "o_orderkey")


@query(
    "list_batches",
    f"WITH {_BATCHES} SELECT batch, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS ids FROM p GROUP BY batch",
)
def list_batches(spark, d):
    return ct.list_batches(v.table(spark, d, "orders"), "o_orderkey")


@query(
    "dedup_keep_first",
    """SELECT text, doc_id, source FROM documents
       QUALIFY row_number() OVER (PARTITION BY text ORDER BY source, doc_id) = 1""",
)
def dedup_keep_first(spark, d):
    docs = v.table(spark, d, "documents").select("text", "doc_id", "source")
    return ct.dedup_keep_first(docs, "text", ["source", "doc_id"])


@query(
    "concat_tables",
    v.with_views(
        _LISTS,
        f""", {_BY_WORK} SELECT CAST(pmid AS VARCHAR) AS pmid, CAST(NULL AS BIGINT) AS seq FROM work_lists
            UNION ALL SELECT pmid_text, seq FROM by_work""",
    ),
)
def concat_tables(spark, d):
    first = v.work_lists(spark, d).select(F.col("pmid").cast("string").alias("pmid"))
    return ct.concat_tables(first, _by_work(spark, d).select("pmid", "seq"))


# ---- landed JSON ----------------------------------------------------------------------------


def _urls(refs):
    return F.transform(refs, lambda x: F.concat(F.lit("https://openalex.org/"), x))


@query("parse_work_refs", v.with_views(_LISTS, "SELECT pmid, array_to_string(refs, '|') AS refs FROM work_lists"))
def parse_work_refs(spark, d):
    landed = v.work_lists(spark, d).select(
        "pmid", F.to_json(F.struct(_urls(F.col("refs")).alias("referenced_works"))).alias("payload")
    )
    parsed = payloads.parse_work_refs(landed, "payload", "pmid")
    return parsed.select("pmid", F.array_join("references", "|").alias("refs"))


@query(
    "parse_works",
    v.with_views(
        _LISTS,
        """SELECT 'W' || e.vec_id AS openalex_id,
                  CASE WHEN label NOT IN (2, 4, 6) THEN CAST(e.vec_id + 100000 AS VARCHAR) END AS pmid,
                  CASE WHEN label NOT IN (4, 6) THEN 'https://doi.org/10.1/' || e.vec_id END AS doi,
                  CASE WHEN label IN (4, 6) THEN '' ELSE array_to_string(refs, '|') END AS refs
           FROM (SELECT pmid AS vec_id, pmid % 10 AS label, refs FROM work_lists) e""",
    ),
)
def parse_works(spark, d):
    works = v.work_lists(spark, d).select(F.col("pmid").alias("vec_id"), (F.col("pmid") % 10).alias("label"), "refs")
    label = F.col("label")
    pmid = F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), F.col("vec_id") + 100000)
    doi = F.concat(F.lit("https://doi.org/10.1/"), "vec_id")
    whole = F.to_json(
        F.struct(
            F.struct(F.when(label != 2, pmid).alias("pmid")).alias("ids"),
            doi.alias("doi"),
            _urls(F.col("refs")).alias("referenced_works"),
        )
    )
    null_ids = F.concat(F.lit('{"ids": null, "doi": "'), doi, F.lit('"}'))
    landed = works.select(
        F.concat(F.lit("W"), "vec_id").alias("openalex_id"),
        F.when(label == 4, null_ids).when(label == 6, F.lit("not json")).otherwise(whole).alias("payload"),
    )
    parsed = payloads.parse_works(landed, "payload")
    return parsed.select("openalex_id", "pmid", "doi", F.array_join("references", "|").alias("refs"))


@query("parse_esearch", v.with_views("lookup", "SELECT seq, pmid FROM lookup"))
def parse_esearch(spark, d):
    found = F.struct(F.array_compact(F.array("pmid")).alias("idlist"))
    landed = v.lookup(spark, d).select("seq", F.to_json(F.struct(found.alias("esearchresult"))).alias("payload"))
    return landed.select("seq", payloads.parse_esearch(F.col("payload")).alias("pmid"))
