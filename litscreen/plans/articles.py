"""Queries on curated labels and articles: columns, filters, labels, counts, joins, files."""

from __future__ import annotations

from pyspark.sql import functions as F

from litscreen.functions.labels import bool_label, map_labels
from litscreen.operators import aggregates as agg
from litscreen.operators import columns as cols
from litscreen.operators import filters as flt
from litscreen.operators.enrich import enrich_articles
from litscreen.plans import views as v
from litscreen.plans.registry import query
from litscreen.plans.screening import LABEL_CLASSES, REVIEW_REASON, screen_articles
from litscreen.session import scratch_path
from litscreen.sources import delimited

# ---- files ----------------------------------------------------------------------------------

ARTICLE_SCHEMA = "PMID string, Title string, Abstract string, Journal string"

_NA_LIST = ", ".join("'" + token.replace("'", "''") + "'" for token in delimited.NA_TOKENS)


@query(
    "read_delimited",
    v.with_views(
        "fetched",
        f"""SELECT CAST(PMID AS VARCHAR) AS PMID,
                   CASE WHEN Title NOT IN ({_NA_LIST}) THEN Title END AS Title,
                   CASE WHEN Abstract NOT IN ({_NA_LIST}) THEN Abstract END AS Abstract,
                   CASE WHEN Journal NOT IN ({_NA_LIST}) THEN Journal END AS Journal
            FROM fetched""",
    ),
)
def read_delimited(spark, d):
    path = scratch_path(spark, "articles") + ".tsv"
    delimited.write_delimited(v.fetched(spark, d), path)
    return delimited.read_delimited(spark, path, ARTICLE_SCHEMA)


@query("read_csv_index", "SELECT p_partkey, p_name, p_size FROM part")
def read_csv_index(spark, d):
    path = scratch_path(spark, "indexed") + ".csv"
    part = v.table(spark, d, "part").select(
        (F.col("p_partkey") * 2).alias("_c0"), "p_partkey", "p_name", "p_size"
    )
    delimited.write_delimited(part, path)
    schema = "_c0 bigint, p_partkey bigint, p_name string, p_size int"
    return delimited.read_csv_index(spark, path, schema)


@query(
    "load_id_list",
    """SELECT CAST(conv_id AS VARCHAR) AS id,
              (SELECT count(conv_id) - count(DISTINCT conv_id) FROM conversations) AS n_duplicates
       FROM conversations WHERE conv_id IS NOT NULL""",
)
def load_id_list(spark, d):
    ids, duplicates = delimited.load_id_list(v.table(spark, d, "conversations"), "conv_id")
    return ids.withColumn("n_duplicates", duplicates.select("n_duplicates").scalar())


@query(
    "write_csv",
    v.with_views(
        "work_members work_lists",
        "SELECT pmid, CAST(len(refs) AS INTEGER) AS n_refs, array_to_string(refs, '|') AS refs FROM work_lists",
    ),
)
def write_csv(spark, d):
    path = scratch_path(spark, "works") + ".csv"
    delimited.write_delimited(v.work_lists(spark, d), path)
    back = delimited.read_delimited(spark, path, "pmid bigint, refs string")
    refs = delimited.decode_list_literal(F.col("refs"))
    return back.select("pmid", F.size(refs).alias("n_refs"), F.array_join(refs, "|").alias("refs"))


# ---- columns --------------------------------------------------------------------------------


@query("reduce_columns", v.with_views("raw_labels", "SELECT DISTINCT rejection, reason FROM raw_labels"))
def reduce_columns(spark, d):
    return cols.reduce_columns(v.raw_labels(spark, d), ["rejection", "reason"], drop_duplicates=True)


@query("lower_columns", v.with_views("fetched", "SELECT PMID AS pmid, Title AS title, Abstract AS abstract, Journal AS journal FROM fetched"))
def lower_columns(spark, d):
    return cols.lower_columns(v.fetched(spark, d))


@query("rename_columns", v.with_views("raw_labels", "SELECT PMID AS id, rejection, reason AS why FROM raw_labels"))
def rename_columns(spark, d):
    return cols.rename_columns(v.raw_labels(spark, d), {"PMID": "id", "reason": "why"})


@query("add_null_column", "SELECT doc_id, lang, CAST(NULL AS VARCHAR) AS Journal FROM documents")
def add_null_column(spark, d):
    return cols.add_null_column(v.table(spark, d, "documents").select("doc_id", "lang"), "Journal")


@query("feature_label_view", v.with_views("labelled", "SELECT doc_id, text, label AS labels FROM labelled"))
def feature_label_view(spark, d):
    return cols.feature_label_view(v.labelled(spark, d), "label", ["doc_id", "text"])


@query("ensure_labels", v.with_views("fetched", "SELECT PMID, Title, Abstract, Journal, CAST(-1 AS INTEGER) AS labels FROM fetched"))
def ensure_labels(spark, d):
    return cols.ensure_labels(v.fetched(spark, d))


# ---- filters --------------------------------------------------------------------------------


def _merged(spark, d):
    return enrich_articles(v.raw_labels(spark, d), v.fetched(spark, d))


_MERGED = "raw_labels fetched merged"


@query("drop_missing", v.with_views(_MERGED, "SELECT * FROM merged WHERE Abstract IS NOT NULL"))
def drop_missing(spark, d):
    return flt.drop_missing(_merged(spark, d), ["Abstract"])[0]


@query("drop_missing_rejects", v.with_views(_MERGED, "SELECT * FROM merged WHERE Abstract IS NULL"))
def drop_missing_rejects(spark, d):
    return flt.drop_missing(_merged(spark, d), ["Abstract"])[1]


@query("drop_values_rejects", v.with_views("raw_labels", "SELECT * FROM raw_labels WHERE reason = 'Review article'"))
def drop_values_rejects(spark, d):
    return flt.drop_values(v.raw_labels(spark, d), "reason", REVIEW_REASON)[1]


@query("drop_values", v.with_views("raw_labels", "SELECT * FROM raw_labels WHERE reason IS DISTINCT FROM 'Review article'"))
def drop_values(spark, d):
    return flt.drop_values(v.raw_labels(spark, d), "reason", REVIEW_REASON)[0]


@query(
    "rejected_ledger",
    v.with_views(
        _MERGED,
        """SELECT PMID, reason, 'missing' AS reason_dropped FROM merged WHERE Abstract IS NULL
           UNION ALL
           SELECT PMID, reason, 'excluded' FROM merged
           WHERE Abstract IS NOT NULL AND reason = 'Review article'""",
    ),
)
def rejected_ledger(spark, d):
    marked = flt.mark_rejections(_merged(spark, d), ["Abstract"], {"reason": REVIEW_REASON})
    return marked.where("reason_dropped IS NOT NULL").select("PMID", "reason", "reason_dropped")


@query(
    "split_labelled",
    v.with_views(
        "raw_labels",
        """SELECT PMID, CASE WHEN rejection IN ('Useful', 'Rejected') THEN 'train' ELSE 'test' END AS split
           FROM raw_labels""",
    ),
)
def split_labelled(spark, d):
    mapped = v.raw_labels(spark, d).withColumn("label", map_labels(F.col("rejection"), LABEL_CLASSES))
    return flt.split_labelled(mapped, "label").select("PMID", "split")


# ---- values ---------------------------------------------------------------------------------

_MAP_SQL = "CASE rejection WHEN 'Rejected' THEN 0 WHEN 'Useful' THEN 1 {other} END"


@query(
    "map_labels",
    v.with_views("raw_labels", f"SELECT PMID, CAST({_MAP_SQL.format(other='ELSE -1')} AS INTEGER) AS label FROM raw_labels"),
)
def map_labels_query(spark, d):
    return v.raw_labels(spark, d).select("PMID", map_labels(F.col("rejection"), LABEL_CLASSES).alias("label"))


@query(
    "map_labels_strict",
    v.with_views("raw_labels", f"SELECT PMID, CAST({_MAP_SQL.format(other='')} AS INTEGER) AS label FROM raw_labels"),
)
def map_labels_strict(spark, d):
    return v.raw_labels(spark, d).select(
        "PMID", map_labels(F.col("rejection"), LABEL_CLASSES, default=None).alias("label")
    )


@query("map_bool_labels", "SELECT doc_id, CAST(toxic = 1 AS INTEGER) AS label FROM labels")
def map_bool_labels(spark, d):
    return v.table(spark, d, "labels").select("doc_id", bool_label(F.col("toxic") == 1).alias("label"))


@query("normalise_ids", "SELECT DISTINCT CAST(conv_id AS VARCHAR) AS conv_id FROM conversations")
def normalise_ids(spark, d):
    return cols.normalise_ids(v.table(spark, d, "conversations"), "conv_id")[0]


@query(
    "normalise_ids_rejects",
    v.with_views("lookup", "SELECT DISTINCT pmid AS value FROM lookup WHERE pmid LIKE 'PMC%'"),
)
def normalise_ids_rejects(spark, d):
    return cols.normalise_ids(v.lookup(spark, d), "pmid")[1]


# ---- joins and the whole plan ---------------------------------------------------------------


@query("enrich_articles", v.with_views(_MERGED, "SELECT * FROM merged"))
def enrich_articles_query(spark, d):
    return _merged(spark, d)


@query(
    "screen_articles",
    v.with_views(
        _MERGED,
        f"""SELECT PMID, reason, Title, Abstract, Journal,
                   CAST({_MAP_SQL.format(other='ELSE -1')} AS INTEGER) AS rejection,
                   CASE WHEN rejection IN ('Useful', 'Rejected') THEN 'train' ELSE 'test' END AS split
            FROM merged WHERE Abstract IS NOT NULL AND reason IS DISTINCT FROM 'Review article'""",
    ),
)
def screen_articles_query(spark, d):
    return screen_articles(v.raw_labels(spark, d), v.fetched(spark, d), "PMID", "rejection", "reason")


# ---- counts ---------------------------------------------------------------------------------


@query("label_distribution", v.with_views("raw_labels", "SELECT rejection, count(*) AS n FROM raw_labels GROUP BY ALL"))
def label_distribution(spark, d):
    return agg.label_distribution(v.raw_labels(spark, d), "rejection")


@query(
    "label_shares",
    v.with_views(
        "raw_labels",
        """SELECT rejection, count(*) / (SELECT count(*) FROM raw_labels) AS share
           FROM raw_labels WHERE rejection IS NOT NULL GROUP BY rejection""",
    ),
)
def label_shares(spark, d):
    return agg.label_shares(v.raw_labels(spark, d), "rejection")


@query(
    "value_counts",
    v.with_views("raw_labels", "SELECT rejection, count(*) AS n FROM raw_labels WHERE rejection IS NOT NULL GROUP BY ALL"),
)
def value_counts(spark, d):
    return agg.value_counts(v.raw_labels(spark, d), "rejection")


@query("distinct_values", v.with_views("raw_labels", "SELECT DISTINCT reason FROM raw_labels"))
def distinct_values(spark, d):
    return agg.distinct_values(v.raw_labels(spark, d), "reason")


@query(
    "duplicate_count",
    """SELECT count(l_partkey) AS n_values, count(l_partkey) - count(DISTINCT l_partkey) AS n_duplicates
       FROM lineitem""",
)
def duplicate_count(spark, d):
    return agg.duplicate_count(v.table(spark, d, "lineitem"), "l_partkey")


@query(
    "profile_columns",
    v.with_views(
        "fetched",
        """SELECT unnest(['PMID', 'Title', 'Abstract', 'Journal']) AS column_name,
                  unnest(['bigint', 'string', 'string', 'string']) AS data_type,
                  unnest([count(PMID), count(Title), count(Abstract), count(Journal)]) AS non_null
           FROM fetched""",
    ),
)
def profile_columns(spark, d):
    return agg.profile_columns(v.fetched(spark, d))


@query("drop_duplicate_rows", "SELECT DISTINCT text, lang FROM documents")
def drop_duplicate_rows(spark, d):
    return cols.reduce_columns(v.table(spark, d, "documents"), ["text", "lang"], drop_duplicates=True)


@query("head", v.with_views("fetched", "SELECT * FROM fetched ORDER BY PMID LIMIT 5"))
def head(spark, d):
    return v.fetched(spark, d).orderBy("PMID").limit(5)
