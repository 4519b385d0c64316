"""Input views over the given tables: articles, citations, runs, predictions.

Every view is given twice, as a DataFrame for Spark and as SQL for the check.
All rows and whole texts of the underlying tables take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_views(names: str, body: str) -> str:
    """``WITH`` clause of the named SQL views (in order) in front of ``body``.

    A body that starts with a comma goes on with views of its own.
    """
    views = ",\n".join(f"{name} AS ({SQL_VIEWS[name]})" for name in names.split())
    return f"WITH {views}\n{body}"


# ---- articles -------------------------------------------------------------------------------

SQL_VIEWS = {
    "raw_labels": """
        SELECT d.doc_id AS PMID,
               CASE l.quality WHEN 1 THEN 'Useful' WHEN 0 THEN 'Rejected' END AS rejection,
               CASE WHEN l.toxic = 1 THEN 'Review article'
                    WHEN d.source = 'src5' THEN 'Off topic' END AS reason
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    # one source is filed under other ids, short texts have no abstract, one source has no journal
    "fetched": """
        SELECT CASE WHEN source = 'src13' THEN -doc_id - 1 ELSE doc_id END AS PMID,
               split_part(text, chr(10), 1) AS Title,
               CASE WHEN n_chars < 400 THEN NULL ELSE text END AS Abstract,
               CASE WHEN source = 'src3' THEN NULL ELSE source END AS Journal
        FROM documents""",
    "merged": """
        SELECT r.PMID, r.rejection, r.reason, f.Title, f.Abstract, f.Journal
        FROM raw_labels r LEFT JOIN fetched f ON r.PMID = f.PMID""",
    "labelled": """
        SELECT d.doc_id, d.text, l.quality AS label
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    # ---- citations
    "lookup": """
        SELECT CASE WHEN p_size = 13 THEN concat('X', p_partkey) ELSE concat('W', p_partkey) END AS openalex_id,
               CASE WHEN p_brand = 'Brand#11' THEN NULL
                    WHEN p_brand = 'Brand#7' THEN concat('PMC', p_partkey)
                    ELSE CAST(p_partkey + 100000 AS VARCHAR) END AS pmid,
               concat('https://doi.org/10.1/', p_partkey) AS doi,
               p_partkey AS seq
        FROM part""",
    "edges": """
        SELECT o_orderkey AS pmid, l_linenumber AS pos, concat('W', l_partkey) AS ref
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
    # works with a list of referenced ids: orders with their parts; some works have none
    "work_members": """
        SELECT o_orderkey AS work, l_linenumber AS pos, l_partkey AS part
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey % 6 <> 0""",
    "work_lists": """
        SELECT o_orderkey AS pmid,
               coalesce(list('W' || m.part ORDER BY m.pos, m.part) FILTER (WHERE m.part IS NOT NULL), []) AS refs
        FROM orders LEFT JOIN work_members m ON o_orderkey = m.work GROUP BY o_orderkey""",
    # ---- experiment runs
    "runs": """
        SELECT l_orderkey * 10 + l_linenumber AS run_id,
               CASE WHEN l_linenumber = 1 THEN '2e-05' WHEN l_linenumber <= 3 THEN '3e-05'
                    ELSE '5e-05' END AS learning_rate,
               CAST(floor(l_quantity / 13) AS INTEGER) * 2 + 6 AS unfreeze_last_k_layers,
               CASE WHEN l_linestatus = 'F' AND l_linenumber = 7 THEN NULL ELSE l_returnflag END AS model,
               CASE WHEN l_linestatus = 'O' THEN true END AS title_abstract_journal,
               CAST(CASE WHEN l_linenumber > 4 THEN 380 ELSE 20 END AS INTEGER) AS seq_max_length,
               CAST(CASE WHEN l_returnflag = 'N' THEN 0.1 ELSE 0.01 END AS DOUBLE) AS weight_decay,
               l_discount * 10 AS best_val_f1,
               nullif(l_tax, 0) AS test_f1,
               l_quantity / 50 AS best_train_f1,
               l_tax * 5 AS best_val_precision,
               l_extendedprice / 100000 AS best_val_recall
        FROM lineitem""",
    "run_labels": """
        SELECT *, 'LR: ' || learning_rate || ', Layers: ' || unfreeze_last_k_layers AS run_group FROM runs""",
    "loss_runs": """
        SELECT vec_id AS run_id,
               CASE label WHEN 0 THEN 'allenai/biomed_roberta_base'
                          WHEN 1 THEN 'cambridgeltl/SapBERT-from-PubMedBERT-fulltext'
                          WHEN 2 THEN 'microsoft/BiomedNLP-BiomedBERT-base-uncased-abstract'
                          ELSE 'unlisted' END AS model_code,
               embedding AS train_loss
        FROM embeddings""",
    # ---- predictions
    "scores": """
        SELECT vec_id, labels, z0, z1, CAST(CASE WHEN z1 > z0 THEN 1 ELSE 0 END AS INTEGER) AS predicted_label,
               CASE WHEN md5(CAST(vec_id AS VARCHAR)) < 'b' THEN 'train'
                    WHEN md5(CAST(vec_id AS VARCHAR)) < 'd' THEN 'val' ELSE 'test' END AS split
        FROM (SELECT vec_id, CAST(label % 2 AS INTEGER) AS labels,
                     list_sum(list_transform(embedding[1:32], lambda x: CAST(x AS DOUBLE))) AS z0,
                     list_sum(list_transform(embedding[33:64], lambda x: CAST(x AS DOUBLE))) AS z1 FROM embeddings)""",
}


def raw_labels(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels")
    reason = F.when(F.col("toxic") == 1, "Review article").when(F.col("source") == "src5", "Off topic")
    rejection = F.when(F.col("quality") == 1, "Useful").when(F.col("quality") == 0, "Rejected")
    return (
        table(spark, d, "documents")
        .join(labels, "doc_id", "left")
        .select(F.col("doc_id").alias("PMID"), rejection.alias("rejection"), reason.alias("reason"))
    )


def fetched(spark: SparkSession, d: str) -> DataFrame:
    key = F.when(F.col("source") == "src13", -F.col("doc_id") - 1).otherwise(F.col("doc_id"))
    return table(spark, d, "documents").select(
        key.alias("PMID"),
        F.substring_index("text", "\n", 1).alias("Title"),
        F.when(F.col("n_chars") >= 400, F.col("text")).alias("Abstract"),
        F.when(F.col("source") != "src3", F.col("source")).alias("Journal"),
    )


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents: ``doc_id, text, label``."""
    labels = table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    return table(spark, d, "documents").join(labels, "doc_id").select("doc_id", "text", "label")


def lookup(spark: SparkSession, d: str) -> DataFrame:
    brand, part = F.col("p_brand"), F.col("p_partkey")
    pmid = (
        F.when(brand == "Brand#7", F.concat(F.lit("PMC"), part))
        .when(brand != "Brand#11", (part + 100000).cast("string"))
    )
    prefix = F.when(F.col("p_size") == 13, "X").otherwise("W")
    return table(spark, d, "part").select(
        F.concat(prefix, part).alias("openalex_id"),
        pmid.alias("pmid"),
        F.concat(F.lit("https://doi.org/10.1/"), part).alias("doi"),
        part.alias("seq"),
    )


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Citation edges ``pmid, pos, ref``."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    orders = table(spark, d, "orders").select("o_orderkey")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey").alias("pmid"),
        F.col("l_linenumber").alias("pos"),
        F.concat(F.lit("W"), "l_partkey").alias("ref"),
    )


def work_lists(spark: SparkSession, d: str) -> DataFrame:
    """Works with a list cell of referenced ids: ``pmid, refs``."""
    lines = table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey").alias("member"))
    cited = F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderkey")) == F.col("l_orderkey")
    members = table(spark, d, "orders").join(lines, cited, "left").groupBy("o_orderkey")
    lists = members.agg(F.sort_array(F.collect_list("member")).alias("members"))
    ids = F.transform("members", lambda m: F.concat(F.lit("W"), m["l_partkey"]))
    return lists.select(F.col("o_orderkey").alias("pmid"), ids.alias("refs"))


def runs(spark: SparkSession, d: str) -> DataFrame:
    line = F.col("l_linenumber")
    rate = F.when(line == 1, "2e-05").when(line <= 3, "3e-05").otherwise("5e-05")
    unnamed = (F.col("l_linestatus") == "F") & (line == 7)
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + line).alias("run_id"),
        rate.alias("learning_rate"),
        (F.floor(F.col("l_quantity") / 13).cast("int") * 2 + 6).alias("unfreeze_last_k_layers"),
        F.when(~unnamed, F.col("l_returnflag")).alias("model"),
        F.when(F.col("l_linestatus") == "O", True).alias("title_abstract_journal"),
        F.when(line > 4, 380).otherwise(20).alias("seq_max_length"),
        F.when(F.col("l_returnflag") == "N", 0.1).otherwise(0.01).alias("weight_decay"),
        (F.col("l_discount") * 10).alias("best_val_f1"),
        F.nullif(F.col("l_tax"), F.lit(0.0)).alias("test_f1"),
        (F.col("l_quantity") / 50).alias("best_train_f1"),
        (F.col("l_tax") * 5).alias("best_val_precision"),
        (F.col("l_extendedprice") / 100000).alias("best_val_recall"),
    )


# Model codes and their display names.
MODEL_NAMES = {
    "allenai/biomed_roberta_base": "BioMed RoBERTa",
    "cambridgeltl/SapBERT-from-PubMedBERT-fulltext": "SapBERT",
    "microsoft/BiomedNLP-BiomedBERT-base-uncased-abstract": "BioMed BERT",
}


def loss_runs(spark: SparkSession, d: str) -> DataFrame:
    """One loss vector per run: ``run_id, model_code, train_loss``."""
    code: Column = F.lit("unlisted")
    for number, name in enumerate(MODEL_NAMES):
        code = F.when(F.col("label") == number, name).otherwise(code)
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("run_id"), code.alias("model_code"), F.col("embedding").alias("train_loss")
    )


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x.cast("double"))


def scores(spark: SparkSession, d: str) -> DataFrame:
    """Binary logits, the sums of the two halves of the vectors: ``vec_id, labels, logits, split``."""
    digest = F.md5(F.col("vec_id").cast("string"))
    split = F.when(digest < "b", "train").when(digest < "d", "val").otherwise("test")
    return table(spark, d, "embeddings").select(
        "vec_id",
        (F.col("label") % 2).alias("labels"),
        F.array(_total(F.slice("embedding", 1, 32)), _total(F.slice("embedding", 33, 32))).alias("logits"),
        split.alias("split"),
    )
