"""Queries on whole texts: cleaning, tokens, marks, encoded input, vocabulary, TF-IDF."""

from __future__ import annotations

from pyspark.sql import functions as F

from litscreen.functions import text as tx
from litscreen.operators import aggregates as agg
from litscreen.operators import columns as cols
from litscreen.operators import features as ft
from litscreen.operators.vocabulary import learn_vocabulary
from litscreen.plans import views as v
from litscreen.plans.registry import query

# SQL pieces with the same character classes
_SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]"
_NOT_SPACE = r"[^\t-\r\x{1c}-\x{20}\x{85}\p{Z}]"
_WORD = r"[\p{L}\p{N}_]"


def _sql_collapse(text: str) -> str:
    return f"trim(regexp_replace({text}, '{_SPACE}+', ' ', 'g'))"


def _sql_clean(text: str, lower=True, digits=True, punct=True) -> str:
    text = f"coalesce({text}, '')"
    if lower:
        text = f"lower({text})"
    patterns = ["<[^>]+>", rf"http{_NOT_SPACE}+|www\.{_NOT_SPACE}+", f"{_NOT_SPACE}+@{_NOT_SPACE}+"]
    patterns += [r"\p{Nd}+"] if digits else []
    patterns += [r"[^\p{L}\p{N}_\t-\r\x{1c}-\x{20}\x{85}\p{Z}]"] if punct else []
    for pattern in patterns:
        text = f"regexp_replace({text}, '{pattern}', ' ', 'g')"
    return _sql_collapse(text)


def _sql_tokens(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '{_WORD}{{2,}}')"


def _sql_mark(text: str, keyword: str) -> str:
    """Whole-word marks without look-around: fence every non-word character, replace, unfence."""
    fenced = f"regexp_replace({text}, '([^\\p{{L}}\\p{{N}}_])', chr(1) || '\\1' || chr(1), 'g')"
    hit = f"'(?i)(^|' || chr(1) || '){keyword}(' || chr(1) || '|$)'"
    marked = f"regexp_replace({fenced}, {hit}, '\\1[KEY] {keyword} [KEY]\\2', 'g')"
    return f"replace({marked}, chr(1), '')"


# ---- scalar functions -----------------------------------------------------------------------


@query("collapse_whitespace", f"SELECT doc_id, {_sql_collapse('text')} AS text FROM documents")
def collapse_whitespace(spark, d):
    return v.table(spark, d, "documents").select("doc_id", tx.collapse_whitespace(F.col("text")).alias("text"))


@query(
    "clean_text",
    f"""SELECT page_id, {_sql_clean('html')} AS cleaned,
               {_sql_clean('html', lower=False, digits=False, punct=False)} AS lightly_cleaned FROM pages""",
)
def clean_text(spark, d):
    html = F.col("html")
    return v.table(spark, d, "pages").select(
        "page_id",
        tx.clean_text(html).alias("cleaned"),
        tx.clean_text(html, lower=False, remove_digits=False, remove_punct=False).alias("lightly_cleaned"),
    )


@query("word_tokens", f"SELECT doc_id, array_to_string({_sql_tokens('text')}, ' ') AS tokens FROM documents")
def word_tokens(spark, d):
    return v.table(spark, d, "documents").select(
        "doc_id", F.array_join(tx.word_tokens(F.col("text")), " ").alias("tokens")
    )


@query(
    "word_count",
    f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{_NOT_SPACE}+')) AS INTEGER) AS n_words FROM documents",
)
def word_count(spark, d):
    return v.table(spark, d, "documents").select("doc_id", tx.word_count(F.col("text")).alias("n_words"))


@query(
    "word_ngrams",
    f"""WITH t AS (SELECT doc_id, {_sql_tokens('text')} AS w FROM documents)
        SELECT doc_id,
               array_to_string(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), '|') AS grams
        FROM t""",
)
def word_ngrams(spark, d):
    # the token list is a column of its own, so that it is not extracted once per use
    tokens = v.table(spark, d, "documents").select("doc_id", tx.word_tokens(F.col("text")).alias("w"))
    return tokens.select("doc_id", F.array_join(tx.word_ngrams(F.col("w"), 1, 2), "|").alias("grams"))


_MARKED = _sql_mark(_sql_mark(_sql_mark("text", "the"), "of"), "und")


@query("mark_keywords", f"SELECT doc_id, {_MARKED} AS marked FROM documents")
def mark_keywords(spark, d):
    return v.table(spark, d, "documents").select(
        "doc_id", tx.mark_keywords(F.col("text"), ["the", "of", "und"]).alias("marked")
    )


_COMPOSED = """coalesce(Title, 'None') || ' [T_END] ' || coalesce(Journal, 'None') || ' [J_END] '
               || coalesce(Abstract, 'None')"""


@query("compose_input_text", v.with_views("fetched", f"SELECT PMID, {_COMPOSED} AS input_text FROM fetched"))
def compose_input_text(spark, d):
    text = tx.compose_input_text(F.col("Title"), F.col("Journal"), F.col("Abstract"))
    return v.fetched(spark, d).select("PMID", text.alias("input_text"))


_WORD_LENGTHS = f"list_transform(regexp_extract_all(text, '{_NOT_SPACE}+'), lambda x: CAST(length(x) AS INTEGER))"


@query(
    "truncate_pad",
    f"""WITH t AS (SELECT doc_id, {_WORD_LENGTHS} AS ids FROM documents)
        SELECT doc_id,
               array_to_string(ids[1:64] || list_transform(range(greatest(64 - len(ids), 0)), lambda x: 0), ' ') AS input_ids,
               array_to_string(list_transform(range(64), lambda x: CAST(x < len(ids) AS INTEGER)), ' ') AS attention_mask
        FROM t""",
)
def truncate_pad(spark, d):
    # stand-in ids: the length of each word
    lengths = F.transform(tx.words(F.col("text")), F.length)
    lists = v.table(spark, d, "documents").select("doc_id", lengths.alias("ids"))
    input_ids, mask = tx.truncate_pad(F.col("ids"), 64)
    return lists.select(
        "doc_id", F.array_join(input_ids, " ").alias("input_ids"), F.array_join(mask, " ").alias("attention_mask")
    )


# ---- aggregates over texts ------------------------------------------------------------------

_COUNTS = f"WITH t AS (SELECT len(regexp_extract_all(text, '{_NOT_SPACE}+')) AS n_words FROM documents)"


@query(
    "describe_numeric",
    f"""{_COUNTS}
        SELECT count(n_words) AS n, round(avg(n_words), 6) AS mean, round(stddev_samp(n_words), 6) AS std,
               CAST(min(n_words) AS DOUBLE) AS min, CAST(max(n_words) AS DOUBLE) AS max,
               CAST(quantile_cont(n_words, 0.25) AS DOUBLE) AS q25,
               CAST(quantile_cont(n_words, 0.5) AS DOUBLE) AS q50,
               CAST(quantile_cont(n_words, 0.75) AS DOUBLE) AS q75 FROM t""",
)
def describe_numeric(spark, d):
    counts = v.table(spark, d, "documents").select(tx.word_count(F.col("text")).alias("n_words"))
    described = agg.describe_numeric(counts, "n_words")
    return described.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query("mean_word_count", f"{_COUNTS} SELECT round(avg(n_words), 6) AS mean_words FROM t")
def mean_word_count(spark, d):
    means = agg.mean_word_count(v.table(spark, d, "documents"), "text")
    return means.select(F.round("mean_words", 6).alias("mean_words"))


# ---- features -------------------------------------------------------------------------------

_TERMS = f"""terms AS (SELECT doc_id, unnest({_sql_tokens('text')}) AS term FROM documents)"""
_VOCABULARY = f"""{_TERMS},
    top AS (SELECT term, count(*) AS n, count(DISTINCT doc_id) AS df FROM terms GROUP BY term ORDER BY n DESC, term LIMIT 5000),
    vocabulary AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx, n, df FROM top)"""


@query("build_vocabulary", f"WITH {_VOCABULARY} SELECT term, idx, n, df FROM vocabulary")
def build_vocabulary(spark, d):
    tokens = v.table(spark, d, "documents").select(tx.word_tokens(F.col("text")).alias("w"))
    return ft.build_vocabulary(tokens, "w", 5000)


@query(
    "build_vocabulary_bigrams",
    f"""WITH tokens AS (SELECT doc_id, {_sql_tokens('text')} AS w FROM documents),
        grams AS (SELECT doc_id, unnest(w) AS term FROM tokens UNION ALL
                  SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM tokens),
        top AS (SELECT term, count(*) AS n, count(DISTINCT doc_id) AS df FROM grams GROUP BY term ORDER BY n DESC, term LIMIT 2000)
        SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx, n, df FROM top""",
)
def build_vocabulary_bigrams(spark, d):
    # the token list is a column of its own, so that it is not extracted once per use
    tokens = v.table(spark, d, "documents").select(tx.word_tokens(F.col("text")).alias("w"))
    return ft.build_vocabulary(tokens.select(tx.word_ngrams(F.col("w"), 1, 2).alias("w")), "w", 2000)


@query(
    "term_counts",
    f"""WITH {_VOCABULARY}
        SELECT doc_id, idx, count(*) AS tf FROM terms JOIN vocabulary USING (term) GROUP BY doc_id, idx""",
)
def term_counts(spark, d):
    tokens = v.table(spark, d, "documents").select("doc_id", tx.word_tokens(F.col("text")).alias("w"))
    return ft.term_counts(tokens, "doc_id", "w", learn_vocabulary(tokens, "w", 5000).terms)


_TFIDF = f"""WITH {_VOCABULARY},
    tf AS (SELECT doc_id, idx, count(*) AS tf FROM terms JOIN vocabulary USING (term) GROUP BY doc_id, idx),
    df AS (SELECT idx, count(*) AS df FROM tf GROUP BY idx),
    raw AS (SELECT doc_id, idx, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w
            FROM tf JOIN df USING (idx))
    SELECT doc_id, idx, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 9) AS weight FROM raw"""


@query("tfidf", _TFIDF)
def tfidf(spark, d):
    tokens = v.table(spark, d, "documents").select("doc_id", tx.word_tokens(F.col("text")).alias("w"))
    weights = ft.tfidf_weights(tokens, "doc_id", "w", learn_vocabulary(tokens, "w", 5000))
    return weights.withColumn("weight", F.round("weight", 9))


# A small lemma table of frequent words.
LEMMAS = {"is": "be", "are": "be", "was": "be", "an": "a", "these": "this", "der": "die", "les": "le", "los": "el"}

_LEMMA_SQL = "CASE w " + " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in LEMMAS.items()) + " ELSE w END"


@query(
    "lemmatise",
    f"""SELECT doc_id, array_to_string(list_transform(
               string_split(cleaned, ' '), lambda w: {_LEMMA_SQL}), ' ') AS lemmas
        FROM (SELECT doc_id, {_sql_clean('text')} AS cleaned FROM documents)""",
)
def lemmatise(spark, d):
    lemmas = spark.createDataFrame(list(LEMMAS.items()), "token string, lemma string")
    cleaned = v.table(spark, d, "documents").select("doc_id", tx.clean_text(F.col("text")).alias("text"))
    return ft.lemmatise(cleaned, "text", lemmas).select("doc_id", "lemmas")


_ENCODE = f"""WITH composed AS (
        SELECT doc_id, {_sql_mark("coalesce(split_part(text, chr(10), 1), 'None') || ' [T_END] ' || coalesce(source, 'None') || ' [J_END] ' || coalesce(text, 'None')", "the")} AS input_text
        FROM documents),
    pieces AS (SELECT doc_id, regexp_extract_all(lower(input_text), '\\[key\\]|\\[t_end\\]|\\[j_end\\]|{_WORD}{{2,}}') AS p
               FROM composed),
    words AS (SELECT unnest(p) AS term FROM pieces),
    top AS (SELECT term, count(*) AS n FROM words WHERE term NOT LIKE '[%' GROUP BY term ORDER BY n DESC, term LIMIT 5000),
    ids AS (SELECT term, row_number() OVER (ORDER BY term) + 4 AS id FROM top
            UNION ALL SELECT '[key]', 2 UNION ALL SELECT '[t_end]', 3 UNION ALL SELECT '[j_end]', 4),
    placed AS (SELECT doc_id, i, p[i] AS term
               FROM (SELECT doc_id, p, unnest(range(1, least(len(p), 48) + 1)) AS i FROM pieces)),
    found AS (SELECT doc_id, i, coalesce(id, 1) AS id FROM placed LEFT JOIN ids USING (term)),
    lists AS (SELECT d.doc_id, coalesce(list(id ORDER BY i) FILTER (WHERE id IS NOT NULL), []) AS ids
              FROM documents d LEFT JOIN found f ON d.doc_id = f.doc_id GROUP BY d.doc_id)
    SELECT doc_id,
           array_to_string(ids || list_transform(range(48 - len(ids)), lambda x: 0), ' ') AS input_ids,
           array_to_string(list_transform(range(48), lambda x: CAST(x < len(ids) AS INTEGER)), ' ') AS attention_mask
    FROM lists"""


def _encoded(spark, d):
    doc = v.table(spark, d, "documents")
    title = F.substring_index("text", "\n", 1)
    composed = doc.select(
        "doc_id", tx.mark_keywords(tx.compose_input_text(title, F.col("source"), F.col("text")), ["the"]).alias("input_text")
    )
    encoder = ft.learn_encoder(composed, "input_text", 5000)
    return ft.encode_fixed_length(composed, "input_text", encoder, 48)


@query("encode_fixed_length", _ENCODE)
def encode_fixed_length(spark, d):
    return _encoded(spark, d).select(
        "doc_id",
        F.array_join("input_ids", " ").alias("input_ids"),
        F.array_join("attention_mask", " ").alias("attention_mask"),
    )


@query("model_input_columns", f"SELECT input_ids, attention_mask FROM ({_ENCODE})")
def model_input_columns(spark, d):
    kept = cols.model_input_columns(_encoded(spark, d))
    return kept.select(*[F.array_join(c, " ").alias(c) for c in kept.columns])
