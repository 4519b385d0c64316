"""Classical text features: vocabulary, counts, TF-IDF, lemmas, fixed-length ids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litscreen.functions import text as tx
from litscreen.functions.lookup import lookup_ids, replace_members
from litscreen.operators.lists import map_members
from litscreen.operators.vocabulary import Vocabulary, learn_vocabulary
from litscreen.session import scratch_path

# Ids of the encoder that are no words, in this order.
SPECIAL_TOKENS = ["[PAD]", "[UNK]", tx.KEY_MARKER, tx.TITLE_END, tx.JOURNAL_END]


def exploded_terms(tokens: DataFrame, column: str, *keys: str) -> DataFrame:
    """One row ``keys, term`` per token.

    The outer form keeps Catalyst from putting a test for empty lists in front,
    which would tokenise every text a second time.
    """
    return tokens.select(*keys, F.explode_outer(column).alias("term")).where("term IS NOT NULL")


def build_vocabulary(tokens: DataFrame, column: str, max_features: int) -> DataFrame:
    """``term, idx, n, df``: the most frequent terms of the corpus, indexed alphabetically.

    ``n`` is the number of occurrences, ``df`` that of documents; see
    :func:`learn_vocabulary`, which runs at once.
    """
    found = learn_vocabulary(tokens, column, max_features)
    rows = list(zip(found.terms, range(len(found.terms)), found.counts, found.documents))
    return tokens.sparkSession.createDataFrame(rows, "term string, idx long, n long, df long")


def count_model(terms: Sequence[str], column: str, output: str) -> CountVectorizerModel:
    """Document-term counts of a fixed vocabulary; unseen terms are ignored."""
    return CountVectorizerModel.from_vocabulary(list(terms), inputCol=column, outputCol=output)


def weighted_model(terms: Sequence[str], weights: Sequence[float], column: str, output: str) -> PipelineModel:
    """Counts of the terms times their weights, scaled to length 1; nothing is left to fit."""
    counts, scaled = f"{output}_counts", f"{output}_scaled"
    return PipelineModel(
        [
            count_model(terms, column, counts),
            ElementwiseProduct(scalingVec=Vectors.dense(weights), inputCol=counts, outputCol=scaled),
            Normalizer(p=2.0, inputCol=scaled, outputCol=output),
        ]
    )


def tfidf_model(vocabulary: Vocabulary, column: str, output: str) -> PipelineModel:
    """tf * (ln((1+n)/(1+df)) + 1), scaled to length 1."""
    return weighted_model(vocabulary.terms, vocabulary.inverse_document_frequency(), column, output)


def vector_entries(df: DataFrame, key: str, vector: str, value: str) -> DataFrame:
    """The stored entries of a sparse vector column as rows ``key, idx, value``; no shuffle."""
    raw = df.select(key, F.unwrap_udt(vector).alias("v"))
    pairs = F.arrays_zip(F.col("v.indices").alias("idx"), F.col("v.values").alias(value))
    return raw.select(key, F.inline(pairs)).select(key, F.col("idx").cast("long").alias("idx"), value)


def term_counts(tokens: DataFrame, key: str, column: str, terms: Sequence[str]) -> DataFrame:
    """``key, idx, tf`` of the terms of the vocabulary; all others are left out."""
    counted = count_model(terms, column, "_counts").transform(tokens.select(key, column))
    return vector_entries(counted, key, "_counts", "tf").withColumn("tf", F.col("tf").cast("long"))


def tfidf_weights(tokens: DataFrame, key: str, column: str, vocabulary: Vocabulary) -> DataFrame:
    """``key, idx, weight`` of the TF-IDF vectors."""
    weighted = tfidf_model(vocabulary, column, "_tfidf").transform(tokens.select(key, column))
    return vector_entries(weighted, key, "_tfidf", "weight")


# ---- lemmas ---------------------------------------------------------------------------------


def lemmatise(df: DataFrame, column: str, lemmas: DataFrame, output: str = "lemmas") -> DataFrame:
    """Replace every blank-separated token by its lemma, if ``lemmas(token, lemma)`` has one.

    Of a token that is listed twice the smallest lemma counts. A blank text has
    no tokens, a NULL one no lemmas. The table may have any size; it is stored
    first, as Catalyst shuffles every token if it does not know that size.
    """
    unique = lemmas.where("token IS NOT NULL").groupBy(F.col("token").alias("member")).agg(F.min("lemma").alias("value"))
    path = scratch_path(df.sparkSession, "lemmas")
    unique.write.parquet(path)
    unique = df.sparkSession.read.schema(unique.schema).parquet(path)
    words = map_members(df, tx.words(F.col(column)), unique, "_lemmas", keep_unknown=True)
    text = F.when(F.col(column).isNotNull(), F.array_join("_lemmas", " "))
    return words.withColumn(output, text).drop("_lemmas")


def lemma_text(col: Column, table: Mapping[str, str]) -> Column:
    """Text of lemmas from a list that is a model's parameter; :func:`lemmatise` takes a table."""
    return F.array_join(replace_members(tx.words(col), table), " ")


# ---- fixed-length ids -----------------------------------------------------------------------


def input_pieces(col: Column, specials: Sequence[str] = SPECIAL_TOKENS) -> Column:
    """Marker tokens and lower-case words of a model input text, in order."""
    markers = "|".join(m.lower().replace("[", r"\[").replace("]", r"\]") for m in specials)
    return F.regexp_extract_all(F.lower(col), F.lit(f"{markers}|{tx.WORD}{{2,}}"), F.lit(0))


def learn_encoder(df: DataFrame, column: str, max_features: int) -> dict[str, int]:
    """``{piece: id}``: the special tokens, then the most frequent words in alphabetical order."""
    specials = [m.lower() for m in SPECIAL_TOKENS]
    pieces = df.select(F.filter(input_pieces(F.col(column)), lambda p: ~p.isin(specials)).alias("words"))
    terms = learn_vocabulary(pieces, "words", max_features).terms
    return {piece: number for number, piece in enumerate([*specials, *terms])}


def encode_fixed_length(df: DataFrame, column: str, encoder: Mapping[str, int], max_length: int) -> DataFrame:
    """Add ``input_ids`` and ``attention_mask``, both exactly ``max_length`` long.

    Pieces beyond ``max_length`` are cut off, unknown ones get the id of ``[UNK]``.
    """
    kept = F.slice(input_pieces(F.col(column)), 1, max_length)
    found = df.withColumn("_ids", lookup_ids(kept, encoder, SPECIAL_TOKENS.index("[UNK]")))
    input_ids, mask = tx.truncate_pad(F.col("_ids"), max_length, SPECIAL_TOKENS.index("[PAD]"))
    return found.withColumns({"input_ids": input_ids, "attention_mask": mask}).drop("_ids")
