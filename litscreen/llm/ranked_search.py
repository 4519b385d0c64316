"""Ranked lexical search, term at a time with a limit on accumulators.

The documents are searched in blocks. For each item a block goes through the
item's terms from the rarest on. A document with the term gets an accumulator,
until the bounds of the remaining terms together cannot reach the k-th best
partial score of the block: no new document can then be among its k best. From
there on only documents that have an accumulator are updated, exactly and to
the last term. The k best of every block are merged by score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litscreen.llm.common import LOWER, UPPER, ascii_lower, byte_slices, stored, table

TOP = 50
BLOCK_BYTES = 16 << 20  # text of a block of documents
BLOCK_DOCS = 1 << 14  # documents of a block at most, for the memory
QUERY_BYTES = 4 << 20  # text of the items that are searched in one pass
SLICE = 1 << 20  # bytes of a text that are split at a time
MERGE_BUCKETS = 64
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_IS_TERM = [c >= 128 or chr(c).isalnum() for c in range(256)]
#: A-Z to a-z, other ASCII characters that are in no term to blanks
_BYTES = bytes(ord(chr(c).lower()) if c < 128 and _IS_TERM[c] else c if c >= 128 else 32 for c in range(256))


def terms_of(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a whole text in order, in lists of bounded size; a null text has none."""
    data = (text or "").encode().translate(_BYTES)
    start = 0
    while start < len(data):
        stop = len(data)
        if stop - start > SLICE:
            cut = data.rfind(b" ", start, start + SLICE)
            if cut < 0:
                cut = data.find(b" ", start + SLICE)  # a term longer than a slice
            stop = cut if cut >= 0 else stop
        yield data[start:stop].split()
        start = stop + 1


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def query_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item, block, terms``: the distinct terms of every item; items of about ``QUERY_BYTES`` share a block."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    terms = F.array_distinct(F.regexp_extract_all(ascii_lower(text), F.lit(TERM), F.lit(0)))
    rows = stored(items.select(F.col(id_col).alias("item"), F.octet_length(text).alias("bytes"), terms.alias("terms")), "items")
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    blocks = -(-total // QUERY_BYTES) or 1
    return rows.select("item", F.pmod(F.xxhash64("item", "terms"), F.lit(blocks)).cast("int").alias("block"), "terms")


def corpus_statistics(docs: DataFrame, terms: dict[bytes, int]) -> tuple[int, int, np.ndarray]:
    """``N, L`` and, for every given term, the number of documents that hold it; over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        held = np.zeros(len(known) + 2, np.int64)  # per term, then documents with terms, then all their terms
        for batch in batches:
            for part in byte_slices(batch, "text", BLOCK_BYTES):
                for text in part.column("text").to_pylist():
                    found: set = set()
                    size = 0
                    for words in terms_of(text):
                        size += len(words)
                        found.update(map(known.get, words))
                    found.discard(None)
                    held[list(found)] += 1
                    held[-2] += size > 0
                    held[-1] += size
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], ["term", "n"])

    counted = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    held = np.zeros(len(terms) + 2, np.int64)
    for term, n in counted.collect():  # a number per term of the pass
        held[term] = n
    return int(held[-2]), int(held[-1]), held[:-2]


class Block:
    """Postings of a block of documents for the given terms, by term."""

    def __init__(self, texts: list[str | None], known: dict[bytes, int], n_docs: int, n_terms: int):
        ids, counts, held, damping = [], [], [], []
        for text in texts:
            tf: Counter = Counter()
            size = 0
            for words in terms_of(text):
                size += len(words)
                tf.update(map(known.get, words))
            del tf[None]
            ids.append(list(tf))
            counts.append(list(tf.values()))
            held.append(len(tf))
            damping.append(20 * (50 + 50 * size * n_docs // n_terms) if size else 0)
        term = np.fromiter(chain.from_iterable(ids), np.int64)
        tf_ = np.fromiter(chain.from_iterable(counts), np.int64)
        doc = np.repeat(np.arange(len(texts)), held)
        order = np.argsort(term, kind="stable")
        self.docs = doc[order]
        self.impacts = (1_000_000_000 * tf_ // (1000 * tf_ + np.array(damping, np.int64)[doc]))[order]
        self.starts = np.searchsorted(term[order], np.arange(len(known) + 1))
        self.size = len(texts)

    def best(self, ids: pa.Array, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the ``k`` best documents for one item, rarest term first; ties go to smaller ids."""
        lows, highs = self.starts[terms], self.starts[terms + 1]
        bounds = np.array([w * self.impacts[i:j].max(initial=0) for i, j, w in zip(lows, highs, weights)], np.int64)
        remaining = np.append(np.cumsum(bounds[::-1])[::-1], 0)  # of this term and all behind it
        score = np.zeros(self.size, np.int64)
        live = np.zeros(self.size, bool)
        n_live, open_ = 0, True
        for at, (i, j, w) in enumerate(zip(lows, highs, weights)):
            if open_ and n_live >= k and remaining[at] < score.max():
                open_ = remaining[at] >= np.partition(score, -k)[-k]  # documents without accumulator have 0
            docs, gain = self.docs[i:j], w * self.impacts[i:j]
            if open_:
                live[docs] = True
                n_live = int(np.count_nonzero(live))
            else:
                mine = live[docs]
                docs, gain = docs[mine], gain[mine]
            score[docs] += gain
        places = np.flatnonzero(score)
        if len(places) > k:
            cut = np.partition(score, -k)[-k]
            above, tied = np.flatnonzero(score > cut), np.flatnonzero(score == cut)
            first = pc.array_sort_indices(ids.take(pa.array(tied))).to_numpy()[: k - len(above)]
            places = np.concatenate((above, tied[first]))
        return places, score[places]


def _document_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """Ids and texts in blocks of about ``BLOCK_BYTES`` or ``BLOCK_DOCS`` documents."""
    ids: list[pa.Array] = []
    texts: list[str | None] = []
    size = 0
    for batch in batches:
        for part in byte_slices(batch, "text", BLOCK_BYTES):
            if texts and (size + part.column("text").nbytes > BLOCK_BYTES or len(texts) + part.num_rows > BLOCK_DOCS):
                yield pa.concat_arrays(ids), texts
                ids, texts, size = [], [], 0
            ids.append(part.column("doc_id"))
            texts += part.column("text").to_pylist()
            size += part.column("text").nbytes
    if texts:
        yield pa.concat_arrays(ids), texts


def _search(docs: DataFrame, items: list, k: int) -> DataFrame:
    """``item, doc_id, score``: for the items of one pass, the best documents of every block."""
    known = {term: number for number, term in enumerate(sorted({t.encode() for _, terms in items for t in terms}))}
    n_docs, n_terms, held = corpus_statistics(docs, known)
    plans = []
    for item, terms in items:
        numbers = sorted((known[t.encode()] for t in terms), key=lambda n: (held[n], n))
        numbers = [n for n in numbers if held[n]]
        weights = [weight(n_docs, int(held[n])) for n in numbers]
        plans.append((np.array(numbers, np.int64), np.array(weights, np.int64)))
    shared = docs.sparkSession.sparkContext.broadcast((known, plans))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, plans = shared.value
        for ids, texts in _document_blocks(batches):
            block = Block(texts, known, n_docs, n_terms)
            for number, (terms, weights) in enumerate(plans):
                places, scores = block.best(ids, terms, weights, k)
                if len(places):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(places), number, np.int32)), ids.take(pa.array(places)), pa.array(scores)],
                        ["number", "doc_id", "score"],
                    )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(search, f"number int, doc_id {kind}, score long")


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text"
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of every item with a score above 0.

    Of equal scores the smaller id comes first, null ids last. Whole texts are
    read; null and empty ones have no terms, and an item without terms, or of
    which no document has a term, has no rows. Repeated documents and items
    count as often as they stand there. Empty tables give no rows; other columns
    are not read. Items are searched in passes of about ``QUERY_BYTES`` of their
    text, each of which reads the documents twice.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    queries = query_terms(items, item_col, text_col)
    kind = queries.schema["item"].dataType.simpleString()
    found = []
    for (block,) in queries.select("block").distinct().orderBy("block").collect():
        # the items of one pass, bounded by QUERY_BYTES
        mine = [(r["item"], r["terms"]) for r in queries.where(F.col("block") == block).select("item", "terms").collect()]
        names = spark.createDataFrame([(n, item) for n, (item, _) in enumerate(mine)], f"number int, item {kind}")
        candidates = _search(docs, mine, k)
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        # the best of every bucket first, so that no task meets all candidates of an item
        bucket = F.pmod(F.xxhash64("doc_id"), F.lit(MERGE_BUCKETS))
        some = candidates.withColumn("bucket", bucket)
        some = some.withColumn("rank", F.row_number().over(Window.partitionBy("number", "bucket").orderBy(*order)))
        some = some.where(F.col("rank") <= k).drop("rank", "bucket")
        best = some.withColumn("rank", F.row_number().over(Window.partitionBy("number").orderBy(*order)))
        best = best.where(F.col("rank") <= k)
        named = best.join(F.broadcast(names), "number")
        found.append(stored(named.select(F.col("item").alias("item_id"), "rank", "doc_id", "score"), "ranked"))
    if not found:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id {dict(docs.dtypes)['doc_id']}, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


ORACLE_SQL = r"""
    WITH words AS (
        SELECT doc_id, unnest(regexp_extract_all(
            translate(text, '{upper}', '{lower}'), '{term}')) AS term
        FROM documents
    ),
    postings AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
    sizes AS (SELECT doc_id, sum(tf) AS n FROM postings GROUP BY ALL),
    totals AS (SELECT count(*) AS nn, sum(n) AS ll FROM sizes),
    frequencies AS (SELECT term, count(*) AS df FROM postings GROUP BY ALL),
    queries AS (
        SELECT DISTINCT item_id, unnest(regexp_extract_all(
            translate(text, '{upper}', '{lower}'), '{term}')) AS term
        FROM benchmark
    ),
    weights AS (
        SELECT term, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
        FROM frequencies, totals
    ),
    damping AS (SELECT doc_id, 50 + CAST((50 * n * nn) // ll AS BIGINT) AS m FROM sizes, totals),
    scores AS (
        SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
        FROM queries JOIN weights USING (term) JOIN postings USING (term) JOIN damping USING (doc_id)
        GROUP BY ALL
    )
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
    FROM scores WHERE score > 0
    QUALIFY rank <= {top}
"""
for _name, _value in (("term", TERM), ("top", str(TOP)), ("upper", UPPER), ("lower", LOWER)):
    ORACLE_SQL = ORACLE_SQL.replace(f"{{{_name}}}", _value)


def op12_ranked_search(spark, sf_dir):
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
