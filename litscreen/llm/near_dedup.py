"""Near-duplicate detection by MinHash with tensored banding.

Two groups of ``collections`` small hash tuples (``rows`` MinHash values each)
are computed per document, and every pair of one tuple of each group is a table
key: 2 * collections * rows MinHash values serve collections ** 2 tables of
2 * rows values. Only tuples that two documents share are paired, because a
table key is shared only where both its tuples are.

Candidates are verified on the full shingle sets:

1. Documents with equal sets become one node.
2. In every table bucket each node is compared with the smallest node; links
   that hold join their nodes into components.
3. Buckets whose nodes are not yet one component are gathered into clusters, and
   within a cluster all nodes of different components are compared, block by
   block. So no link between bucket mates is lost, and the members of a dense
   group are not compared with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litscreen.llm.common import stored, table
from litscreen.llm.components import connected_components

COLLECTIONS = 16
ROWS = 3
BLOCK = 512  # nodes of a cluster that one task compares with as many others
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles.

    Words stand between ASCII blanks, A-Z lower-cased. Fewer words than ``size``
    are one shingle; a text without words has none.
    """
    import xxhash

    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(hashes) - size + 1
    mixed = np.zeros(n, np.uint64)
    for k in range(size):
        mixed = (mixed ^ hashes[k : k + n]) * _ODD[k % 3]
        mixed ^= mixed >> np.uint64(29)
    return np.unique(_mixed(mixed))


def minhashes(shingles: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Smallest value of each 32-bit hash function over the shingles."""
    out = np.full(len(factors), 2**32 - 1, np.uint32)
    keys = (shingles >> np.uint64(32)).astype(np.uint32)
    for start in range(0, len(keys), 2048):
        np.minimum(out, (keys[start : start + 2048, None] * factors + shifts).min(0), out=out)
    return out


def tuple_keys(signatures: np.ndarray, collections: int, rows: int) -> np.ndarray:
    """One 64-bit key per tuple: documents x (2 * collections)."""
    parts = signatures.reshape(-1, 2 * collections, rows).astype(np.uint64)
    keys = np.broadcast_to(np.arange(2 * collections, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(rows):
        keys = _mixed(keys * _ODD[0] + parts[:, :, k])
    return keys


def _hash_functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.RandomState(7)
    factors = random.randint(0, 2**31, count, dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
    return factors, random.randint(0, 2**32, count, dtype=np.int64).astype(np.uint32)


def _set_id(shingles: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(shingles.tobytes())


def set_signatures(docs: DataFrame, shingle_words: int, collections: int, rows: int) -> DataFrame:
    """``doc_id, text_hash, n_shingles, set_id, left, right`` for every row of ``doc_id, text_hash, text``.

    Rows without shingles have a null ``set_id`` and no keys.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, shifts = _hash_functions(2 * collections * rows)
        for batch in batches:
            counts, ids = [], []
            signatures = np.zeros((batch.num_rows, len(factors)), np.uint32)
            for i, text in enumerate(batch.column("text")):
                shingles = shingle_hashes(text.as_py(), shingle_words)
                counts.append(len(shingles))
                ids.append(_set_id(shingles) if len(shingles) else None)
                signatures[i] = minhashes(shingles, factors, shifts)
            keys = tuple_keys(signatures, collections, rows).view(np.int64)
            offsets = pa.array(np.arange(batch.num_rows + 1) * collections, pa.int32())
            left, right = (
                pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(part).ravel()))
                for part in (keys[:, :collections], keys[:, collections:])
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_hash"),
                    pa.array(counts, pa.int64()),
                    pa.array(ids, pa.binary()),
                    left,
                    right,
                ],
                names=["doc_id", "text_hash", "n_shingles", "set_id", "left", "right"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text_hash long, n_shingles long, set_id binary, left array<long>, right array<long>"
    return docs.select("doc_id", "text_hash", "text").mapInArrow(sign, schema)


def _shared(nodes: DataFrame, side: str) -> DataFrame:
    """``node`` with the array of its tuple keys that another node has too."""
    keys = nodes.select("node", F.explode(side).alias("key"))
    common = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    return keys.join(common, "key").groupBy("node").agg(F.collect_list("key").alias(side))


def table_buckets(nodes: DataFrame) -> DataFrame:
    """``bucket, node``: the entries of the tensored tables whose two tuples are both shared."""
    both = _shared(nodes, "left").join(_shared(nodes, "right"), "node")
    exploded = both.select("node", F.explode("left").alias("l"), "right").select(
        "node", "l", F.explode("right").alias("r")
    )
    return exploded.select(F.xxhash64("l", "r").alias("bucket"), "node")


def _stars(buckets: DataFrame) -> DataFrame:
    """Distinct pairs ``a`` (the smallest node of a bucket) and ``b`` (another node of it)."""
    first = buckets.groupBy("bucket").agg(F.min("node").alias("a"), F.max("node").alias("_last"))
    first = first.where("a < _last").drop("_last")
    return buckets.join(first, "bucket").where("a < node").select("a", F.col("node").alias("b")).distinct()


def _shingle_sets(docs: DataFrame, wanted: DataFrame, shingle_words: int) -> DataFrame:
    """``node, shingles`` (64-bit little-endian, sorted) of the wanted ``node, set_id, doc_id``."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sets = [], []
            for node, set_id, text in zip(batch.column("node"), batch.column("set_id"), batch.column("text")):
                shingles = shingle_hashes(text.as_py(), shingle_words)
                if _set_id(shingles) == set_id.as_py():  # not another text under the same id
                    nodes.append(node.as_py())
                    sets.append(shingles.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "shingles"])

    renamed = wanted.select("node", "set_id", F.col("doc_id").alias("_doc_id"))
    texts = docs.join(renamed, docs["doc_id"].eqNullSafe(renamed["_doc_id"])).select("node", "set_id", "text")
    return texts.mapInArrow(make, "node long, shingles binary").dropDuplicates(["node"])


def similar(left: np.ndarray, right: np.ndarray, percent: int) -> bool:
    small, large = sorted((len(left), len(right)))
    if 100 * small < percent * large:
        return False
    common = len(np.intersect1d(left, right, assume_unique=True))
    return 100 * common >= percent * (small + large - common)


def _verified_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets are similar enough."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            holds = [
                similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent)
                for x, y in zip(batch.column("x"), batch.column("y"))
            ]
            yield batch.select(["a", "b"]).filter(pa.array(holds, pa.bool_()))

    xs = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    ys = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    ratio = F.octet_length("x") * 100 >= percent * F.octet_length("y")
    inverse = F.octet_length("y") * 100 >= percent * F.octet_length("x")
    rows = pairs.join(ys, "b").join(xs, "a").where(ratio & inverse)
    return rows.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long")


def cross_links(group: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links between nodes of different components in one pair of blocks.

    ``group``: ``node, component, block, one, two, shingles``. Overlaps are
    counted through an inverted index of the second block's shingles.
    """
    one, two = group["one"].iloc[0], group["two"].iloc[0]
    first, second = group[group["block"] == one], group[group["block"] == two]
    sets = [np.frombuffer(x, np.uint64) for x in second["shingles"]]
    if not len(first) or not sets:
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    sizes = np.array(list(map(len, sets)))
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owners = values[order], np.repeat(np.arange(len(sets)), sizes)[order]
    nodes, components = second["node"].to_numpy(), second["component"].to_numpy()
    found: list[tuple[int, int]] = []
    for node, component, data in zip(first["node"], first["component"], first["shingles"]):
        mine = np.frombuffer(data, np.uint64)
        lo, hi = np.searchsorted(values, mine, "left"), np.searchsorted(values, mine, "right")
        hits = hi - lo
        places = np.repeat(lo - np.concatenate(([0], np.cumsum(hits)[:-1])), hits) + np.arange(hits.sum())
        common = np.bincount(owners[places], minlength=len(sets))
        good = (100 * common >= percent * (len(mine) + sizes - common)) & (components != component) & (nodes != node)
        found += [(node, other) for other in nodes[good]]
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def _remaining_links(buckets: DataFrame, components: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links between different components among nodes that share a bucket."""
    placed = buckets.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi"))
    open_buckets = stored(buckets.join(mixed.where("_lo < _hi").select("bucket"), "bucket"), "open-buckets")
    clusters = stored(
        connected_components(_stars(open_buckets)).select("node", F.col("component").alias("cluster")), "clusters"
    )
    sizes = clusters.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = (
        clusters.join(sizes, "cluster")
        .join(components, "node", "left")
        .select(
            "node",
            "cluster",
            "blocks",
            F.coalesce("component", "node").alias("component"),
            F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"),
        )
    )
    paired = dealt.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "node",
        "cluster",
        "component",
        "block",
        F.least("block", "_with").alias("one"),
        F.greatest("block", "_with").alias("two"),
    )

    def links(group: pd.DataFrame) -> pd.DataFrame:
        return cross_links(group, percent)

    return paired.join(sets, "node").groupBy("cluster", "one", "two").applyInPandas(links, "a long, b long")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 5,
    percent: int = 80,
    collections: int = COLLECTIONS,
    rows: int = ROWS,
    block: int = BLOCK,
) -> DataFrame:
    """``doc_id, text_hash, n_shingles, component_id, group`` for every row of ``docs``.

    Rows are linked whose distinct word shingles have a Jaccard similarity of
    ``percent`` / 100 or more; ``component_id`` is the smallest id reachable,
    its own included, and ``group`` a number of the component (null without
    words). ``text_hash`` is ``xxhash64`` of the text, so that id and hash name a row. Null texts count as empty; a text without words has no
    shingles and is linked with nothing. Null ids take part and are smaller than
    none: a component of null ids only has a null id. Repeated rows get equal
    results. Other columns are left out.

    ``docs`` must read a table, as it is evaluated twice: once for the
    signatures, once for the sets of the candidates. With the default tuples a
    link at similarity 0.85 is missed with a probability below 1e-6, one at 0.8
    below 1e-4; raise ``collections`` for lower thresholds.
    """
    text = F.col(text_col)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    signed = stored(set_signatures(texts, shingle_words, collections, rows), "signatures")
    nodes = stored(
        signed.where("n_shingles > 0")
        .groupBy("set_id")
        .agg(F.min("doc_id").alias("doc_id"), F.first("left").alias("left"), F.first("right").alias("right"))
        .withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    buckets = stored(table_buckets(nodes), "buckets")
    stars = stored(_stars(buckets), "stars")
    candidates = stars.select(F.col("a").alias("node")).union(stars.select("b")).distinct()
    wanted = nodes.join(candidates, "node").select("node", "set_id", "doc_id")
    sets = stored(_shingle_sets(texts, wanted, shingle_words), "sets")

    links = stored(_verified_pairs(stars, sets, percent), "links")
    components = stored(connected_components(links), "components")
    more = stored(_remaining_links(buckets, components, sets, percent, block), "more-links")
    if more.limit(1).count():
        components = stored(connected_components(links.union(more)), "components")

    labelled = nodes.select("node", "set_id", "doc_id").join(components, "node", "left")
    labelled = labelled.withColumn("component", F.coalesce("component", "node"))
    smallest = labelled.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_set = labelled.join(smallest, "component").select("set_id", "component_id", F.col("component").alias("group"))
    found = signed.where("set_id IS NOT NULL").join(by_set, "set_id")
    alone = signed.where("set_id IS NULL").withColumns(
        {"component_id": F.col("doc_id"), "group": F.lit(None).cast("long")}
    )
    columns = ["doc_id", "text_hash", "n_shingles", "component_id", "group"]
    return found.select(*columns).unionByName(alone.select(*columns))


def op7_near_dedup(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, percent=85)
    return found.select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


ORACLE_SQL = r"""
    WITH RECURSIVE words AS (
        SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
        FROM documents),
    shingle AS (
        SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 3], ' ') AS s
        FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 2, 1))) AS i FROM words WHERE len(w) > 0)),
    size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
    common AS (
        SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
        FROM shingle x JOIN shingle y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
    link AS (
        SELECT a, b FROM common JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b
        WHERE 100 * c >= 85 * (p.n + q.n - c)),
    both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
    reach(doc_id, other) AS (
        SELECT a, b FROM both_ways
        UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON reach.other = both_ways.a)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(least(d.doc_id, r.other), d.doc_id) AS component_id,
           coalesce(r.other, d.doc_id) >= d.doc_id AS kept
    FROM words d LEFT JOIN size ON size.doc_id = d.doc_id
    LEFT JOIN (SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id) r ON r.doc_id = d.doc_id"""
