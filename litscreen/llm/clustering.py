"""Centroid clustering whose tasks hold blocks of dimensions, not whole centroids.

Vectors are kept as blocks of columns, each block in a folder of its own. A
round runs over the blocks: a task meets only the slice of the centroids that
belongs to its block and gives the exact partial distances to all of them. The
partial distances of a vector are added by key and the smallest wins. Every
block then sums its own columns per cluster, combined before the shuffle, and
moves its own slice of the centroids. All numbers are integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litscreen.llm.common import stored, table

CLUSTERS = 16
ROUNDS = 3
BLOCK = 16  # dimensions of a block
SCALE = 64
DIMENSIONS = 64


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, dimensions: int, scale: int) -> DataFrame:
    """``id, components`` (array of int): every vector of that length without null, NaN and infinity, ``floor(scale * x)``.

    A component so large that distances would not fit in 64 bits raises an error.
    """
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    most = float(int((2.0**61 / dimensions) ** 0.5))

    def whole(x: Column) -> Column:
        scaled = F.floor(x * float(scale))
        return F.when(F.abs(x * float(scale)) < min(most, 2.0**31), scaled.cast("int")).otherwise(
            F.raise_error(F.lit("a component is too large for exact distances in 64 bits")).cast("int")
        )

    kept = vectors.where((F.size(vector) == dimensions) & finite)
    return kept.select(F.col(f"`{id_col}`").alias("id"), F.transform(vector, whole).alias("components"))


def first_centroids(kept: DataFrame, clusters: int, salt: str) -> np.ndarray:
    """The vectors with the smallest SHA-256 of ``salt`` and id, in that order; vectors without id come last."""
    order = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")).cast("binary"), 256)
    chosen = kept.orderBy(order.asc_nulls_last(), "components").limit(clusters).collect()  # ``clusters`` rows
    return np.array([row["components"] for row in chosen], np.int64)


def in_blocks(numbered: DataFrame, dimensions: int, size: int) -> DataFrame:
    """``row, id, block, part``: the columns of every block, stored block by block."""
    blocks = [
        F.struct(F.lit(i).alias("block"), F.slice("components", i * size + 1, size).alias("part"))
        for i in range(-(-dimensions // size))
    ]
    parts = numbered.select("row", "id", F.inline(F.array(*blocks)))
    return stored(parts, "blocks", partition_by="block")


def nearest(blocks: DataFrame, centroids: np.ndarray, size: int, with_parts: bool) -> DataFrame:
    """``row, id, cluster, distance`` and, on request, ``blocks``: the nearest centroid of every vector.

    Of equally near ones the smallest number wins.
    """
    spark = blocks.sparkSession
    # clusters x dimensions numbers, cut into the slices of the blocks
    n_blocks = -(-centroids.shape[1] // size)
    shared = spark.sparkContext.broadcast([centroids[:, i * size : (i + 1) * size] for i in range(n_blocks)])
    n = len(centroids)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.column("block").to_numpy()
            flat = batch.column("part").flatten().to_numpy().astype(np.int64)
            ends = np.cumsum(batch.column("part").value_lengths().to_numpy())
            distances = np.zeros((len(of), n), np.int64)
            for block in np.unique(of):
                mine = np.flatnonzero(of == block)
                values = shared.value[block]
                width = values.shape[1]
                part = flat[ends[mine][:, None] - width + np.arange(width)]
                for number, centre in enumerate(values):
                    distances[mine, number] = ((part - centre) ** 2).sum(1)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(0, distances.size + 1, n, dtype=np.int32)), pa.array(distances.ravel())
            )
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("row", "id", "block", "part")), lists], ["row", "id", "block", "part", "partial"]
            )

    kinds = dict(blocks.dtypes)
    found = blocks.select("row", "id", "block", "part").mapInArrow(
        partial, f"row long, id {kinds['id']}, block int, part array<int>, partial array<long>"
    )
    # a vector has one entry per block
    columns = [F.collect_list("partial").alias("partials")]
    if with_parts:
        columns.append(F.collect_list(F.struct("block", "part")).alias("blocks"))
    added = F.aggregate(
        "partials", F.array_repeat(F.lit(0).cast("long"), n), lambda total, one: F.zip_with(total, one, lambda a, b: a + b)
    )
    kept = ["row", "id", *(["blocks"] if with_parts else [])]
    summed = found.groupBy("row", "id").agg(*columns).select(*kept, added.alias("distances"))
    least = F.array_min("distances")
    cluster = (F.array_position("distances", least) - 1).cast("int")
    return summed.select(*kept, cluster.alias("cluster"), least.alias("distance"))


def moved(assigned: DataFrame, centroids: np.ndarray, size: int) -> np.ndarray:
    """The centroids after every block has moved its slice to the floor of the mean; those without vectors stay."""
    members = assigned.select("cluster", F.inline("blocks"))
    sums = [F.sum(F.get("part", F.lit(i)).cast("long")).alias(f"s{i}") for i in range(size)]
    count = F.count(F.lit(1)).alias("n")
    out = centroids.copy()
    # one row per block and cluster
    for row in members.groupBy("block", "cluster").agg(count, *sums).collect():
        slice_ = [row[f"s{i}"] // row["n"] for i in range(size) if row[f"s{i}"] is not None]
        out[row["cluster"], row["block"] * size : row["block"] * size + len(slice_)] = slice_
    return out


def cluster_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS,
    scale: int = SCALE,
    block: int = BLOCK,
    salt: str = "1:",
) -> tuple[DataFrame, np.ndarray]:
    """``(id, cluster, distance per kept vector, final centroids)`` after ``rounds`` rounds of Lloyd's algorithm.

    Kept are the vectors with exactly ``dimensions`` components, none of them
    null, NaN or infinite; a null vector and all others have no row in the result.
    Repeated rows and null ids are vectors of their own. The start is the
    ``clusters`` vectors with the smallest hashes (all, if there are fewer); a
    cluster without vectors keeps its centroid. Of equally near centroids the
    smaller number wins. An empty table gives no rows and no centroids. Other
    columns are not read. ``vectors`` is read once; its blocks are stored.
    """
    spark = vectors.sparkSession
    kept = whole_vectors(vectors, id_col, vector_col, dimensions, scale)
    # written once, so the numbers are the same for all who read them
    numbered = stored(kept.withColumn("row", F.monotonically_increasing_id()), "vectors")
    centroids = first_centroids(numbered, clusters, salt)
    if not len(centroids):
        kind = kept.schema["id"].dataType.simpleString()
        return spark.createDataFrame([], f"id {kind}, cluster int, distance long"), np.zeros((0, dimensions), np.int64)
    blocks = in_blocks(numbered, dimensions, block)
    for _ in range(rounds):
        centroids = moved(nearest(blocks, centroids, block, True), centroids, block)
    return nearest(blocks, centroids, block, False).select("id", "cluster", "distance"), centroids


def _sql(clusters: int, rounds: int) -> str:
    """The same rounds as common tables in long form."""
    parts = [
        f"""
        numbered AS (SELECT row_number() OVER () AS row, vec_id, embedding FROM embeddings),
        long AS (SELECT row, vec_id, generate_subscripts(embedding, 1) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM numbered),
        kept AS (SELECT row, vec_id FROM long GROUP BY ALL HAVING count(*) = {DIMENSIONS} AND bool_and(coalesce(isfinite(x), false))),
        v AS (SELECT row, vec_id, d, CAST(floor({SCALE} * x) AS BIGINT) AS x FROM long SEMI JOIN kept USING (row)),
        starts AS (SELECT row, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS cluster FROM kept
            QUALIFY cluster < {clusters}),
        c0 AS (SELECT cluster, d, x AS c FROM v JOIN starts USING (row))"""
    ]
    for r in range(rounds + 1):
        parts.append(
            f"""
        near{r} AS (SELECT row, vec_id, cluster, distance
            FROM (SELECT row, vec_id, cluster, sum((x - c) * (x - c)) AS distance FROM v JOIN c{r} USING (d)
                GROUP BY row, vec_id, cluster)
            QUALIFY row_number() OVER (PARTITION BY row ORDER BY distance, cluster) = 1)"""
        )
        if r < rounds:
            parts.append(
                f"""
        m{r} AS (SELECT cluster, d, sum(x) AS s, count(*) AS n FROM v JOIN near{r} USING (row) GROUP BY ALL),
        c{r + 1} AS (SELECT cluster, d, coalesce((s - ((s % n) + n) % n) // n, c) AS c FROM c{r} LEFT JOIN m{r} USING (cluster, d))"""
            )
    return f"""
        WITH {",".join(parts)},
        digests AS (SELECT cluster, sha256(string_agg(CAST(c AS BIGINT), ',' ORDER BY d)) AS centroid_sha256
            FROM c{rounds} GROUP BY cluster)
        SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
            CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
            CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
        FROM near{rounds} JOIN digests USING (cluster)"""


ORACLE_SQL = _sql(CLUSTERS, ROUNDS)


def op13_clusters(spark, sf_dir):
    """Cluster and squared distance of every kept vector, with the inertia and the digest of its cluster."""
    assigned, centroids = cluster_vectors(table(spark, sf_dir, "embeddings"))
    assigned = stored(assigned, "clusters")
    # one row per cluster
    inertia = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    rows = [(c, inertia.get(c, 0), sum(inertia.values()), d) for c, d in enumerate(digests)]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select(
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
