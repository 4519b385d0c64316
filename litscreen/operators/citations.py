"""Citation lists: id mapping, cleaning, coverage."""

from __future__ import annotations

from decimal import Decimal
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litscreen.functions.labels import numeric_id
from litscreen.operators.checks import require_columns
from litscreen.operators.columns import replace_ids
from litscreen.operators.lists import map_members
from litscreen.operators.ranks import nth_text, ordered_positions


def last_known_pmid(lookup: DataFrame, order: str) -> DataFrame:
    """``openalex_id, pmid``: one row per id with the last non-null pmid in the given order."""
    require_columns(lookup, ["openalex_id", "pmid", order])
    known = lookup.where(F.col("pmid").isNotNull() & F.col("openalex_id").isNotNull())
    return known.groupBy("openalex_id").agg(F.max_by("pmid", order).alias("pmid"))


def map_references(
    works: DataFrame, lookup: DataFrame, refs: str = "refs", output: str = "pmids", order: str = "seq"
) -> DataFrame:
    """Replace each id of a list by its pmid; unknown ids go, order and repeats stay.

    Of an id that the lookup has twice the last known pmid counts. A NULL list
    becomes an empty one. Rows need no key, and the lookup may have any size.
    """
    require_columns(works, [refs])
    known = last_known_pmid(lookup, order).select(F.col("openalex_id").alias("member"), F.col("pmid").alias("value"))
    return map_members(works, F.col(refs), known, output)


def known_references(edges: DataFrame, known: DataFrame, ref: str = "ref", output: str = "pmid") -> DataFrame:
    """Edges whose target has a pmid, with that pmid in the column ``output``.

    ``known(openalex_id, pmid)`` has one row per id, so no edge is doubled.
    """
    targets = known.select(F.col("openalex_id").alias("_target"), F.col("pmid").alias(output))
    return edges.join(targets, F.col(ref) == F.col("_target")).drop("_target")


def dedup_keep_first(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row per key, the first in the given total order.

    The filter on the row number lets Spark cut each key to one row per task
    before the shuffle, so a key with very many rows is no burden.
    """
    first = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank")


def concat_tables(*tables: DataFrame) -> DataFrame:
    """All rows under each other by column name; a column a table lacks is NULL there."""
    result = tables[0]
    for table in tables[1:]:
        result = result.unionByName(table, allowMissingColumns=True)
    return result


def clean_reference_table(
    by_pmid: DataFrame,
    by_work: DataFrame,
    lookup: DataFrame,
    corrections: Mapping[str, str],
    order: str = "seq",
) -> DataFrame:
    """``pmid, references, num_of_refs`` from two landed reference tables.

    ``by_pmid(pmid, refs, seq)`` comes first, ``by_work(pmid, refs, seq)`` second;
    of several rows with the same pmid the first one stays. Ids are corrected,
    those that are no number drop out, and list members are mapped to pmids.
    """
    tables = []
    for priority, table in enumerate([by_pmid, by_work]):
        repaired = replace_ids(table.withColumn("pmid", F.col("pmid").cast("string")), "pmid", corrections)
        numbered = repaired.select(numeric_id(F.col("pmid")).alias("pmid"), "refs", order)
        valid = numbered.where(F.col("pmid").isNotNull())
        tables.append(valid.withColumn("_priority", F.lit(priority)))
    rows = dedup_keep_first(concat_tables(*tables), "pmid", ["_priority", order])
    mapped = map_references(rows, lookup, "refs", "references", order)
    return num_refs(mapped.select("pmid", "references"), "references", "num_of_refs")


def num_refs(df: DataFrame, column: str, output: str = "num_refs") -> DataFrame:
    """Length of each list; NULL for a NULL list."""
    return df.withColumn(output, F.size(column))


def unique_reference_ids(edges: DataFrame, ref: str = "ref") -> DataFrame:
    """Every referenced id once."""
    return edges.select(ref).where(F.col(ref).isNotNull()).distinct()


def unique_reference_count(edges: DataFrame, ref: str = "ref", approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct(ref) if approximate else F.count_distinct(F.col(ref))
    return edges.agg(count.alias("n_unique"))


def exploded_references(works: DataFrame, refs: str, *keys: str) -> DataFrame:
    """List cells as edges ``keys, pos, ref``; no shuffle."""
    return works.select(*keys, F.posexplode(refs).alias("pos", "ref"))


def halve_ids(df: DataFrame, column: str) -> DataFrame:
    """Distinct ids in order with ``half`` 1 for the first ``n // 2`` of them, 2 for the rest.

    The last id of the first half is found by :func:`nth_text`; nothing is sorted.
    """
    ids = df.select(F.col(column).alias("_id")).where(F.col(column).isNotNull()).distinct()
    text = F.col("_id").cast("string")
    if dict(df.dtypes)[column] in ("tinyint", "smallint", "int", "bigint"):  # digits of one length, none negative
        text = F.lpad((F.col("_id").cast("decimal(20, 0)") + F.lit(Decimal(1 << 63))).cast("string"), 20, "0")
    kept = ids.select(text.alias("text")).persist()
    try:
        cut = nth_text(kept, "text", kept.count() // 2)
    finally:
        kept.unpersist()
    first = F.lit(False) if cut is None else text <= cut
    return ids.select(F.col("_id").alias(column), F.when(first, 1).otherwise(2).alias("half"))


def assign_batches(df: DataFrame, column: str, size: int = 200) -> DataFrame:
    """Distinct ids with the 0-based number of their batch of ``size`` in id order."""
    ids = df.select(column).where(F.col(column).isNotNull()).distinct()
    placed = ordered_positions(ids, [column], "_position", "_rows")
    return placed.select(column, F.floor(F.col("_position") / size).alias("batch"))


def list_batches(df: DataFrame, column: str, size: int = 200) -> DataFrame:
    """One row per batch: its ids in order, comma-joined (never more than ``size``)."""
    members = F.array_sort(F.collect_list(column)).cast("array<string>")
    return assign_batches(df, column, size).groupBy("batch").agg(F.array_join(members, ",").alias("ids"))


def empty_list_share(df: DataFrame, sources: Mapping[str, str]) -> DataFrame:
    """Per source: lists of length 0 and their share in all rows; ``sources`` maps name to count column.

    A NULL count (a row the source does not know) is not empty, but is part of the total.
    """
    rows = [
        F.struct(
            F.lit(name).alias("source"),
            F.count_if(F.coalesce(F.col(column) == 0, F.lit(False))).alias("n_empty"),
            F.try_divide(
                F.count_if(F.coalesce(F.col(column) == 0, F.lit(False))).cast("double"), F.count("*")
            ).alias("share_empty"),
        )
        for name, column in sources.items()
    ]
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))
