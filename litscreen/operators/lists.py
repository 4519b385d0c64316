"""Lookups of list members in a table of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from litscreen.operators.checks import require_columns


def content_hash(df: DataFrame) -> Column:
    """A number that depends on the values of a row alone, so that a repeated task gives the same one."""
    hashable = [f.name for f in df.schema if not isinstance(f.dataType, (MapType, VariantType))]
    return F.xxhash64(*[F.col(f"`{c}`") for c in hashable])


def map_members(df: DataFrame, members: Column, table: DataFrame, output: str, keep_unknown: bool = False) -> DataFrame:
    """Add ``output``: the values of the members of a text list, in order, repeats included.

    ``table`` has ``member`` (no value twice) and ``value``. Unknown and null
    members go, unless ``keep_unknown`` leaves them as they are. A NULL list gives
    an empty one.

    Only members that the table knows are shuffled, as patches ``position,
    value`` under the digest of their list; equal lists share their patches,
    which are combined before their one shuffle. Each row then meets the patches
    of its list, and they are put into it; the list itself is not shuffled but
    made again from the row, so ``members`` must name columns. Nothing depends
    on the order of rows, so a repeated task gives the same result. ``df`` is
    evaluated twice.
    """
    require_columns(table, ["member", "value"], "lookup table")
    rows = df.select(F.struct("*").alias("_whole"), members.alias("_list"), content_hash(df).alias("_hash"))
    # lists without members have no patches; their rows are spread
    digest = F.when(F.size("_list") > 0, F.unhex(F.md5(F.to_json("_list")))).otherwise(F.col("_hash").cast("string").cast("binary"))
    keyed = rows.select("_whole", "_list", digest.alias("_digest"))

    values = table.where("value IS NOT NULL").select(F.col("member").alias("_known"), F.col("value").alias("_value"))
    exploded = keyed.select("_digest", F.posexplode("_list").alias("_pos", "_member")).where("_member IS NOT NULL")
    hits = exploded.join(values, F.col("_member") == F.col("_known"))
    # of equal lists every position has one value, so a set of the patches holds each once
    patches = hits.groupBy(F.col("_digest").alias("_of")).agg(
        F.array_sort(F.collect_set(F.struct("_pos", "_value"))).alias("_patches")
    )

    patched = F.transform("_patches", lambda p: p["_value"])
    if keep_unknown:
        patched = F.when(F.col("_patches").isNull(), F.col("_list")).otherwise(_put_in(F.col("_list"), F.col("_patches")))
    empty = F.array().cast("array<string>") if keep_unknown else F.array().cast(f"array<{dict(values.dtypes)['_value']}>")
    met = keyed.select("_whole", "_digest").join(patches, F.col("_digest") == F.col("_of"), "left")
    joined = met.select("_whole", "_patches", "_whole.*").select("_whole", "_patches", members.alias("_list"))
    kept = [F.col(f"_whole.`{c}`").alias(c) for c in df.columns if c != output]
    return joined.select(*kept, F.coalesce(patched, empty).alias(output))


def _put_in(members: Column, patches: Column) -> Column:
    """The list with the patched members; null members go.

    Both are sorted by position together; of a member and its patch the patch comes last and stays.
    """
    old = F.transform(members, lambda m, i: F.struct(i.alias("pos"), F.lit(0).alias("kind"), m.alias("value")))
    new = F.transform(patches, lambda p: F.struct(p["_pos"].alias("pos"), F.lit(1).alias("kind"), p["_value"].alias("value")))
    # in a list of one, so that it is sorted once and not for every member
    both = F.array(F.array_sort(F.concat(F.filter(old, lambda e: e["value"].isNotNull()), new)))

    def last_of_place(entries: Column) -> Column:
        return F.filter(entries, lambda e, i: F.coalesce(F.get(entries, i + 1)["pos"] != e["pos"], F.lit(True)))

    return F.transform(F.transform(both, last_of_place)[0], lambda e: e["value"])
