"""Shards by rendezvous hashing of stable record keys.

Every record scores each shard by ``-weight / ln(u)``, ``u`` being a uniform
number hashed from key and shard, and goes to the best one. A shard's share
follows its weight. Adding a shard moves only the rows that the new shard wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litscreen.llm.common import numbered_within, stored, table


def _score(key: Column, shard: int, weight: float) -> Column:
    """Orders first by score, then by the smaller shard number."""
    uniform = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11) + F.lit(0.5)) * F.lit(2.0**-53)
    return F.struct((F.lit(-float(weight)) / F.ln(uniform)).alias("score"), F.lit(-shard).alias("minus_shard"))


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """Shard from 0 to ``len(weights) - 1`` that wins the key; a null key is a key of its own."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive numbers, one per shard")
    name = F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit(""))
    scores = [_score(name, shard, weight) for shard, weight in enumerate(weights)]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return (-best["minus_shard"]).cast("int")


def assign_shards(
    records: DataFrame, key: str, weights: Sequence[float], new_weight: float = 1.0, buckets: int = 1024
) -> DataFrame:
    """Add ``shard``, ``grown_shard`` (with one more shard) and ``slot`` to ``records``.

    ``slot`` counts from 0 without gaps within a shard. Key and weights alone
    decide the shards, so repeated rows meet in one shard, each with a slot of
    its own; equal keys are still numbered by many tasks, because a row's bucket
    is hashed from the whole row. Pass narrow records: all columns are shuffled.

    Columns named like the added ones are replaced. An empty table gives an empty table.
    """
    kept = [c for c in records.columns if c.lower() not in ("shard", "grown_shard", "slot", "_row")]
    placed = records.select(
        *kept,
        rendezvous_shard(F.col(key), weights).alias("shard"),
        rendezvous_shard(F.col(key), [*weights, new_weight]).alias("grown_shard"),
        F.monotonically_increasing_id().alias("_row"),
    )
    numbered = numbered_within(stored(placed, "shards"), "shard", [key, "_row"], "slot", buckets)
    return numbered.drop("_row")


def op1_sharding(spark, sf_dir):
    """All documents in eight equal shards under the law ``key``."""
    text = F.col("text")
    records = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    return assign_shards(records, "doc_id", [1.0] * 8).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
