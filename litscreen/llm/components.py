"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litscreen.llm.common import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of ``edges`` (``a, b``: long).

    Alternates large-star and small-star steps until every node is linked to its
    smallest one alone: a node links its larger neighbours, then its smaller
    ones, to the smallest of them and itself. The number of edges never grows;
    the rounds grow with the logarithm of the longest path. Only minima are
    gathered per node, so a node with very many edges is combined before it is
    shuffled. Edges from a node to itself are allowed.
    """
    given = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = stored(given.where("a <> b").distinct(), "edges")
    while not _all_stars(links):
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b")
        links = stored(small.union(least).distinct(), "edges")
    pairs = links.union(links.select("b", "b")).union(given.where("a = b"))
    return pairs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))


def _all_stars(links: DataFrame) -> bool:
    """Whether every node is linked to one smaller node at most, and that one to none."""
    roles = links.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select("b", F.lit(0), F.lit(1)))
    roles = roles.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not roles.where("up > 1 OR (up = 1 AND down = 1)").limit(1).count()
