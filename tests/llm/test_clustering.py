"""Dimension-sharded clustering against a plain loop over whole vectors."""

import hashlib
import math
import random
from collections import Counter

import pytest

from litscreen.llm.clustering import cluster_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, block int, row string, cluster long, id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "r", 3, "x") for i, v in rows], SCHEMA)


def brute(rows, clusters, rounds, dimensions, scale=64):
    kept = [
        (i, [math.floor(scale * x) for x in v])
        for i, v in rows
        if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)
    ]
    digest = lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest()
    centres = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, digest(r[0]), r[1]))[:clusters]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(near(v)[1], []).append(v)
        centres = [
            [sum(x) // len(members[n]) for x in zip(*members[n])] if n in members else c for n, c in enumerate(centres)
        ]
    return Counter((i, near(v)[1], near(v)[0]) for i, v in kept), centres


def check(spark, rows, clusters, rounds, dimensions, block):
    assigned, centres = cluster_vectors(
        frame(spark, rows), clusters=clusters, rounds=rounds, dimensions=dimensions, block=block
    )
    expected, wanted = brute(rows, clusters, rounds, dimensions)
    assert Counter(tuple(r) for r in assigned.collect()) == expected
    assert centres.tolist() == wanted


@pytest.mark.parametrize("block", [1, 3, 4, 10, 16])
def test_blocks_of_any_size(spark, block):
    dice = random.Random(block)
    rows = [(i, [dice.randrange(-40, 40) / 16 for _ in range(10)]) for i in range(200)]
    check(spark, rows, 7, 3, 10, block)


def test_edges(spark):
    good = [[0.5, -0.5], [0.25, 3.0], [-7.1, 2.0], [0.5, -0.5]]
    rows = list(enumerate(good))
    rows += [(1, good[1]), (1, [9.0, 9.0]), (None, good[0]), (None, good[2])]  # repeated rows and null ids
    rows += [(20, None), (21, []), (22, [1.0]), (23, [1.0, 2.0, 3.0]), (24, [1.0, None]), (25, [float("nan"), 1.0])]
    rows += [(26, [float("inf"), 1.0]), (27, [1.0, float("-inf")])]
    for clusters in (1, 3, 50):
        check(spark, rows, clusters, 2, 2, 1)
    check(spark, rows, 3, 0, 2, 2)


def test_ties_and_empty_clusters(spark):
    # all equal: every vector goes to cluster 0, the others keep their centroids
    check(spark, [(i, [1.0, 1.0]) for i in range(30)], 4, 3, 2, 1)


def test_empty_table(spark):
    for rows in ([], [(1, None)]):
        assigned, centres = cluster_vectors(frame(spark, rows))
        assert assigned.columns == ["id", "cluster", "distance"] and not assigned.collect() and not len(centres)


def test_too_large_components_are_named(spark):
    with pytest.raises(Exception, match="too large"):
        cluster_vectors(frame(spark, [(1, [1e30] * 64)]))
