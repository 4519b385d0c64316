import random
from collections import defaultdict

import pandas as pd
from pyspark.sql import functions as F

from litscreen.llm import near_dedup
from litscreen.llm.components import connected_components
from litscreen.llm.near_dedup import cross_links, near_duplicates, shingle_hashes
from tests.llm.helpers import EDGES, documents


def shingles(text, size):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(len(words) - size + 1, 1)))


def brute(rows, size, percent):
    """Number of shingles and smallest id reachable, per row."""
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        least[find(i)].append(doc)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [x for x in least[find(i)] if x is not None]
        out.append((doc, len(sets[i]), min(ids) if ids and sets[i] else doc))
    return sorted(out, key=str)


def found(spark, rows, **options):
    got = near_duplicates(documents(spark, rows), **options)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str)


def variants(seed):
    """Groups of texts that differ in some words, in chains that a star alone does not link."""
    rng = random.Random(seed)
    rows = []
    for group in range(12):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([8, 60, 200]))]
        for _ in range(14):
            text = list(base)
            for _ in range(rng.randint(0, 5)):
                text[rng.randrange(len(text))] = f"x{rng.randint(0, 9)}"
            if rng.random() < 0.3:
                base = text
            rows.append((len(rows) * 7 % 1009, " ".join(text)))
    return rows


def test_equals_brute_force(spark):
    rows = variants(1)
    assert found(spark, rows, shingle_words=3, percent=85) == brute(rows, 3, 85)
    assert found(spark, rows, shingle_words=3, percent=85, block=5) == brute(rows, 3, 85)


def test_edges(spark):
    rows = EDGES + [(20, "one"), (21, "ONE"), (22, "one two"), (23, "one\ttwo"), (24, "\x1cone two")]
    assert found(spark, rows, shingle_words=3, percent=85) == brute(rows, 3, 85)
    assert near_duplicates(documents(spark, EDGES).where("false")).count() == 0


def test_every_table_key_joins_one_tuple_of_each_side(spark):
    nodes = spark.createDataFrame(
        [(1, [11, 12], [21, 22]), (2, [11, 13], [21, 24]), (3, [15, 12], [25, 22]), (4, [16, 17], [26, 27])],
        "node long, left array<long>, right array<long>",
    )
    got = near_dedup.table_buckets(nodes).groupBy("bucket").agg(F.sort_array(F.collect_list("node")).alias("n"))
    assert sorted(r.n for r in got.collect()) == [[1], [1], [1, 2], [1, 3]]


def test_cross_links_skip_linked_nodes():
    sets = [shingle_hashes("a b c d e f g h i j k l m n o p q r s t u v w x", 3).tobytes()] * 3
    group = pd.DataFrame(
        {"node": [1, 2, 3], "component": [1, 1, 3], "block": [0, 0, 1], "one": 0, "two": 1, "shingles": sets}
    )
    assert cross_links(group, 85).values.tolist() == [[1, 3], [2, 3]]


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 99), (99, 100), (7, 7), (200, 200), (300, 61)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    expected = {i: 0 for i in range(61)} | {99: 99, 100: 99, 200: 200, 300: 61, 61: 61}
    assert {r.node: r.component for r in got} == expected and len(got) == len(expected)
