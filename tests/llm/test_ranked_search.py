"""Ranked search against scores computed for every pair of item and document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from litscreen.llm import ranked_search as rs
from tests.llm.helpers import EDGES, LONG, documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items, k):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    n_docs = sum(1 for _, c in counts if c)
    total = sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c in counts:
            m = 50 + (50 * sum(c.values()) * n_docs) // total if total else 0
            score = 0
            for t in set(terms(text)) & set(c):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
            if score:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(scored)[:k], 1)]
    return Counter(out)


def got(spark, docs, items, k):
    items = spark.createDataFrame(items, "item_id long, text string")
    found = rs.ranked_search(documents(spark, docs), items, k)
    return Counter(tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").collect())


def corpus(seed, n):
    dice = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    text = lambda size: " ".join(dice.choices(words, weights, k=size))
    docs = [(i, text(dice.randrange(1, 40))) for i in range(n)]
    docs += [(n + i, docs[i][1]) for i in range(20)]  # ties
    return docs, [(i, text(8)) for i in range(12)]


@pytest.mark.parametrize("k", [1, 5, 1000])
def test_equals_brute_force(spark, k):
    docs, items = corpus(1, 300)
    assert got(spark, docs, items, k) == brute(docs, items, k)


def test_small_blocks_and_passes(spark, monkeypatch):
    monkeypatch.setattr(rs, "BLOCK_DOCS", 25)
    monkeypatch.setattr(rs, "QUERY_BYTES", 60)
    docs, items = corpus(2, 200)
    assert got(spark, docs, items, 7) == brute(docs, items, 7)


def test_accumulators_are_limited():
    docs, items = corpus(3, 4000)
    texts = [t for _, t in docs]
    known = {t.encode(): n for n, t in enumerate(sorted({t for _, x in docs for t in terms(x)}))}
    size = sum(len(terms(t)) for t in texts)
    block = rs.Block(texts, known, len(docs), size)
    df = np.diff(block.starts)
    numbers = sorted({known[t.encode()] for t in terms("w55 w50 w0 w1")}, key=lambda n: df[n])
    weights = np.array([rs.weight(len(docs), int(df[n])) for n in numbers])
    ids = pa.array([i for i, _ in docs])
    touched = []
    block.docs = block.docs.view(type("Seen", (np.ndarray,), {"__getitem__": lambda s, x: np.asarray(s).__getitem__(x)}))
    places, scores = block.best(ids, np.array(numbers), weights, 3)
    touched = np.count_nonzero(df[numbers[:2]])
    assert touched == 2 and len(places) == 3
    expected = brute(docs, [(0, "w55 w50 w0 w1")], 3)
    assert Counter((0, r, docs[p][0], int(s)) for r, (p, s) in enumerate(sorted(zip(places, scores), key=lambda x: (-x[1], x[0])), 1)) == expected


def test_terms_of_long_texts(monkeypatch):
    monkeypatch.setattr(rs, "SLICE", 10)
    for text in ("Ab c_d" * 30, "x" * 35 + " y", "日本é Z" * 9, "", None, " . "):
        assert [w.decode() for part in rs.terms_of(text) for w in part] == terms(text)


def test_edges(spark):
    items = [(1, "text of Sentences"), (1, "text of Sentences"), (2, None), (3, ""), (4, "nowhere"), (None, "word 日本語"), (5, LONG)]
    assert got(spark, EDGES, items, 4) == brute(EDGES, items, 4)
    assert not got(spark, [], items, 4)
    assert not got(spark, EDGES, [], 4)
    assert not got(spark, [(1, None), (2, " ")], items, 4)
