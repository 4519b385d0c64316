import random
import re

from litscreen.llm.decontamination import find_benchmark
from tests.llm.helpers import EDGES, documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window):
    mine, hit, names = words(text), set(), set()
    for name, item in items:
        theirs = words(item)
        n = min(window, len(theirs))
        for i in range(len(theirs) - n + 1 if n else 0):
            for j in range(len(mine) - n + 1):
                if mine[j : j + n] == theirs[i : i + n]:
                    hit.update(range(j, j + n))
                    names.add("" if name is None else str(name))
    return len(mine), sorted(hit), sorted(names)


def check(spark, rows, items, window, **options):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = find_benchmark(documents(spark, rows), benchmark, window=window, **options).collect()
    assert len(got) == len(rows)
    for r in got:
        hit = [k for s in r.spans for k in range(s.start, s.end)]
        assert (r.n_words, hit, r["items"]) == brute(r.text, items, window), r.text


def test_equals_brute_force_in_one_or_many_passes(spark):
    random.seed(2)
    vocabulary = ["a", "b", "c", "d", "É", "x1"]

    def text(n):
        return random.choice([" ", ", ", "-"]).join(random.choice(vocabulary) for _ in range(n))

    rows = [(i, text(random.randint(0, 80)).upper() if i % 3 else text(40)) for i in range(60)]
    items = [(i, text(random.randint(0, 9))) for i in range(12)] + [(3, "A-b"), (None, "c"), (5, None), (6, "")]
    for window in (1, 2, 3, 5):
        check(spark, rows, items, window)
    check(spark, rows, items, 4, pass_bytes=150)


def test_edges(spark):
    items = [(1, "a text without an id"), (2, "under the same id"), (2, "under the same id"), (3, "𝄞")]
    short = [row for row in EDGES if len(row[1] or "") < 1000]
    check(spark, short, items, 10)
    docs = documents(spark, EDGES)
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(r.spans == [] for r in find_benchmark(docs, none).collect())
    assert find_benchmark(docs.where("false"), none).count() == 0
    assert "text" not in find_benchmark(docs, none, with_text=False).columns
