import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from litscreen.llm.packing import op10_packing, pack_documents, plan_layouts
from litscreen.llm.tokens import CachedTokenizer
from tests.llm.helpers import EDGES, documents

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF_DIR = "/root/testdata/sf0.01"


def test_cached_ids_equal_the_tokenizers():
    rng = random.Random(1)
    parts = ["a", "The", " ", "  ", "\n", " \n", "\t", "é", "<|endoftext|>", "1", "!", "—", "'s", "ß", "日本", "\x1c", "\x00", ".", " x", " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(1500)] + ["", " ", " a", "a "]
    texts.append(" ".join(rng.choice(["abc", "défg", "x.\ny"]) for _ in range(600_000)))  # over several segments
    cached, plain = CachedTokenizer(PATH), Tokenizer.from_file(PATH)
    for _ in range(2):  # empty and filled cache
        for text, ids in zip(texts, cached.encode_all([t.encode() for t in texts])):
            assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids


def test_a_tokenizer_takes_little_memory():
    """Several workers live side by side in an executor, and all keep their tokenizer."""
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["abc", "of", "is x.", "word"]) for _ in range(600)).encode() for _ in range(1500)]
    tracemalloc.start()
    try:
        CachedTokenizer(PATH).encode_all(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 80e6, peak


def test_layouts_use_every_piece_once_and_few_sequences():
    for seed in range(6):
        rng = np.random.RandomState(seed)
        counts = np.zeros(65, np.int64)
        counts[1:] = rng.randint(0, [3, 50, 4, 1000, 2, 7][seed], 64)
        layouts = plan_layouts(counts)
        used = Counter()
        for lengths, times in layouts:
            assert sum(lengths) <= 64 and times > 0
            for x in lengths:
                used[x] += times
        assert used == Counter({i: int(n) for i, n in enumerate(counts) if n})
        least = max(-(-int(counts @ np.arange(65)) // 64), int(counts[33:].sum()))
        assert sum(t for _, t in layouts) <= 1.05 * least + 1
    assert plan_layouts(np.zeros(9, np.int64)) == []


def check(rows, pieces, capacity):
    plain = Tokenizer.from_file(PATH)
    expected = Counter()
    for doc, text in rows:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % capacity + 1
        for piece, (a, b) in enumerate(zip([0, *range(first, len(ids), capacity)], range(first, len(ids) + 1, capacity))):
            data = np.array(ids[a:b], "<u4").tobytes()
            expected[doc, piece, a, b - a, zlib.crc32(data)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces) == expected
    sequences = defaultdict(list)
    for r in pieces:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    pieces = op10_packing(spark, SF_DIR).collect()
    n = check(docs, pieces, 2048)
    assert n <= -(-sum(r.length for r in pieces) // 2048) * 1.02


def test_edges(spark):
    rows = EDGES + [(30, "the same text")] * 200
    pieces = pack_documents(documents(spark, rows), capacity=16).collect()
    check(rows, pieces, 16)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in pieces)
    assert pack_documents(documents(spark, rows).where("false")).count() == 0


def test_search_ends_at_the_lower_bound_only(monkeypatch):
    """A plan that needs one sequence too many of 2000 is not taken while another trial meets the bound."""
    from litscreen.llm import packing

    tried = []

    def trial(counts, most=3, even=False):
        tried.append((most, even))
        counts[:] = 0
        return [((8,), 2000 if most == 1 else 2001)]

    monkeypatch.setattr(packing, "exact_layouts", trial)
    counts = np.zeros(9, np.int64)
    counts[8] = 2000
    assert packing.plan_layouts(counts) == [((8,), 2000)]
    assert tried[-1] == (1, False) and all(most > 0 for most, _ in tried)
