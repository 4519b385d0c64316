"""Piece encoding against the library and against merging whole texts."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from litscreen.llm import sentence_pieces as sp
from litscreen.llm.common import table
from tests.llm.helpers import EDGES, documents, rows_of

SF_DIR = "/root/testdata/sf0.01"
PATH = public_tokenizers.path(sp.MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return sp.PieceModel(PATH)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_equals_library_on_whole_table(spark, library):
    got = {r.doc_id: r for r in sp.op11_pieces(spark, SF_DIR).collect()}
    docs = table(spark, SF_DIR, "documents").collect()
    assert len(got) == len(docs)
    for doc in docs:
        ids = library.encode(doc.text or "")
        expected = (len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids)))
        row = got[doc.doc_id]
        assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == expected


def test_random_texts(model, library):
    dice = random.Random(7)
    letters = "aabbcdeé \t\n.,<>/x0日本▁𝄞\x00ABthe ing"
    for _ in range(3000):
        text = "".join(dice.choice(letters) for _ in range(dice.randrange(60)))
        ids = model.encode(text).tolist()
        assert ids == library.encode(text)
        assert model.decode(ids) == library.decode(ids)


def test_backtracking_equals_merging_whole_chunks(model):
    dice = random.Random(8)
    for _ in range(300):
        chunk = "".join(dice.choice("abcdeghilnorst▁") for _ in range(dice.randrange(1, 40)))
        assert model._search(chunk) == model._merged(chunk)


@pytest.mark.parametrize("unit", ["a", " ", "ab", "日", "=-", "word "])
def test_very_long_texts(model, library, unit):
    text = unit * (300_000 // len(unit))
    assert model.encode(text).tolist() == library.encode(text)


def test_decoding_of_any_ids(model, library):
    dice = random.Random(9)
    for _ in range(2000):
        ids = [dice.choice([dice.randrange(32000), dice.randrange(3, 259)]) for _ in range(dice.randrange(1, 12))]
        assert model.decode(ids) == library.decode(ids), ids


def test_memories_are_bounded(library, monkeypatch):
    monkeypatch.setattr(sp, "KEPT_CHUNKS", 50)
    small = sp.PieceModel(PATH)
    dice = random.Random(10)
    text = " ".join("".join(dice.choice("abcdefgh") for _ in range(6)) for _ in range(2000))
    assert small.encode(text).tolist() == library.encode(text)
    assert len(small.known) <= 50 and len(small.known_before) <= 50 and len(small.agreeing) <= 50


def test_edges(spark, library):
    rows = sp.encode_texts(documents(spark, EDGES)).select("row.doc_id", "ids", "decoded", "row.shard").collect()
    expected = sorted((i or 0, library.encode(t or ""), library.decode(library.encode(t or ""))) for i, t in EDGES)
    assert sorted((r.doc_id or 0, r.ids, r.decoded) for r in rows) == expected
    assert {r.shard for r in rows} == {3}
    assert not rows_of(sp.encode_texts(documents(spark, [])), "ids")


def test_other_models_are_refused(tmp_path):
    with pytest.raises((OSError, RuntimeError)):
        sp.PieceModel(str(tmp_path / "none.model"))
