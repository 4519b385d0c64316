import random
import re

from litscreen.llm.line_dedup import drop_repeated_lines, op3_line_dedup
from tests.llm.helpers import EDGES, LONG, documents

SF_DIR = "/root/testdata/sf0.01"
def gone_words(texts, least):
    """Per text the byte ranges of words in runs of ``least`` words that stand earlier."""
    out = []
    for text, gone in zip(texts, brute_words(texts, least)):
        ends = [m.start() for m in re.finditer(rb"[^ \t\n\r\x0b\x0c]+", text)] + [len(text)]
        out.append([(ends[i], ends[i + 1]) for i in gone])
    return out


def brute(texts, least):
    """Texts in order, without runs of ``least`` words that stand earlier."""
    out = []
    for text, ranges in zip(texts, gone_words(texts, least)):
        left = [True] * len(text)
        for start, stop in ranges:
            left[start:stop] = [False] * (stop - start)
        out.append(bytes(c for c, stays in zip(text, left) if stays))
    return out


def run(spark, texts, least):
    docs = documents(spark, list(enumerate(texts)))
    done = drop_repeated_lines(docs, min_words=least).orderBy("row.doc_id").collect()
    return [r.text.encode() for r in done]


def test_equals_brute_force(spark):
    random.seed(5)
    pool = ["a b.", "c!", "d e f", "g  h. ", "", "é x y?", " k", " q w."]
    for least in (1, 4, 7):
        texts = [
            "".join(random.choice(pool) + random.choice(["\n", " ", ". ", "\n\n"]) for _ in range(random.randint(0, 14)))
            for _ in range(60)
        ]
        assert run(spark, texts, least) == brute([t.encode() for t in texts], least)


def test_query_equals_brute_force_on_whole_table(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in op3_line_dedup(spark, SF_DIR).collect()}
    expected = brute([r.text.encode() for r in docs], 30)
    assert len(got) == len(docs)
    for doc, text in zip(docs, expected):
        row = got[doc.doc_id]
        assert row.text.encode() == text, doc.doc_id
        assert (row.n_chars, row.removed_bytes) == (len(text.decode()), len(doc.text.encode()) - len(text))


def test_long_passage_goes_from_later_texts_only(spark):
    passage = " ".join(f"word{i}{'.' if i % 10 == 9 else ''}" for i in range(60))
    got = run(spark, [f"First. {passage} End.", f"Other start. {passage} Another end.", "Clean text."], 30)
    assert got == [f"First. {passage} End.".encode(), b"Other start. Another end.", b"Clean text."]


def test_edges(spark):
    docs = documents(spark, EDGES)
    done = drop_repeated_lines(docs).collect()
    assert len(done) == len(EDGES)
    texts = [(r.row.doc_id, r.text) for r in done]
    assert texts.count((2, None)) == 2 and (None, None) in texts and (3, "") in texts and (7, " \t\n ") in texts
    # the very long text keeps its first run, its later copy keeps the line that is new
    assert len(dict(texts)[5]) < 2_000 and len(dict(texts)[6]) < 200 and len(LONG) > 1_000_000
    assert drop_repeated_lines(docs.where("false")).count() == 0
    assert set(done[0].row.asDict()) == set(docs.columns) - {"text"}


def brute_words(texts, least):
    """Per text the numbers of the words in runs of ``least`` words that stand earlier."""
    seen, out = {}, []
    for number, text in enumerate(texts):
        words, gone = text.split(), set()
        for i in range(len(words) - least + 1):
            first = seen.setdefault(tuple(words[i : i + least]), (number, i))
            if first != (number, i):
                gone |= set(range(i if first[0] != number else max(i, first[1] + least), i + least))
        out.append(gone)
    return out


def test_passage_spliced_into_a_line_goes_whole(spark):
    words = [f"word{i}" for i in range(53)]
    words[30] += "."
    words[36] += "."  # sentences of 31, 6 and 16 words
    passage = " ".join(words)
    texts = [f"First {passage} end.", f"Other start without a stop {passage} and another end."]
    texts += [f"{' '.join(words[:29])} is short", f"is {' '.join(words[7:37])} long"]
    got = run(spark, texts, 30)
    assert got[0] == texts[0].encode() and got[1] == b"Other start without a stop and another end."
    assert got[2] == texts[2].encode() and got[3] == b"is long"


def test_no_run_of_over_50_words_survives(spark):
    random.seed(7)
    word = lambda: f"w{random.randint(0, 10**9)}" + random.choice(["", "", "", ".", "\n", " "])
    pool = [[word() for _ in range(random.randint(45, 90))] for _ in range(6)]
    texts = []
    for _ in range(40):
        parts = [random.choice([[word() for _ in range(random.randint(1, 40))], random.choice(pool)]) for _ in range(5)]
        texts.append(" ".join(" ".join(p[random.randint(0, 3) :]) for p in parts))
    raw = [t.encode() for t in texts]
    expected = [[w for i, w in enumerate(t.split()) if i not in gone] for t, gone in zip(raw, brute_words(raw, 51))]
    assert [t.split() for t in run(spark, texts, 51)] == expected
    assert sum(map(len, brute_words(raw, 51))) > 1000


def test_scripts_without_blanks(spark):
    random.seed(9)
    shared = "".join(chr(random.randint(0x4E00, 0x9FFF)) for _ in range(120))
    thai = "".join(chr(random.randint(0x0E01, 0x0E2E)) for _ in range(70))
    texts = [f"一{shared}", f"二三{shared}四", f"x {thai} y", f"other {thai}", shared[:29]]
    assert run(spark, texts, 30) == [f"一{shared}".encode(), "二三四".encode(), f"x {thai} y".encode(), b"other ", shared[:29].encode()]


def test_nothing_goes_on_equal_hashes_alone(spark, monkeypatch):
    """With one hash for all words, only words with equal bytes are deleted."""
    import numpy as np

    from litscreen.llm import line_dedup

    monkeypatch.setattr(line_dedup, "word_hashes", lambda words: np.ones(len(words.begin), np.uint64))
    random.seed(11)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [" ".join(f"w{random.randint(0, 10**9)}" for _ in range(120)) for _ in range(12)]
    texts[3] += " " + passage
    texts[7] = passage + " " + texts[7]
    expected = [t.encode() for t in texts]
    expected[7] = texts[7].removeprefix(passage + " ").encode()
    assert run(spark, texts, 30) == expected
