from collections import Counter

import corpus_pipeline as pipeline
from litscreen.llm import decontamination, near_dedup, quality
from litscreen.llm.common import stored, table
from tests.llm.helpers import EDGES, documents, rows_of
from tests.llm.test_line_dedup import brute
from tests.llm.test_packing import check

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_every_stage_against_its_rule(spark):
    docs = table(spark, SF_DIR, "documents")
    for name, stage in pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        result = stored(stage(spark, docs, SF_DIR), "test")
        after = result.collect()
        if name == "quality classifier":
            scored = quality.score_quality(docs, quality.fitted(docs, table(spark, SF_DIR, "labels"))).collect()
            assert {r.row.doc_id for r in scored if r.predicted} == {r.doc_id for r in after}
        elif name == "line dedup":
            order = sorted(before)
            texts = dict(zip(order, brute([before[i].text.encode() for i in order], 30)))
            left = {i: t.decode() for i, t in texts.items() if t.strip() or t == before[i].text.encode()}
            assert left == {r.doc_id: r.text for r in after}
            assert all(r.n_chars == len(r.text) for r in after if r.text != before[r.doc_id].text)
        elif name == "MinHash near-dedup":
            found = near_dedup.near_duplicates(docs).collect()
            assert {r.doc_id for r in after} == {r.doc_id for r in found if r.component_id == r.doc_id}
        elif name == "benchmark decontamination":
            found = decontamination.find_benchmark(docs, table(spark, SF_DIR, "benchmark")).collect()
            assert {r.doc_id for r in after} == {r.row.doc_id for r in found if not r.spans}
        if name == "best-fit packing":
            check([(r.doc_id, r.text) for r in before.values()], after, 2048)
        else:
            assert result.columns == COLUMNS
            assert all(r == before[r.doc_id] for r in after if name != "line dedup")
        docs = result
    whole = pipeline.run(spark, SF_DIR)
    pieces = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert rows_of(whole, *pieces) == rows_of(docs, *pieces)


def test_stages_take_edges_and_empty_tables(spark):
    for rows in (EDGES + [(11, "a b c d e f g h"), (12, "a b c d e f g h")], []):
        docs = stored(documents(spark, rows), "edges")
        for _, stage in pipeline.STAGES:
            docs = stored(stage(spark, docs, SF_DIR), "edges")
        if not rows:
            assert docs.count() == 0


def test_near_duplicates_keep_one_row_per_group(spark):
    rows = [(1, "a b c d e f g h"), (1, "a b c d e f g h"), (2, "A b c d e f g h"), (2, "other words are here now"), (3, ""), (4, None), (None, "a b c d e f g h")]
    docs = stored(documents(spark, rows), "edges")
    kept = pipeline.minhash_near_dedup(spark, docs, SF_DIR)
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(
        [(1, "a b c d e f g h"), (2, "other words are here now"), (3, ""), (4, None)]
    )
    assert kept.columns == docs.columns
