import struct
import zlib

import numpy as np
import xxhash

from litscreen.llm.quality import FEATURES, class_prior, fit_nnpu, fitted, op4_quality, score_quality, text_features
from tests.llm.helpers import EDGES, documents

SF_DIR = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in op4_quality(spark, SF_DIR).collect()}
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()
    assert len(rows) == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    held = [r for r in labels if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(rows[r.doc_id].held_out for r in held)
    assert sum(r.held_out for r in rows.values()) < 0.25 * len(rows)
    right = [rows[r.doc_id].predicted == r.quality for r in held]
    assert np.mean(right) > 0.97
    good = [rows[r.doc_id].predicted for r in held if r.quality == 1]
    assert np.mean(good) > 0.99
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows.values())


def test_non_negative_risk_separates_without_negative_labels():
    random = np.random.RandomState(0)
    good, bad = random.normal(1, 0.5, (900, 4)), random.normal(-1, 0.5, (300, 4))
    model = fit_nnpu(good[:300], np.vstack([good[300:], bad]), prior=2 / 3)
    assert (model.score(good) > 0.5).mean() > 0.97 and (model.score(bad) < 0.5).mean() > 0.97
    none = fit_nnpu(np.zeros((0, 4)), bad, prior=0.4)
    assert np.allclose(none.score(bad), 0.4)


def test_prior_comes_from_positives_and_unlabelled_rows():
    random = np.random.RandomState(1)
    for share in (0.2, 0.5, 0.85):
        good = random.normal(1, 0.7, (2000, 4))
        mixed = np.vstack([random.normal(1, 0.7, (int(2000 * share), 4)), random.normal(-1, 0.7, (2000 - int(2000 * share), 4))])
        assert abs(class_prior(good, random.permutation(mixed)) - share) < 0.06
    assert class_prior(good[:0], good) == 0.5


def test_query_equals_fit_and_scores_without_spark(spark):
    """Samples by the smallest hashed ids, prior, fit and scores, all computed here."""
    folder = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()

    known = [i for i in docs if zlib.crc32(str(i).encode()) % 5]
    # both samples hold fewer rows than the bound, so only their order is at stake, which Spark takes from the id alone
    by_hash = lambda ids: sorted(ids, key=lambda i: (struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(struct.pack("<q", i), seed=42)))[0], i))
    good = by_hash(r.doc_id for r in labels if r.quality == 1 and r.doc_id in set(known))
    positive, unlabelled = (np.array([text_features((docs[i] or "").encode()) for i in ids]) for ids in (good, by_hash(known)))
    model = fit_nnpu(positive, unlabelled, class_prior(positive, unlabelled))
    got = {r.doc_id: r.score for r in op4_quality(spark, folder).collect()}
    ids = sorted(docs)
    expected = model.score(np.array([text_features((docs[i] or "").encode()) for i in ids]))
    assert np.allclose([got[i] for i in ids], expected, atol=1e-9)


def test_edges_and_empty_tables(spark):
    docs = documents(spark, EDGES)
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (6, 1, 0), (None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    model = fitted(docs, labels)
    rows = score_quality(docs, model).collect()
    assert len(rows) == len(EDGES) and all(0 <= r.score <= 1 for r in rows)
    blank = {r.score for r in rows if not r.row.text}
    assert len(blank) == 1
    empty = docs.where("false")
    assert score_quality(empty, fitted(empty, labels.where("false"))).count() == 0
    assert text_features(None).shape == (FEATURES,)
