import hashlib
from collections import defaultdict

from litscreen.llm.exact_dedup import deduplicate_files
from tests.llm.helpers import EDGES, documents


def low(text):
    return (text or "").encode().lower()


def check(spark, path, rows, **options):
    got = deduplicate_files(spark, path, **options).collect()
    groups = defaultdict(list)
    for i, text in rows:
        groups[low(text)].append(i)
    assert len(got) == len(rows)
    kept = defaultdict(int)
    for text, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        mine = [r for r in got if r.digest == options.get("digest", lambda b: hashlib.sha256(b).hexdigest())(text)]
        mine = [r for r in mine if (r.keep_id, r.group_size) == (best, len(ids))]
        kept[text] = sum(r.kept for r in mine)
        assert len(mine) >= len(ids) and all(r.id == best for r in mine if r.kept)
    assert sum(r.kept for r in got) == len(groups)


def test_edges(spark, tmp_path):
    path = str(tmp_path / "docs.parquet")
    documents(spark, EDGES).repartition(3).write.parquet(path)
    check(spark, path, EDGES)


def test_equal_digests_of_unequal_texts(spark, tmp_path):
    path = str(tmp_path / "docs.parquet")
    rows = [(i, f"text {i % 7}") for i in range(40)] + [(100, "TEXT 3")]
    documents(spark, rows).write.parquet(path)
    check(spark, path, rows, digest=lambda data: "same")


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "docs.parquet")
    documents(spark, EDGES).where("false").write.parquet(path)
    assert deduplicate_files(spark, path).count() == 0


def test_copies_across_micro_batches(spark, tmp_path):
    """One file per micro-batch: later records meet the state of earlier ones."""
    from litscreen.llm.exact_dedup import BYTES_PER_BATCH, deduplicate_files

    assert BYTES_PER_BATCH < 16 << 30
    path = str(tmp_path / "docs.parquet")
    for start in (20, 0, 10):  # the largest id is not in the last batch
        rows = [(start + i, f"Text {i % 5}" if i < 8 else f"own {start + i}") for i in range(10)]
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(path)
    got = {r.id: r for r in deduplicate_files(spark, path, bytes_per_batch=1).collect()}
    assert len(got) == 30 and sum(r.kept for r in got.values()) == 5 + 6
    assert (got[0].keep_id, got[0].group_size) == (25, 6) and (got[4].keep_id, got[4].group_size) == (24, 3)
    assert (got[9].keep_id, got[9].group_size, got[9].kept) == (9, 1, True)
