"""Hand-written edge rows for behaviour the tables do not show."""

import re

import pytest
from pyspark.sql import functions as F

from litscreen.functions import text as tx
from litscreen.functions.labels import argmax_label, bool_label, map_labels, numeric_id, whole_id
from litscreen.functions.markup import unescape_html
from litscreen.operators import aggregates as agg
from litscreen.operators import citations as ct
from litscreen.operators import columns as cols
from litscreen.operators import experiments as ex
from litscreen.operators import features as ft
from litscreen.operators import filters as flt
from litscreen.operators import metrics as mt
from litscreen.operators import vocabulary
from litscreen.operators.enrich import enrich_articles, fill_pmid_by_doi, left_join_known, merge_reference_tables
from litscreen.operators.lists import map_members
from litscreen.operators.quantiles import exact_quantiles
from litscreen.plans.screening import screen_articles
from litscreen.sources import delimited, payloads, runs


def values(df, column=None):
    return [row[0 if column is None else column] for row in df.collect()]


def column_of(spark, cells, expression, kind="string"):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], f"i int, c {kind}")
    return [row["r"] for row in df.select("i", expression(F.col("c")).alias("r")).orderBy("i").collect()]


# ---- filters and labels ---------------------------------------------------------------------


def test_drop_values_keeps_null(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "i int, reason string")
    kept, dropped = flt.drop_values(df, "reason", "a")
    assert sorted(values(kept)) == [2, 3] and values(dropped) == [1]


def test_drop_missing_keeps_empty_text(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, None, "y"), (3, "", None), (None, None, None)], "i int, a string, b string")
    kept, dropped = flt.drop_missing(df, ["a"])
    assert sorted(values(kept)) == [1, 3] and dropped.count() == 2
    kept, dropped = flt.drop_missing(df)
    assert values(kept) == [1] and kept.count() + dropped.count() == df.count()
    with pytest.raises(KeyError, match="nope"):
        flt.drop_missing(df, ["a", "nope"])


def test_rejected_ledger_allows_repeats(spark):
    df = spark.createDataFrame([(1,), (2,)], "i int")
    ledger = flt.rejected_ledger(missing=df, review=df)
    assert sorted(map(tuple, ledger.collect())) == [(1, "missing"), (1, "review"), (2, "missing"), (2, "review")]


def test_one_pass_ledger_equals_two_filters(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, None, "x"), (3, "a", None), (4, "a", "y"), (5, None, "y")], "i int, t string, r string")
    kept, missing = flt.drop_missing(df, ["t"])
    kept, excluded = flt.drop_values(kept, "r", "x")
    marked = flt.mark_rejections(df, ["t"], {"r": "x"})
    assert sorted(values(marked.where("reason_dropped IS NULL"))) == sorted(values(kept))
    ledger = flt.rejected_ledger(missing=missing, excluded=excluded)
    assert sorted(map(tuple, marked.where("reason_dropped IS NOT NULL").collect()), key=str) == sorted(map(tuple, ledger.collect()), key=str)


def test_split_labelled(spark):
    df = spark.createDataFrame([(0,), (1,), (-1,), (None,), (2,)], "label int")
    got = {row["label"]: row["split"] for row in flt.split_labelled(df, "label").collect()}
    assert got == {0: "train", 1: "train", -1: "test", None: "test", 2: "test"}


def test_map_labels(spark):
    mapping = {"Rejected": 0, "Useful": 1}
    cells = ["Rejected", "Useful", "other", None]
    assert column_of(spark, cells, lambda c: map_labels(c, mapping)) == [0, 1, -1, -1]
    assert column_of(spark, cells, lambda c: map_labels(c, mapping, None)) == [0, 1, None, None]
    assert column_of(spark, [True, False, None], bool_label, "boolean") == [1, 0, None]


def test_ids(spark):
    cells = ["12", "12.0", "12.7", "PMC3", "", None, "1e3", "nan", "9007199254740993"]
    assert column_of(spark, cells, numeric_id) == [12, 12, 12, None, None, None, 1000, None, 9007199254740993]
    assert column_of(spark, cells, whole_id) == [12, 12, None, None, None, None, 1000, None, 9007199254740993]
    ids, rejected = cols.normalise_ids(spark.createDataFrame([(c,) for c in cells], "id string"), "id")
    assert sorted(values(ids)) == ["1000", "12", "9007199254740993"]
    assert sorted(values(rejected)) == ["", "12.7", "PMC3", "nan"]


def test_screening_with_awkward_names(spark):
    raw = spark.createDataFrame(
        [(1, "Useful", None, "x"), (2, "Rejected", "Review article", "x"), (3, None, None, "x"), (4, "Useful", "o", "x")],
        "PMID long, `Rejection?` string, `If so; reason to reject?` string, extra string",
    )
    fetched = spark.createDataFrame([("1", "t1", "a1"), ("2", "t2", "a2"), ("3.0", "t3", "a3")], "PMID string, Title string, Abstract string")
    got = screen_articles(raw, fetched, "PMID", "Rejection?", "If so; reason to reject?").collect()
    assert sorted((r["PMID"], r["Rejection?"], r["split"]) for r in got) == [(1, 1, "train"), (3, -1, "test")]
    with pytest.raises(KeyError, match="absent"):
        cols.reduce_columns(raw, ["PMID", "absent"])


def test_labels_column(spark):
    df = spark.createDataFrame([(1, 5)], "i int, y int")
    assert cols.ensure_labels(df).first()["labels"] == -1
    assert cols.ensure_labels(df, "y").first()["labels"] == 5
    assert cols.ensure_labels(cols.ensure_labels(df, "y")).first()["labels"] == 5
    with pytest.raises(TypeError):
        cols.ensure_labels([1, 2])


# ---- joins ----------------------------------------------------------------------------------


def test_enrich_articles(spark):
    left = spark.createDataFrame([("1",), ("2.0",), ("9",), (None,)], "PMID string")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "PMID long, Abstract string")
    got = sorted(map(tuple, enrich_articles(left, right).collect()), key=str)
    assert got == [(1, "a"), (2, "b"), (2, "c"), (9, None), (None, None)]
    with pytest.raises(KeyError):
        enrich_articles(left, right.drop("PMID"))


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_map_references_by_broadcast_and_by_shuffle(spark, broadcast):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    works = spark.createDataFrame(
        [(1, ["W1", "W2", "W1", "W9"]), (2, []), (3, None), (4, ["W3", "W4"]), (1, ["W2", None]), (None, ["W1"])],
        "pmid long, refs array<string>",
    )
    lookup = spark.createDataFrame(
        [("W1", "11", 1), ("W2", "21", 2), ("W2", "22", 3), ("W3", None, 4), ("W4", "41", 5), ("W4", None, 6)],
        "openalex_id string, pmid string, seq long",
    )
    try:
        got = [(r["pmid"], r["refs"], r["pmids"]) for r in ct.map_references(works, lookup).collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(got, key=str) == [
        (1, ["W1", "W2", "W1", "W9"], ["11", "22", "11"]),
        (1, ["W2", None], ["22"]),
        (2, [], []),
        (3, None, []),
        (4, ["W3", "W4"], ["41"]),
        (None, ["W1"], ["11"]),
    ]


def test_dedup_clean_and_merge(spark):
    first = spark.createDataFrame([("5", ["W1"], 0), ("7", ["W1", "W1"], 1)], "pmid string, refs array<string>, seq long")
    second = spark.createDataFrame(
        [("7", ["W2"], 0), (None, ["W1"], 1), ("PMC123", ["W1"], 2), ("PMC3251548", [], 3)],
        "pmid string, refs array<string>, seq long",
    )
    lookup = spark.createDataFrame([("W1", "100", 0)], "openalex_id string, pmid string, seq long")
    clean = ct.clean_reference_table(first, second, lookup, {"PMC3251548": "22152337"})
    got = {r["pmid"]: (r["references"], r["num_of_refs"]) for r in clean.collect()}
    assert got == {5: (["100"], 1), 7: (["100", "100"], 2), 22152337: ([], 0)}
    articles = spark.createDataFrame([(5, "x"), (6, "y")], "pmid long, references string")
    merged = merge_reference_tables(articles, clean)
    assert sorted((r["pmid"], r["references_article"], r["num_of_refs"]) for r in merged.collect()) == [(5, "x", 1), (6, "y", None)]


def test_fill_pmid_by_doi(spark):
    works = spark.createDataFrame(
        [("W1", None, "https://doi.org/10.1/a"), ("W2", "5", "https://doi.org/10.1/a"), ("W3", None, None)],
        "openalex_id string, pmid string, doi string",
    )
    index = spark.createDataFrame([("10.1/a", "77"), ("10.1/a", "88")], "doi string, found_pmid string")
    assert {r["openalex_id"]: r["pmid"] for r in fill_pmid_by_doi(works, index).collect()} == {"W1": "77", "W2": "5", "W3": None}


@pytest.mark.parametrize("n", [0, 1, 5, 200, 201])
def test_halves_and_batches(spark, n):
    ids = spark.createDataFrame([(i,) for i in range(n)] + [(None,)] + [(i,) for i in range(n)], "id long").repartition(7)
    halves = {r["id"]: r["half"] for r in ct.halve_ids(ids, "id").collect()}
    assert halves == {i: 1 if i < n // 2 else 2 for i in range(n)}
    batches = {r["batch"]: r["ids"] for r in ct.list_batches(ids, "id").collect()}
    assert batches == {b: ",".join(str(i) for i in range(b * 200, min(n, b * 200 + 200))) for b in range(-(-n // 200))}


def test_halves_of_texts_and_negative_numbers(spark):
    import random

    dice = random.Random(3)
    texts = list({"".join(dice.choice(["a", "b", "é", "日", "", "aa"]) for _ in range(dice.randrange(8))) for _ in range(300)})
    for cells, kind in ((texts, "string"), ([-5, 3, -(2**63), 2**63 - 1, 0, 7], "bigint"), (["x"], "string")):
        df = spark.createDataFrame([(c,) for c in cells], f"id {kind}")
        key = (lambda c: c.encode()) if kind == "string" else None
        first = set(sorted(cells, key=key)[: len(cells) // 2])
        assert {r["id"]: r["half"] for r in ct.halve_ids(df, "id").collect()} == {c: 1 if c in first else 2 for c in cells}


def test_quantiles_of_any_doubles(spark):
    """Signs, zeros, neighbours, infinities and a third of all rows with one value."""
    import math
    import random

    import numpy as np

    dice = random.Random(4)
    cells = [dice.choice([1, -1]) * 10 ** dice.uniform(-300, 300) for _ in range(200)] + [0.0, -0.0, 5e-324, -5e-324]
    cells += [1.0, math.nextafter(1.0, 2)] + [0.25] * 100
    df = spark.createDataFrame([(x,) for x in cells] + [(None,)], "x double").repartition(5)
    probs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.77, "e": 1.0}
    assert tuple(exact_quantiles(df, [], "x", probs).first()) == pytest.approx(np.quantile(cells, list(probs.values())))
    odd = spark.createDataFrame([(float("inf"),), (float("inf"),), (1.0,), (float("-inf"),)], "x double")
    assert tuple(exact_quantiles(odd, [], "x", {"a": 0.0, "b": 0.9, "c": 1.0}).first()) == (-math.inf, math.inf, math.inf)
    described = agg.describe_numeric(df.where("x = 0.25"), "x").first()
    assert tuple(described) == (100, 0.25, 0.0, 0.25, 0.25, 0.25, 0.25, 0.25)
    assert tuple(agg.describe_numeric(df.limit(0), "x").first()) == (0, *[None] * 7)


def test_history_parts_by_place(spark):
    rows = [("a", 10**6 * i // 2, float(i), None if i % 3 else float(-i)) for i in range(25)]  # steps repeat and leave gaps
    rows += [("b", 7, 1.0, None), ("b", 900_000, 2.0, 3.0), (None, 1, 4.0, None)]
    df = spark.createDataFrame(rows, "run string, step long, train double, eval double").repartition(6)
    got = {(r["run"], r["part"]): (r["train"], r["eval"]) for r in runs.collect_run_history(df, "run", "step", ["train", "eval"], 10).collect()}
    whole = [r for r in rows if r[0] == "a"]
    for part in range(3):
        mine = whole[10 * part : 10 * part + 10]
        assert got.pop(("a", part)) == ([r[2] for r in mine], [r[3] for r in mine if r[3] is not None])
    assert got == {("b", 0): ([1.0, 2.0], [3.0]), (None, 0): ([4.0], [])}


def test_empty_lists(spark):
    df = spark.createDataFrame([(0, 0), (3, None), (0, 2), (1, 0)], "a int, b int")
    got = {r["source"]: (r["n_empty"], r["share_empty"]) for r in ct.empty_list_share(df, {"x": "a", "y": "b"}).collect()}
    assert got == {"x": (2, 0.5), "y": (2, 0.5)}
    texts = spark.createDataFrame([("[]",), (" [] ",), ("",), (None,), ("['W1']",)], "r string")
    assert tuple(flt.empty_reference_count(texts, "r").first()) == (4, 5, 0.8)
    lists = spark.createDataFrame([([],), (None,), (["a"],)], "l array<string>")
    assert values(ct.num_refs(lists, "l"), "num_refs") == [0, None, 1]


def test_plans_do_not_depend_on_the_order_of_rows(spark):
    """The same rows, dealt and ordered differently, give the same result; null keys and equal rows included."""
    rows = [(i % 7 if i % 3 else None, ["a", None, "b", "z"][: i % 5], f"t{i % 4}") for i in range(200)]
    lookup = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", None)], "member string, value string")
    other = spark.createDataFrame([(k, f"r{k}") for k in range(5)], "k long, right string")
    results = []
    for seed in (1, 2):
        df = spark.createDataFrame(rows, "k long, l array<string>, t string").repartition(3 + seed).orderBy(F.rand(seed))
        joined = left_join_known(map_members(df, F.col("l"), lookup, "m"), other, "k")
        kept = map_members(joined, F.col("l"), lookup, "u", keep_unknown=True)
        results.append(sorted(map(str, kept.select("k", "l", "t", "m", "u", "right").collect())))
    assert results[0] == results[1] and len(results[0]) == 200
    plan = kept._jdf.queryExecution().toString()
    assert "monotonically_increasing_id" not in plan
    found = {str(r["l"]): (r["m"], r["u"]) for r in kept.collect()}
    assert found["['a', None, 'b', 'z']"] == (["A", "B"], ["A", "B", "z"]) and found["[]"] == ([], [])


# ---- files and payloads ---------------------------------------------------------------------


def test_delimited_round_trip(spark, tmp_path):
    rows = [(1, 'say "hi", you', "two\nlines"), (2, " spaced ", "tab\there"), (3, "NA", None), (4, "", "\\ back")]
    for extension in ("csv", "tsv", "TXT"):
        path = str(tmp_path / f"t.{extension}")
        delimited.write_delimited(spark.createDataFrame(rows, "i int, a string, b string"), path)
        got = sorted(map(tuple, delimited.read_delimited(spark, path, "i int, a string, b string").collect()))
        assert got == [(1, 'say "hi", you', "two\nlines"), (2, " spaced ", "tab\there"), (3, None, None), (4, None, "\\ back")]
    (tmp_path / "plain.csv").write_text(',a\n0,x\n1,"y, z"\n')
    assert sorted(values(delimited.read_csv_index(spark, str(tmp_path / "plain.csv")))) == ["x", "y, z"]


def test_quoted_records_across_many_splits(spark, tmp_path):
    """Line breaks in values, quotes, blank lines and values longer than a split, against the csv module."""
    import csv
    import io
    import random

    dice = random.Random(5)
    pieces = ["a", '"', "\n", ",", " ", "é", "x" * 40, "\n\n", '""', "\r\n"]
    rows = [(i, "".join(dice.choices(pieces, k=dice.randrange(12)))) for i in range(600)]
    rows.insert(300, (600, '"\n' * 4000))
    folder = tmp_path / "files.csv"
    folder.mkdir()
    for part in range(2):
        out = io.StringIO(newline="")
        writer = csv.writer(out, lineterminator="\r\n" if part else "\n", quoting=csv.QUOTE_NONNUMERIC)
        writer.writerow(["the\nid", "text"])
        writer.writerows(rows[part::2])
        (folder / f"{part}.csv").write_bytes(out.getvalue().encode())
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        read = delimited.read_delimited(spark, str(folder), "id int, text string")
        got = read.collect()
        assert spark.read.text(str(folder), lineSep="\n").select(F.spark_partition_id()).distinct().count() > 20
        whole = delimited.read_delimited(spark, str(folder), "id int, text string", one_task=True).collect()
        assert delimited.read_delimited(spark, str(folder)).columns == ["the\nid", "text"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    expected = sorted((i, t or None) for i, t in rows)
    assert sorted(map(tuple, got)) == expected and sorted(map(tuple, whole)) == expected


def test_id_list_warns(spark):
    df = spark.createDataFrame([(1,), (1,), (None,), (2,)], "id long")
    with pytest.warns(UserWarning, match="1 duplicate"):
        ids, duplicates = delimited.load_id_list(df, "id", warn=True)
    assert values(ids) == ["1", "1", "2"] and tuple(duplicates.first()) == (3, 1)
    with pytest.warns(UserWarning, match="empty"):
        delimited.load_id_list(df.limit(0), "id", warn=True)


def test_decode_list_literal(spark):
    cells = ["[]", "['W1', 'W2']", '["W1"]', "  ", "garbage", None, "[ 'a' ]"]
    assert column_of(spark, cells, delimited.decode_list_literal) == [[], ["W1", "W2"], ["W1"], None, None, None, ["a"]]
    floats = ["[0.1, 2e-05]", "[1]", "[]"]
    assert column_of(spark, floats, lambda c: delimited.decode_list_literal(c, "double")) == [[0.1, 2e-05], [1.0], []]
    odd = ["['a', None]", r"""['x\xa0y', 'it\'s', "it's"]""", """['None, "b"', ]""", r"['c\\x41', 'd\\']", "['a' 'b']", "['a'"]
    expected = [["a", None], ["x\xa0y", "it's", "it's"], ['None, "b"'], [r"c\x41", "d\\"], None, None]
    assert column_of(spark, odd, delimited.decode_list_literal) == expected
    losses = column_of(spark, ["[nan, 1.5, inf, -inf, None]"], lambda c: delimited.decode_list_literal(c, "double"))[0]
    assert str(losses) == "[nan, 1.5, inf, -inf, None]"
    long = "[" + ", ".join(f"'W{i}'" for i in range(50_000)) + "]"
    assert len(column_of(spark, [long], delimited.decode_list_literal)[0]) == 50_000
    df = spark.createDataFrame([(1, "['a']"), (2, "x y"), (3, None)], "id int, t string")
    decoded, rejects = delimited.decode_lists(df, "t", "l")
    assert [tuple(r) for r in decoded.orderBy("id").collect()] == [(1, "['a']", ["a"]), (3, None, None)]
    assert [tuple(r) for r in rejects.collect()] == [(2, "x y")]


def test_parse_works(spark):
    cells = {
        "ok": '{"ids": {"pmid": "https://x/123"}, "doi": "d", "referenced_works": ["https://o/W1", "W2"]}',
        "no ids": '{"doi": "d"}',
        "ids null": '{"ids": null, "doi": "d", "referenced_works": ["W1"]}',
        "refs null": '{"ids": {"pmid": "p/1"}, "doi": "d", "referenced_works": null}',
        "member null": '{"ids": {"pmid": "p/1"}, "doi": "d", "referenced_works": ["W1", null]}',
        "empty pmid": '{"ids": {"pmid": ""}, "doi": null}',
        "bad": "{not json",
        "null": None,
        "list": "[1]",
    }
    df = spark.createDataFrame(list(cells.items()), "openalex_id string, payload string")
    got = {r["openalex_id"]: tuple(r)[1:] for r in payloads.parse_works(df, "payload").collect()}
    unreadable = (None, None, [])
    assert got == {
        "ok": ("123", "d", ["W1", "W2"]),
        "no ids": (None, "d", []),
        "ids null": unreadable,
        "refs null": unreadable,
        "member null": unreadable,
        "empty pmid": (None, None, []),
        "bad": unreadable,
        "null": unreadable,
        "list": unreadable,
    }
    refs = {r["openalex_id"]: r["references"] for r in payloads.parse_work_refs(df, "payload", "openalex_id").collect()}
    assert refs["ok"] == ["W1", "W2"] and refs["ids null"] == ["W1"]
    assert all(refs[k] == [] for k in cells if k not in ("ok", "ids null"))


def test_parse_esearch(spark):
    cells = ['{"esearchresult": {"idlist": ["7", "8"]}}', '{"esearchresult": {"idlist": []}}', "{}", "x", None]
    assert column_of(spark, cells, payloads.parse_esearch) == ["7", None, None, None, None]


def test_runs_log(spark, tmp_path):
    path = str(tmp_path / "runs")
    runs.append_run(spark.createDataFrame([(1, 0.5)], "id int, f1 double"), path)
    runs.append_run(spark.createDataFrame([(2, 0.6, "x")], "id int, f1 double, note string"), path)
    assert sorted(map(tuple, runs.read_runs(spark, path).collect())) == [(1, 0.5, None), (2, 0.6, "x")]
    history = spark.createDataFrame([("a", 3, 0.3, None), ("a", 1, 0.1, 1.0), ("a", 2, 0.2, 2.0), ("b", 1, 0.9, None)],
                                    "run string, step long, train double, eval double")
    got = {r["run"]: (r["train"], r["eval"]) for r in runs.collect_run_history(history, "run", "step", ["train", "eval"]).collect()}
    assert got == {"a": ([0.1, 0.2, 0.3], [1.0, 2.0]), "b": ([0.9], [])}


# ---- texts ----------------------------------------------------------------------------------

SPACE_TEXTS = [" a  b\n\tc ", "", "   ", "x", None, "no break em", "a\x1cb\x85c", "one two"]


def test_white_space(spark):
    assert column_of(spark, SPACE_TEXTS, tx.collapse_whitespace) == [None if t is None else " ".join(t.split()) for t in SPACE_TEXTS]
    assert column_of(spark, SPACE_TEXTS, tx.word_count) == [None if t is None else len(t.split()) for t in SPACE_TEXTS]
    assert column_of(spark, SPACE_TEXTS, tx.words) == [None if t is None else t.split() for t in SPACE_TEXTS]


CLEAN_TEXTS = [
    "p < 0.05 and q > 3 end", "See http://a.b/c?d and www.x.org/y, HTTP://UP.CASE", "mail me@x.org now, a@ @b a@@ @@x @u@x",
    "<b>bold</b> 12 mg 3.5", "été_naïve Straße №5 Ⅷ ½ x²", "", None, "  lots\n\nof   space ", "tabs\tand nbsp (par) [sq]",
    "١٢٣ digits", "a-b_c d'e", "< unclosed", "http", "x@y@z w@", "snake_case 10°C α-helix",
]


def python_clean(text, lower, digits, punct):
    text = text or ""
    steps = [r"<[^>]+>", r"http\S+|www\.\S+", r"\S+@\S+"] + [r"\d+"] * digits + [r"[^\w\s]"] * punct
    text = text.lower() if lower else text
    for pattern in steps:
        text = re.sub(pattern, " ", text)
    return " ".join(text.split())


@pytest.mark.parametrize("lower", [True, False])
@pytest.mark.parametrize("digits", [True, False])
@pytest.mark.parametrize("punct", [True, False])
def test_clean_text(spark, lower, digits, punct):
    got = column_of(spark, CLEAN_TEXTS, lambda c: tx.clean_text(c, lower, digits, punct))
    assert got == [python_clean(t, lower, digits, punct) for t in CLEAN_TEXTS]


MARK_TEXTS = [
    "Protein protein PROTEIN", "proteins pre-protein xprotein", "éprotein proteiné", "", None, "protein", "A(b) x A(b)y (protein)",
    "cost $5 and a\\b", "tau protein tau", "the tau-protein KEY",
]


def python_mark(text, keywords, marker):
    for kw in keywords:
        text = re.sub(rf"\b{re.escape(kw)}\b", lambda m: f"{marker} {kw} {marker}", text, flags=re.IGNORECASE)
    return text


@pytest.mark.parametrize("keywords", [["protein"], ["tau", "protein"], ["protein", "KEY"], ["A(b)"], ["$5"], ["a\\b"], ["tau protein", "tau"]])
def test_mark_keywords(spark, keywords):
    for marker in ("[KEY]", "$0\\"):
        got = column_of(spark, MARK_TEXTS, lambda c: tx.mark_keywords(c, keywords, marker))
        assert got == [None if t is None else python_mark(t, keywords, marker) for t in MARK_TEXTS]


def test_tokens_and_ngrams(spark):
    cells = ["One two 3 four_5", "", "a b", "Größe ça", None]
    assert column_of(spark, cells, tx.word_tokens) == [["one", "two", "four_5"], [], [], ["größe", "ça"], None]
    grams = column_of(spark, [["x"], [], ["a", "b", "c"]], lambda c: tx.word_ngrams(c, 1, 2), "array<string>")
    assert grams == [["x"], [], ["a", "b", "c", "a b", "b c"]]
    assert column_of(spark, [["a", "b", "c"]], lambda c: tx.word_ngrams(c, 2, 3), "array<string>") == [["a b", "b c", "a b c"]]


def test_compose_input_text(spark):
    df = spark.createDataFrame([("t", "j", "a"), (None, "j", "a"), ("t", None, "a"), ("t", "j", None)], "t string, j string, a string")
    got = values(df.select(tx.compose_input_text(F.col("t"), F.col("j"), F.col("a"))))
    assert got == [f"{t} [T_END] {j} [J_END] {a}" for t, j, a in map(tuple, df.collect())]


def test_truncate_pad(spark):
    cells = [[], [1, 2], [1, 2, 3], [1, 2, 3, 4]]
    df = spark.createDataFrame([(c,) for c in cells], "ids array<int>")
    ids, mask = tx.truncate_pad(F.col("ids"), 3, 9)
    got = [tuple(r) for r in df.select(ids, mask).collect()]
    assert got == [([9, 9, 9], [0, 0, 0]), ([1, 2, 9], [1, 1, 0]), ([1, 2, 3], [1, 1, 1]), ([1, 2, 3], [1, 1, 1])]


def test_paths_and_entities(spark):
    assert column_of(spark, ["https://a/b/W1", "W1", "a/", None], tx.last_path_segment) == ["W1", "W1", "", None]
    dois = ["https://doi.org/10.1/x", "10.1/x", "doi.org/doi.org/y", None]
    assert column_of(spark, dois, tx.normalise_doi) == ["10.1/x", "10.1/x", "y", None]
    entities = ["a &lt; b", "&eacute;&#946;&#x3b5;", "plain", "AT&T", None, "&amp;amp;"]
    assert column_of(spark, entities, unescape_html) == ["a < b", "éβε", "plain", "AT&T", None, "&amp;"]


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_lemmas_by_broadcast_and_by_shuffle(spark, broadcast):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    df = spark.createDataFrame([(1, "cells are  bound\nare"), (2, ""), (3, None), (4, "x")], "id int, t string")
    lemmas = spark.createDataFrame([("cells", "cell"), ("are", "bee"), ("are", "be"), (None, "y")], "token string, lemma string")
    try:
        got = {r["id"]: r["lemmas"] for r in ft.lemmatise(df, "t", lemmas).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {1: "cell be bound be", 2: "", 3: None, 4: "x"}


def test_encoder(spark):
    df = spark.createDataFrame([("[KEY] tau [KEY] binds tau",), ("",), ("new words tau",)], "t string")
    encoder = ft.learn_encoder(df, "t", 2)
    assert list(encoder) == ["[pad]", "[unk]", "[key]", "[t_end]", "[j_end]", "binds", "tau"]
    got = values(ft.encode_fixed_length(df, "t", encoder, 4), "input_ids")
    assert got == [[2, 6, 2, 5], [0, 0, 0, 0], [1, 1, 6, 0]]


@pytest.mark.parametrize("capacity", [3, 40, 1000])
def test_vocabulary_of_small_summaries(spark, capacity):
    """Summaries that forget terms give the same counts as those that hold all."""
    import random
    from collections import Counter

    dice = random.Random(capacity)
    words = [f"t{i:03d}" for i in range(400)]
    lists = [dice.choices(words, [1 / (i + 1) ** 1.3 for i in range(400)], k=dice.randrange(30)) for _ in range(600)]
    lists += [None, [], [None, "t001"]]
    n = Counter(t for l in lists for t in l or () if t)
    df = Counter(t for l in lists for t in set(l or ()) if t)
    rows = spark.createDataFrame([(l,) for l in lists], "w array<string>").repartition(5)
    for k in (1, 10, 1000):
        best = sorted(sorted(n, key=lambda t: (-n[t], t))[:k])
        found = vocabulary.learn_vocabulary(rows, "w", k, capacity)
        assert found == (best, [n[t] for t in best], [df[t] for t in best], 603)
    assert vocabulary.learn_vocabulary(rows.limit(0), "w", 5, capacity) == ([], [], [], 0)


@pytest.mark.parametrize("buckets", [2, 64, 1 << 12])
def test_fold_vocabularies_against_a_plain_count(spark, buckets, monkeypatch):
    """Per fold the terms of the other rows; few buckets are full of other terms, so that the second pass is made anew; tasks hold few terms."""
    import random
    from collections import Counter

    monkeypatch.setattr(vocabulary, "CAPACITY", 20)
    dice = random.Random(buckets)
    words = [f"t{i:03d}" for i in range(300)]
    rows = [(dice.choices(words, [1 / (i + 1) for i in range(300)], k=dice.randrange(20)), dice.choice([0, 1, 2, None])) for _ in range(300)]
    rows += [(None, 1), ([None, "t001"], 2), (["only"] * 50, 0)]
    df = spark.createDataFrame(rows, "w array<string>, fold int").repartition(4)
    for most in (1, 7, 1000):
        found = vocabulary.fold_vocabularies(df, "w", 3, most, buckets)
        for fold in range(3):
            n = Counter(t for w, f in rows if f is not None and f != fold for t in w or () if t)
            assert found[fold] == sorted(n, key=lambda t: (-n[t], t))[:most]


def test_no_term_outside_full_buckets_is_counted(spark):
    """Rare terms neither leave the tasks nor are shuffled."""
    rows = spark.createDataFrame([([f"r{i}", "often", "often"],) for i in range(500)], "w array<string>").repartition(3)
    hashed = vocabulary._hashed(rows, "w", None)
    sums = vocabulary._bucket_counts(hashed, 1 << 12, None, 0)[0]
    assert sums.sum() == 1500 and sums.max() >= 1000
    left = vocabulary._partial_counts(hashed, sums >= 500, vocabulary.CAPACITY).where("term IS NOT NULL").collect()
    assert len(left) <= 3 + 10 and sum(r["n"] for r in left if r["term"] == "often") == 1000


def test_bigrams_extract_the_tokens_once(spark, tmp_path, monkeypatch):
    """The plan of the query's token lists names the extraction once."""
    from litscreen.plans import texts

    given = []
    monkeypatch.setattr(texts.ft, "build_vocabulary", lambda tokens, *a: given.append(tokens))
    spark.createDataFrame([(1, "a text of words")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    texts.build_vocabulary_bigrams(spark, str(tmp_path))
    assert given[0]._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_tfidf_of_a_text_without_known_terms(spark):
    tokens = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b"]), (3, ["z"])], "id int, w array<string>")
    known = vocabulary.learn_vocabulary(tokens, "w", 2)
    assert known == (["a", "b"], [2, 2], [1, 2], 3)
    weights = {(r["id"], r["idx"]): r["weight"] for r in ft.tfidf_weights(tokens, "id", "w", known).collect()}
    import math

    a, b = 2 * (math.log(4 / 2) + 1), math.log(4 / 3) + 1
    assert weights == {(1, 0): pytest.approx(a / math.hypot(a, b)), (1, 1): pytest.approx(b / math.hypot(a, b)), (2, 1): pytest.approx(1.0)}


# ---- scores and metrics ---------------------------------------------------------------------


def test_argmax_label(spark):
    cells = [[0.1, 0.9], [0.5, 0.5], [-3.0, -2.0, -2.0], [7.0]]
    assert column_of(spark, cells, argmax_label, "array<double>") == [1, 0, 1, 0]


@pytest.mark.parametrize(
    "pairs, expected",
    [
        ([(1, 0), (0, 0)], (0.5, 0, 0, 0)),
        ([(0, 1), (0, 0)], (0.5, 0, 0, 0)),
        ([(1, 1), (0, 0)], (1, 1, 1, 1)),
        ([(1, 0), (0, 1)], (0, 0, 0, 0)),
        ([(1, 1), (1, 1), (1, 0), (0, 1)], (0.5, 2 / 3, 2 / 3, 2 / 3)),
    ],
)
def test_binary_metrics(spark, pairs, expected):
    df = spark.createDataFrame(pairs, "y int, p int")
    assert tuple(mt.binary_metrics(df, "y", "p").first()) == pytest.approx(expected)


def test_report_of_three_classes(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1), (2, 2), (2, 2)], "y int, p int")
    rows = {r["class_name"]: r for r in mt.classification_report(df, "y", "p").collect()}
    assert set(rows) == {"0", "1", "2", "accuracy", "macro avg", "weighted avg"}
    assert (rows["1"]["precision"], rows["1"]["recall"], rows["1"]["f1"]) == pytest.approx((1 / 3, 1, 0.5))
    assert rows["accuracy"]["f1"] == pytest.approx(4 / 6) and rows["macro avg"]["support"] == 6
    assert rows["weighted avg"]["recall"] == pytest.approx((2 * 0.5 + 1 + 3 * 2 / 3) / 6)


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2 + [(None,)], "y int")
    weighted = mt.balanced_class_weights(df, "y").where("y IS NOT NULL")
    assert weighted.agg(F.sum("weight")).first()[0] == pytest.approx(8)
    assert {r["y"]: r["weight"] for r in weighted.distinct().collect()} == {0: pytest.approx(8 / 12), 1: pytest.approx(2.0)}


def test_cross_entropy_of_large_logits(spark):
    df = spark.createDataFrame([([1000.0, 0.0], 0), ([0.0, 0.0], 1)], "z array<double>, y int")
    import math

    assert mt.weighted_cross_entropy(df, "z", "y", [1.0, 3.0]).first()[0] == pytest.approx(3 * math.log(2) / 4)


# ---- summaries ------------------------------------------------------------------------------


def test_quantiles_against_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    rows = [("hot", float(x)) for x in rng.integers(0, 9, 400)] + [("few", float(x)) for x in rng.random(5)] + [("one", 2.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    got = {r["g"]: tuple(r)[1:] for r in exact_quantiles(df, ["g"], "x", probs).collect()}
    for g in ("hot", "few", "one"):
        assert got.pop(g) == pytest.approx(np.quantile([x for k, x in rows if k == g], list(probs.values())))
    assert got == {}
    whole = exact_quantiles(df, [], "x", probs).first()
    assert tuple(whole) == pytest.approx(np.quantile([x for _, x in rows if x is not None], list(probs.values())))


def test_group_summaries(spark):
    df = spark.createDataFrame(
        [("a", 0.5), ("a", 0.7), ("b", 0.6), ("c", None), (None, 0.9)], "g string, m double"
    )
    rows = [tuple(r) for r in ex.run_group_summary(df, "g", "m").collect()]
    assert [r[0] for r in rows] == ["a", "b", "c"]  # ties by name, NULL mean last
    assert rows[1] == ("b", 0.6, 0.6, 0.6, None, 1, 0.6, 0.6)
    assert rows[2][1:] == (None, None, None, None, 0, None, None)
    assert values(ex.group_mean_order(df, "g", "m")) == ["a", "b", "c"]
    assert ex.group_count(df, ["g"]).first()[0] == 3
    check = {r["n_records"]: (r["n_groups"], r["as_expected"]) for r in ex.fold_count_check(df, ["g"], "m", 2).collect()}
    assert check == {2: (1, True), 1: (1, False), 0: (1, False)}


def test_rounding_is_half_to_even(spark):
    df = spark.createDataFrame([("a", 0.00005), ("b", 0.00015), ("c", 0.00025)], "k string, m double")
    got = {r["k"]: r["m"] for r in ex.experiment_summary(df, ["k"], ["m"]).collect()}
    assert got == {"a": 0.0, "b": 0.0002, "c": 0.0002}
    with pytest.raises(KeyError, match="absent"):
        ex.experiment_summary(df, ["k", "absent"], ["m"])


def test_boxplot(spark):
    rows = [("g", float(x)) for x in [1, 2, 3, 4, 5, 100, -90, 100]] + [("one", 3.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    stats = {r["g"]: r.asDict() for r in ex.boxplot_stats(df, "g", "x").collect()}
    assert stats["one"] == {"g": "one", "q1": 3.0, "median": 3.0, "q3": 3.0, "whisker_low": 3.0, "whisker_high": 3.0, "n_outliers": 0}
    box = stats["g"]
    assert (box["q1"], box["median"], box["q3"]) == (1.75, 3.5, 28.75)
    assert (box["whisker_low"], box["whisker_high"], box["n_outliers"]) == (1.0, 28.75, 3)
    assert sorted(map(tuple, ex.boxplot_outliers(df, "g", "x").collect())) == [("g", -90.0, 1), ("g", 100.0, 2)]


def test_best_rows_on_ties(spark):
    epochs = spark.createDataFrame([("r", 1, 0.4), ("r", 2, 0.8), ("r", 3, 0.8), ("s", 1, None)], "run_id string, epoch int, f1 double")
    assert {r["run_id"]: r["epoch"] for r in ex.best_checkpoint(epochs).collect()} == {"r": 2, "s": 1}
    results = spark.createDataFrame([(10.0, False, 0.5), (0.1, False, 0.9), (0.1, True, 0.9), (1.0, True, 0.9)], "C double, d boolean, mean_test_f1 double")
    numbered = ex.number_candidates(results, {"d": [True, False], "C": [0.1, 1.0, 10.0]})
    assert [r["candidate"] for r in numbered.collect()] == [5, 1, 0, 2]
    # equal means: the first candidate, not the smaller parameter value
    assert tuple(ex.best_grid_point(numbered).first())[:2] == (0.1, True)
    assert [r["candidate"] for r in ex.top_grid_points(numbered).collect()] == [0, 1]


def test_loss_curves(spark):
    df = spark.createDataFrame([("a", [1.0, 4.0]), ("a", [3.0, 8.0]), (None, [0.0])], "m string, l array<double>")
    band = {(r["m"], r["step"]): (r["mean"], r["q1"], r["q3"]) for r in ex.loss_curve_band(df, "m", "l").collect()}
    assert band == {("a", 1): (2.0, 1.5, 2.5), ("a", 2): (6.0, 5.0, 7.0)}
    uneven = spark.createDataFrame([("a", [1.0]), ("a", [3.0, 8.0])], "m string, l array<double>")
    with pytest.raises(ValueError, match="unequal"):
        ex.loss_curve_band(uneven, "m", "l")


def test_counts(spark):
    df = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "c string")
    assert [tuple(r) for r in agg.label_distribution(df, "c").collect()] == [("x", 2), (None, 1), ("y", 1)]
    assert [tuple(r) for r in agg.value_counts(df, "c").collect()] == [("x", 2), ("y", 1)]
    assert {r["c"]: r["share"] for r in agg.label_shares(df, "c").collect()} == {"x": 0.5, "y": 0.25}


def test_stateless_operators_take_a_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    df = spark.createDataFrame([(1, "Useful", "A <b>text</b>"), (2, None, None)], "PMID long, label string, Abstract string")
    df.write.parquet(source)
    stream = spark.readStream.schema(df.schema).parquet(source)
    kept, _ = flt.drop_missing(stream, ["Abstract"])
    shown = kept.select("PMID", map_labels(F.col("label"), {"Useful": 1}).alias("y"), tx.clean_text(F.col("Abstract")).alias("t"))
    started = shown.writeStream.format("memory").queryName("screened").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        started.processAllAvailable()
        assert [tuple(r) for r in spark.table("screened").collect()] == [(1, 1, "a text")]
    finally:
        started.stop()


def test_task_functions_travel_by_value(tmp_path):
    """A worker that does not have the package can still run the functions it is sent."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    from litscreen.functions import text as tx

    (tmp_path / "f.pkl").write_bytes(cloudpickle.dumps(tx._is_word_char))
    code = "import pickle; print(pickle.load(open('f.pkl', 'rb'))('_'))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert done.stdout.strip() == "True"


def test_lists_are_not_shuffled_with_their_rows(spark, capsys):
    """Patches meet once per list, and the rows travel without the list that is made from their text."""
    df = spark.createDataFrame([(1, "is a is"), (2, "is a is"), (3, None), (4, " ")], "id int, t string")
    lemmas = spark.createDataFrame([("is", "be"), ("is", "zz")], "token string, lemma string")
    found = ft.lemmatise(df, "t", lemmas)
    assert {r["id"]: r["lemmas"] for r in found.collect()} == {1: "be a be", 2: "be a be", 3: None, 4: ""}
    found.explain("formatted")
    plan = capsys.readouterr().out
    moved = [part for part in plan.split("\n\n") if ") Exchange" in part.split("\n")[0]]
    assert moved and not any(name in part for part in moved for name in ("_list", "_member"))
