"""Sizes, quotas and stability of splits and folds."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from litscreen.operators import splits as sp


def table(spark, *class_sizes, start=0):
    rows, key = [], start
    for label, size in enumerate(class_sizes):
        for _ in range(size):
            rows.append((key, label))
            key += 1
    return spark.createDataFrame(rows, "id long, y int")


def counts(df, *columns):
    return Counter(tuple(row) for row in df.select(*columns).collect())


def test_sizes_of_a_split(spark):
    got = counts(sp.stratified_split(table(spark, 58, 341), "y", "id", 0.2), "split", "y")
    assert got == {("test", 0): 12, ("test", 1): 68, ("train", 0): 46, ("train", 1): 273}


def test_size_is_rounded_up_and_ties_go_to_the_lower_label(spark):
    got = counts(sp.stratified_split(table(spark, 5, 5, 5), "y", "id", 0.3), "split", "y")
    assert [got["test", y] for y in range(3)] == [2, 2, 1]
    assert sp.exact_size(10, 0.3) == 3 and sp.exact_size(11, 0.3) == 4


def test_split_does_not_depend_on_partitions(spark):
    df = table(spark, 30, 71)
    once = set(map(tuple, sp.three_way_split(df.repartition(1), "y", "id").collect()))
    again = set(map(tuple, sp.three_way_split(df.repartition(9), "y", "id").collect()))
    assert once == again
    other_seed = set(map(tuple, sp.three_way_split(df, "y", "id", seed=7).collect()))
    assert once != other_seed


def test_three_ways(spark):
    got = counts(sp.three_way_split(table(spark, 40, 60), "y", "id"), "split", "y")
    assert got == {("train", 0): 28, ("train", 1): 42, ("val", 0): 6, ("val", 1): 9, ("test", 0): 6, ("test", 1): 9}


@pytest.mark.parametrize("sizes", [(58, 341), (7, 8, 9), (5, 5)])
def test_folds(spark, sizes):
    folds = sp.stratified_kfold(table(spark, *sizes), "y", "id", 5)
    assert folds.select("id").distinct().count() == folds.count() == sum(sizes)
    per_fold = counts(folds, "fold")
    assert set(per_fold) == {(f,) for f in range(5)} and max(per_fold.values()) - min(per_fold.values()) <= 1
    per_class = counts(folds, "y", "fold")
    for label in range(len(sizes)):
        found = [per_class[label, f] for f in range(5)]
        assert max(found) - min(found) <= 1


def test_fewer_rows_of_a_class_than_folds(spark):
    folds = sp.stratified_kfold(table(spark, 2, 20), "y", "id", 5)
    assert counts(folds, "y")[(0,)] == 2 and counts(folds, "fold").total() == 22


def test_holdout_and_folds(spark):
    rows = sp.split_data(table(spark, 20, 80), "cv", "y", "id")
    assert counts(rows, "split", "y") == {("test", 0): 3, ("test", 1): 12, ("cv", 0): 17, ("cv", 1): 68}
    assert rows.where("split = 'test' AND fold IS NOT NULL").count() == 0
    assert set(counts(rows.where("split = 'cv'"), "fold").values()) == {17}


def test_fold_views(spark):
    folds = sp.stratified_kfold(table(spark, 10, 10), "y", "id", 5)
    train, test = sp.fold_view(folds, 2)
    assert (train.count(), test.count()) == (16, 4)
    assert counts(sp.fold_views(folds, 5), "view", "part")[2, "train"] == 16


def test_twelve_thousand_classes(spark):
    df = spark.range(36_000).selectExpr("id", "id div 3 AS y")
    got = sp.stratified_split(df, "y", "id", 1 / 3).groupBy("y").agg(F.count_if(F.col("split") == "test").alias("n"))
    assert {tuple(r) for r in got.groupBy("n").count().collect()} == {(1, 12_000)}
    folds = sp.stratified_kfold(spark.range(60_000).selectExpr("id", "id div 5 AS y"), "y", "id", 5)
    assert {tuple(r) for r in folds.groupBy("y", "fold").count().groupBy("count").count().collect()} == {(1, 60_000)}


def test_quotas_by_largest_remainder(spark):
    classes = spark.createDataFrame([(c, n) for c, n in enumerate([10, 11, 12, 13, 7])], "_class int, _n long")
    got = {r["_class"]: r["q"] for r in sp.class_quotas(classes, "_n", 17, "q").collect()}
    # 17/53 of each: 3.21, 3.53, 3.85, 4.17, 2.25; the two largest remainders go up
    assert got == {0: 3, 1: 4, 2: 4, 3: 4, 4: 2}


def test_many_classes(spark):
    df = table(spark, *[3] * 80)
    got = counts(sp.stratified_split(df, "y", "id", 1 / 3), "split", "y")
    assert all(got["test", y] == 1 and got["train", y] == 2 for y in range(80))
    folds = sp.stratified_kfold(table(spark, *[5] * 80), "y", "id", 5)
    assert set(counts(folds, "y", "fold").values()) == {1}


def test_text_keys_and_labels(spark):
    df = spark.createDataFrame([(f"k{i}", "a" if i < 4 else "b") for i in range(10)], "id string, y string")
    got = counts(sp.stratified_split(df, "y", "id", 0.5), "split", "y")
    assert got == {("test", "a"): 2, ("test", "b"): 3, ("train", "a"): 2, ("train", "b"): 3}


def test_errors(spark):
    with pytest.raises(ValueError, match="fewer than 2"):
        sp.stratified_split(table(spark, 1, 20), "y", "id")
    with pytest.raises(ValueError, match="fewer rows than"):
        sp.stratified_split(table(spark, 2, 2, 2), "y", "id", 0.2)
    with pytest.raises(ValueError, match="NULL"):
        sp.stratified_split(spark.createDataFrame([(1, None), (2, 0)], "id long, y int"), "y", "id")
    with pytest.raises(ValueError, match="no rows"):
        sp.stratified_split(table(spark, 2).limit(0), "y", "id")
    with pytest.raises(ValueError, match="Unknown"):
        sp.split_data(table(spark, 9, 9), "other", "y", "id")
    with pytest.raises(ValueError, match="no class has 5"):
        sp.stratified_kfold(table(spark, 3, 4), "y", "id", 5)


def test_random_split(spark):
    got = counts(sp.random_split(table(spark, 1, 20), "id", 0.25), "split")
    assert got == {("test",): 6, ("train",): 15}


def test_a_key_that_repeats_at_a_cut_is_an_error(spark):
    df = spark.createDataFrame([(7, 0)] * 10, "id long, y int")
    with pytest.raises(ValueError, match="repeats at a cut"):
        sp.stratified_split(df, "y", "id", 0.5)
