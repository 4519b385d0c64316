"""Composed plans and their file ends."""

from litscreen.operators.columns import replace_ids
from litscreen.operators.models import TextModel
from litscreen.plans.screening import experiment_run, write_predictions
from litscreen.sources.delimited import read_delimited, write_delimited
from litscreen.sources.runs import read_runs


def test_experiment_run_appends_one_record(spark, tmp_path):
    rows = [(i, ("useful cells bind " if i % 2 else "weather and traffic ") * 3 + f"n{i}", i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, text string, y int")
    spec = TextModel(max_features=50, C=1.0, max_iter=50)
    for c in (1.0, 2.0):
        experiment_run(df, "id", "text", "y", spec, str(tmp_path / "log"), {"C": c})
    records = read_runs(spark, str(tmp_path / "log")).collect()
    assert sorted(r["C"] for r in records) == [1.0, 2.0]
    assert all(r["best_train_f1"] == 1.0 and r["test_f1"] == 1.0 for r in records)


def test_predictions_and_their_positives(spark, tmp_path):
    scored = spark.createDataFrame([(1, 0), (2, 1), (3, None)], "id long, predicted_label int")
    paths = write_predictions(scored, str(tmp_path))
    read = {part: read_delimited(spark, path, "id long, predicted_label int") for part, path in paths.items()}
    assert sorted(map(tuple, read["all"].collect())) == [(1, 0), (2, 1), (3, None)]
    assert [tuple(r) for r in read["positives"].collect()] == [(2, 1)]


def test_large_files_are_split_without_multi_line(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    write_delimited(spark.range(5000).selectExpr("id", "concat('v,', id) AS v").coalesce(1), path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = read_delimited(spark, path, "id long, v string", multi_line=False)
        assert df.rdd.getNumPartitions() > 1 and df.count() == 5000
        assert df.where("v = concat('v,', id)").count() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_corrections_from_a_table(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("a", 4)], "k string, n int")
    table = spark.createDataFrame([("a", "x"), ("a", "w"), (None, "z")], "old string, new string")
    got = replace_ids(df, "k", table)
    assert got.columns == ["k", "n"]
    assert sorted(map(tuple, got.collect()), key=str) == [("b", 2), ("w", 1), ("w", 4), (None, 3)]
