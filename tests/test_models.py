"""Classifiers on a small separable corpus."""

from dataclasses import replace

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from litscreen.operators import models as md
from litscreen.operators import splits as sp

SPEC = md.TextModel(max_features=50, C=1.0, max_iter=50)


@pytest.fixture(scope="module")
def corpus(spark):
    """Class 1 speaks of binding, class 0 of prices; every third row is class 1."""
    rows = []
    for i in range(60):
        y = int(i % 3 == 0)
        subject = "ligand binding site" if y else "market price index"
        rows.append((i, f"The {subject} number {i} shows w{i % 7} again", y))
    rows.append((99, None, 0))
    return spark.createDataFrame(rows, "id long, text string, y int").repartition(2).persist()


def accuracy(model, rows):
    return md.evaluate_model(model, rows, "y").first()["accuracy"]


def test_fit_save_load(spark, corpus, tmp_path):
    spec = replace(SPEC, weighting="tfidf", ngram_max=2, lemmas={"shows": "show"})
    model = md.fit_text_model(corpus, "text", "y", spec)
    assert accuracy(model, corpus) > 0.95
    model.write().save(str(tmp_path / "m"))
    loaded = PipelineModel.load(str(tmp_path / "m"))
    kept = ["id", "prediction", "probability"]
    assert sorted(loaded.transform(corpus).select(kept).collect()) == sorted(model.transform(corpus).select(kept).collect())
    assert "show" in md.vocabulary_of(model) and "shows" not in md.vocabulary_of(model)
    best = md.top_features(model, spark, 3).collect()
    assert len(best) == 3 and any("bind" in row["feature"] or "ligand" in row["feature"] or "site" in row["feature"] for row in best)


def test_forest_is_grown_in_parts_on_rows_dealt_out(spark, corpus, monkeypatch, tmp_path):
    """No task for each class, as the join with the class weights leaves them; all trees vote."""
    seen = []

    class Forest(md.RandomForestClassifier):
        def fit(self, rows):
            seen.append([r["count"] for r in rows.groupBy(F.spark_partition_id().alias("task")).count().collect()])
            return super().fit(rows)

    monkeypatch.setattr(md, "RandomForestClassifier", Forest)
    monkeypatch.setattr(md, "FOREST_ROWS", 10)
    model = md.fit_text_model(corpus, "text", "y", replace(SPEC, classifier="forest", n_trees=8, max_depth=3))
    assert len(seen) == md.FORESTS and all(len(counts) == 7 and max(counts) <= 18 for counts in seen)
    model.write().save(str(tmp_path / "m"))
    model = PipelineModel.load(str(tmp_path / "m"))
    parts = [stage for stage in model.stages if hasattr(stage, "trees")]
    assert sorted(part.getNumTrees for part in parts) == [1, 1, 1, 1, 2, 2]
    features = next(stage.getFeaturesCol() for stage in parts)
    for row in model.transform(corpus).select(features, "rawPrediction", "probability").collect():
        votes = sum(part.predictRaw(row[features]).toArray() for part in parts)
        assert abs(votes.sum() - 8) < 1e-9 and abs(row.rawPrediction.toArray() - votes).max() < 1e-9
        assert abs(row.probability.toArray() - votes / 8).max() < 1e-9


def test_forest_threshold(corpus):
    forest = replace(SPEC, classifier="forest", n_trees=5, max_depth=5)
    sure = md.fit_text_model(corpus, "text", "y", replace(forest, threshold=0.99)).transform(corpus)
    easy = md.fit_text_model(corpus, "text", "y", replace(forest, threshold=0.01)).transform(corpus)
    n_sure, n_easy = (df.agg(F.sum("prediction")).first()[0] for df in (sure, easy))
    assert n_sure <= n_easy and n_easy >= 20


def test_stronger_penalty_gives_smaller_coefficients(corpus):
    sizes = []
    for c in (0.01, 10.0):
        model = md.fit_text_model(corpus, "text", "y", replace(SPEC, C=c))
        sizes.append(model.stages[-1].coefficients.norm(2))
    assert sizes[0] < sizes[1]


def test_penalty_follows_the_summed_loss(corpus):
    """At the optimum the gradient of 1/2 |w|^2 + C * sum(weight * loss) vanishes."""
    import numpy as np

    spec = replace(SPEC, C=0.5, max_iter=500)
    model = md.fit_text_model(corpus, "text", "y", spec)
    rows = model.transform(corpus).select("features", "y").collect()
    x = np.array([r["features"].toArray() for r in rows])
    y = np.array([r["y"] for r in rows])
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    w, b = model.stages[-1].coefficients.toArray(), model.stages[-1].intercept
    p = 1 / (1 + np.exp(-(x @ w + b)))
    gradient = w + spec.C * x.T @ (weight * (p - y))
    assert np.abs(gradient).max() < 1e-2


def test_grid_search(corpus):
    folds = sp.stratified_kfold(corpus, "y", "id", 3)
    grid = {"ngram_max": [1, 2], "C": [0.001, 1.0]}
    results, best = md.grid_search(folds, "text", "y", SPEC, grid, n_folds=3, parallelism=2)
    model = md.fit_text_model(folds, "text", "y", best)
    rows = results.collect()
    assert len(rows) == 4 and {"mean_test_f1", "std_test_f1", "mean_test_precision", "mean_test_recall", "mean_train_f1"} <= set(results.columns)
    top = max(rows, key=lambda r: r["mean_test_f1"])
    assert top["mean_test_f1"] > 0.9 and best.C in (0.001, 1.0) and accuracy(model, corpus) > 0.9


def test_grid_search_equals_one_fit_per_fold(corpus):
    # without the row that has no text: its probability is 0.5 at the optimum, and rounding decides its class
    folds = sp.stratified_kfold(corpus, "y", "id", 3).where("text IS NOT NULL")
    spec = replace(SPEC, weighting="tfidf")
    results, _ = md.grid_search(folds, "text", "y", spec, {"C": [1.0]}, n_folds=3)
    f1 = []
    for fold in range(3):
        train, test = sp.fold_view(folds, fold)
        f1.append(md.evaluate_model(md.fit_text_model(train, "text", "y", spec), test, "y").first()["f1"])
    assert results.first()["mean_test_f1"] == pytest.approx(sum(f1) / 3)


@pytest.mark.parametrize("weighting", ["count", "tfidf"])
def test_every_model_of_a_search_is_at_its_optimum(corpus, weighting, monkeypatch):
    """Coefficients of all folds and candidates against the gradient of a plain sum over whole rows."""
    import re
    from collections import Counter

    import numpy as np

    from litscreen.operators import many_models as mm

    monkeypatch.setattr(mm, "BLOCK_ROWS", 7)
    fitted = {}
    real = mm.fit_models

    def spy(blocks, widths, views, models, most, tolerance):
        found, left = real(blocks, widths, views, models, most, tolerance)
        fitted.update(views=views, models=models, found=found, left=left)
        return found, left

    monkeypatch.setattr(mm, "fit_models", spy)
    folds = sp.stratified_kfold(corpus, "y", "id", 3)
    spec = replace(SPEC, weighting=weighting, max_iter=500)
    records = md.search_folds(folds, "text", "y", spec, {"C": [0.5, 5.0], "max_features": [4, 20]}, n_folds=3).collect()
    assert len(records) == 12 and max(r["gradient"] for r in records) <= mm.TOLERANCE
    rows = [(Counter(re.findall(r"\b[a-z_]{2,}\b", (r["text"] or "").lower())), r["y"], r["fold"]) for r in folds.collect()]
    for model, point in zip(fitted["models"], fitted["found"]):
        view = fitted["views"][model.view]
        train = [(c, y) for c, y, f in rows if f != view.fold]
        total = Counter()
        for c, _ in train:
            total.update(c)
        terms = sorted(sorted(total, key=lambda t: (-total[t], t))[: len(view.columns)])
        x = np.array([[c[t] for t in terms] for c, _ in train], float)
        y = np.array([y for _, y in train])
        if weighting == "tfidf":
            x *= np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 1
            length = np.linalg.norm(x, axis=1, keepdims=True)
            x = x / np.where(length > 0, length, 1)
        weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
        p = 1 / (1 + np.exp(-(x @ point[:-1] + point[-1])))
        slope = x.T @ (weight * (p - y)) / len(y) + point[:-1] / (model.penalty * len(y))
        assert np.abs(slope).max() <= 2 * mm.TOLERANCE and abs((weight * (p - y)).sum()) / len(y) <= 2 * mm.TOLERANCE


def test_search_takes_rows_without_fold_label_or_text(spark, corpus):
    folds = sp.stratified_kfold(corpus, "y", "id", 3)
    extra = spark.createDataFrame(
        [(200, "market ligand", None, 0), (201, "ligand", 1, None), (202, None, 0, 1), (203, "", 1, 2)], "id long, text string, y int, fold int"
    )
    records = md.search_folds(folds.select("id", "text", "y", "fold").union(extra), "text", "y", SPEC, {"C": [1.0]}, n_folds=3)
    assert len(records.collect()) == 3


def test_candidates():
    assert len(md.candidates(SPEC, md.COUNT_GRID)) == 48
    assert len(md.candidates(SPEC, md.TFIDF_GRID)) == 18


def test_cv_run(corpus):
    rows = sp.holdout_then_kfold(corpus, "y", "id", k=3)
    records = md.cv_run(rows, "text", "y", SPEC, n_folds=3).collect()
    assert sorted(r["cv"] for r in records) == [0, 1, 2]
    assert all(r["test_accuracy"] > 0.5 and r["best_train_f1"] > 0.9 for r in records)
    assert {r["run_name"] for r in records} == {f"logreg_count_cleaned_50x1_C1.0_seed1_cv{i}" for i in range(3)}
    assert all(r["max_iter"] == 50 and r["C"] == 1.0 and not r["lemmatised"] for r in records)


def test_refit_and_test(corpus):
    train, test = corpus.where("id < 40"), corpus.where("id >= 40")
    report = {r["class_name"]: r for r in md.refit_and_test(train, test, "text", "y", SPEC).collect()}
    assert report["accuracy"]["support"] == 21 and report["1"]["f1"] > 0.8


def test_queries_use_the_whole_grids(monkeypatch):
    """The registered searches and fits are handed the full grids and settings."""
    from litscreen.plans import models as plans

    given = []
    monkeypatch.setattr(plans, "_train_test", lambda spark, d: (None, None))
    monkeypatch.setattr(md, "grid_search", lambda train, text, label, base, grid: given.append((base, grid)) or [None])
    plans.grid_search(None, None)
    plans.grid_search_counts(None, None)
    assert [(base.weighting, len(md.candidates(base, grid))) for base, grid in given] == [("tfidf", 18), ("count", 48)]
    assert all(base.max_iter == 1000 for base, _ in given)
    forest = plans._FOREST
    assert (forest.n_trees, forest.max_features, forest.ngram_max, forest.max_depth) == (300, 5000, 2, 30)
    assert (plans._SPEC.max_features, plans._SPEC.max_iter) == (5000, 1000)


def test_rows_of_a_search_are_sparse_products(spark):
    """Products, sums, scales and weights of a block against its dense matrix, with rows that have no terms."""
    import numpy as np

    from litscreen.operators import many_models as mm

    schema = "source int, fold int, label int, terms array<int>, counts array<double>"
    data = [(0, 0, 1, [0, 2], [3.0, 1.0]), (0, 1, 0, [], []), (0, None, 1, [1], [2.0]), (0, 1, 1, [0, 1, 2], [1.0, 1.0, 4.0])]
    (block,) = mm.kept(mm.pack(spark.createDataFrame(data, schema).coalesce(1))).collect()
    rows = mm.Rows(block, 3)
    dense = np.array([[3.0, 0, 1], [0, 0, 0], [0, 2, 0], [1, 1, 4]])
    point = np.array([0.5, -1.0, 2.0])
    assert np.allclose(rows.times(point), dense @ point)
    assert np.allclose(rows.added(np.arange(4.0)), dense.T @ np.arange(4.0))
    view = mm.View(0, 1, np.array([0, 2]), np.array([1.0, 2.0]), True, (0.5, 2.0), 4)
    lengths = np.sqrt((dense[:, 0]) ** 2 + (2 * dense[:, 2]) ** 2)
    assert np.allclose(rows.scales(view), [1 / lengths[0], 0, 0, 1 / lengths[3]])
    assert rows.weights(view).tolist() == [2.0, 0.0, 0.0, 0.0]


def test_badly_conditioned_counts_take_few_passes(spark):
    """A fit over counts of very different sizes; every pass is a job."""
    import numpy as np

    from litscreen.operators import many_models as mm

    random = np.random.RandomState(3)
    sizes = np.geomspace(0.02, 60, 120)
    x = random.poisson(sizes, (800, 120)).astype(float)
    y = (x @ (random.normal(0, 1, 120) / np.sqrt(sizes * 120 + 1)) + random.logistic(0, 1, 800) > 0).astype(float)
    weight, n, passes = 1.0 / 800, len(y), {}
    for memory in (mm.LEAST_STEPS, mm.MOST_STEPS):
        search = mm.minimise(np.zeros(120), mm.TOLERANCE, 3000, memory)
        point, passes[memory] = next(search), 0
        while True:
            z = x @ point
            value = (np.logaddexp(0, z) - y * z).sum() * weight + 0.5 * point @ point / n
            gradient = x.T @ (1 / (1 + np.exp(-z)) - y) * weight + point / n
            passes[memory] += 1
            try:
                point = search.send((value, gradient))
            except StopIteration as end:
                assert np.abs(end.value[1]).max() <= mm.TOLERANCE
                break
    assert passes[mm.MOST_STEPS] < 0.75 * passes[mm.LEAST_STEPS]


def test_single_fit_has_no_job_per_step_of_its_own(spark, corpus, monkeypatch):
    """A fit of two classes takes the optimisation of the searches; its model is the optimum, and the folds of ``cv_run`` share one."""
    from litscreen.operators import many_models as mm

    calls = []
    real = mm.fit_models
    monkeypatch.setattr(mm, "fit_models", lambda *a: calls.append(len(a[3])) or real(*a))
    corpus = corpus.where("text IS NOT NULL")  # its probability is 0.5 at the optimum
    md.fit_text_model(corpus, "text", "y", SPEC)
    rows = sp.holdout_then_kfold(corpus, "y", "id", k=3)
    tfidf = replace(SPEC, weighting="tfidf")
    records = md.cv_run(rows, "text", "y", tfidf, n_folds=3).collect()
    assert calls == [1, 3]
    train = rows.where("split = 'cv' AND fold <> 0")
    model = md.fit_text_model(train, "text", "y", tfidf)
    first = next(r for r in records if r["cv"] == 0)
    assert md.evaluate_model(model, rows.where("split = 'test'"), "y").first()["f1"] == pytest.approx(first["test_f1"])


def test_more_than_two_classes(corpus):
    three = corpus.withColumn("y", F.when(F.col("id") % 3 == 1, 2).otherwise(F.col("y")))
    model = md.fit_text_model(three, "text", "y", SPEC)
    assert model.transform(three).select("prediction").distinct().count() >= 2


def test_products_of_many_models_are_those_of_each(spark):
    """Dense blocks, taken from ``DENSE_MODELS`` columns on, against one column at a time; sparse ones stay sparse."""
    import numpy as np

    from litscreen.operators import many_models as mm

    random = np.random.RandomState(5)
    for share, counts in ((0.3, [1.0, 2.0, 300.0, 0.5]), (0.005, [1.0, 2.0, 255.0])):
        filled = random.rand(40, 60) < share
        data = [(0, i % 3, i % 2, np.flatnonzero(f).tolist(), random.choice(counts, f.sum()).tolist()) for i, f in enumerate(filled)]
        df = spark.createDataFrame(data, "source int, fold int, label int, terms array<int>, counts array<double>")
        (block,) = mm.kept(mm.pack(df.coalesce(1))).collect()
        rows, points = mm.Rows(block, 60), random.normal(size=(60, 9))
        assert sorted(zip(rows.of, rows.terms, rows.counts)) == [(i, t, c) for i, r in enumerate(data) for t, c in zip(r[3], r[4])]
        assert np.allclose(rows.times(points), np.stack([rows.times(p) for p in points.T], axis=1))
        factors = random.normal(size=(40, 9))
        assert np.allclose(rows.added(factors), np.stack([rows.added(f) for f in factors.T], axis=1))
        assert (rows._dense is not None) == (share > 0.1)


def test_rows_are_dealt_out_before_they_are_tokenised(spark, corpus, monkeypatch):
    """Texts are shuffled, not their token lists."""
    plans = []
    real = md.fit_on_tokens
    monkeypatch.setattr(md, "fit_on_tokens", lambda tokens, spec: plans.append(tokens._jdf.queryExecution().optimizedPlan().toString()) or real(tokens, spec))
    md.fit_text_model(corpus, "text", "y", SPEC)
    source = md._source
    monkeypatch.setattr(md, "_source", lambda n, tokens, *a: plans.append(tokens._jdf.queryExecution().withCachedData().toString()) or source(n, tokens, *a))
    md.search_folds(sp.stratified_kfold(corpus, "y", "id", 3), "text", "y", SPEC, {"C": [1.0]}, n_folds=3)
    assert len(plans) == 2
    for plan in plans:
        assert "regexp_extract_all" not in plan.split("Exchange RoundRobin")[-1].split("Repartition 8")[-1]


def test_python_workers_get_small_batches(spark):
    """Token lists come in few megabytes at a time, however large the partition is."""
    import pyarrow as pa

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.unset(key)
    try:
        text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(600)), lambda i: F.concat(F.lit("word"), i + F.col("id"))), " ")
        texts = spark.range(0, 900, 1, 1).select(text.alias("text"), F.lit(1).alias("y"))
        rows = md.tokenised(texts, "text", "y", replace(SPEC, remove_digits=False, ngram_max=2))[1].select("tokens")

        def sizes(batches):
            for batch in batches:
                yield pa.RecordBatch.from_pydict({"n": pa.array([batch.nbytes], pa.int64())})

        largest = rows.mapInArrow(sizes, "n long").agg(F.max("n"), F.sum("n")).first()
        assert largest[1] > 10 << 20 and largest[0] <= 6 << 20
    finally:
        spark.conf.set(key, before)


def test_bucket_counts_come_from_few_tasks(spark, monkeypatch):
    """A task gives the counts of all buckets, so their number does not grow with the partitions."""
    from litscreen.operators import vocabulary as vo

    tasks = []
    frame = type(spark.range(1))
    real = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, *a, **k: tasks.append(self.rdd.getNumPartitions()) or real(self, *a, **k))
    monkeypatch.setattr(vo, "TASKS_A_CORE", 1, raising=False)
    tokens = spark.range(0, 300, 1, 30).select(F.array(F.lit("aa"), F.concat(F.lit("t"), F.col("id") % 7)).alias("tokens"))
    found = vo.learn_vocabulary(tokens, "tokens", 3)
    assert found.terms == ["aa", "t0", "t1"] and list(found.counts) == [300, 43, 43] and found.n_documents == 300
    assert tasks[0] <= spark.sparkContext.defaultParallelism


def test_block_files_have_small_row_groups(spark, tmp_path):
    """One file of many blocks is read in parts, and a page holds few blocks."""
    import pyarrow.parquet as pq

    from litscreen.operators import features as ft

    shifted = F.transform(F.sequence(F.lit(0), F.lit(149)), lambda i: F.concat(F.lit("t"), (7 * i + F.col("id") * (i + 1)) % 3000))
    tokens = spark.range(0, 512 * 60, 1, 1).select(shifted.alias("tokens"), (F.col("id") % 2).cast("int").alias("label"), F.lit(0).alias("fold"))
    counted = ft.count_model([f"t{i}" for i in range(3000)], "tokens", "_counts").transform(tokens)
    md._write_blocks(counted, "_counts", str(tmp_path / "blocks"))
    (file,) = (tmp_path / "blocks").glob("*.parquet")
    groups = pq.ParquetFile(file).metadata
    sizes = [groups.row_group(i).total_byte_size for i in range(groups.num_row_groups)]
    assert sum(sizes) > 16 << 20 and max(sizes) <= 12 << 20


def test_class_weights_do_not_shuffle_token_lists(spark, corpus, monkeypatch):
    """The weights of the classes come to the rows, also where nothing is broadcast by itself; rows without label have none."""
    seen = []
    real = md.train_classifier
    monkeypatch.setattr(md, "train_classifier", lambda rows, *a: seen.append(rows) or real(rows, *a))
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        rows = corpus.withColumn("y", F.when(F.col("id") != 5, F.col("y")))
        md.fit_text_model(rows, "text", "y", SPEC)
        plan = seen[0]._jdf.queryExecution().executedPlan().toString()
        weights = {tuple(r) for r in seen[0].select("label", F.round("weight", 6)).collect()}
    finally:
        spark.conf.set(key, before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert weights == {(0, 0.75), (1, 1.5), (None, None)}


def test_candidates_with_equal_token_lists_share_fits(spark, monkeypatch):
    """Punctuation is in no token: both settings are compared and fitted once, unless lemmas, which it sticks to, tell them apart."""
    from litscreen.operators import many_models as mm

    texts = [("the ligand, binds; it shows (a) site-1 at 3.5", 1), ("prices shows, fall! market index: 7", 0)]
    rows = [(i, f"{texts[i % 2][0]} w{i % 5}", texts[i % 2][1], i // 2 % 3) for i in range(36)] + [(40, None, 0, 1), (41, "a,b", 1, None)]
    train = spark.createDataFrame(rows, "id long, text string, y int, fold int")
    fitted = []
    real = mm.fit_models
    monkeypatch.setattr(mm, "fit_models", lambda *a: fitted.append(len(a[3])) or real(*a))
    grid = {"remove_punct": [True, False], "remove_digits": [True, False], "ngram_max": [1, 2], "C": [0.1, 1.0]}
    records = md.search_folds(train, "text", "y", SPEC, grid, n_folds=3).collect()
    assert fitted == [24] and len(records) == 48 and {r["candidate"] for r in records} == set(range(16))
    by_setting = {(r["remove_punct"], r["remove_digits"], r["ngram_max"], r["C"], r["fold"]): tuple(r)[-5:] for r in records}
    assert all(found == by_setting[(not punct, *rest)] for (punct, *rest), found in by_setting.items())
    with_lemmas = replace(SPEC, lemmas={"shows": "show"})
    md.search_folds(train, "text", "y", with_lemmas, {"remove_punct": [True, False], "C": [1.0]}, n_folds=3).collect()
    assert fitted[1] == 6
    assert len(md._shared_groups(train, "text", md.candidates(SPEC, grid))) == 4
