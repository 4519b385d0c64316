"""Class-weighted text classifiers: training, grid search, cross-validation, reports.

Everything that is learned (vocabulary, document frequencies, class weights)
is learned on the training rows of the fold or split at hand.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from itertools import product
from multiprocessing.pool import ThreadPool
from typing import NamedTuple

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litscreen.operators import features as ft
from litscreen.operators import many_models as mm
from litscreen.operators import metrics as mt
from litscreen.operators.checks import require_columns
from litscreen.operators.experiments import best_grid_point, grid_results
from litscreen.operators.stages import Lemmatiser, LogisticScorer, NgramTokens, TextCleaner, ThresholdPrediction, VoteSum
from litscreen.operators.vocabulary import Vocabulary, fold_vocabularies, learn_vocabulary
from litscreen.session import scratch_path, small_batches


@dataclass(frozen=True)
class TextModel:
    """Settings of one classifier. ``lemmas`` maps tokens to lemmas; empty means none."""

    cleaned: bool = True
    lower: bool = True
    remove_digits: bool = True
    remove_punct: bool = True
    lemmas: Mapping[str, str] = field(default_factory=dict)
    weighting: str = "count"  # or "tfidf"
    max_features: int = 5000
    ngram_max: int = 1
    classifier: str = "logreg"  # or "forest"
    C: float = 1.0
    max_iter: int = 1000
    n_trees: int = 100
    max_depth: int = 30
    threshold: float = 0.5
    seed: int = 1

    def text_options(self) -> tuple:
        """What the token list of a text depends on."""
        options = (self.lower, self.remove_digits, self.remove_punct) if self.cleaned else None
        return options, tuple(sorted(self.lemmas.items())), self.ngram_max


# The five kinds of text models, with the settings they are used with.
VARIANTS = {
    "counts": TextModel(remove_digits=False, remove_punct=False, ngram_max=2, C=0.1),
    "counts_lemmas": TextModel(ngram_max=2, C=0.1),
    "tfidf_raw": TextModel(cleaned=False, weighting="tfidf"),
    "tfidf_cleaned": TextModel(weighting="tfidf"),
    "tfidf_lemmas": TextModel(weighting="tfidf", ngram_max=2, C=1.0),
}

# The two search grids.
COUNT_GRID = {
    "lower": [True],
    "remove_digits": [True, False],
    "remove_punct": [True, False],
    "max_features": [2000, 5000],
    "ngram_max": [1, 2],
    "C": [0.1, 1.0, 10.0],
}
TFIDF_GRID = {"max_features": [1000, 2000, 5000], "ngram_max": [1, 2], "C": [0.1, 1.0, 10.0]}
FOREST_GRID = {"max_features": [5000], "ngram_max": [2], "n_trees": [300], "threshold": [0.2]}

FORESTS = 6  # parts of a forest, fixed so that its trees do not depend on the number of cores
FOREST_ROWS = 20_000  # rows of one task of a forest, which holds a row as one number per feature


# ---- stages ---------------------------------------------------------------------------------


def text_stages(spec: TextModel, text: str, output: str = "tokens") -> list:
    """From the text column to the token list."""
    stages, column = [], text
    if spec.cleaned:
        stages.append(
            TextCleaner(
                inputCol=column,
                outputCol="cleaned",
                lower=spec.lower,
                removeDigits=spec.remove_digits,
                removePunct=spec.remove_punct,
            )
        )
        column = "cleaned"
    if spec.lemmas:
        stages.append(
            Lemmatiser(
                inputCol=column, outputCol="lemmatised", tokens=list(spec.lemmas), lemmas=list(spec.lemmas.values())
            )
        )
        column = "lemmatised"
    return [*stages, NgramTokens(inputCol=column, outputCol=output, nMax=spec.ngram_max)]


def vector_model(spec: TextModel, vocabulary: Vocabulary) -> PipelineModel:
    """From the token list to the feature vector."""
    if spec.weighting == "tfidf":
        return ft.tfidf_model(vocabulary, "tokens", "features")
    return PipelineModel([ft.count_model(vocabulary.terms, "tokens", "features")])


def _blocks(rows: DataFrame, vector: str, source: int = 0) -> DataFrame:
    """Blocks of ``fold, label`` and the entries of a sparse vector column."""
    opened = rows.withColumn("_v", F.unwrap_udt(vector))
    return mm.pack(
        opened.select(
            F.lit(source).alias("source"), "fold", "label", F.col("_v.indices").alias("terms"), F.col("_v.values").alias("counts")
        )
    )


# A block is one row of some 100 KB: the sizes of pages and row groups are looked at after every row, not every hundred,
# as a page is compressed outside the heap and a row group is read by one task.
_BLOCK_FILES = {"parquet.page.size.row.check.min": 1, "parquet.block.size.row.check.min": 1, "parquet.block.size": 8 << 20}


def _write_blocks(rows: DataFrame, vector: str, path: str, source: int = 0) -> None:
    _blocks(rows, vector, source).write.options(**_BLOCK_FILES).parquet(path)


def train_logreg(train: DataFrame, spec: TextModel, width: int):
    """L2 logistic regression on ``features, label``, balanced by class, with ``width`` features.

    The labels 0 and 1 take the optimisation of the searches, which needs few
    passes and sums sparse blocks; with more classes the model is Spark's own.
    The classes' weights sum to the number of rows, and Spark divides the loss by
    that sum, so the penalty strength 1/C is divided by it as well.
    """
    by_label = {row["label"]: row["count"] for row in train.where("label IS NOT NULL").groupBy("label").count().collect()}
    if not by_label:
        raise ValueError("there are no rows with a label")
    n_train = sum(by_label.values())
    if not set(by_label) <= {0, 1}:
        return LogisticRegression(
            weightCol="weight",
            regParam=1.0 / (spec.C * n_train),
            elasticNetParam=0.0,
            standardization=False,
            maxIter=spec.max_iter,
        ).fit(train)
    spark = train.sparkSession
    path = scratch_path(spark, "fit")
    _write_blocks(train.withColumn("fold", F.lit(0)), "features", path)
    blocks = mm.kept(spark.read.schema(mm.BLOCK).parquet(path))
    try:
        weights = _class_weights(np.array([by_label.get(c, 0) for c in (0, 1)], float))
        view = mm.View(0, mm.EVERY_FOLD, np.arange(width), np.ones(width), False, weights, n_train)
        (found,), _ = mm.fit_models(blocks, [width], [view], [mm.Model(0, spec.C)], spec.max_iter, mm.TOLERANCE)
    finally:
        blocks.unpersist()
    return LogisticScorer(weights=found[:-1].tolist(), bias=float(found[-1]))


def train_forest(train: DataFrame, spec: TextModel) -> list:
    """Random forest on ``features, label, weight`` with sqrt(features) candidates per split, as fitted stages.

    Every task counts all nodes at hand for itself, so more tasks for one fit
    only add counts. The forest is grown in ``FORESTS`` parts instead, side by
    side as far as there are cores, and the trees of all parts vote. The join
    with the class weights leaves all rows of a class to one task, so the rows
    are dealt out anew, at most about ``FOREST_ROWS`` to a task.
    """
    train = train.persist()
    try:
        tasks = max(2, -(-train.count() // FOREST_ROWS))
        parts = min(FORESTS, spec.n_trees)

        def grow(part: int):
            return RandomForestClassifier(
                weightCol="weight",
                numTrees=spec.n_trees // parts + (part < spec.n_trees % parts),
                maxDepth=spec.max_depth,
                featureSubsetStrategy="sqrt",
                seed=spec.seed + 1000 * part,
                rawPredictionCol=f"_votes{part}",
                probabilityCol="",
                predictionCol="",
            ).fit(train.repartition(tasks))

        at_a_time = train.sparkSession.sparkContext.defaultParallelism // tasks
        with ThreadPool(min(parts, max(1, at_a_time))) as pool:
            grown = pool.map(inheritable_thread_target(train.sparkSession)(grow), range(parts), chunksize=1)
    finally:
        train.unpersist()
    return [*grown, VoteSum(inputCols=[f"_votes{part}" for part in range(parts)])]


def train_classifier(train: DataFrame, spec: TextModel, width: int) -> list:
    """Fitted stages from the feature vector to ``prediction``."""
    if spec.classifier == "forest":
        return [*train_forest(train, spec), ThresholdPrediction(threshold=spec.threshold)]
    return [train_logreg(train, spec, width)]


def tokenised(rows: DataFrame, text: str, label: str, spec: TextModel, *keep: str) -> tuple[list, DataFrame]:
    """``(text stages, rows)``; the rows have ``label``, ``tokens`` and the columns to keep."""
    require_columns(rows, [text, label, *keep])
    small_batches(rows.sparkSession)
    stages = text_stages(spec, text)
    labelled = rows.select(text, *keep, F.col(label).cast("int").alias("label"))
    return stages, PipelineModel(stages).transform(labelled).select("label", "tokens", *keep)


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def fit_on_tokens(tokens: DataFrame, spec: TextModel) -> list:
    """Fitted stages from the token list to ``prediction``; ``tokens`` should be kept in memory."""
    vocabulary = learn_vocabulary(tokens, "tokens", spec.max_features)
    vectors = vector_model(spec, vocabulary)
    # a row per class; a shuffled join would hand all token lists of a class to one task
    weighted = tokens.join(F.broadcast(mt.class_weights(tokens, "label")), "label", "left")
    rows = vectors.transform(weighted).select("features", "label", "weight")
    return [*vectors.stages, *train_classifier(rows, spec, len(vocabulary.terms))]


def fit_text_model(train: DataFrame, text: str, label: str, spec: TextModel) -> PipelineModel:
    """One fitted object from the text column to ``prediction``."""
    # texts come in few, large files; they are dealt out before their much larger token lists are made
    stages, tokens = tokenised(train.repartition(_partitions(train)), text, label, spec)
    tokens = tokens.persist()
    try:
        return PipelineModel([*stages, *fit_on_tokens(tokens, spec)])
    finally:
        tokens.unpersist()


def vocabulary_of(model: PipelineModel) -> list[str]:
    return next(stage.vocabulary for stage in model.stages if hasattr(stage, "vocabulary"))


def top_features(model: PipelineModel, spark, n: int = 20) -> DataFrame:
    """The terms with the largest coefficients for class 1; ties go to the first term.

    Coefficients live in the fitted model, ``max_features`` of them.
    """
    classifier = next(stage for stage in reversed(model.stages) if hasattr(stage, "coefficients"))
    pairs = list(zip(vocabulary_of(model), map(float, classifier.coefficients.toArray())))
    table = spark.createDataFrame(pairs, "feature string, coef double")
    return table.orderBy(F.col("coef").desc(), "feature").limit(n)


# ---- evaluation -----------------------------------------------------------------------------


def evaluate_model(model, rows: DataFrame, label: str = "label", **tags) -> DataFrame:
    """Accuracy, precision, recall and F1 of class 1; one row with the given tags."""
    scored = model.transform(rows)
    metrics = mt.binary_metrics(scored, label, "prediction")
    return metrics.select(*[F.lit(value).alias(name) for name, value in tags.items()], *metrics.columns)


def refit_and_test(train: DataFrame, test: DataFrame, text: str, label: str, spec: TextModel) -> DataFrame:
    """Fit the chosen settings and report on the test rows."""
    model = fit_text_model(train, text, label, spec)
    scored = model.transform(test).select(F.col(label).cast("int").alias("label"), F.col("prediction").cast("int").alias("p"))
    return mt.classification_report(scored, "label", "p")


# ---- grid search ----------------------------------------------------------------------------


def candidates(base: TextModel, grid: Mapping[str, Sequence]) -> list[TextModel]:
    """Every combination of the grid: parameters by name, the last one changing fastest."""
    names = sorted(grid)
    return [replace(base, **dict(zip(names, values))) for values in product(*(grid[n] for n in names))]


def _source(number: int, tokens: DataFrame, n_folds: int, most: int) -> tuple:
    """Of one token list of a search, with ``fold`` and ``label``: top terms per fold, all of them in order, its blocks."""
    tops = fold_vocabularies(tokens, "tokens", n_folds, most)
    terms = sorted(set().union(*tops))
    if not terms:
        raise ValueError("the training texts have no terms")
    counted = ft.count_model(terms, "tokens", "_counts").transform(tokens)
    path = scratch_path(tokens.sparkSession, "search")
    _write_blocks(counted, "_counts", path, number)
    return tops, terms, path


def _search_source(number: int, train: DataFrame, text: str, label: str, spec: TextModel, n_folds: int, most: int) -> tuple:
    tokens = tokenised(train, text, label, spec, "fold")[1].where("label IS NOT NULL").persist()
    try:
        return _source(number, tokens, n_folds, most)
    finally:
        tokens.unpersist()


def _fold_statistics(rows: mm.Rows, n_folds: int) -> Iterator[tuple[int, np.ndarray]]:
    """Per source and fold: rows by label, then in how many rows each term stands."""
    for fold in range(n_folds):
        mine = rows.fold == fold
        labels = np.bincount(rows.label[mine & (rows.label >= 0)], minlength=2)[:2].astype(np.float64)
        held = np.bincount(rows.terms[mine[rows.of] & (rows.counts > 0)], minlength=rows.width)
        yield rows.source * n_folds + fold, np.concatenate((labels, held))


def _class_weights(counts: np.ndarray) -> tuple[float, float]:
    """Balanced weights of label 0 and 1; a class without rows has none."""
    present = np.count_nonzero(counts)
    return tuple(float(counts.sum() / (present * n)) if n else 0.0 for n in counts)


def _idf(held: np.ndarray, n_rows: float) -> np.ndarray:
    return np.log((1 + n_rows) / (1 + held)) + 1


def _same_tokens(rows: DataFrame, text: str, one: TextModel, other: TextModel) -> bool:
    """Whether two settings give every row the same words, and so the same n-grams, by comparing all of them."""
    for name, spec in (("_one", one), ("_other", other)):
        for stage in text_stages(replace(spec, ngram_max=1), text, name):
            rows = stage.transform(rows)
        rows = rows.drop("cleaned", "lemmatised")
    return not rows.where(~F.col("_one").eqNullSafe(F.col("_other"))).limit(1).count()


def _shared_groups(rows: DataFrame, text: str, specs: list[TextModel]) -> list[list[int]]:
    """Numbers of the candidates that read the same token lists.

    Tokens are runs of word characters, so it mostly makes no difference whether
    the cleaner takes out punctuation before. Settings that differ in that alone are
    compared on all rows, and where all token lists are equal they share one source.
    """
    by_text: dict = {}
    for number, spec in enumerate(specs):
        by_text.setdefault(spec.text_options(), []).append(number)
    compared: dict = {}
    alike: dict = {}
    for group in by_text.values():
        spec = specs[group[0]]
        for others in alike.setdefault(replace(spec, remove_punct=True).text_options(), []):
            pair = [replace(specs[n], ngram_max=1) for n in (others[0], group[0])]
            key = tuple(one.text_options() for one in pair)
            if key not in compared:
                compared[key] = _same_tokens(rows, text, *pair)
            if compared[key]:
                others += group
                break
        else:
            alike[replace(spec, remove_punct=True).text_options()].append(group)
    return [sorted(group) for groups in alike.values() for group in groups]


class _Search(NamedTuple):
    """The fitted models of a search: candidate and fold of each, and per model what the optimisation found."""

    candidates: list[tuple[int, int]]
    views: list[mm.View]
    found: list[np.ndarray]
    left: np.ndarray
    confusions: list[np.ndarray]


def _fit_search(spark, sources: Sequence[tuple], groups: Sequence[Sequence[int]], specs: list[TextModel], n_folds: int) -> _Search:
    """All models of the candidates ``groups`` on their token lists ``sources`` in one optimisation."""
    blocks = mm.kept(spark.read.schema(mm.BLOCK).parquet(*[path for _, _, path in sources]))
    widths = [len(terms) for _, terms, _ in sources]
    try:
        counted = mm.summed(blocks, widths, _fold_statistics, n_folds)
        views, view_of, models, model_of, candidates_of, which = [], {}, [], {}, [], []
        for source, (group, (tops, terms, _)) in enumerate(zip(groups, sources)):
            place = {term: i for i, term in enumerate(terms)}
            folds = [counted.get(source * n_folds + f, np.zeros(2 + len(terms))) for f in range(n_folds)]
            for fold in range(n_folds):
                rest = sum(folds) - folds[fold]
                for number in group:
                    spec = specs[number]
                    key = (source, fold, spec.weighting, spec.max_features)
                    if key not in view_of:
                        columns = np.array(sorted(place[t] for t in tops[fold][: spec.max_features]), np.int64)
                        tfidf = spec.weighting == "tfidf"
                        weights = _idf(rest[2:][columns], rest[:2].sum()) if tfidf else np.ones(len(columns))
                        view_of[key] = len(views)
                        weight = _class_weights(rest[:2])
                        views.append(mm.View(source, fold, columns, weights, tfidf, weight, int(rest[:2].sum())))
                    model = mm.Model(view_of[key], spec.C)
                    if model not in model_of:  # candidates that share token lists and all else share the fit
                        model_of[model] = len(models)
                        models.append(model)
                    which.append(model_of[model])
                    candidates_of.append((number, fold))
        models = [replace(model, candidates=which.count(i)) for i, model in enumerate(models)]
        found, left = mm.fit_models(blocks, widths, views, models, specs[0].max_iter, mm.TOLERANCE)
        confusions = mm.confusion_counts(blocks, widths, views, models, found)
    finally:
        blocks.unpersist()
    seen = [views[models[i].view] for i in which]
    return _Search(candidates_of, seen, [found[i] for i in which], left[which], [confusions[i] for i in which])


def _search_records(
    train: DataFrame, text: str, label: str, specs: list[TextModel], names: Sequence[str], n_folds: int, parallelism: int
) -> list[dict]:
    """One record per candidate and fold, all models of the search fitted together."""
    rows = train.select(text, label, "fold").repartition(_partitions(train)).persist()
    try:
        groups = _shared_groups(rows, text, specs)
        with ThreadPool(parallelism) as pool:
            tasks = [
                (source, rows, text, label, specs[group[0]], n_folds, max(specs[n].max_features for n in group))
                for source, group in enumerate(groups)
            ]
            sources = pool.starmap(_search_source, tasks)
    finally:
        rows.unpersist()
    done = _fit_search(train.sparkSession, sources, groups, specs, n_folds)
    records = []
    for (number, fold), cells, gradient in zip(done.candidates, done.confusions, done.left):
        (train_f1, _, _), (f1, precision, recall) = (_scores(part) for part in cells)
        tags = {"candidate": number} | {name: getattr(specs[number], name) for name in names}
        scores = {"f1": f1, "precision": precision, "recall": recall, "train_f1": train_f1}
        records.append({**tags, "fold": fold, **scores, "gradient": float(gradient)})
    return records


def _fold_models(tokens: DataFrame, spec: TextModel, n_folds: int) -> list[PipelineModel]:
    """Per fold the model of all other rows of ``tokens``, from the token list to ``prediction``."""
    labelled = tokens.where("label IS NOT NULL AND fold IS NOT NULL")
    if spec.classifier != "logreg" or labelled.where("label NOT IN (0, 1)").limit(1).count():
        return [PipelineModel(fit_on_tokens(tokens.where(F.col("fold") != fold), spec)) for fold in range(n_folds)]
    source = _source(0, labelled, n_folds, spec.max_features)
    done = _fit_search(tokens.sparkSession, [source], [[0]], [spec], n_folds)
    models = []
    for view, point in zip(done.views, done.found):
        terms = [source[1][i] for i in view.columns]
        if spec.weighting == "tfidf":
            vectors = ft.weighted_model(terms, view.weights, "tokens", "features")
        else:
            vectors = ft.count_model(terms, "tokens", "features")
        models.append(PipelineModel([vectors, LogisticScorer(weights=point[:-1].tolist(), bias=float(point[-1]))]))
    return models


def _scores(cells: np.ndarray) -> tuple[float, float, float]:
    """F1, precision and recall of class 1 from ``[label, prediction]`` counts, 0 where there is nothing to divide by."""
    hit, predicted, actual = cells[1, 1], cells[:, 1].sum(), cells[1].sum()
    return tuple(float(a / b) if b else 0.0 for a, b in ((2 * hit, predicted + actual), (hit, predicted), (hit, actual)))


def _fitted_records(
    train: DataFrame, text: str, label: str, specs: list[TextModel], names: Sequence[str], n_folds: int
) -> list[dict]:
    """As ``_search_records`` for classifiers that have no gradient: one fit per candidate and fold."""
    records = []
    for number, spec in enumerate(specs):
        tokens = tokenised(train, text, label, spec, "fold")[1].persist()
        try:
            for fold in range(n_folds):
                own, rest = F.col("fold") == fold, F.col("fold") != fold
                model = PipelineModel(fit_on_tokens(tokens.where(rest), spec))
                part = F.when(own, "test").otherwise("train")
                scored = model.transform(tokens.where("fold IS NOT NULL").withColumn("part", part))
                found = {row["part"]: row for row in mt.binary_metrics(scored, "label", "prediction", "part").collect()}
                tags = {"candidate": number} | {name: getattr(spec, name) for name in names}
                scores = {m: found["test"][m] for m in ("f1", "precision", "recall")}
                records.append({**tags, "fold": fold, **scores, "train_f1": found["train"]["f1"], "gradient": None})
        finally:
            tokens.unpersist()
    return records


def search_folds(
    train: DataFrame,
    text: str,
    label: str,
    base: TextModel,
    grid: Mapping[str, Sequence],
    n_folds: int = 5,
    parallelism: int = 4,
) -> DataFrame:
    """One row per numbered candidate of the grid and per ``fold``: its parameters, test metrics and training F1.

    Texts are tokenised and counted once per set of text options; vocabulary,
    document frequencies and class weights are those of the training rows of the
    fold. All logistic models are fitted in one optimisation (``many_models``);
    ``gradient`` is the largest component of the gradient that is left of each.
    """
    require_columns(train, [text, label, "fold"])
    specs, names = candidates(base, grid), sorted(grid)
    if all(spec.classifier == "logreg" for spec in specs):
        records = _search_records(train, text, label, specs, names, n_folds, parallelism)
    else:
        records = _fitted_records(train, text, label, specs, names, n_folds)
    kinds = {bool: "boolean", int: "int", float: "double", str: "string"}
    typed = [f"`{name}` {kinds[type(getattr(specs[0], name))]}" for name in names]
    schema = ", ".join(["candidate int", *typed, "fold int, f1 double, precision double, recall double, train_f1 double, gradient double"])
    # one small record per candidate and fold
    return train.sparkSession.createDataFrame([tuple(r.values()) for r in records], schema).coalesce(1)


def grid_search(
    train: DataFrame, text: str, label: str, base: TextModel, grid: Mapping[str, Sequence], n_folds: int = 5, parallelism: int = 4
) -> tuple[DataFrame, TextModel]:
    """``(results, best settings)`` of a full grid over the ``fold`` column.

    The results have, per numbered candidate, mean and population std of the
    test metrics and the mean F1 on the training rows. Of equal candidates the
    first wins; ``fit_text_model`` with the best settings refits it on all rows.
    """
    names = sorted(grid)
    folds = search_folds(train, text, label, base, grid, n_folds, parallelism)
    results = grid_results(folds, ["candidate", *names], ["f1", "precision", "recall"]).join(
        folds.groupBy("candidate").agg(F.avg("train_f1").alias("mean_train_f1")), "candidate"
    )
    winner = best_grid_point(results).first()
    return results, replace(base, **{name: winner[name] for name in names})


def model_name(spec: TextModel) -> str:
    """Name of a run with these settings."""
    strength = f"C{spec.C}" if spec.classifier == "logreg" else f"trees{spec.n_trees}"
    text = "lemmas" if spec.lemmas else "cleaned" if spec.cleaned else "raw"
    return f"{spec.classifier}_{spec.weighting}_{text}_{spec.max_features}x{spec.ngram_max}_{strength}_seed{spec.seed}"


def cv_run(rows: DataFrame, text: str, label: str, spec: TextModel, n_folds: int = 5) -> DataFrame:
    """One record per fold: metrics on its train and test rows and on the common hold-out, all settings, the run's name.

    ``rows`` carry ``split`` (``cv``/``test``) and ``fold`` as made by the hold-out split.
    """
    tokens = tokenised(rows.repartition(_partitions(rows)), text, label, spec, "split", "fold")[1].persist()
    try:
        cv, holdout = tokens.where("split = 'cv'"), tokens.where("split = 'test'")
        records = []
        for fold, model in enumerate(_fold_models(cv, spec, n_folds)):
            own = F.when(F.col("fold") == fold, "val").otherwise("train")
            parts = cv.withColumn("part", own).unionByName(holdout.withColumn("part", F.lit("test")))
            evaluation = mt.evaluate_splits(model.transform(parts), "label", "prediction", "part")
            # twelve numbers per fold
            records.append({"cv": fold, **mt.prefix_metrics(evaluation, "part").first().asDict()})
    finally:
        tokens.unpersist()
    table = rows.sparkSession.createDataFrame([tuple(r.values()) for r in records], list(records[0])).coalesce(1)
    settings = {name: F.lit(value) for name, value in vars(spec).items() if name != "lemmas"}
    settings |= {"cv": F.col("cv").cast("int"), "lemmatised": F.lit(bool(spec.lemmas))}
    return table.withColumns(settings).withColumn("run_name", F.concat(F.lit(f"{model_name(spec)}_cv"), "cv"))
