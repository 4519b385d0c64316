"""Exact, repeatable splits and folds.

Rows are put in the order of ``md5(seed|key)`` inside their class and cut at
exact positions, so sizes are exact and membership does not depend on how the
rows are partitioned. The cuts are found by counting hash buckets; only the
buckets that hold a cut are ranked. The table itself is then marked row by row
by comparing with the cut points of its class. Class sizes, quotas and cuts are
tables themselves, so there may be any number of classes.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litscreen.operators.checks import require_columns
from litscreen.operators.ranks import ordered_positions, running_weight
from litscreen.session import ensure_checkpoint_dir

_BUCKET_DIGITS = 4  # 65 536 hash buckets per class


def hash_order(seed: int, key: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))


# ---- sizes (small integer arithmetic on class counts) ---------------------------------------


def exact_size(total: int, share: float) -> int:
    """Rows of the test side: the share, rounded up."""
    size = total * share
    nearest = round(size)
    return nearest if abs(size - nearest) < 1e-9 * max(total, 1) else int(-(-size // 1))


def class_quotas(classes: DataFrame, column: str, size: int, output: str) -> DataFrame:
    """Add ``output``: ``size`` shared among the classes in proportion to ``column``, by largest remainder.

    Ties go to the lower label. ``classes`` is a stored table of ``_class`` and
    counts; remainders are ranked by a distributed sort of that table.
    """
    total = classes.agg(F.sum(column)).first()[0]
    shared = f"CAST({column} AS DECIMAL(19, 0)) * CAST({size} AS DECIMAL(19, 0))"
    whole = classes.withColumns(
        {"_whole": F.expr(f"({shared}) DIV {total}"), "_rest": F.expr(f"CAST(({shared}) % {total} AS DECIMAL(20, 0))")}
    )
    over = size - whole.agg(F.sum("_whole")).first()[0]
    if over:
        ranked = ordered_positions(whole, [F.col("_rest").desc(), F.col("_class")], "_place", "_classes")
        quota = F.col("_whole") + (F.col("_place") < over).cast("long")
    else:
        ranked, quota = whole, F.col("_whole")
    return ranked.select(*classes.columns, quota.alias(output))


def fold_cuts(classes: DataFrame, column: str, k: int, before: str | None = None) -> DataFrame:
    """Add ``_cuts``: where the folds of each class end, the last left out; classes in label order dealt out in turn.

    The rows of a class go to the folds round about, the first to the fold after
    that of the last row of the class before. With ``before`` the cuts are moved
    by that many rows, which make the first part.
    """
    placed = running_weight(classes, ["_class"], column, "_upto", "_total")
    start = F.col("_upto") - F.col(column)

    def dealt(fold: int) -> Column:
        """Rows of the class in the folds up to this one."""
        return reduce(
            lambda a, b: a + b,
            [F.floor((F.col("_upto") - i + k - 1) / k) - F.floor((start - i + k - 1) / k) for i in range(fold + 1)],
        )

    first = F.lit(0) if before is None else F.col(before)
    cuts = [first + dealt(fold) for fold in range(k - 1)]
    if before is not None:
        cuts.insert(0, first)
    return placed.select(*classes.columns, F.array(*[c.cast("long") for c in cuts]).alias("_cuts"))


class Sizes(NamedTuple):
    """What the checks need to know of a table of class sizes."""

    rows: int
    classes: int
    least: int
    most: int


def _sizes(classes: DataFrame, column: str = "_n") -> Sizes:
    found = classes.agg(F.sum(column), F.count("*"), F.min(column), F.max(column), F.count_if(F.col("_class").isNull())).first()
    if not found[1]:
        raise ValueError("there are no rows to split")
    if found[4]:
        raise ValueError("NULL labels cannot be split")
    return Sizes(*found[:4])


def _check_split(sizes: Sizes, test: int) -> None:
    if sizes.least < 2:
        raise ValueError("a class has fewer than 2 rows")
    if test < sizes.classes or sizes.rows - test < sizes.classes:
        raise ValueError("a side of the split has fewer rows than there are classes")


# ---- counting and cutting -------------------------------------------------------------------


def _keyed(df: DataFrame, label: str | None, key: str, seed: int) -> DataFrame:
    """``_class, _hash, _key``: what the cuts depend on, and nothing else."""
    require_columns(df, [key] if label is None else [key, label])
    group = F.lit(0) if label is None else F.col(label)
    return df.select(group.alias("_class"), hash_order(seed, key).alias("_hash"), F.col(key).alias("_key"))


def _bucket() -> Column:
    return F.substring("_hash", 1, _BUCKET_DIGITS)


def _bucket_counts(keyed: DataFrame) -> DataFrame:
    """``_class, _bucket, _n``, stored: at most 65 536 rows per class."""
    ensure_checkpoint_dir(keyed.sparkSession)
    return keyed.groupBy("_class", _bucket().alias("_bucket")).agg(F.count("*").alias("_n")).checkpoint()


def _cut_points(keyed: DataFrame, buckets: DataFrame, cuts: DataFrame) -> DataFrame:
    """``_class, _skipped, _lasts``, stored: hash and key of the last row before each cut of a class, in order.

    ``cuts`` has the increasing cut positions of every class in ``_cuts``. A cut
    at position 0 takes nothing and is only counted, in ``_skipped``.
    """
    wanted = cuts.select("_class", F.posexplode("_cuts").alias("_cut", "_position"))
    upto = Window.partitionBy("_class").orderBy("_bucket")
    placed = buckets.withColumn("_upto", F.sum("_n").over(upto))
    holding = (
        placed.join(wanted.where("_position > 0"), "_class")
        .where((F.col("_position") <= F.col("_upto")) & (F.col("_position") > F.col("_upto") - F.col("_n")))
        .select("_class", "_cut", "_bucket", (F.col("_position") - F.col("_upto") + F.col("_n")).alias("_rank_wanted"))
    )
    inside = Window.partitionBy("_class", "_cut").orderBy("_hash", "_key")
    ranked = (
        keyed.withColumn("_bucket", _bucket())
        .join(holding, ["_class", "_bucket"])  # one bucket per cut
        .withColumns({"_rank": F.row_number().over(inside), "_next": F.lead("_key").over(inside)})
        .where(F.col("_rank") == F.col("_rank_wanted"))
    )
    last = F.struct(F.col("_hash").alias("h"), F.col("_key").alias("k"))
    lasts = ranked.groupBy("_class").agg(
        F.array_sort(F.collect_list(last)).alias("_lasts"), F.max(F.col("_next") == F.col("_key")).alias("_repeats")
    )
    skipped = F.size(F.filter("_cuts", lambda position: position == 0))
    points = cuts.select("_class", skipped.alias("_skipped")).join(lasts, "_class", "left").checkpoint()
    if points.where("_repeats").limit(1).count():
        raise ValueError("the key does not identify the rows: it repeats at a cut")
    return points.drop("_repeats")


def _marked(df: DataFrame, label: str | None, key: str, seed: int, cuts_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Add ``_part``: how many cuts lie before the row in the order of its class.

    ``cuts_of`` adds ``_cuts`` to the table of class sizes. The table is joined
    with the cut points of the classes and compared with them row by row;
    Catalyst broadcasts them if they are few.
    """
    keyed = _keyed(df, label, key, seed)
    buckets = _bucket_counts(keyed)
    classes = buckets.groupBy("_class").agg(F.sum("_n").alias("_n")).checkpoint()
    points = _cut_points(keyed, buckets, cuts_of(classes))
    if label is None:
        points = F.broadcast(points)  # one row
    points = points.withColumnRenamed("_class", "_of")
    group = F.lit(0) if label is None else F.col(label)
    at = F.struct(hash_order(seed, key).alias("h"), F.col(key).alias("k"))
    passed = F.col("_skipped") + F.coalesce(F.size(F.filter("_lasts", lambda last: last < at)), F.lit(0))
    return df.join(points, group == F.col("_of")).withColumn("_part", passed).drop("_of", "_skipped", "_lasts")


# ---- public operators -----------------------------------------------------------------------


def stratified_split(
    df: DataFrame, label: str, key: str, test_size: float = 0.2, seed: int = 42, stratify: bool = True
) -> DataFrame:
    """Add ``split`` (``train``/``test``) with exact sizes overall and per class.

    ``key`` must identify the row. Raises ``ValueError`` if a class has fewer
    than 2 rows, a side has fewer rows than classes, a label is NULL, or the
    key repeats at a cut.
    """

    def cuts(classes: DataFrame) -> DataFrame:
        sizes = _sizes(classes)
        test = exact_size(sizes.rows, test_size)
        if stratify:
            _check_split(sizes, test)
        return class_quotas(classes, "_n", test, "_test").withColumn("_cuts", F.array("_test"))

    marked = _marked(df, label if stratify else None, key, seed, cuts)
    return marked.withColumn("split", F.when(F.col("_part") == 0, "test").otherwise("train")).drop("_part")


def random_split(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``split`` without regard to classes."""
    return stratified_split(df, "", key, test_size, seed, stratify=False)


def stratified_kfold(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Add ``fold`` 0..k-1: sizes differ by one row at most, classes are spread evenly."""

    def cuts(classes: DataFrame) -> DataFrame:
        if _sizes(classes).most < k:
            raise ValueError(f"no class has {k} rows")
        return fold_cuts(classes, "_n", k)

    return _marked(df, label, key, seed, cuts).withColumnRenamed("_part", "fold")


def three_way_split(
    df: DataFrame, label: str, key: str, rest_size: float = 0.3, test_share: float = 0.5, seed: int = 42
) -> DataFrame:
    """Add ``split`` train/val/test: a stratified rest, itself split by class into val and test."""

    def cuts(classes: DataFrame) -> DataFrame:
        sizes = _sizes(classes)
        rest_rows = exact_size(sizes.rows, rest_size)
        _check_split(sizes, rest_rows)
        rest = class_quotas(classes, "_n", rest_rows, "_rest_rows").checkpoint()
        test_rows = exact_size(rest_rows, test_share)
        _check_split(_sizes(rest, "_rest_rows"), test_rows)
        return class_quotas(rest, "_rest_rows", test_rows, "_test").withColumn("_cuts", F.array("_test", "_rest_rows"))

    marked = _marked(df, label, key, seed, cuts)
    split = F.when(F.col("_part") == 0, "test").when(F.col("_part") == 1, "val").otherwise("train")
    return marked.withColumn("split", split).drop("_part")


def holdout_then_kfold(
    df: DataFrame, label: str, key: str, test_size: float = 0.15, k: int = 5, seed: int = 42
) -> DataFrame:
    """Add ``split`` (``test``/``cv``) and ``fold`` (NULL for the hold-out)."""

    def cuts(classes: DataFrame) -> DataFrame:
        sizes = _sizes(classes)
        test_rows = exact_size(sizes.rows, test_size)
        _check_split(sizes, test_rows)
        tested = class_quotas(classes, "_n", test_rows, "_test")
        return fold_cuts(tested.withColumn("_cv", F.col("_n") - F.col("_test")), "_cv", k, before="_test")

    marked = _marked(df, label, key, seed, cuts)
    return marked.withColumns(
        {
            "split": F.when(F.col("_part") == 0, "test").otherwise("cv"),
            "fold": F.when(F.col("_part") > 0, F.col("_part") - 1),
        }
    ).drop("_part")


def split_data(df: DataFrame, strategy: str, label: str, key: str, seed: int = 42) -> DataFrame:
    """The split of an experiment run: ``train_test`` (70/15/15) or ``cv`` (15 % hold-out, 5 folds)."""
    if strategy == "train_test":
        return three_way_split(df, label, key, seed=seed)
    if strategy == "cv":
        return holdout_then_kfold(df, label, key, seed=seed)
    raise ValueError(f"Unknown split strategy: {strategy}. Use 'train_test' or 'cv'")


def fold_views(folds: DataFrame, k: int, fold: str = "fold") -> DataFrame:
    """Long form of the folds: each row once per fold, as ``train`` or, in its own fold, ``test``."""
    numbers = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    long = folds.withColumn("view", numbers)
    return long.withColumn("part", F.when(F.col(fold) == F.col("view"), "test").otherwise("train"))


def fold_view(folds: DataFrame, number: int, fold: str = "fold") -> tuple[DataFrame, DataFrame]:
    """``(train, test)`` of one fold."""
    return folds.where(F.col(fold) != number), folds.where(F.col(fold) == number)


def split_sizes(df: DataFrame, *columns: str) -> DataFrame:
    """Row counts per split (and fold)."""
    return df.groupBy(*columns).agg(F.count("*").alias("n"))
