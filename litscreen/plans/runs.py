"""Queries on experiment logs and loss curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from litscreen.functions.labels import map_values
from litscreen.operators import columns as cols
from litscreen.operators import experiments as ex
from litscreen.operators.models import COUNT_GRID
from litscreen.plans import views as v
from litscreen.plans.registry import query
from litscreen.session import scratch_path
from litscreen.sources import runs as log

_LABELLED_RUNS = "runs run_labels"


def _labelled(spark, d):
    return v.runs(spark, d).withColumn("run_group", ex.run_label())


@query("run_label", v.with_views(_LABELLED_RUNS, "SELECT run_id, best_val_f1, run_group FROM run_labels"))
def run_label(spark, d):
    return _labelled(spark, d).select("run_id", "best_val_f1", "run_group")


@query(
    "run_name",
    v.with_views(
        "runs",
        """SELECT run_id, best_train_f1,
                  coalesce(model, 'None') || '_lr' || learning_rate || '_unfreeze' || unfreeze_last_k_layers || '__ml'
                  || seq_max_length || '__seed42' AS name,
                  'title_' || coalesce(model, 'None') || '_lr' || learning_rate || '_unfreeze' || unfreeze_last_k_layers || '__ml'
                  || seq_max_length || '__seed42_cv' || run_id % 10 AS cv_name
           FROM runs""",
    ),
)
def run_name(spark, d):
    parts = [F.col(c) for c in ("model", "learning_rate", "unfreeze_last_k_layers", "seq_max_length")]
    return v.runs(spark, d).select(
        "run_id",
        "best_train_f1",
        ex.run_name(*parts, F.lit(42)).alias("name"),
        ex.run_name(*parts, F.lit(42), F.col("run_id") % 10).alias("cv_name"),
    )


@query(
    "fill_flag",
    v.with_views("runs", "SELECT run_id, coalesce(title_abstract_journal, false) AS title_abstract_journal FROM runs"),
)
def fill_flag(spark, d):
    return cols.fill_flag(v.runs(spark, d), "title_abstract_journal").select("run_id", "title_abstract_journal")


@query(
    "append_run",
    v.with_views(
        "runs",
        """SELECT run_id, learning_rate, best_val_f1, test_f1 FROM runs
           UNION ALL SELECT run_id, learning_rate, best_val_f1, test_f1 FROM runs WHERE learning_rate = '2e-05'""",
    ),
)
def append_run(spark, d):
    path = scratch_path(spark, "runs")
    records = v.runs(spark, d).select("run_id", "learning_rate", "best_val_f1", "test_f1")
    log.append_run(records, path)
    log.append_run(records.where("learning_rate = '2e-05'"), path)
    return log.read_runs(spark, path)


@query(
    "collect_run_history",
    """WITH logged AS (SELECT user_id, event_id // 3 * 2 AS step, CAST(value * 100 AS BIGINT) AS loss,
                           CASE WHEN event_type = 'click' THEN CAST(value * 100 AS BIGINT) END AS eval FROM events),
            placed AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY step, loss, eval NULLS FIRST) - 1 AS place
                       FROM logged)
       SELECT user_id AS run_id, CAST(place // 20 AS BIGINT) AS part,
              string_agg(CAST(loss AS VARCHAR), ' ' ORDER BY place) AS train_loss,
              coalesce(string_agg(CAST(eval AS VARCHAR), ' ' ORDER BY place) FILTER (WHERE eval IS NOT NULL), '') AS eval_loss
       FROM placed GROUP BY user_id, place // 20""",
)
def collect_run_history(spark, d):
    """Steps that repeat and leave gaps."""
    loss = F.round(F.col("value") * 100).cast("long")
    history = v.table(spark, d, "events").select(
        F.col("user_id").alias("run_id"),
        (F.floor(F.col("event_id") / 3) * 2).alias("step"),
        loss.alias("train_loss"),
        F.when(F.col("event_type") == "click", loss).alias("eval_loss"),
    )
    vectors = log.collect_run_history(history, "run_id", "step", ["train_loss", "eval_loss"], part_size=20)
    return vectors.select("run_id", "part", *[F.array_join(c, " ").alias(c) for c in ("train_loss", "eval_loss")])


# ---- summaries ------------------------------------------------------------------------------


@query(
    "run_group_summary",
    v.with_views(
        _LABELLED_RUNS,
        """SELECT run_group, round(avg(best_val_f1), 9) AS mean, round(quantile_cont(best_val_f1, 0.25), 9) AS q1,
                  round(quantile_cont(best_val_f1, 0.75), 9) AS q3, round(stddev_samp(best_val_f1), 9) AS std,
                  count(best_val_f1) AS count, min(best_val_f1) AS min, max(best_val_f1) AS max
           FROM run_labels GROUP BY run_group""",
    ),
)
def run_group_summary(spark, d):
    summary = ex.run_group_summary(_labelled(spark, d), "run_group", "best_val_f1")
    return summary.withColumns({c: F.round(c, 9) for c in ("mean", "q1", "q3", "std")})


@query(
    "group_mean_order",
    v.with_views(_LABELLED_RUNS, "SELECT run_group, round(avg(best_val_f1), 9) AS mean FROM run_labels GROUP BY ALL"),
)
def group_mean_order(spark, d):
    return ex.group_mean_order(_labelled(spark, d), "run_group", "best_val_f1").withColumn("mean", F.round("mean", 9))


_KEYS = ", ".join(ex.GROUP_COLUMNS)
_FILLED = "filled AS (SELECT * REPLACE (coalesce(title_abstract_journal, false) AS title_abstract_journal) FROM runs)"
_HAS_KEYS = " AND ".join(f"{k} IS NOT NULL" for k in ex.GROUP_COLUMNS)
_SUMMARY = f"""{_FILLED}, summary AS (SELECT {_KEYS},
        {', '.join(f'CAST(round_even(avg({m}), 4) AS DOUBLE) AS {m}' for m in ex.METRICS)},
        {', '.join(f'CAST(round_even(stddev_samp({m}), 4) AS DOUBLE) AS {m}_std' for m in ex.STD_METRICS)}
    FROM filled WHERE {_HAS_KEYS} GROUP BY {_KEYS})"""


def _filled(spark, d):
    return cols.fill_flag(v.runs(spark, d), "title_abstract_journal")


@query("experiment_summary", v.with_views("runs", f", {_SUMMARY} SELECT * FROM summary"))
def experiment_summary(spark, d):
    return ex.experiment_summary(_filled(spark, d))


@query(
    "top_experiments",
    v.with_views("runs", f", {_SUMMARY} SELECT * FROM summary ORDER BY best_val_f1 DESC NULLS LAST, {_KEYS} LIMIT 10"),
)
def top_experiments(spark, d):
    return ex.top_experiments(ex.experiment_summary(_filled(spark, d)), "best_val_f1", ex.GROUP_COLUMNS)


@query(
    "fold_count_check",
    v.with_views(
        "runs",
        f""", {_FILLED}, counts AS (SELECT count(best_train_f1) AS n_records FROM filled WHERE {_HAS_KEYS}
                                    GROUP BY {_KEYS})
            SELECT n_records, count(*) AS n_groups, n_records = 5 AS as_expected FROM counts GROUP BY n_records""",
    ),
)
def fold_count_check(spark, d):
    return ex.fold_count_check(_filled(spark, d), ex.GROUP_COLUMNS, "best_train_f1")


@query(
    "group_count",
    v.with_views(
        "runs",
        f", {_FILLED} SELECT count(*) AS n_groups FROM (SELECT DISTINCT {_KEYS} FROM filled WHERE {_HAS_KEYS})",
    ),
)
def group_count(spark, d):
    return ex.group_count(_filled(spark, d), ex.GROUP_COLUMNS)


# a metric with far-out values, so that there are outliers
_PRICES = """prices AS (SELECT l_returnflag || l_linestatus AS grp, l_extendedprice * l_quantity AS price FROM lineitem),
    boxes AS (SELECT grp, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.5) AS median,
                     quantile_cont(price, 0.75) AS q3 FROM prices GROUP BY grp),
    fenced AS (SELECT p.*, q1, median, q3,
                      price BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
               FROM prices p JOIN boxes USING (grp))"""


def _prices(spark, d):
    group = F.concat("l_returnflag", "l_linestatus").alias("grp")
    return v.table(spark, d, "lineitem").select(group, (F.col("l_extendedprice") * F.col("l_quantity")).alias("price"))


@query(
    "boxplot_stats",
    f"""WITH {_PRICES}
        SELECT grp, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
               least(min(price) FILTER (WHERE inside), q1) AS whisker_low,
               greatest(max(price) FILTER (WHERE inside), q3) AS whisker_high,
               count(*) FILTER (WHERE NOT inside) AS n_outliers
        FROM fenced GROUP BY grp, q1, median, q3""",
)
def boxplot_stats(spark, d):
    stats = ex.boxplot_stats(_prices(spark, d), "grp", "price")
    return stats.withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3")})


@query(
    "boxplot_outliers",
    f"WITH {_PRICES} SELECT grp, price AS outlier, count(*) AS n FROM fenced WHERE NOT inside GROUP BY ALL",
)
def boxplot_outliers(spark, d):
    return ex.boxplot_outliers(_prices(spark, d), "grp", "price")


# ---- grid results ---------------------------------------------------------------------------

_PARAMS = ["lower", "remove_digits", "remove_punct", "max_features", "ngram_max", "C"]
_GRID = """points AS (SELECT true AS lower, l_linestatus = 'O' AS remove_digits, l_returnflag = 'N' AS remove_punct,
                     CAST(CASE WHEN l_quantity > 25 THEN 5000 ELSE 2000 END AS INTEGER) AS max_features,
                     CAST(CASE WHEN l_tax > 0.04 THEN 2 ELSE 1 END AS INTEGER) AS ngram_max,
                     CASE WHEN l_linenumber < 3 THEN 0.1::DOUBLE WHEN l_linenumber < 6 THEN 1 ELSE 10 END AS C,
                     l_orderkey % 5 AS fold, l_discount * 10 AS f1, l_quantity / 50 AS recall FROM lineitem),
    folds AS (SELECT lower, remove_digits, remove_punct, max_features, ngram_max, C, fold,
                     avg(f1) AS f1, avg(recall) AS recall FROM points GROUP BY ALL),
    results AS (SELECT lower, remove_digits, remove_punct, max_features, ngram_max, C,
                       round(avg(f1), 9) AS mean_test_f1, round(stddev_pop(f1), 9) AS std_test_f1,
                       round(avg(recall), 9) AS mean_test_recall, round(stddev_pop(recall), 9) AS std_test_recall
                FROM folds GROUP BY ALL)"""


def _grid(spark, d):
    line = F.col("l_linenumber")
    points = v.table(spark, d, "lineitem").select(
        F.lit(True).alias("lower"),
        (F.col("l_linestatus") == "O").alias("remove_digits"),
        (F.col("l_returnflag") == "N").alias("remove_punct"),
        F.when(F.col("l_quantity") > 25, 5000).otherwise(2000).alias("max_features"),
        F.when(F.col("l_tax") > 0.04, 2).otherwise(1).alias("ngram_max"),
        F.when(line < 3, 0.1).when(line < 6, 1.0).otherwise(10.0).alias("C"),
        (F.col("l_orderkey") % 5).alias("fold"),
        (F.col("l_discount") * 10).alias("f1"),
        (F.col("l_quantity") / 50).alias("recall"),
    )
    folds = points.groupBy(*_PARAMS, "fold").agg(F.avg("f1").alias("f1"), F.avg("recall").alias("recall"))
    results = ex.grid_results(folds, _PARAMS, ["f1", "recall"])
    return results.select(*_PARAMS, *[F.round(c, 9).alias(c) for c in results.columns if c not in _PARAMS])


@query("grid_results", f"WITH {_GRID} SELECT * FROM results")
def grid_results(spark, d):
    return _grid(spark, d)


@query(
    "select_grid_point",
    f"""WITH {_GRID} SELECT C, mean_test_f1, std_test_f1 FROM results
        WHERE lower AND NOT remove_digits AND NOT remove_punct AND max_features = 5000 AND C = 0.1 AND ngram_max = 2""",
)
def select_grid_point(spark, d):
    point = {"lower": True, "remove_digits": False, "remove_punct": False, "max_features": 5000, "C": 0.1, "ngram_max": 2}
    return ex.select_grid_point(_grid(spark, d), point, ["C", "mean_test_f1", "std_test_f1"])


# means rounded to tie; the candidates are numbered as the search makes them, some parameters in falling order
_NUMBERED = f"""{_GRID},
    numbered AS (SELECT * REPLACE (round(mean_test_f1) AS mean_test_f1), CAST(
        CASE C WHEN 0.1 THEN 0 WHEN 1 THEN 16 ELSE 32 END + CASE max_features WHEN 2000 THEN 0 ELSE 8 END
        + (ngram_max - 1) * 4 + CASE WHEN remove_digits THEN 0 ELSE 2 END + CASE WHEN remove_punct THEN 0 ELSE 1 END
        AS INTEGER) AS candidate FROM results)"""
_GRID_ORDER = "mean_test_f1 DESC, candidate"


def _numbered(spark, d):
    return ex.number_candidates(_grid(spark, d), COUNT_GRID).withColumn("mean_test_f1", F.round("mean_test_f1"))


@query("top_grid_points", f"WITH {_NUMBERED} SELECT * FROM numbered ORDER BY {_GRID_ORDER} LIMIT 2")
def top_grid_points(spark, d):
    return ex.top_grid_points(_numbered(spark, d))


@query("best_grid_point", f"WITH {_NUMBERED} SELECT * FROM numbered ORDER BY {_GRID_ORDER} LIMIT 1")
def best_grid_point(spark, d):
    return ex.best_grid_point(_numbered(spark, d))


@query(
    "best_checkpoint",
    """SELECT user_id AS run_id, event_id AS epoch, floor(value / 50) AS f1 FROM events
       QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY floor(value / 50) DESC, event_id) = 1""",
)
def best_checkpoint(spark, d):
    epochs = v.table(spark, d, "events").select(
        F.col("user_id").alias("run_id"),
        F.col("event_id").alias("epoch"),
        F.floor(F.col("value") / 50).cast("double").alias("f1"),
    )
    return ex.best_checkpoint(epochs)


# ---- loss curves ----------------------------------------------------------------------------

_NAMED = "CASE model_code " + " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in v.MODEL_NAMES.items()) + " END"


def _named(spark, d):
    return v.loss_runs(spark, d).withColumn("model_name", map_values(F.col("model_code"), v.MODEL_NAMES))


@query("map_model_names", v.with_views("loss_runs", f"SELECT run_id, {_NAMED} AS model_name FROM loss_runs"))
def map_model_names(spark, d):
    return _named(spark, d).select("run_id", "model_name")


_POINTS = f"""points AS (SELECT run_id, {_NAMED} AS model_name, unnest(range(1, len(train_loss) + 1)) AS step,
                                CAST(unnest(train_loss) AS DOUBLE) AS loss FROM loss_runs)"""


@query(
    "loss_curve_points",
    v.with_views("loss_runs", f", {_POINTS} SELECT run_id, CAST(step AS INTEGER) AS step, loss FROM points"),
)
def loss_curve_points(spark, d):
    return ex.loss_curve_points(v.loss_runs(spark, d), "train_loss", "run_id")


@query(
    "loss_curve_band",
    v.with_views(
        "loss_runs",
        f""", {_POINTS} SELECT model_name, CAST(step AS INTEGER) AS step, round(avg(loss), 9) AS mean,
                   round(quantile_cont(loss, 0.25), 9) AS q1, round(quantile_cont(loss, 0.75), 9) AS q3
            FROM points WHERE model_name IS NOT NULL GROUP BY ALL""",
    ),
)
def loss_curve_band(spark, d):
    band = ex.loss_curve_band(_named(spark, d), "model_name", "train_loss")
    return band.withColumns({c: F.round(c, 9) for c in ("mean", "q1", "q3")})
