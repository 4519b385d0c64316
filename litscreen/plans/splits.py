"""Queries on splits and folds of the labelled rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from litscreen.operators import splits as sp
from litscreen.plans import views as v
from litscreen.plans.registry import query

# SQL form: rank inside the class in hash order, quotas by largest remainder in integers
_RANKED = """ranked AS (SELECT doc_id, quality, toxic,
                     row_number() OVER (PARTITION BY quality ORDER BY md5('{seed}|' || doc_id), doc_id) AS rn,
                     row_number() OVER (ORDER BY md5('{seed}|' || doc_id), doc_id) AS rn_all FROM labels),
    counts AS (SELECT quality, count(*)::HUGEINT AS n FROM labels GROUP BY quality)"""


def _quotas(name: str, source: str, share: str) -> str:
    """Per class ``q`` rows out of ``n``: the total is the share of all rows, rounded up."""
    return f"""{name}_parts AS (SELECT quality, n, sum(n) OVER () AS total,
                       ceil({share} * sum(n) OVER ())::HUGEINT AS size FROM {source}),
    {name}_base AS (SELECT quality, n, size, n * size // total AS base,
                    row_number() OVER (ORDER BY n * size % total DESC, quality) AS nr FROM {name}_parts),
    {name} AS (SELECT quality, n, base + CASE WHEN nr <= size - sum(base) OVER () THEN 1 ELSE 0 END AS q
               FROM {name}_base)"""


def _folds(source: str) -> str:
    """Cumulated rows per class and fold; ``source`` holds quality and n."""
    return f"""starts AS (SELECT quality, n, sum(n) OVER (ORDER BY quality) - n AS start FROM {source}),
    dealt AS (SELECT quality, i AS fold, (start + n - i + 4) // 5 - (start - i + 4) // 5 AS part
              FROM starts, range(5) AS t(i)),
    upto AS (SELECT quality, fold, sum(part) OVER (PARTITION BY quality ORDER BY fold) AS upto FROM dealt)"""


def _labels(spark, d):
    return v.table(spark, d, "labels")


@query(
    "stratified_split",
    f"""WITH {_RANKED.format(seed=42)}, {_quotas('test', 'counts', '0.2')}
        SELECT doc_id, quality, CASE WHEN rn <= q THEN 'test' ELSE 'train' END AS split
        FROM ranked JOIN test USING (quality)""",
)
def stratified_split(spark, d):
    return sp.stratified_split(_labels(spark, d), "quality", "doc_id").select("doc_id", "quality", "split")


@query(
    "stratified_split_many",
    """WITH ranked AS (SELECT o_orderkey, o_orderkey // 7 AS class,
                   row_number() OVER (PARTITION BY o_orderkey // 7 ORDER BY md5('42|' || o_orderkey), o_orderkey) AS rn
                   FROM orders),
        sizes AS (SELECT class, count(*)::HUGEINT AS n, sum(count(*)) OVER ()::HUGEINT AS total FROM ranked GROUP BY class),
        parts AS (SELECT class, n, total, ceil(0.2 * total)::HUGEINT AS size FROM sizes),
        base AS (SELECT class, size, n * size // total AS base,
                        row_number() OVER (ORDER BY n * size % total DESC, class) AS nr FROM parts),
        quotas AS (SELECT class, base + CASE WHEN nr <= size - sum(base) OVER () THEN 1 ELSE 0 END AS q FROM base)
        SELECT o_orderkey, CASE WHEN rn <= q THEN 'test' ELSE 'train' END AS split FROM ranked JOIN quotas USING (class)""",
)
def stratified_split_many(spark, d):
    """Thousands of classes of seven rows."""
    orders = v.table(spark, d, "orders").select("o_orderkey", F.floor(F.col("o_orderkey") / 7).alias("class"))
    return sp.stratified_split(orders, "class", "o_orderkey").select("o_orderkey", "split")


@query(
    "random_split",
    f"""WITH {_RANKED.format(seed=42)}
        SELECT doc_id, CASE WHEN rn_all <= (SELECT ceil(0.2 * count(*)) FROM labels) THEN 'test' ELSE 'train' END AS split
        FROM ranked""",
)
def random_split(spark, d):
    return sp.random_split(_labels(spark, d), "doc_id").select("doc_id", "split")


_KFOLD = f"""WITH {_RANKED.format(seed=1)}, {_folds('counts')},
    folds AS (SELECT doc_id, quality, CAST(count(*) FILTER (WHERE upto < rn) AS INTEGER) AS fold
              FROM ranked JOIN upto USING (quality) GROUP BY doc_id, quality, rn)"""


def _kfold(spark, d):
    return sp.stratified_kfold(_labels(spark, d), "quality", "doc_id", 5, seed=1)


@query("stratified_kfold", f"{_KFOLD} SELECT doc_id, quality, fold FROM folds")
def stratified_kfold(spark, d):
    return _kfold(spark, d).select("doc_id", "quality", "fold")


@query(
    "fold_views",
    f"""{_KFOLD} SELECT doc_id, CAST(i AS INTEGER) AS view, CASE WHEN fold = i THEN 'test' ELSE 'train' END AS part
        FROM folds, range(5) AS t(i)""",
)
def fold_views(spark, d):
    return sp.fold_views(_kfold(spark, d), 5).select("doc_id", "view", "part")


_THREE = f"""WITH {_RANKED.format(seed=42)}, {_quotas('rest', 'counts', '0.3')},
    rest_counts AS (SELECT quality, q AS n FROM rest), {_quotas('test', 'rest_counts', '0.5')},
    split AS (SELECT doc_id, quality,
                     CASE WHEN rn <= test.q THEN 'test' WHEN rn <= rest.q THEN 'val' ELSE 'train' END AS split
              FROM ranked JOIN rest USING (quality) JOIN test USING (quality))"""


@query("three_way_split", f"{_THREE} SELECT doc_id, quality, split FROM split")
def three_way_split(spark, d):
    return sp.split_data(_labels(spark, d), "train_test", "quality", "doc_id").select("doc_id", "quality", "split")


@query("split_sizes", f"{_THREE} SELECT split, quality, count(*) AS n FROM split GROUP BY ALL")
def split_sizes(spark, d):
    return sp.split_sizes(sp.three_way_split(_labels(spark, d), "quality", "doc_id"), "split", "quality")


@query(
    "holdout_then_kfold",
    f"""WITH {_RANKED.format(seed=1)}, {_quotas('test', 'counts', '0.15')},
        rest AS (SELECT quality, n - q AS n FROM test), {_folds('rest')}
        SELECT doc_id, quality, CASE WHEN rn <= q THEN 'test' ELSE 'cv' END AS split,
               CASE WHEN rn > q THEN CAST(count(*) FILTER (WHERE upto < rn - q) AS INTEGER) END AS fold
        FROM ranked JOIN test USING (quality) JOIN upto USING (quality) GROUP BY doc_id, quality, rn, q""",
)
def holdout_then_kfold(spark, d):
    return sp.split_data(_labels(spark, d), "cv", "quality", "doc_id", seed=1).select(
        "doc_id", "quality", "split", "fold"
    )
