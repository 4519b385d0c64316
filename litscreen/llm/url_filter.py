"""URL filter: host and path rules, then a weighted vocabulary.

A rule fits its host and all subdomains if the URL's path starts with the
rule's; the longest decides. A URL without a rule is scored: one pass of an
Aho-Corasick automaton counts the terms that stand between boundaries. A strict
term weighs as much as the limit, a soft term 1 (each counted once), and a URL
at or above the limit is blocked.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litscreen.llm.common import ascii_lower, table


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


# The rules of the query.
RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)
STRICT = ("casino", "porn", "viagra", "xxx")
SOFT = (
    "ads", "bet", "bets", "bonus", "cheap", "click", "dating", "farm", "free", "loan", "loans", "pills", "poker",
    "prize", "spam", "track", "win", "winner",
)
SOFT_HITS = 2


def url_host(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct ``rule, verdict`` of the longest rule that fits, null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.host + r.path), r)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        named = F.struct(F.lit(rule.host + rule.path).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        found = F.when(fits, named).otherwise(found)
    return found


def term_weight(strict: Sequence[str], soft: Sequence[str], soft_hits: int):
    """Pandas function: weight of the distinct terms in each URL.

    Terms are lower-case; before and after a hit no ASCII letter or digit may stand.
    """
    weights = {**dict.fromkeys(soft, 1), **dict.fromkeys(strict, soft_hits)}

    @F.pandas_udf("long")
    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        inside = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
        machine = ahocorasick.Automaton()
        for term, weight in weights.items():
            machine.add_word(term, (term, weight))
        machine.make_automaton()

        def total(url: str | None) -> int:
            if not url:
                return 0
            url = f" {url} "
            hits = set()
            for end, (term, weight) in machine.iter(url):
                if url[end + 1] not in inside and url[end - len(term)] not in inside:
                    hits.add((term, weight))
            return sum(weight for _, weight in hits)

        for urls in batches:
            yield urls.map(total, na_action=None).astype("int64")

    return weigh


def judge_urls(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: Sequence[Rule] = RULES,
    strict: Sequence[str] = STRICT,
    soft: Sequence[str] = SOFT,
    soft_hits: int = SOFT_HITS,
) -> DataFrame:
    """``id, host, path, rule, verdict, weight`` of every page, row by row.

    A null URL has weight 0 and is allowed. Repeated rows are judged alike;
    other columns are left out. ``weight`` is null where a rule decided.
    """
    url = F.col("_url")
    parts = pages.select(F.col(id_col).alias(id_col), F.col(url_col).alias("_url")).select(
        id_col, "_url", url_host(url).alias("host"), url_path(url).alias("path")
    )
    ruled = parts.withColumn("_rule", longest_rule(F.col("host"), F.col("path"), rules))
    weighed = ruled.withColumn("_weight", term_weight(strict, soft, soft_hits)(ascii_lower(url)))
    by_weight = F.when(F.col("_weight") >= soft_hits, "block").otherwise("allow")
    return weighed.select(
        id_col,
        "host",
        "path",
        F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), by_weight).alias("verdict"),
        F.when(F.col("_rule").isNull(), F.col("_weight")).alias("weight"),
    )


def op6_url_filter(spark, sf_dir):
    return judge_urls(table(spark, sf_dir, "pages"))


def _oracle() -> str:
    def fits(rule: Rule) -> str:
        return (
            f"(host = '{rule.host}' OR ends_with(host, '.{rule.host}')) AND starts_with(path, '{rule.path}')"
        )

    ordered = sorted(RULES, key=lambda r: (len(r.host + r.path), r), reverse=True)
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r.host}{r.path}'" for r in ordered) + " END"
    verdict = "CASE " + " ".join(f"WHEN rule = '{r.host}{r.path}' THEN '{r.verdict}'" for r in ordered)
    weights = [(t, SOFT_HITS) for t in STRICT] + [(t, 1) for t in SOFT]
    weight = " + ".join(
        f"{w} * CAST(regexp_matches(low, '(^|[^a-z0-9]){t}($|[^a-z0-9])') AS INTEGER)" for t, w in weights
    )
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
        WITH parts AS (
            SELECT page_id, {lower.format("coalesce(url, '')")} AS low,
                   {lower.format("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} AS host,
                   coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages),
        ruled AS (SELECT *, {rule} AS rule, CAST({weight} AS BIGINT) AS total FROM parts)
        SELECT page_id, host, path, rule,
               {verdict} WHEN total >= {SOFT_HITS} THEN 'block' ELSE 'allow' END AS verdict,
               CASE WHEN rule IS NULL THEN total END AS weight
        FROM ruled"""


ORACLE_SQL = _oracle()
