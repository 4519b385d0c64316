"""Delimited text files, list cells in text form, id lists."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litscreen.operators.aggregates import duplicate_count
from litscreen.operators.checks import require_columns
from litscreen.sources.records import quoted_records

# Texts that stand for a missing value in a delimited file.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# File extensions that mean TAB; every other one means comma.
TAB_EXTENSIONS = (".tsv", ".txt")

_QUOTING = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def _separator(path: str) -> str:
    return "\t" if path.lower().endswith(TAB_EXTENSIONS) else ","


def read_delimited(
    spark: SparkSession, path: str, schema: str | None = None, multi_line: bool = True, one_task: bool = False
) -> DataFrame:
    """Read a delimited file (or a folder of them) with header.

    Without ``schema`` every column is read as string. A large file is split
    among many tasks. With ``multi_line`` quoted values may hold line breaks,
    see :func:`quoted_records`; without it a record is a line. A file with
    quotes inside unquoted values needs ``one_task``, which parses each file whole.
    """
    options = dict(sep=_separator(path), multiLine=multi_line, **_QUOTING)
    reader = spark.read.options(**options)
    whole = (reader.schema(schema) if schema else reader).csv(path)
    if multi_line and not one_task:
        given = {name: str(value).lower() if isinstance(value, bool) else value for name, value in options.items()}
        parsed = F.from_csv("record", whole.schema.toDDL(), given | {"header": "false"})
        whole = quoted_records(spark, path).select(parsed.alias("_row")).select("_row.*")
    texts = {name for name, kind in whole.dtypes if kind == "string"}
    return whole.select(
        *[
            F.when(~F.col(f"`{c}`").isin(NA_TOKENS), F.col(f"`{c}`")).alias(c) if c in texts else F.col(f"`{c}`")
            for c in whole.columns
        ]
    )


def read_csv_index(
    spark: SparkSession, path: str, schema: str | None = None, multi_line: bool = True
) -> DataFrame:
    """Read a file whose first column is a saved row index and leave that column out."""
    df = read_delimited(spark, path, schema, multi_line)
    return df.drop(df.columns[0])


def write_delimited(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write with header; list columns are stored as JSON text."""
    lists = {name for name, kind in df.dtypes if kind.startswith("array")}
    plain = df.select(*[F.to_json(f"`{c}`").alias(c) if c in lists else F.col(f"`{c}`") for c in df.columns])
    plain.write.mode(mode).options(sep=_separator(path), **_QUOTING).csv(path)


def load_id_list(df: DataFrame, column: str, warn: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(ids, duplicates)``: the non-null values of a column as text, and how many repeat.

    ``warn=True`` runs the count at once and warns about duplicates or an empty list.
    """
    require_columns(df, [column])
    ids = df.select(F.col(column).cast("string").alias("id")).where("id is not null")
    duplicates = duplicate_count(ids, "id")
    if warn:
        found = duplicates.first()
        if found["n_values"] == 0:
            warnings.warn("The list of ids is empty.")
        elif found["n_duplicates"]:
            warnings.warn(f"Found {found['n_duplicates']} duplicate id(s) in column '{column}'.")
    return ids, duplicates


# A member of a list literal: a quoted text or a bare word or number.
_MEMBER = r"""'(?:[^'\\]|\\.)*+'|"(?:[^"\\]|\\.)*+"|[^\s,\[\]'"]++"""
# Bare words and what they are in JSON.
_BARE = {"None": "null", "nan": "NaN", "inf": "Infinity", "-inf": "-Infinity", "True": "true", "False": "false"}


def _json_member(member: Column) -> Column:
    """A quoted member as a JSON text (``\\xHH`` and ``\\'`` are no JSON escapes), a bare one in JSON's words."""
    inner = F.substring(member, F.lit(2), F.length(member) - 2)
    plain = F.replace(inner, F.lit("\\\\"), F.lit("\ue000"))  # escaped backslashes out of the way
    plain = F.regexp_replace(plain, r"\\x([0-9a-fA-F]{2})", r"\\u00$1")
    plain = F.replace(F.replace(plain, F.lit("\\'"), F.lit("'")), F.lit('\\"'), F.lit('"'))
    plain = F.replace(F.replace(plain, F.lit('"'), F.lit('\\"')), F.lit("\ue000"), F.lit("\\\\"))
    bare = member
    for word, json in _BARE.items():
        bare = F.when(member == word, json).otherwise(bare)
    return F.when(member.rlike("^['\"]"), F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(bare)


def decode_list_literal(col: Column, element: str = "string") -> Column:
    """A list written as text (quotes of either kind, ``None``, ``nan``, ``inf``, escapes) as an array; NULL if it is none."""
    shape = F.regexp_replace(F.regexp_replace(col, _MEMBER, "x"), r"\s+", "")
    is_list = F.replace(shape, F.lit(",x"), F.lit("")).isin("[]", "[x]", "[x,]")
    members = F.transform(F.regexp_extract_all(col, F.lit(_MEMBER), F.lit(0)), _json_member)
    json = F.concat(F.lit("["), F.array_join(members, ","), F.lit("]"))
    return F.when(is_list, F.from_json(json, f"array<{element}>"))


def decode_lists(df: DataFrame, column: str, output: str, element: str = "string") -> tuple[DataFrame, DataFrame]:
    """``(decoded, rejects)``: rows with their list in ``output``, and rows whose text is no list.

    A NULL text is no reject: its list is NULL.
    """
    require_columns(df, [column])
    decoded = df.withColumn(output, decode_list_literal(F.col(column), element))
    failed = F.col(column).isNotNull() & F.col(output).isNull()
    return decoded.where(~failed), decoded.where(failed).drop(output)
