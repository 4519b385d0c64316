"""Precondition checks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "DataFrame") -> None:
    """Raise ``KeyError`` naming every column of ``columns`` that ``df`` lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"{what} has no column named {', '.join(missing)}")
