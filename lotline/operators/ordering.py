"""Top-k operators; every order ends in a key, so ties are settled the same way each time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def top_rows(df: DataFrame, measures: Sequence[str], key: str, n: int) -> DataFrame:
    """The ``n`` rows with the largest measures; one bounded heap per task."""
    return df.orderBy(*(F.desc(name) for name in measures), key).limit(n)


def first_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` rows with the smallest keys."""
    return df.orderBy(key).limit(n)


def top_categories(df: DataFrame, category: str, measure: str, n: int) -> list[str]:
    """Names of the ``n`` categories with the largest sums, largest first."""
    sums = df.filter(F.col(category).isNotNull()).groupBy(category).agg(F.sum(measure).alias("_sum"))
    return [row[0] for row in top_rows(sums, ["_sum"], category, n).select(category).collect()]


def head_then_sort(df: DataFrame, key: str, n: int, sort_by: str) -> DataFrame:
    """First ``n`` rows by key, then ordered by ``sort_by`` when that column exists."""
    head = first_rows(df, key, n)
    if sort_by not in df.columns:
        return head
    return head.orderBy(F.desc(f"`{sort_by}`"), key)
