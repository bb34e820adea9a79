"""Aggregations with the totals and pivots the report pages show."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lotline.operators.joins import spread

TOTAL = "Total"


def group_sums(df: DataFrame, key: str, measures: Mapping[str, str]) -> DataFrame:
    """Sum columns by one key; ``measures`` is ``{result name: column}``."""
    return df.groupBy(key).agg(*(F.sum(col).alias(name) for name, col in measures.items()))


def distinct_counts(df: DataFrame, key: str, counted: str, name: str, measures: Mapping[str, str]) -> DataFrame:
    """Number of different values of ``counted`` (NULL is none) and sums, by ``key``.

    Each pair of both is summed up first. A count of distinct values would hold three tables of pairs in one
    task, beside the rows of a join before it; here the pairs are ``spread``, so that a task holds the tables
    of its few pairs only.
    """
    rows = df.select(key, counted, *dict.fromkeys(col for col in measures.values() if col not in (key, counted)))
    pairs = spread(rows, [key, counted]).groupBy(key, counted)
    pairs = pairs.agg(*(F.sum(col).alias(f"_{m}") for m, col in measures.items()))
    return pairs.groupBy(key).agg(F.count(counted).alias(name), *(F.sum(f"_{m}").alias(m) for m in measures))


def conditional_sum(condition: Column, value: Column) -> Column:
    """Sum of ``value`` where the condition holds, 0 elsewhere."""
    return F.sum(F.when(condition, value).otherwise(0))


def flag_count(condition: Column) -> Column:
    return F.count_if(condition)


def total_row(shown: DataFrame, key: str, measures: Sequence[str], label: str = TOTAL) -> DataFrame:
    """Rows of ``shown`` ordered by key, then one row with the sums of its measures.

    ``shown`` has one row per key. The roll-up reads it once; ``grouping`` tells the
    total from a group whose key is NULL.
    """
    rolled = shown.rollup(key).agg(
        F.grouping(key).alias("_total"), *(F.sum(name).alias(name) for name in measures)
    )
    name = F.when(F.col("_total") == 1, label).otherwise(F.col(key).cast("string"))
    return rolled.orderBy("_total", key).select(name.alias(key), *measures)


def pivot_sum(df: DataFrame, index: str, columns: str, value: str, shown: Sequence[str]) -> DataFrame:
    """Sums of ``value`` by index, one column per entry of ``shown``, 0 where empty.

    Rows without index or category are left out.
    """
    known = df.filter(F.col(index).isNotNull() & F.col(columns).isNotNull())
    table = known.groupBy(index).pivot(columns, list(shown)).agg(F.sum(value))
    return table.select(index, *(F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c) for c in shown))


def pivot_margin(table: DataFrame, index: str, shown: Sequence[str], label: str = TOTAL) -> DataFrame:
    """Add the row total and order by it, largest first."""
    margin = sum((F.col(f"`{c}`") for c in shown[1:]), F.col(f"`{shown[0]}`"))
    return table.withColumn(label, margin).orderBy(F.desc(label), index)
