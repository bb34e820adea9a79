"""Filters whose NULL behaviour or time window needs care.

``isin``, ``==``, ``!=`` and ``startswith`` drop NULL as SQL does and are used
directly where that is wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lotline.functions.clock import AsOf, business_day_start, days_before, time_literal


def differs_or_missing(value: Column, other: object) -> Column:
    """True unless ``value`` equals ``other``; a missing value counts as different."""
    return ~value.eqNullSafe(F.lit(other))


def filter_ne_keep_null(df: DataFrame, name: str, other: object) -> DataFrame:
    return df.filter(differs_or_missing(F.col(name), other))


def recent(ts: Column, as_of: AsOf, days: int, truncate: bool = False) -> Column:
    """``ts`` is at most ``days`` before ``as_of`` (or before its midnight)."""
    return ts >= time_literal(days_before(as_of, days, truncate))


def recent_business_days(ts: Column, as_of: AsOf, days: int) -> Column:
    """The business date of ``ts`` is at most ``days`` before the date of ``as_of``."""
    return ts >= time_literal(business_day_start(as_of, days))


def recent_rows(df: DataFrame, ts: str, as_of: AsOf, days: int, truncate: bool = False) -> DataFrame:
    return df.filter(recent(F.col(ts), as_of, days, truncate))


def closed_line_of_open_order(order_state: Column, line_state: Column, closed: int) -> Column:
    """The line is closed although its order is not; NULL as in SQL."""
    return (order_state != closed) & (line_state == closed)
