"""Time rules: windows, business days, shifts, ages and the latest of three dates.

No expression reads the wall clock. The caller passes ``as_of``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

# The business day starts at 06:00; shifts are given by their hours.
DAY_START_HOUR = 6
SHIFT_1_HOURS = (6, 13)
SHIFT_2_HOURS = (14, 21)
SHIFT_1, SHIFT_2, SHIFT_3 = "1 TURNO", "2 TURNO", "3 TURNO"

AsOf = dt.datetime | dt.date | str


def as_moment(as_of: AsOf) -> dt.datetime:
    """Any accepted form of ``as_of`` as a datetime (a plain date is its midnight)."""
    if isinstance(as_of, str):
        return dt.datetime.fromisoformat(as_of)
    if isinstance(as_of, dt.datetime):
        return as_of
    return dt.datetime.combine(as_of, dt.time())


def time_literal(moment: dt.datetime) -> Column:
    """Text literal that Spark folds to the type of the column it is compared with.

    The column itself stays uncast, so the comparison reaches the scan for
    TIMESTAMP and TIMESTAMP_NTZ columns alike.
    """
    return F.lit(moment.isoformat(sep=" "))


def days_before(as_of: AsOf, days: int, truncate: bool = False) -> dt.datetime:
    """The moment ``days`` before ``as_of``, optionally at midnight."""
    start = as_moment(as_of) - dt.timedelta(days=days)
    return dt.datetime.combine(start.date(), dt.time()) if truncate else start


def business_day_start(as_of: AsOf, days: int) -> dt.datetime:
    """First instant whose business date is ``days`` before the date of ``as_of``.

    ``business_date(ts) >= d`` holds exactly when ``ts >= d 06:00``, so a window on
    the derived date becomes a plain range that parquet and JDBC can prune by.
    """
    return days_before(as_of, days, truncate=True) + dt.timedelta(hours=DAY_START_HOUR)


def business_date(ts: Column) -> Column:
    """Date of the shift day: hours 0-5 belong to the day before."""
    day = F.to_date(ts)
    return F.when(F.hour(ts) < DAY_START_HOUR, F.date_sub(day, 1)).otherwise(day)


def shift_of_hour(hour: Column) -> Column:
    """Shift label of an hour 0-23; NULL stays NULL."""
    return (
        F.when(hour.between(*SHIFT_1_HOURS), SHIFT_1)
        .when(hour.between(*SHIFT_2_HOURS), SHIFT_2)
        .when(hour.isNotNull(), SHIFT_3)
    )


def age_days(as_of: AsOf, ts: Column) -> Column:
    """Whole days from the date of ``ts`` to the date of ``as_of``."""
    return F.datediff(F.lit(as_moment(as_of).date()), F.to_date(ts))


def to_second(ts: Column) -> Column:
    """``ts`` without fractions of a second."""
    return F.substring(ts.cast("string"), 1, 19).cast("timestamp_ntz")


def text_to_time(text: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Timestamp read from text; text that does not fit gives NULL."""
    return F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz")


def latest_of(a: Column, b: Column, c: Column) -> Column:
    """Latest of three dates when at most one is missing, else NULL."""
    missing = sum((x.isNull().cast("int") for x in (b, c)), a.isNull().cast("int"))
    return F.when(missing <= 1, F.greatest(a, b, c))


# Text comes from the cast to ``yyyy-MM-dd HH:mm:ss``. For a TIMESTAMP_NTZ that cast
# knows no zone, whereas ``date_format`` would move times that a clock change skips.


def _cut(ts: Column, start: int, length: int) -> Column:
    return F.substring(ts.cast("string"), start, length)


def iso_day_text(ts: Column) -> Column:
    return _cut(ts, 1, 10)


def hour_text(ts: Column) -> Column:
    return _cut(ts, 12, 2)


def clock_text(ts: Column) -> Column:
    return _cut(ts, 12, 8)


def day_text(ts: Column) -> Column:
    """``dd/MM/yyyy``"""
    slash = F.lit("/")
    return F.concat(_cut(ts, 9, 2), slash, _cut(ts, 6, 2), slash, _cut(ts, 1, 4))


def minute_text(ts: Column) -> Column:
    """``dd/MM/yyyy HH:mm``"""
    return F.concat(day_text(ts), F.lit(" "), _cut(ts, 12, 5))


def second_text(ts: Column) -> Column:
    """``dd/MM/yyyy HH:mm:ss``"""
    return F.concat(day_text(ts), F.lit(" "), clock_text(ts))
