"""Register of checked queries: a Spark function and its SQL under one key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from checks.views import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
BUILDERS: dict[str, Callable[[Views], DataFrame]] = {}
SQL: dict[str, str] = {}

# SQL of reports that other checks build on, by name.
SHARED: dict[str, str] = {}


def comparable(df: DataFrame) -> DataFrame:
    """Same values in the types both engines share: bigint, double, boolean and text."""

    def plain(field: T.StructField):
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            col = F.round(col, 6).cast("double")
        elif isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            col = col.cast("bigint")
        elif isinstance(field.dataType, T.FloatType):
            col = col.cast("double")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            col = F.substring(col.cast("string"), 1, 19)
        elif isinstance(field.dataType, T.DateType):
            col = col.cast("string")
        return col.alias(field.name)

    return df.select(*(plain(field) for field in df.schema.fields))


def check(key: str, sql: str | None = None):
    """Register the decorated ``views -> DataFrame`` under ``key``."""

    def register(build: Callable[[Views], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        BUILDERS[key] = build
        QUERIES[key] = lambda spark, sf_dir: comparable(build(Views(spark, sf_dir)))
        if sql is not None:
            SQL[key] = sql
        return build

    return register


def oracle_texts() -> dict[str, str]:
    return {key: with_views(sql, SHARED) for key, sql in SQL.items()}


def n6(expr: str) -> str:
    """Number with six digits as double."""
    return f"cast(round({expr}, 6) as double)"


def i8(expr: str) -> str:
    return f"cast({expr} as bigint)"


def at(expr: str) -> str:
    """Timestamp as text to the second."""
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


def day(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d')"
