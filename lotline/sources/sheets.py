"""Spreadsheet-like CSV inputs: ranges without header, headed ranges and KPI cells."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from lotline.functions.display import text_export
from lotline.sources.records import read_records

# One dialect for all cells: quotes inside a quoted cell are doubled.
DIALECT = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def _cells(
    spark: SparkSession,
    path: str,
    *,
    header: bool,
    schema: str | None = None,
    infer: bool = False,
    multi_line: bool = True,
    split: bool = False,
) -> DataFrame:
    """Cells with doubled quotes. Cells may hold line breaks, for which a file is read in one
    piece; with ``split`` many tasks find its records (``sources.records``). Without ``multi_line`` large files are
    split too and a torn row fails."""
    if split and multi_line:
        return read_records(spark, path, DIALECT, header=header, schema=schema, infer=infer)
    reader = spark.read.options(**DIALECT).option("multiLine", multi_line).option("header", header)
    if not multi_line:
        reader = reader.option("mode", "FAILFAST")
    return reader.csv(path, schema=schema, inferSchema=infer, enforceSchema=True)


def read_positional(
    spark: SparkSession, path: str, names: Sequence[str], *, multi_line: bool = True, split: bool = False
) -> DataFrame:
    """Cells without a header row, as text under the given names; a blank is ``''``."""
    schema = ", ".join(f"`{name}` string" for name in names)
    cells = _cells(spark, path, header=False, schema=schema, multi_line=multi_line, split=split)
    return text_export(cells, null_text="")


def read_headed(
    spark: SparkSession, path: str, n_cols: int | None = None, *, multi_line: bool = True, split: bool = False
) -> DataFrame:
    """Cells as text under the names of the header row, first ``n_cols`` columns; a blank is ``''``."""
    cells = _cells(spark, path, header=True, multi_line=multi_line, split=split)
    return text_export(cells.select(*(f"`{name}`" for name in cells.columns[:n_cols])), null_text="")


def read_csv_fill(
    spark: SparkSession, path: str, schema: str | None = None, *, multi_line: bool = True, split: bool = False
) -> DataFrame:
    """Headed CSV as text with blanks as ``''``.

    Types come from ``schema``, or are inferred by one more pass over the file. ``split`` reads a large file by many tasks.
    """
    typed = _cells(spark, path, header=True, schema=schema, infer=not schema, multi_line=multi_line, split=split)
    return text_export(typed, null_text="")


def select_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Pick columns by name; ``names`` is ``{new: old}``."""
    return df.select(*(F.col(f"`{old}`").alias(new) for new, old in names.items()))


def read_lookups(
    spark: SparkSession, path: str, tabs: Sequence[str] = ("modes", "branches", "cities"), fmt: str = "parquet"
) -> dict[str, DataFrame]:
    """The lookup tabs below ``path``, every column as text."""
    options = {"header": True} if fmt == "csv" else {}
    return {tab: text_export(spark.read.load(f"{path}/{tab}", format=fmt, **options)) for tab in tabs}


def kpi_block(cells: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row with a column per name from ``(pos, value)`` cells; ``pos`` counts from 0."""
    picked = (
        F.max(F.when(F.col("pos") == pos, F.col("value"))).alias(name) for pos, name in enumerate(names)
    )
    return cells.agg(*picked)
