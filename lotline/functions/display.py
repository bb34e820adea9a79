"""Numbers as Brazilian Portuguese text, always kept beside the numeric column."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

SUFFIX = "_texto"


def volume_text(value: Column) -> Column:
    """Six decimals with a decimal comma, no grouping."""
    return F.replace(value.cast("decimal(38,6)").cast("string"), F.lit("."), F.lit(","))


def fmt_ptbr(value: Column, kind: str, places: int = 0) -> Column:
    """``1.234.567`` (NORMAL), ``1.234,5`` (CUBAGEM), ``12,5%`` (PORCENTAGEM), ``R$ 1.234`` (REAL).

    NORMAL always shows no decimals and CUBAGEM always one; ``places`` applies to
    the other two.
    """
    number = value.cast("double")
    if kind == "NORMAL":
        return F.translate(F.format_number(number, 0), ",.", ".,")
    if kind == "CUBAGEM":
        return F.translate(F.format_number(number, 1), ",.", ".,")
    if kind == "PORCENTAGEM":
        return F.concat(F.translate(F.format_number(number * 100, places), ".,", ","), F.lit("%"))
    if kind == "REAL":
        return F.concat(F.lit("R$ "), F.translate(F.format_number(number, places), ",.", ".,"))
    raise ValueError(f"unknown number style: {kind}")


def with_display(df: DataFrame, styles: Mapping[str, str]) -> DataFrame:
    """Add ``<name>_texto`` for each ``{name: style}``."""
    return df.withColumns({name + SUFFIX: fmt_ptbr(F.col(name), kind) for name, kind in styles.items()})


def text_export(df: DataFrame, null_text: str | None = None) -> DataFrame:
    """Every column as text; NULL stays NULL unless ``null_text`` is given."""
    texts = (F.col(f"`{name}`").cast("string") for name in df.columns)
    if null_text is not None:
        texts = (F.coalesce(text, F.lit(null_text)) for text in texts)
    return df.select(*(text.alias(name) for text, name in zip(texts, df.columns)))
