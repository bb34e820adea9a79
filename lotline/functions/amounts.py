"""Exact decimal arithmetic for quantities, volumes and money."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

QUANTITY = "decimal(18,6)"
VOLUME = "decimal(20,9)"

# Fixed value: cubic centimetres to cubic metres.
M3_PER_CM3 = Decimal("0.000001")


def unit_volume(height: Column, width: Column, depth: Column) -> Column:
    """Volume in m3 of one piece measured in cm, kept to the cubic millimetre.

    The casts keep every intermediate within 38 digits, so Spark never rounds
    before the last step.
    """
    sides = [side.cast("decimal(12,4)") for side in (height, width, depth)]
    cm3 = (sides[0] * sides[1] * sides[2]).cast("decimal(26,6)")
    return (cm3 * F.lit(M3_PER_CM3)).cast(VOLUME)


def zero_if_null(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def line_amount(qty: Column, each: Column) -> Column:
    """Quantity times price or unit volume."""
    return qty * each


def truncate_number(value: Column, places: int = 2) -> Column:
    """Cut toward zero at ``places`` digits."""
    digits = F.lit(places)
    return F.when(value < 0, F.ceil(value, digits)).otherwise(F.floor(value, digits))


def round_number(value: Column, places: int = 0) -> Column:
    """Round half away from zero."""
    return F.round(value, places)


def parse_decimal_comma(text: Column, dtype: str = QUANTITY) -> Column:
    """``'12,5'`` as 12.5; text that is no number gives NULL."""
    return F.trim(F.replace(text, F.lit(","), F.lit("."))).try_cast(dtype)


def bad_decimal_rows(df: DataFrame, names: list[str]) -> DataFrame:
    """One row with, per column, how many filled cells are not numbers."""
    return df.agg(
        *(
            F.count_if(F.col(n).isNotNull() & parse_decimal_comma(F.col(n)).isNull()).alias(n)
            for n in names
        )
    )
