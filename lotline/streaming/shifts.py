"""Shift production kept up to date from a stream of picks.

Shifts start on whole hours, so sums per hour and lot hold all that the report needs;
business date, shift and hour follow from the start of the hour. Every batch stores the
sums of its own picks, and the report adds them up: sums of rounded quantities add
exactly, so picks may land late and in any order, and there is no state to keep.

The store keeps a part per batch and business date (``sources.parts``). A report reads the parts of its dates in
one scan; a date with many parts is folded into one, alone.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from lotline.functions import amounts, clock, codes
from lotline.operators.filters import recent_business_days
from lotline.operators.joins import Window
from lotline.plans.warehouse import COMPANY, production_rows
from lotline.sources.parts import Parts, append_batch, fold_slot, parts_of, read_parts

# Parts of a business date that are folded into one.
FOLD_PARTS = 64

HOURS_SCHEMA = "inicio timestamp, cd_carga {lot}, qt decimal(38,6), m3 decimal(38,15), dia date"


def _sums() -> list[Column]:
    return [F.sum("qt").cast("decimal(38,6)").alias("qt"), F.sum("m3").cast("decimal(38,15)").alias("m3")]


def hourly_production(
    picks: DataFrame,
    order_header: DataFrame,
    product: DataFrame,
    *,
    company: int = COMPANY,
    weight_by_qty: bool = False,
) -> DataFrame:
    """Quantity and volume by business date, hour and lot."""
    rows = production_rows(picks, order_header, product, company=company, weight_by_qty=weight_by_qty)
    hour = F.date_trunc("hour", "dt_separacao").alias("inicio")
    sums = rows.groupBy(hour, "cd_carga").agg(*_sums())
    return sums.withColumn("dia", clock.business_date(F.col("inicio")))


def batch_hours(
    batch: DataFrame,
    order_header: DataFrame,
    product: DataFrame,
    *,
    company: int = COMPANY,
    weight_by_qty: bool = False,
) -> DataFrame:
    """``hourly_production`` of a batch; the orders are cut in their scan to those of the batch."""
    headers = Window(batch, ["nu_pedido"]).cut(order_header, ["nu_pedido"])
    return hourly_production(batch, headers, product, company=company, weight_by_qty=weight_by_qty)


def _sum_up(hours: DataFrame) -> DataFrame:
    return hours.groupBy("inicio", "cd_carga", "dia").agg(*_sums()).select(*hours.columns)


def _fold(spark: SparkSession, path: str, state: Parts, least: int) -> int:
    """Fold every business date with ``least`` parts or more; returns their number."""
    days = [day for day, folders in state.slots().items() if len(folders) >= least]
    for day in days:
        state = fold_slot(spark, path, state, day, "dia", _sum_up)
    return len(days)


def store_hours(
    picks: DataFrame,
    order_header: DataFrame,
    product: DataFrame,
    path: str,
    checkpoint: str,
    *,
    company: int = COMPANY,
    weight_by_qty: bool = False,
    once: bool = False,
) -> StreamingQuery:
    """Store the hourly sums of each batch of the stream ``picks``.

    ``dt_separacao`` must be a TIMESTAMP. A repeated batch holds the same picks and is not
    stored again, as told by ``checkpoint``. Each batch reads ``order_header`` anew, cut in its scan to the orders of the
    batch. A business date is folded when it has ``FOLD_PARTS`` parts.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        hours = batch_hours(batch, order_header, product, company=company, weight_by_qty=weight_by_qty)
        state = append_batch(hours, path, "dia", checkpoint, batch_id)
        _fold(batch.sparkSession, path, state, FOLD_PARTS)

    writer = picks.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")
    return writer.start()


def compact_hours(spark: SparkSession, path: str) -> int:
    """Fold every business date with two parts or more; returns their number. Batches may land meanwhile."""
    return _fold(spark, path, parts_of(spark, path), 2)


def stored_shift_production(
    spark: SparkSession, path: str, *, as_of: clock.AsOf, window_days: int = 2, lot: str = "bigint"
) -> DataFrame:
    """Shift production from the stored sums; only the business dates shown are read. ``lot`` is the type of the lot."""
    first = clock.as_moment(as_of).date() - dt.timedelta(days=window_days + 1)
    hours = read_parts(spark, path, lambda day: day >= first.isoformat())
    if hours is None:
        hours = spark.createDataFrame([], HOURS_SCHEMA.format(lot=lot))
    hours = hours.filter(recent_business_days(F.col("inicio"), as_of, window_days))
    sums = hours.groupBy("inicio", "cd_carga").agg(*_sums())
    start = F.col("inicio")
    return sums.select(
        clock.iso_day_text(clock.business_date(start)).alias("dt_competencia"),
        "cd_carga",
        clock.shift_of_hour(F.hour(start)).alias("turno"),
        F.col("qt").alias("qt_separado"),
        amounts.truncate_number(F.col("m3")).alias("cubagem"),
        codes.pad2(F.hour(start)).alias("hora"),
    )
