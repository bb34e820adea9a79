"""Refresh of a published report whenever new rows have landed, as a whole or by the keys they touch."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from lotline.operators.joins import Window
from lotline.sources.parts import parts_of, read_parts, replace_keys
from lotline.sources.snapshots import write_snapshot

# Fixed value: pause between refreshes.
REFRESH = "300 seconds"
# Parts of a report that is kept by keys.
SLOTS = 256


def refresh_on_arrival(
    arrivals: DataFrame,
    rebuild: Callable[[SparkSession], DataFrame],
    target: str,
    checkpoint: str,
    *,
    once: bool = False,
    fmt: str = "parquet",
) -> StreamingQuery:
    """Rebuild the report and replace its snapshot for each batch of arrived rows.

    ``rebuild`` reads the whole landed tables; a repeated batch writes the same
    result again. ``once=True`` handles what is there and stops.
    """

    def publish(batch: DataFrame, batch_id: int) -> None:
        write_snapshot(rebuild(batch.sparkSession), target, fmt=fmt)

    writer = arrivals.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=REFRESH)
    return writer.start()


def of_keys(table: DataFrame, changed: DataFrame | None, names: Mapping[str, str]) -> DataFrame:
    """Rows of ``table`` whose keys are in ``changed`` (all rows when that is None); ``names`` is ``{column: key}``.

    The bit set of the keys cuts the table in its scan; the exact semi join meets what is left.
    """
    if changed is None:
        return table
    keys = changed.select(*(F.col(f"`{key}`").alias(column) for column, key in names.items()))
    return Window(keys, list(names)).cut(table, list(names)).join(keys.distinct(), list(names), "left_semi")


def maintain_on_arrival(
    arrivals: DataFrame,
    touched: Callable[[DataFrame], DataFrame],
    rebuild: Callable[[SparkSession, DataFrame | None], DataFrame],
    target: str,
    checkpoint: str,
    *,
    slots: int = SLOTS,
    once: bool = False,
) -> StreamingQuery:
    """Keep a report by the keys that each batch of arrived rows touches.

    ``touched(batch)`` gives the keys of the report rows that the batch may change, under their
    names in the report; ``rebuild(spark, changed)`` gives the report of those keys, and of all when ``changed`` is
    None, as for the first batch. The stored report is dealt into ``slots`` parts by its keys; only parts of touched keys
    are read and written, and a batch shows as a whole. A repeated batch changes nothing. Rows that change
    by time alone are touched by no arrival: add their keys in ``touched``.
    """

    def publish(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        changed = touched(batch).distinct()
        keys = changed.columns
        slot = F.pmod(F.xxhash64(*(F.col(f"`{key}`").cast("string") for key in keys)), F.lit(slots)).alias("_of")
        if not parts_of(spark, target).schema:
            replace_keys(rebuild(spark, None).select("*", slot), None, target, "_of", checkpoint, batch_id)
            return
        changed = changed.persist()
        try:
            rows = rebuild(spark, changed)
            replace_keys(rows.select("*", slot), changed.select("*", slot), target, "_of", checkpoint, batch_id)
        finally:
            changed.unpersist()

    writer = arrivals.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=REFRESH)
    return writer.start()


def maintained(spark: SparkSession, target: str) -> DataFrame:
    """The report kept by ``maintain_on_arrival``; raises before its first batch."""
    rows = read_parts(spark, target)
    if rows is None:
        raise FileNotFoundError(f"no report at {target}")
    return rows.drop("_of")
