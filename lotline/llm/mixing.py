"""Mixing sources to target weights by Pfair scheduling.

The stream has one slot per block of documents. Block ``i`` of a source of weight ``w``
is released at slot ``floor(i / w)`` and due by slot ``ceil((i + 1) / w)``; in each slot
the released block with the earliest deadline goes first. The weights fill the stream,
so every deadline is met, and before a source runs out its blocks among the first ``t``
slots differ from ``t * w`` by less than one. With whole weights per period the schedule
repeats, so one period of slots, fixed by the weights alone, places the blocks of any
amount of data by joins. When a source has no block left, its slots stay empty.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

REST = "*"  # all sources that no weight names, and rows without source
BLOCK_DOCS = 8
# Documents per cell and cells per group of cells, when the rows of a source are numbered.
CELL_ROWS = 256
GROUP_CELLS = 512
# Key of the schedule in the metadata of the source column.
SCHEDULE = "mixing"


def period(weights: Mapping[str, int]) -> list[tuple[str, int, int]]:
    """``(source, block, slot)`` of one period of ``sum(weights)`` slots, earliest deadline first.

    Ties go to the name. A weight is the number of blocks per period, at least 1.
    """
    if min(weights.values(), default=0) < 1:
        raise ValueError("every weight must be a whole number of blocks per period")
    slots = sum(weights.values())
    done = dict.fromkeys(sorted(weights), 0)
    plan = []
    for slot in range(slots):
        _, source = min(
            (-(-(i + 1) * slots // weights[name]), name) for name, i in done.items() if i * slots // weights[name] <= slot
        )
        plan.append((source, done[source], slot))
        done[source] += 1
    return plan


def with_schedule(
    docs: DataFrame, weights: Mapping[str, int], *, source: str = "source", block_docs: int = BLOCK_DOCS
) -> DataFrame:
    """``docs`` with the schedule as metadata of the column ``source``, which Parquet files keep; rows stay as they are."""
    schedule = {"weights": dict(weights), "block_docs": block_docs}
    return docs.withMetadata(source, _metadata(docs, source) | {SCHEDULE: schedule})


def schedule_of(docs: DataFrame, source: str = "source") -> dict | None:
    """``weights`` and ``block_docs`` that ``with_schedule`` handed on; None where it did not, or the metadata is lost."""
    return _metadata(docs, source).get(SCHEDULE)


def _metadata(docs: DataFrame, column: str) -> dict:
    return docs.select(F.col(f"`{column}`")).schema[0].metadata


def _hash(doc_id: Column) -> Column:
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def numbered(rows: DataFrame, group: str, order: list[Column], cells: int) -> DataFrame:
    """``rows`` with ``number``, their place from 0 in their group by ``__hash`` and ``order``.

    Rows of a group are cut into cells by their hash, which keeps the order, and numbered
    within; the rows of all cells before are added. So no task sorts a whole group.
    """
    part = F.conv(F.substring("__hash", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("__cell", F.shiftright(part * cells, 32))
    counts = rows.groupBy(group, "__cell").agg(F.count("*").alias("__n"))
    counts = counts.withColumn("__super", F.floor(F.col("__cell") / GROUP_CELLS))
    before = Window.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    inner = F.sum("__n").over(before.partitionBy(group, "__super"))
    supers = counts.groupBy(group, "__super").agg(F.sum("__n").alias("__n"))
    ahead = Window.partitionBy(group).orderBy("__super").rowsBetween(Window.unboundedPreceding, -1)
    supers = supers.select(group, "__super", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__ahead"))
    offsets = counts.select(group, "__super", "__cell", F.coalesce(inner, F.lit(0)).alias("__inner"))
    offsets = offsets.join(supers, [group, "__super"]).select(
        group, "__cell", (F.col("__ahead") + F.col("__inner")).alias("__offset")
    )
    here = F.row_number().over(Window.partitionBy(group, "__cell").orderBy("__hash", *order)) - 1
    placed = rows.withColumn("__here", here).join(offsets, [group, "__cell"])
    return placed.withColumn("number", F.col("__offset") + F.col("__here")).drop("__cell", "__here", "__offset")


def mix(
    docs: DataFrame,
    weights: Mapping[str, int],
    *,
    doc_id: str = "doc_id",
    source: str = "source",
    keep: tuple[str, ...] = (),
    block_docs: int = BLOCK_DOCS,
) -> DataFrame:
    """The place of every document in the mixed stream; ``ORDER BY slot, place`` is the stream.

    ``doc_id, source, share`` (the name whose weight counts), ``block, release, deadline,
    slot, place`` (in the block) and the columns ``keep``. Within a source documents come by the MD5 of their id.
    Sources that ``weights`` does not name, and rows without source, share the weight ``REST``, which must be
    given. Rows that repeat an id follow each other. No row is dropped or repeated; an empty table
    gives no rows. Other columns are ignored.
    """
    if REST not in weights:
        raise ValueError(f"a weight for {REST!r}, the sources not named, is needed")
    spark, slots = docs.sparkSession, sum(weights.values())
    cells = max(1, -(-docs.count() // CELL_ROWS))
    share = F.when(F.col(f"`{source}`").isin([name for name in weights if name != REST]), F.col(f"`{source}`"))
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.col(f"`{source}`").alias("source"),
        F.coalesce(share, F.lit(REST)).alias("share"),
        _hash(F.col(f"`{doc_id}`")).alias("__hash"),
        *(F.struct(*(F.col(f"`{name}`") for name in keep)).alias("__kept"),) * bool(keep),
    )
    ties = [F.col("doc_id"), F.xxhash64(*(name for name in rows.columns if name != "__hash"))]
    rows = numbered(rows, "share", ties, cells)
    rows = rows.withColumn("block", F.floor(F.col("number") / block_docs)).withColumn("place", F.col("number") % block_docs)

    plan = ", ".join(f"({name!r}, {weights[name]}L, {i}L, {slot}L)" for name, i, slot in period(weights))
    table = spark.sql(f"select * from values {plan} as plan(share, weight, turn, at)")
    turns = spark.sql(
        "select * from values " + ", ".join(f"({name!r}, {weights[name]}L)" for name in weights) + " as w(share, weight)"
    )
    # Both tables hold one period, whatever the data.
    rows = rows.join(F.broadcast(turns), "share").withColumn("turn", F.col("block") % F.col("weight"))
    rows = rows.join(F.broadcast(table.drop("weight")), ["share", "turn"])
    return rows.select(
        "doc_id",
        "source",
        "share",
        "block",
        F.expr(f"(block * {slots}) div weight").alias("release"),
        F.expr(f"((block + 1) * {slots} + weight - 1) div weight").alias("deadline"),
        (F.expr("block div weight") * slots + F.col("at")).alias("slot"),
        "place",
        *(F.col("__kept")[name].alias(name) for name in keep if name not in ("doc_id", "source")),
    )
