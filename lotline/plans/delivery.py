"""Deliveries about to fall due."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lotline.functions.codes import delivery_label
from lotline.operators.aggregates import flag_count, pivot_sum
from lotline.operators.filters import differs_or_missing
from lotline.operators.ordering import head_then_sort, top_categories, top_rows
from lotline.sources.snapshots import scratch_copy

# States, regions left out, and sizes of the tables.
PENDING = "PENDENTE"
LATER, TODAY, OVERDUE = "À VENCER", "VENCE HOJE", "VENCIDO"
OTHER_REGIONS = ("CORREIOS", "FRACIONADO")
CARRIERS_SHOWN = 26
MATRIX_STATUSES = 5
MATRIX_CARRIERS = 16
MATRIX_ORDER = "Em Entrega"

CARRIER = "transp_corrigida"


def pending_deliveries(delivery: DataFrame) -> DataFrame:
    """Pending deliveries outside the other regions; a missing region stays."""
    kept = F.col("finalizador") == PENDING
    for region in OTHER_REGIONS:
        kept = kept & differs_or_missing(F.col("regional"), region)
    return delivery.filter(kept)


def due_counts() -> list[Column]:
    """Counts of deliveries due later, today, overdue, and all."""
    due = F.col("status_prazo")
    return [
        flag_count(due == LATER).alias("a_vencer"),
        flag_count(due == TODAY).alias("vence_hoje"),
        flag_count(due == OVERDUE).alias("vencido"),
        F.count(F.lit(1)).alias("total"),
    ]


def due_totals(delivery: DataFrame) -> DataFrame:
    """One row: pending deliveries due later, today, overdue, and all."""
    return pending_deliveries(delivery).agg(*due_counts())


def due_by_carrier(delivery: DataFrame, n: int = CARRIERS_SHOWN) -> DataFrame:
    """Pending deliveries by carrier, most due today first, then most overdue."""
    counts = pending_deliveries(delivery).groupBy(CARRIER).agg(*due_counts())
    return top_rows(counts, ["vence_hoje", "vencido"], CARRIER, n)


def due_today(delivery: DataFrame) -> DataFrame:
    """Pending deliveries due today by carrier and label; other texts give no label."""
    rows = pending_deliveries(delivery).filter(F.col("status_prazo") == TODAY)
    labelled = rows.select(CARRIER, delivery_label(F.col("status_final")).alias("rotulo"))
    return labelled.filter(F.col("rotulo").isNotNull()).groupBy(CARRIER, "rotulo").agg(F.count(F.lit(1)).alias("n"))


def due_today_matrix(delivery: DataFrame, statuses: Sequence[str] | None = None) -> DataFrame:
    """Deliveries due today: first carriers by name against the most frequent labels.

    The deliveries are read once: their counts by carrier and label, a small table, are stored in the scratch
    folder, and labels and columns are taken from it. With ``statuses`` nothing is stored. Rows are
    ordered by the deliveries on their way, when that label is shown.
    """
    counts = due_today(delivery)
    if statuses is None:
        counts = scratch_copy(counts, "due-today")
    shown = statuses if statuses is not None else top_categories(counts, "rotulo", "n", MATRIX_STATUSES)
    matrix = pivot_sum(counts, CARRIER, "rotulo", "n", list(shown))
    return head_then_sort(matrix, CARRIER, MATRIX_CARRIERS, MATRIX_ORDER)
