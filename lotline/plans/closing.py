"""Day closing: sales value of the backlog against the target."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lotline.functions.display import with_display
from lotline.operators.aggregates import group_sums, total_row
from lotline.operators.filters import differs_or_missing
from lotline.operators.ordering import top_rows
from lotline.plans.backlog import CHECKED, IN_PROCESS, ORDER_KINDS, SCHEDULED

# Target of the day and rows shown.
TARGET = 1952000
SHOWN = 10


def sales_not_scheduled(backlog: DataFrame) -> DataFrame:
    """Sales lines that are not scheduled for later; a missing state stays."""
    return backlog.filter(
        (F.col("tipo_pedido") == ORDER_KINDS[0])
        & differs_or_missing(F.col("status_operacao_gerencial"), SCHEDULED)
    )


def closing_by_status(backlog: DataFrame, display: bool = False) -> DataFrame:
    """Sales value by status, with a total."""
    sums = group_sums(sales_not_scheduled(backlog), "status", {"valtotal": "valtotal"})
    rows = total_row(sums, "status", ["valtotal"])
    return with_display(rows, {"valtotal": "NORMAL"}) if display else rows


def top_lots_by_value(backlog: DataFrame, n: int = SHOWN) -> DataFrame:
    """The lots in process, not yet checked, with the largest sales value."""
    in_process = sales_not_scheduled(backlog).filter(
        (F.col("status_operacao") == IN_PROCESS) & differs_or_missing(F.col("status"), CHECKED)
    )
    return top_rows(group_sums(in_process, "numlote", {"valtotal": "valtotal"}), ["valtotal"], "numlote", n)


def closing_top_lots(backlog: DataFrame, lot_status: DataFrame, display: bool = False) -> DataFrame:
    """The top lots with what is still to pick and check; ``lote`` is NULL without lot status."""
    pending = lot_status.select("lote", "pendente_sep", "pendente_conf")
    top = top_lots_by_value(backlog)
    rows = (
        top.join(pending, top.numlote == pending.lote, "left")
        .orderBy(F.desc("valtotal"), "numlote")
        .select("lote", "valtotal", "pendente_sep", "pendente_conf")
    )
    return with_display(rows, {"valtotal": "NORMAL"}) if display else rows


def closing_top_orders(backlog: DataFrame, display: bool = False) -> DataFrame:
    """The orders not in process with the largest sales value."""
    waiting = sales_not_scheduled(backlog).filter(differs_or_missing(F.col("status_operacao"), IN_PROCESS))
    rows = top_rows(group_sums(waiting, "numpedven", {"valtotal": "valtotal"}), ["valtotal"], "numpedven", SHOWN)
    return with_display(rows, {"valtotal": "NORMAL"}) if display else rows


def lots_to_invoice(backlog: DataFrame) -> DataFrame:
    """Number of lots that are checked and wait for the invoice."""
    checked = sales_not_scheduled(backlog).filter(F.col("status") == CHECKED)
    return checked.agg(F.countDistinct("numlote").alias("lotes_para_faturar"))


def result_vs_target(backlog: DataFrame, target: int = TARGET, display: bool = False) -> DataFrame:
    """Sales value, target, difference, and whether the target was passed."""
    result = F.coalesce(F.sum("valtotal"), F.lit(0))
    total = sales_not_scheduled(backlog).agg(result.alias("resultado"))
    gap = F.col("resultado") - target
    row = total.select("resultado", F.lit(target).alias("meta"), gap.alias("dif"), (gap > 0).alias("acima"))
    return with_display(row, dict.fromkeys(["resultado", "meta", "dif"], "NORMAL")) if display else row
