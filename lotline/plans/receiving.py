"""Receiving reports: labels to put away, open appointments and the gate log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from lotline.functions import clock, codes
from lotline.operators.joins import Window, lookup_one
from lotline.sources.records import has_large_file
from lotline.sources.sheets import read_csv_fill
from lotline.sources.snapshots import write_snapshot

# Companies, label and receipt states, areas and product not counted.
COMPANIES = (1590, 15350)
RECEIVED = 23
STORED_AREAS = (17, 9, 27)
UNCOUNTED_PRODUCT = 11
OPEN_RECEIPTS = (10, 11)


def received_labels(
    label_grouped: DataFrame,
    label_single: DataFrame,
    *,
    company: int,
    excluded_areas: Sequence[int] = STORED_AREAS,
) -> DataFrame:
    """Grouped and single labels received but not stored, under the names of the grouped ones.

    Single labels in an excluded area, or without area, are left out.
    """
    open_label = (
        (F.col("cd_empresa") == company)
        & (F.col("cd_situacao") == RECEIVED)
        & (F.col("cd_produto") != UNCOUNTED_PRODUCT)
    )
    shared = ["dt_conferencia", "dt_addrow", "cd_agenda", "cd_produto", "cd_func_conferencia", "qt_conferido", "cd_endereco"]
    grouped = label_grouped.filter(open_label).select(
        *shared, F.col("nu_etiqueta_lote").alias("etiqueta"), F.lit("AGRUPADA").alias("tp_etiqueta")
    )
    single = label_single.filter(open_label & ~F.col("cd_area_armaz").isin(*excluded_areas)).select(
        *shared, F.col("nu_etiqueta").alias("etiqueta"), F.lit("NORMAL").alias("tp_etiqueta")
    )
    return grouped.unionByName(single)


def putaway_pending(
    label_grouped: DataFrame,
    label_single: DataFrame,
    product: DataFrame,
    employee: DataFrame,
    *,
    as_of: clock.AsOf,
    company: int,
    excluded_areas: Sequence[int] = STORED_AREAS,
    ordered: bool = True,
) -> DataFrame:
    """Labels waiting to be stored, with checker, product name and age in days.

    ``ordered=False`` leaves out the global sort, for results that are stored.
    """
    labels = received_labels(label_grouped, label_single, company=company, excluded_areas=excluded_areas)
    checkers = employee.select(F.col("cd_funcionario").alias("cd_func_conferencia"), "nm_funcionario")
    named = lookup_one(labels, product.select("cd_produto", "ds_produto"), ["cd_produto"])
    rows = named.join(checkers, "cd_func_conferencia")
    if ordered:
        rows = rows.orderBy("dt_conferencia", "etiqueta", "cd_produto", "cd_agenda", "tp_etiqueta")
    return rows.select(
        clock.minute_text(F.col("dt_conferencia")).alias("data_entrada"),
        "cd_agenda",
        "etiqueta",
        clock.age_days(as_of, F.col("dt_addrow")).alias("dias"),
        "cd_produto",
        "ds_produto",
        "nm_funcionario",
        "qt_conferido",
        "tp_etiqueta",
        "cd_endereco",
    )


def open_appointments(
    divergent: DataFrame,
    receipt: DataFrame,
    product: DataFrame,
    appointment: DataFrame,
    invoice: DataFrame,
    *,
    company: int = COMPANIES[0],
    dedupe_invoices: bool = False,
) -> DataFrame:
    """Receipt lines of divergent appointments that are still open.

    A line appears once per invoice of its appointment (once when it has none);
    ``dedupe_invoices=True`` shows each line once and does not read the invoices.
    """
    keys = ["cd_empresa", "cd_agenda"]
    lines = receipt.filter((F.col("cd_empresa") == company) & F.col("cd_situacao").isin(*OPEN_RECEIPTS))
    listed = divergent.filter(F.col("cd_empresa") == company).select(*keys)
    window = Window(listed, keys)
    lines = window.cut(lines, keys).select(*keys, "cd_produto_master", "qt_produto", "qt_recebido", "qt_sobra")
    visits = appointment.filter(F.col("cd_empresa") == company).select(*keys, "id_agenda_externa", "dt_agendamento")
    rows = listed.join(lines, keys).join(window.cut(visits, keys), keys, "left")
    if not dedupe_invoices:
        bills = invoice.filter(F.col("cd_empresa") == company).select(*keys)
        rows = rows.join(window.cut(bills, keys), keys, "left")
    names = product.select(F.col("cd_produto").alias("cd_produto_master"), "ds_produto")
    return rows.join(names, "cd_produto_master", "left").select(
        "cd_empresa",
        clock.day_text(F.col("dt_agendamento")).alias("data_agenda"),
        "cd_agenda",
        "id_agenda_externa",
        codes.appointment_kind(F.col("id_agenda_externa")).alias("tipo_agenda"),
        "cd_produto_master",
        "ds_produto",
        "qt_produto",
        "qt_recebido",
        "qt_sobra",
    )


def gate_snapshot(
    spark: SparkSession, source: str, target: str, schema: str | None = None, *, split: bool | None = None
) -> int:
    """Replicate the gate log with its header row and blanks filled; returns the row count.

    Its cells may hold line breaks. ``split`` has many tasks read a file, which gives the same rows; unless told,
    it is done when a file is larger than one task reads.
    """
    split = has_large_file(spark, source) if split is None else split
    return write_snapshot(read_csv_fill(spark, source, schema, split=split), target, fmt="csv", header=True)
