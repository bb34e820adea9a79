"""Summaries of the enriched backlog.

All read the result of ``enrich_backlog`` (or its stored snapshot), or their part of ``page_sums``, which
reads it once for all of them; sums stay numeric, ``display=True`` adds the text columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from lotline.functions.display import SUFFIX, fmt_ptbr, with_display
from lotline.operators.aggregates import conditional_sum, group_sums, pivot_margin, pivot_sum, total_row
from lotline.operators.ordering import first_rows, top_rows
from lotline.plans.backlog import IN_PICKING, RELEASED

# Daily capacity in m3, rows shown, and the mode of own deliveries.
CAPACITY = 1061
SHOWN = 10
DELIVERY_MODE = "CD Entrega"
# Columns that a branch table may have.
MOST_MODES = 500

PIECES, VOLUME = "pecas", "cubagem"
STYLES = {PIECES: "NORMAL", VOLUME: "CUBAGEM"}


# Columns that the rows of each page are summed by.
PAGES = {
    "status": ["status"],
    "family": ["familia"],
    "mode": ["modal_master", "status"],
    "branch": ["filial", "modal_master"],
    "city": ["modal_master", "cidade", "numpedven"],
}


def page_sums(enriched: DataFrame, mode: str = DELIVERY_MODE) -> DataFrame:
    """Pieces and volume of every page in one long table, from one scan of the enriched backlog.

    ``page`` tells the page of a row; columns that it is not summed by are NULL. Orders are told apart for the
    cities of ``mode`` only. Store it, and give each report the rows of ``page_of``.
    """
    columns = list(dict.fromkeys(name for names in PAGES.values() for name in names))
    order = F.when(F.col("modal_master") == mode, F.col("numpedven")).alias("numpedven")
    rows = enriched.select(*(order if name == "numpedven" else name for name in columns), "qtcomp", "cubtotal")
    sums = rows.groupingSets([tuple(names) for names in PAGES.values()], *columns).agg(
        F.grouping_id(*columns).alias("_set"), F.sum("qtcomp").alias("qtcomp"), F.sum("cubtotal").alias("cubtotal")
    )
    # The grouping id has a bit for each column that is not summed by.
    known = {page: sum((name not in names) << i for i, name in enumerate(reversed(columns))) for page, names in PAGES.items()}
    page = F.coalesce(*(F.when(F.col("_set") == number, page) for page, number in known.items()))
    return sums.select(page.alias("page"), *columns, "qtcomp", "cubtotal")


def page_of(sums: DataFrame, page: str) -> DataFrame:
    """The rows of ``page_sums`` that a page is made of."""
    return sums.filter(F.col("page") == page).drop("page")


def _shown(df: DataFrame, styles: dict[str, str], display: bool) -> DataFrame:
    return with_display(df, styles) if display else df


def backlog_by_status(enriched: DataFrame, display: bool = False) -> DataFrame:
    """Pieces and volume of the first ten statuses, with the total of the rows shown."""
    sums = group_sums(enriched, "status", {PIECES: "qtcomp", VOLUME: "cubtotal"})
    return _shown(total_row(first_rows(sums, "status", SHOWN), "status", [PIECES, VOLUME]), STYLES, display)


def top_families(enriched: DataFrame, display: bool = False) -> DataFrame:
    """The ten families with the largest volume."""
    sums = group_sums(enriched, "familia", {PIECES: "qtcomp", VOLUME: "cubtotal"})
    return _shown(top_rows(sums, [VOLUME], "familia", SHOWN), STYLES, display)


def modes_in_process(enriched: DataFrame, display: bool = False) -> DataFrame:
    """By mode: pieces and volume of released lines and of lines in picking, with a total."""
    rows = enriched.filter(F.col("status").isin(RELEASED, IN_PICKING) & F.col("modal_master").isNotNull())
    sums = rows.groupBy("modal_master").agg(
        F.sum("qtcomp").alias(PIECES),
        conditional_sum(F.col("status") == RELEASED, F.col("cubtotal")).alias("carteira"),
        conditional_sum(F.col("status") == IN_PICKING, F.col("cubtotal")).alias("processo"),
        F.sum("cubtotal").alias(VOLUME),
    )
    measures = [PIECES, "carteira", "processo", VOLUME]
    return _shown(total_row(sums, "modal_master", measures), dict.fromkeys(measures, "CUBAGEM"), display)


def days_in_backlog(enriched: DataFrame, capacity: int = CAPACITY, display: bool = False) -> DataFrame:
    """Three rows: volume in the backlog, daily capacity, and days of work."""
    total = enriched.agg(F.sum("cubtotal").cast("double").alias("m3"))
    rows = total.selectExpr(
        f"stack(3, 'Carteira Atual', m3, 'Capacidade', cast({int(capacity)} as double), "
        f"'Dias Em Carteira', m3 / {int(capacity)}) as (tipo, valor)"
    )
    if not display:
        return rows
    text = F.when(F.col("tipo") == "Capacidade", str(int(capacity))).otherwise(fmt_ptbr(F.col("valor"), "CUBAGEM"))
    return rows.withColumn("valor" + SUFFIX, text)


def mode_names(modes: DataFrame) -> list[str]:
    """Names of the mode lookup, in order; the columns of the branch tables, ``MOST_MODES`` at most."""
    names = modes.select("modal_master").na.drop().distinct().orderBy("modal_master").limit(MOST_MODES + 1)
    found = [row[0] for row in names.collect()]
    if len(found) > MOST_MODES:
        raise ValueError(f"more than {MOST_MODES} modes: too many columns of a branch table")
    return found


def _branch_by_mode(enriched: DataFrame, value: str, modes: Sequence[str], style: str, display: bool) -> DataFrame:
    table = pivot_sum(enriched, "filial", "modal_master", value, modes)
    table = pivot_margin(table, "filial", modes)
    return _shown(table, dict.fromkeys([*modes, "Total"], style), display)


def branch_mode_pieces(enriched: DataFrame, modes: Sequence[str], display: bool = False) -> DataFrame:
    """Pieces by branch and mode, largest branch first."""
    return _branch_by_mode(enriched, "qtcomp", modes, "NORMAL", display)


def branch_mode_volume(enriched: DataFrame, modes: Sequence[str], display: bool = False) -> DataFrame:
    """Volume by branch and mode, largest branch first."""
    return _branch_by_mode(enriched, "cubtotal", modes, "CUBAGEM", display)


def delivery_cities(enriched: DataFrame, mode: str = DELIVERY_MODE, display: bool = False) -> DataFrame:
    """Orders, pieces and volume by city of one mode, largest volume first."""
    rows = enriched.filter((F.col("modal_master") == mode) & F.col("cidade").isNotNull())
    sums = rows.groupBy("cidade").agg(
        F.countDistinct("numpedven").alias("pedidos"),
        F.sum("qtcomp").alias(PIECES),
        F.sum("cubtotal").alias(VOLUME),
    )
    return _shown(sums.orderBy(F.desc(VOLUME), "cidade"), STYLES, display)
