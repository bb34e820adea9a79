"""The order backlog and its lookups."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from lotline.functions import amounts, clock, codes
from lotline.operators.filters import differs_or_missing
from lotline.operators.joins import Window, first_per_key, lookup_merge, require_unique, salted_join, spread

# Codes of eligible orders.
ORIGIN_BRANCH = 2650
OPEN_LOADS = (0, 1, 2, 8, 9, 14)
SUPPLY_NOTES, SUPPLY_STATE = (55, 536, 655, 665), 4
SALE_NOTE, SALE_STATE = 51, 5
SITE_BRANCH = 200
UNLISTED_BRANCH = 98
ORDER_KINDS = {0: "VENDAS", 2: "ABA"}

# States of an order line.
UNRELEASED = "1-Nao Liberado"
RELEASED = "2-Liberado"
IN_PICKING = "4-Lote em Separacao"
CHECKED = "6-Conferido Aguardando Fat"
LOAD_STATES = {
    2: CHECKED,
    8: "8-Venda Pendente SEFAZ",
    9: "9-Bloqueado Expedicao",
    14: "14-Eficiencia Energetica",
}
LOT_STATES = {"N": "3-Lote montado", "B": IN_PICKING, "R": IN_PICKING, "C": "5-Lote em Conferencia"}
IN_BACKLOG, IN_PROCESS = "EM CARTEIRA", "EM PROCESSO"
SCHEDULED = "PROGRAMADO"
SCHEDULE_DAYS = 2

BACKLOG_COLUMNS = (
    "numpedven",
    "tpnota",
    "tipo_pedido",
    "codfiltransffat",
    "canal_vendas",
    "codmodal",
    "descricao",
    "modalidade",
    "descricaorota",
    "data_aprovacao",
    "dtpedido",
    "dtentrega",
    "preventrega",
    "dtlibfat_mod",
    "familia",
    "filorig",
    "status",
    "item",
    "linha",
    "numlote",
    "numpedcomp",
    "qtcomp",
    "precounit",
    "cub_unit",
    "status_operacao",
    "situacao",
    "status_operacao_gerencial",
    "cubtotal",
    "valtotal",
)

ORDER_KEYS = ["codfil", "tipoped", "numpedven"]
# Those of the order keys that the report shows as they are; the kind is shown by its label.
LINE_KEYS = ["codfil", "numpedven"]

# Columns of an order and of its goods that tell two lines apart.
ORDER_COLUMNS = (
    "numpedven",
    "codfil",
    "tipo_pedido",
    "tpnota",
    "filorig",
    "dtpedido",
    "fllibfat",
    "numlote",
    "dtentrega",
    "codfiltransffat",
    "dtlibfat",
    "sitcarga",
    "codreserva",
    "dtalter",
    "praca",
    "numpedcli",
    "codrota",
    "codmodal",
    "modalidade",
    "codcli",
    "dtlibfat_mod",
    "lot_flags",
)
GOODS_COLUMNS = ("item", "descricao", "cub_unit", "linha", "familia")


@dataclass(frozen=True)
class BacklogTables:
    """Input tables of the backlog."""

    order: DataFrame
    item: DataFrame
    kit_item: DataFrame
    item_product: DataFrame
    product: DataFrame
    product_location: DataFrame
    pack: DataFrame
    line: DataFrame
    family: DataFrame
    mode: DataFrame
    lot: DataFrame
    reservation: DataFrame
    area: DataFrame
    area_route: DataFrame
    route: DataFrame
    site_time: DataFrame


def eligible(origin: int = ORIGIN_BRANCH) -> Column:
    """Open supply or sales orders of the origin branch."""
    supply = F.col("tpnota").isin(*SUPPLY_NOTES) & (F.col("status") == SUPPLY_STATE)
    sale = (
        (F.col("tpnota") == SALE_NOTE)
        & (F.col("status") == SALE_STATE)
        & differs_or_missing(F.col("fltransffatnf"), "S")
    )
    return (
        F.col("sitcarga").isin(*OPEN_LOADS)
        & (supply | sale)
        & (F.col("tpped") == "E")
        & (F.col("filorig") == origin)
        & differs_or_missing(F.col("flcredlista"), "G")
    )


def listed(released_only: bool = True) -> Column:
    """Orders the backlog shows: released ones, not sent to the unlisted branch."""
    shown = F.col("codfiltransffat") != UNLISTED_BRANCH
    return shown & (F.col("fllibfat") == "S") if released_only else shown


def release_time(orders: DataFrame, site_time: DataFrame) -> DataFrame:
    """Add ``dtlibfat_mod``: first site movement for site orders, own time for others.

    Movements get the branch of the site, so that they meet site orders only, and by ``LINE_KEYS``,
    by which the orders stay dealt out for their lines. One without time tells nothing and gets none.
    """
    branch = F.when(F.col("dthora_int").isNotNull(), SITE_BRANCH)
    moved = spread(site_time.select("numpedven", "dthora_int", branch.alias("codfil")), LINE_KEYS)
    first = moved.groupBy(*LINE_KEYS).agg(F.min("dthora_int").alias("_site"))
    from_site = F.col("codfil") == SITE_BRANCH
    chosen = F.when(from_site, F.col("_site")).otherwise(F.col("hrpedido"))
    joined = spread(orders, LINE_KEYS).join(first, LINE_KEYS, "left")
    return joined.withColumn("dtlibfat_mod", clock.to_second(chosen)).drop("_site")


def with_lot_flags(orders: DataFrame, lot: DataFrame, salts: int = 0) -> DataFrame:
    """Orders with ``lot_flags``, one ``flseparacao`` per row of their lot, NULL where there is none.

    The lots meet the orders, which are fewer than their lines. Orders without lot (NULL, or a
    number such as 0 that no lot has), a large part of them, are told by the bit set of the lots and go past the join.
    """
    keys = ["numlote", "filorig"]
    lots = lot.select(F.col("nlote").alias("numlote"), F.col("codfil").alias("filorig"), "flseparacao")
    some, none = Window(lots, keys).split(orders, keys)
    flags = lots.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("flseparacao"))).alias("lot_flags"))
    placed = salted_join(some, flags, keys, "left", salts=salts).select(*orders.columns, "lot_flags")
    return placed.unionByName(none, allowMissingColumns=True)


def with_lot_state(rows: DataFrame) -> DataFrame:
    """One row per lot flag, as a left join to the lots has, with ``flseparacao`` for ``lot_flags``."""
    flagged = rows.select("*", F.explode_outer("lot_flags").alias("_flag")).drop("lot_flags")
    return flagged.withColumn("flseparacao", F.col("_flag.flseparacao")).drop("_flag")


def order_items(item: DataFrame, kit_item: DataFrame) -> DataFrame:
    """Kit components and plain items under one set of names, told apart by ``kit``."""
    columns = [*ORDER_KEYS, "codembal", "qtcomp", "precounit"]
    plain = item.filter(differs_or_missing(F.col("flmovitpedkit"), "S")).select(
        *columns, "coditprod", F.lit(False).alias("kit")
    )
    parts = kit_item.select(*columns, F.col("coditprodkit").alias("coditprod"), F.lit(True).alias("kit"))
    return parts.unionByName(plain)


def goods(t: BacklogTables, origin: int = ORIGIN_BRANCH) -> DataFrame:
    """Goods (no services) held at the origin branch, per item and pack code."""
    held = t.product_location.filter(F.col("codfil") == origin).select("coditprod")
    physical = t.product.filter(amounts.zero_if_null(F.col("codtpserv")) == 0)
    packs = t.pack.select(
        "codprod",
        "codembal",
        amounts.unit_volume(F.col("altura"), F.col("largura"), F.col("comp")).alias("cub_unit"),
    )
    return (
        t.item_product.join(physical.select("codprod", "descricao"), "codprod")
        .join(held, "coditprod", "left_semi")
        .join(packs, "codprod")
        .join(t.line.select("codlinha", F.col("descricao").alias("linha")), "codlinha")
        .join(t.family.select("codfam", F.col("descricao").alias("familia")), "codfam")
        .select(
            "coditprod",
            "codembal",
            codes.concat_code(F.col("coditprod"), F.col("digitprod")).alias("item"),
            "descricao",
            "cub_unit",
            "linha",
            "familia",
        )
    )


def listed_orders(t: BacklogTables, origin: int = ORIGIN_BRANCH, released_only: bool = True) -> Window:
    """Orders the backlog is about; they also tell which items and reservations matter."""
    return Window(t.order.filter(eligible(origin) & listed(released_only)), ORDER_KEYS, ["codreserva"])


def backlog_lines(
    t: BacklogTables, chosen: Window, *, origin: int = ORIGIN_BRANCH, salts: int = 0
) -> DataFrame:
    """Distinct lines of the chosen orders; kits and plain items are distinct apart.

    Items of other orders are dropped first, and both kinds meet the goods while they are
    narrow, then the orders in one join. That join deals the lines out by ``LINE_KEYS``, with the
    few kinds of an order number told apart within: equal lines agree in these keys, so they
    are made distinct where they are, without a shuffle of the whole lines. Columns of one
    side travel as a struct, which keeps the generated code of that step short.
    """
    orders = release_time(with_lot_flags(chosen.rows, t.lot, salts), t.site_time)
    orders = orders.join(t.mode.select("codmodal", F.col("descricao").alias("modalidade")), "codmodal", "left")
    orders = orders.withColumn("tipo_pedido", codes.decode_values(F.col("tipoped"), ORDER_KINDS))
    orders = orders.select(*LINE_KEYS, F.col("tipoped").alias("kind"), F.struct(*ORDER_COLUMNS).alias("ordered"))
    stock = goods(t, origin).select("coditprod", "codembal", F.struct(*GOODS_COLUMNS).alias("good"))
    items = chosen.cut(order_items(t.item, t.kit_item), ORDER_KEYS)
    stocked = items.join(stock, ["coditprod", "codembal"])
    if salts < 2:
        stocked = spread(stocked, LINE_KEYS)
    lines = salted_join(stocked, orders, LINE_KEYS, salts=salts)
    # As a range the equality stays out of the keys that deal out the rows.
    lines = lines.filter(F.col("tipoped").between(F.col("kind"), F.col("kind")))
    lines = lines.select(*LINE_KEYS, "ordered", "good", "kit", "coditprod", "qtcomp", "precounit").distinct()
    return lines.select("ordered.*", "good.*", "coditprod", "qtcomp", "precounit")


def line_status() -> Column:
    """Status of a line; the load state goes before the flag of the lot."""
    return F.coalesce(
        F.when(F.col("fllibfat") == "N", UNRELEASED),
        codes.decode_values(F.col("sitcarga"), LOAD_STATES),
        codes.decode_values(F.col("flseparacao"), LOT_STATES),
        F.lit(RELEASED),
    )


def line_situation() -> Column:
    """Supply situation of an unreleased line, from its reservation; NULL for others."""
    kind = F.col("codsitprod")
    rules = [
        (kind.isin("AD", "AN"), "Adicional"),
        (kind == "EC", "Encomenda"),
        ((F.col("tipopedido") == "T") | F.col("codreservay").isNotNull(), "Roteiro Y"),
        (kind.isNotNull() & (F.col("tipopedido") == "C"), "Pedido de Compra"),
    ]
    return F.when(F.col("fllibfat") == "N", codes.classify(rules))


def operation_state() -> Column:
    return F.when(amounts.zero_if_null(F.col("numlote")) == 0, IN_BACKLOG).otherwise(IN_PROCESS)


def managerial_state(as_of: clock.AsOf) -> Column:
    """State shown to managers; the first rule that holds."""
    released = F.col("fllibfat") == "S"
    limit = clock.time_literal(clock.as_moment(as_of) + dt.timedelta(days=SCHEDULE_DAYS))
    rules = [
        (F.col("situacao").isin("Roteiro Y", "Roteiro Y ABA"), "ROT Y"),
        (F.col("fllibfat") == "N", "VENDA FORNECEDOR"),
        (released & (F.col("dt_maxima") > limit), SCHEDULED),
        (F.col("codmodal") == "INA", "ABA INAUGURACAO"),
        (released & (F.col("sitcarga") == 9), "BLOQUEADO"),
    ]
    return codes.classify(rules, F.col("status_operacao"))


def delivery_route() -> Column:
    """Route name; the northern route is split by transport mode."""
    north = F.col("rota") == "NORTE"
    rules = [(north & (F.col("codmodal") == "COU"), "SEDEX"), (north & (F.col("codmodal") != "COU"), "FAVORITA")]
    return codes.classify(rules, F.col("rota"))


def route_of_area(area: DataFrame, area_route: DataFrame, route: DataFrame) -> DataFrame:
    """``praca, rota``: the route that serves each market area; an area with two routes fails the query."""
    routes = route.select("codrota", F.col("descricao").alias("rota"))
    links = area.select("praca").join(area_route.select("praca", "codrota"), "praca").join(routes, "codrota")
    return require_unique(links.select("praca", "rota"), ["praca"])


def first_reservations(reservation: DataFrame) -> DataFrame:
    """At most one reservation per (reservation, product): the earliest delivery."""
    return first_per_key(
        reservation,
        ["codreserva", "coditprod"],
        ["dtentrega", "numpedcomp"],
        ["dtentrega", "numpedcomp", "codsitprod", "tipopedido", "codreservay"],
    ).withColumnRenamed("dtentrega", "dtreserva")


def order_backlog(
    t: BacklogTables,
    *,
    as_of: clock.AsOf,
    origin: int = ORIGIN_BRANCH,
    released_only: bool = True,
    salts: int = 0,
) -> DataFrame:
    """Open order lines with status, route, supply situation, volume and value."""
    routes = route_of_area(t.area, t.area_route, t.route)
    chosen = listed_orders(t, origin, released_only)
    reservations = chosen.cut(t.reservation, ["codreserva"])
    lines = (
        with_lot_state(backlog_lines(t, chosen, origin=origin, salts=salts))
        .join(routes, "praca", "left")
        .join(first_reservations(reservations), ["codreserva", "coditprod"], "left")
    )
    latest = clock.latest_of(F.col("dtlibfat_mod"), F.col("dtpedido"), F.col("dtentrega"))
    derived = lines.withColumns(
        {
            "status": line_status(),
            "situacao": line_situation(),
            "status_operacao": operation_state(),
            "dt_maxima": latest,
            "descricaorota": delivery_route(),
            "canal_vendas": F.when(F.col("codfil") == SITE_BRANCH, "SITE").otherwise("REDE"),
            "data_aprovacao": F.col("dtalter"),
            "preventrega": F.to_date("dtreserva"),
            "cubtotal": amounts.line_amount(F.col("qtcomp"), F.col("cub_unit")),
            "valtotal": amounts.line_amount(F.col("qtcomp"), F.col("precounit")),
        }
    )
    return derived.withColumn("status_operacao_gerencial", managerial_state(as_of)).select(*BACKLOG_COLUMNS)


def enrich_backlog(backlog: DataFrame, modes: DataFrame, branches: DataFrame, cities: DataFrame) -> DataFrame:
    """The backlog with the lookups of mode, branch and city; unmatched rows get NULL."""
    rows = lookup_merge(backlog, modes, {"codmodal": "codmodal"})
    rows = lookup_merge(rows, branches, {"codfiltransffat": "cod"})
    return lookup_merge(rows, cities, {"descricaorota": "rota"})
