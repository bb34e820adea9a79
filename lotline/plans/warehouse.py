"""Floor reports: lot status, shift production, pick productivity and storage addresses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lotline.functions import amounts, clock, codes, display
from lotline.operators.filters import recent, recent_business_days
from lotline.operators.joins import Window, salted_join

# Fixed values of the warehouse: company, states and codes.
COMPANY = 12650
CANCELLED = 68
CLOSED = 64
RETURN_ORDER = "RMN"
PICK_APPLICATION = "CSE020"
UNCOUNTED_ADDRESS = "T99"
UNCOUNTED_AREAS = ("98", "6", "8", "35", "4", "5", "87", "32")


def _piece_volumes(product: DataFrame) -> DataFrame:
    return product.select(
        "cd_produto",
        amounts.unit_volume(F.col("vl_altura"), F.col("vl_largura"), F.col("vl_profundidade")).alias("m3"),
    )


def programmed_lots(
    order_header: DataFrame,
    order_line: DataFrame,
    product: DataFrame,
    as_of: clock.AsOf,
    window_days: int = 5,
    company: int = COMPANY,
) -> DataFrame:
    """Per lot: first date, lowest state, quantity and volume to pick, orders.

    Lines of other periods are dropped first. The rest is summed per order before it
    meets the headers, so an order with very many lines is combined on the map side
    and both steps use one partitioning.
    """
    headers = order_header.filter(
        (F.col("cd_empresa") == company)
        & recent(F.col("dt_addrow"), as_of, window_days)
        & (F.col("cd_situacao") != CANCELLED)
    ).select("nu_pedido_origem", "cd_carga", "dt_addrow", "cd_situacao")

    lines = order_line.filter((F.col("cd_empresa") == company) & (F.col("cd_situacao") != CANCELLED))
    lines = Window(headers, ["nu_pedido_origem"]).cut(lines, ["nu_pedido_origem"])
    lines = lines.join(_piece_volumes(product), "cd_produto").select(
        "nu_pedido_origem",
        (F.col("cd_situacao") != CLOSED).alias("open"),
        (F.col("qt_separar") - amounts.zero_if_null(F.col("qt_cancelada"))).alias("qty"),
        (F.col("qt_separar") * F.col("m3")).alias("m3"),
    )
    per_order = lines.groupBy("nu_pedido_origem").agg(
        F.count_if("open").alias("open_lines"),
        F.sum(F.when(F.col("open"), F.col("qty"))).alias("open_qty"),
        F.sum(F.when(F.col("open"), F.col("m3"))).alias("open_m3"),
        F.sum("qty").alias("all_qty"),
        F.sum("m3").alias("all_m3"),
    )
    whole = F.col("cd_situacao") == CLOSED
    counted = headers.join(per_order, "nu_pedido_origem").filter(whole | (F.col("open_lines") > 0))
    return counted.groupBy(F.col("cd_carga").alias("lote")).agg(
        F.min("dt_addrow").alias("dt_corte"),
        F.min("cd_situacao").alias("cd_situacao"),
        F.sum(F.when(whole, F.col("all_qty")).otherwise(F.col("open_qty"))).alias("programacao"),
        F.sum(F.when(whole, F.col("all_m3")).otherwise(F.col("open_m3"))).alias("cub_programada"),
        F.countDistinct("nu_pedido_origem").alias("pedidos"),
    )


def picked_lots(
    pick: DataFrame,
    product: DataFrame,
    as_of: clock.AsOf,
    window_days: int = 5,
    company: int = COMPANY,
) -> DataFrame:
    """Per lot: quantity and volume picked and checked; a missing quantity counts as 0."""
    picks = pick.filter((F.col("cd_empresa") == company) & recent(F.col("dt_addrow"), as_of, window_days))
    picked = amounts.zero_if_null(F.col("qt_separado"))
    checked = amounts.zero_if_null(F.col("qt_conferido"))
    return (
        picks.join(_piece_volumes(product), "cd_produto")
        .groupBy(F.col("cd_carga").alias("lote"))
        .agg(
            F.sum(picked).alias("separado"),
            F.sum(checked).alias("conferido"),
            F.sum(picked * F.col("m3")).alias("cub_separada"),
            F.sum(checked * F.col("m3")).alias("cub_conferida"),
        )
    )


def lot_status(
    order_header: DataFrame,
    order_line: DataFrame,
    product: DataFrame,
    pick: DataFrame,
    *,
    as_of: clock.AsOf,
    window_days: int = 5,
    company: int = COMPANY,
    unmatched_pending: str = "zero",
) -> DataFrame:
    """Programmed against picked and checked, per lot.

    A lot without picks shows 0 pending; ``unmatched_pending='full'`` shows its
    whole programme instead.
    """
    if unmatched_pending not in ("zero", "full"):
        raise ValueError("unmatched_pending is 'zero' or 'full'")
    planned = programmed_lots(order_header, order_line, product, as_of, window_days, company)
    done = picked_lots(pick, product, as_of, window_days, company)

    def pending(plan: str, done_name: str) -> Column:
        reached = F.col(done_name)
        if unmatched_pending == "full":
            reached = amounts.zero_if_null(reached)
        return amounts.zero_if_null(F.col(plan) - reached)

    return (
        planned.join(done, "lote", "left")
        .orderBy("dt_corte", "lote")
        .select(
            clock.day_text(F.col("dt_corte")).alias("data_corte"),
            "lote",
            "programacao",
            "cub_programada",
            "pedidos",
            "cd_situacao",
            amounts.zero_if_null(F.col("separado")).alias("separado"),
            amounts.zero_if_null(F.col("cub_separada")).alias("cub_separada"),
            amounts.zero_if_null(F.col("conferido")).alias("conferido"),
            amounts.zero_if_null(F.col("cub_conferida")).alias("cub_conferida"),
            pending("programacao", "separado").alias("pendente_sep"),
            pending("cub_programada", "cub_separada").alias("cub_pendente_sep"),
            pending("programacao", "conferido").alias("pendente_conf"),
            pending("cub_programada", "cub_conferida").alias("cub_pendente_conf"),
        )
    )


def aged_lots(
    order_header: DataFrame,
    pick: DataFrame,
    *,
    since: clock.AsOf,
    as_of: clock.AsOf,
    window_days: int = 5,
    company: int = COMPANY,
) -> DataFrame:
    """``lote``: lots with orders or picks that ``lot_status`` shows as of ``since`` and no longer as of ``as_of``."""

    def aged(table: DataFrame) -> DataFrame:
        left = recent(F.col("dt_addrow"), since, window_days) & ~recent(F.col("dt_addrow"), as_of, window_days)
        return table.filter((F.col("cd_empresa") == company) & left).select(F.col("cd_carga").alias("lote"))

    return aged(order_header).unionByName(aged(pick)).distinct()


def production_rows(
    pick: DataFrame,
    order_header: DataFrame,
    product: DataFrame,
    *,
    company: int = COMPANY,
    weight_by_qty: bool = False,
) -> DataFrame:
    """Picks with a quantity, with the lot of their order and their volume.

    The volume of a row is that of one piece; ``weight_by_qty=True`` multiplies it
    by the quantity. Orders of the return type or without type are left out.
    """
    picks = pick.filter((F.col("cd_empresa") == company) & (F.col("qt_separado") > 0)).select(
        "nu_pedido", "cd_produto", "dt_separacao", "qt_separado"
    )
    headers = order_header.filter(
        (F.col("cd_empresa") == company) & (F.col("tp_pedido") != RETURN_ORDER)
    ).select("nu_pedido", "cd_carga")
    m3 = F.col("m3") * F.col("qt_separado") if weight_by_qty else F.col("m3")
    return (
        picks.join(_piece_volumes(product), "cd_produto")
        .join(headers, "nu_pedido")
        .select(
            "cd_carga",
            "dt_separacao",
            amounts.round_number(F.col("qt_separado")).alias("qt"),
            m3.alias("m3"),
        )
    )


def shift_production(
    pick: DataFrame,
    order_header: DataFrame,
    product: DataFrame,
    *,
    as_of: clock.AsOf,
    window_days: int = 2,
    company: int = COMPANY,
    weight_by_qty: bool = False,
) -> DataFrame:
    """Picked quantity and volume by business date, lot, shift and hour."""
    recent_picks = pick.filter(recent_business_days(F.col("dt_separacao"), as_of, window_days))
    headers = Window(recent_picks, ["nu_pedido"]).cut(order_header, ["nu_pedido"])
    rows = production_rows(recent_picks, headers, product, company=company, weight_by_qty=weight_by_qty)
    at = F.col("dt_separacao")
    return (
        rows.groupBy(
            clock.business_date(at).alias("dia"),
            "cd_carga",
            F.hour(at).alias("h"),
        )
        .agg(F.sum("qt").alias("qt_separado"), F.sum("m3").alias("m3"))
        .orderBy("dia", clock.shift_of_hour(F.col("h")), "cd_carga", "h")
        .select(
            clock.iso_day_text(F.col("dia")).alias("dt_competencia"),
            "cd_carga",
            clock.shift_of_hour(F.col("h")).alias("turno"),
            "qt_separado",
            amounts.truncate_number(F.col("m3")).alias("cubagem"),
            codes.pad2(F.col("h")).alias("hora"),
        )
    )


def location_profile(
    location: DataFrame,
    storage_class: DataFrame,
    storage_area: DataFrame,
    location_type: DataFrame,
    location_station: DataFrame,
    station: DataFrame,
    *,
    company: int = COMPANY,
    excluded_areas: Sequence[str] = UNCOUNTED_AREAS,
) -> DataFrame:
    """One row per counted storage address and station that serves it.

    ``location_station`` links addresses to the stations of their company; an address
    without link keeps one row without station. Addresses without area are left out.
    """
    in_company = F.col("cd_empresa") == company
    counted = location.filter(in_company & ~F.col("cd_area_armaz").isin(*excluded_areas))
    links = location_station.filter(in_company).select("cd_endereco", "cd_posto")
    names = station.filter(in_company).select("cd_posto", "ds_posto")
    stations = links.join(names, "cd_posto", "left").select("cd_endereco", "ds_posto")
    parts = codes.address_parts(F.col("cd_endereco"))
    known_class = storage_class.filter(F.col("cd_classe").isin(*codes.CLASS_NAMES)).select(
        "cd_classe", codes.class_name(F.col("cd_classe")).alias("ds_classe_produto")
    )
    return (
        counted.join(known_class, "cd_classe", "left")
        .join(location_type.select("cd_tipo_endereco", "ds_tipo_endereco"), "cd_tipo_endereco", "left")
        .join(storage_area.select("cd_area_armaz", "ds_area_armaz"), "cd_area_armaz", "left")
        .join(stations, "cd_endereco", "left")
        .select(
            "cd_empresa",
            "cd_endereco",
            *(part.alias(name) for name, part in parts.items()),
            codes.address_block(parts["predio"], parts["coluna"]).alias("quadrante"),
            codes.parity(parts["coluna"]).alias("posicao"),
            codes.decode_values(F.col("id_endereco_baixo"), codes.LEVEL_NAMES).alias("nivel"),
            codes.decode_values(F.col("cd_situacao"), codes.OCCUPANCY_NAMES).alias("situacao"),
            "cd_classe",
            "ds_classe_produto",
            "cd_area_armaz",
            "ds_area_armaz",
            "cd_tipo_endereco",
            "ds_tipo_endereco",
            "ds_posto",
        )
    )


def picks_of_tasks(
    pick: DataFrame, task: DataFrame, *, company: int = COMPANY, salts: int = 0
) -> DataFrame:
    """Picks joined to the task that ordered them.

    A task names its pick run and group in a text ``run#group#...``; rows match on
    task, worker, run and group. ``salts`` spreads hot tasks over several tasks of Spark.
    """
    tasks = task.filter(
        (F.col("cd_empresa") == company)
        & F.col("cd_aplicacao").startswith(PICK_APPLICATION)
        & F.col("nu_tarefa").isNotNull()
    ).select(
        "nu_tarefa",
        "cd_funcionario",
        codes.token_number(F.col("variavel"), 0).alias("nu_separacao"),
        codes.token_number(F.col("variavel"), 1).alias("cd_grupo_separacao"),
    )
    tasks = tasks.na.drop(subset=["nu_separacao", "cd_grupo_separacao"])
    keys = ["nu_tarefa", "cd_funcionario", "nu_separacao", "cd_grupo_separacao"]
    return salted_join(pick.filter(F.col("cd_empresa") == company), tasks, keys, salts=salts)


def pick_productivity(
    pick: DataFrame,
    order_header: DataFrame,
    task: DataFrame,
    employee: DataFrame,
    location: DataFrame,
    product: DataFrame,
    family: DataFrame,
    line: DataFrame,
    *,
    as_of: clock.AsOf,
    window_days: int = 7,
    company: int = COMPANY,
    salts: int = 0,
    ordered: bool = True,
) -> DataFrame:
    """Picks by worker, address, product and second over the last business days.

    ``location`` is the result of ``location_profile``. Rows are summed by the keys
    of the pick alone; names and address parts follow from them and are attached to
    the sums. A pick counts once per station of its address, under the label of the
    station. The names of product, worker, family and line must be unique by key.
    ``ordered=False`` leaves out the global sort, for results that are stored.
    """
    at = F.col("dt_separacao")
    recent_picks = pick.filter(
        recent_business_days(at, as_of, window_days) & ~F.col("cd_endereco").startswith(UNCOUNTED_ADDRESS)
    )
    window = Window(recent_picks, ["nu_tarefa"], ["nu_pedido"])
    done = picks_of_tasks(recent_picks, window.cut(task, ["nu_tarefa"]), company=company, salts=salts)
    done = done.withColumn("dt_separacao", clock.to_second(at))
    origin = order_header.filter(F.col("cd_empresa") == company).select("nu_pedido", "nu_pedido_origem")
    sums = (
        done.join(window.cut(origin, ["nu_pedido"]), "nu_pedido", "left")
        .groupBy(
            "cd_funcionario",
            "dt_separacao",
            "cd_endereco",
            "cd_produto",
            "cd_carga",
            "nu_pedido_origem",
            "nu_tarefa",
            "nu_separacao",
            "cd_grupo_separacao",
            "cd_endereco_destino",
        )
        .agg(F.sum("qt_separado").alias("qtde_separada"))
    )
    goods = product.select(
        "cd_produto",
        "ds_produto",
        "cd_familia",
        "cd_linha",
        amounts.unit_volume(F.col("vl_altura"), F.col("vl_largura"), F.col("vl_profundidade")).alias("unit_m3"),
    )
    label = codes.station_label(F.col("ds_posto")).alias("posto")
    places = location.groupBy("cd_endereco", "rua", "predio", "coluna", "quadrante", "nivel", label)
    places = places.agg(F.count(F.lit(1)).cast("decimal(10,0)").alias("stations"))
    named = (
        sums.join(places, "cd_endereco")
        .withColumn("qtde_separada", (F.col("qtde_separada") * F.col("stations")).cast("decimal(28,6)"))
        .join(employee.select("cd_funcionario", "nm_funcionario"), "cd_funcionario", "left")
        .join(goods, "cd_produto", "left")
        .join(family.select("cd_familia", "ds_familia"), "cd_familia", "left")
        .join(line.select("cd_linha", "ds_linha"), "cd_linha", "left")
        .withColumn("m3", F.col("qtde_separada").cast("decimal(22,6)") * F.col("unit_m3"))
    )
    if ordered:
        named = named.orderBy("cd_funcionario", "dt_separacao", "nu_tarefa", "cd_endereco", "cd_produto")
    return named.select(
        F.lit(company).alias("cd"),
        "rua",
        "cd_endereco",
        clock.second_text(at).alias("dt_separacao"),
        clock.day_text(at).alias("data_separacao"),
        "posto",
        F.col("cd_funcionario").alias("id"),
        F.col("nm_funcionario").alias("nome"),
        clock.shift_of_hour(F.hour(at)).alias("turno"),
        "nu_pedido_origem",
        clock.hour_text(at).alias("hs24"),
        "qtde_separada",
        display.volume_text(F.col("m3")).alias("m3_separado"),
        F.col("m3").alias("m3_valor"),
        "cd_produto",
        "ds_produto",
        "ds_familia",
        "ds_linha",
        "predio",
        codes.pad3(F.col("coluna")).alias("n_coluna"),
        "quadrante",
        "nivel",
        F.col("cd_carga").alias("lote"),
        F.col("nu_tarefa").alias("tarefa"),
        F.col("nu_separacao").alias("separacao"),
        "cd_grupo_separacao",
        F.col("cd_endereco_destino").alias("doca"),
        clock.clock_text(at).alias("hora_separacao"),
    )

