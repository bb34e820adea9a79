"""Checks of single operators, sources, sinks, functions and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from checks import reports
from checks.registry import at, check, day, i8, n6
from checks.reports import M3, SHIFT_CASE
from checks.views import Views
from lotline.functions import amounts, clock, codes, display
from lotline.operators import aggregates, filters, joins, ordering
from lotline.operators.joins import Window
from lotline.plans import backlog, backlog_views, closing, delivery, receiving, warehouse
from lotline.sources import sheets, tables
from lotline.sources.snapshots import read_snapshot, scratch_dir, write_snapshot
from lotline.streaming.refresh import maintain_on_arrival, maintained, of_keys
from lotline.streaming.shifts import store_hours, stored_shift_production

# ---- sources and sinks


@check(
    "read_table",
    f"select o_orderkey, o_custkey, o_orderstatus, {at('o_orderdate')} o_orderdate from orders",
)
def _(v):
    orders = tables.read_table(v.spark, "orders", v.sf_dir)
    return orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")


def comma_cells(v: Views) -> DataFrame:
    def cell(name: str):
        return F.replace(F.col(name).cast("string"), F.lit("."), F.lit(",")).alias(name)

    return v.erp_item.select(F.col("numpedven").cast("string"), cell("qtcomp"), cell("precounit"))


def positional(v: Views) -> DataFrame:
    path = scratch_dir(v.spark, "range")
    comma_cells(v).write.csv(path, header=False)
    return sheets.read_positional(v.spark, path, ["NUMPEDVEN", "QTCOMP", "PRECOUNIT"])


@check(
    "read_positional",
    """select cast(numpedven as varchar) "NUMPEDVEN", replace(cast(qtcomp as varchar), '.', ',') "QTCOMP",
              replace(cast(precounit as varchar), '.', ',') "PRECOUNIT" from erp_item""",
)
def _(v):
    return positional(v)


@check(
    "read_headed",
    "select cast(pedido as varchar) pedido, transp_corrigida, finalizador, status_prazo from delivery",
)
def _(v):
    path = scratch_dir(v.spark, "headed")
    v.delivery.write.csv(path, header=True)
    return sheets.read_headed(v.spark, path, 4)


@check("select_columns", 'select lote "Lote", pendente_sep "Pendente Sep", pendente_conf "Pendente Conf" from x_lots')
def _(v):
    picked = {"Lote": "lote", "Pendente Sep": "pendente_sep", "Pendente Conf": "pendente_conf"}
    return sheets.select_columns(reports.lots(v), picked)


@check(
    "read_lookups",
    """
    select 'modes' tab, codmodal chave, modal_master valor from mode_map
    union all select 'branches', cod, filial from branch_map
    union all select 'cities', rota, cidade from city_map""",
)
def _(v):
    path = scratch_dir(v.spark, "lookups")
    for tab, df in {"modes": v.mode_map, "branches": v.branch_map, "cities": v.city_map}.items():
        df.write.parquet(f"{path}/{tab}")
    parts = [
        df.select(F.lit(tab).alias("tab"), F.col(df.columns[0]).alias("chave"), F.col(df.columns[1]).alias("valor"))
        for tab, df in sheets.read_lookups(v.spark, path).items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@check("read_csv_fill", reports.GATE_SQL)
def _(v):
    return sheets.read_csv_fill(v.spark, reports.gate_csv(v))


KPIS = ["total_pedidos", "pendentes", "ns", "saldo_meta", "saldo_pendentes"]


@check(
    "kpi_block",
    "select " + ", ".join(f"max(value) filter (pos = {i}) {name}" for i, name in enumerate(KPIS)) + " from kpi_cells",
)
def _(v):
    return sheets.kpi_block(v.kpi_cells, KPIS)


@check("write_snapshot", "select * from x_lots")
def _(v):
    path = scratch_dir(v.spark, "snapshot")
    write_snapshot(reports.lots(v, unmatched_pending="full"), path)
    write_snapshot(reports.lots(v), path)
    return read_snapshot(v.spark, path)


@check("write_snapshot_headed", "select cast(pedido as varchar) pedido, transp_corrigida, status_prazo from delivery")
def _(v):
    path = scratch_dir(v.spark, "snapshot")
    write_snapshot(v.delivery.select("pedido", "transp_corrigida", "status_prazo"), path, fmt="csv", header=True)
    return read_snapshot(v.spark, path, fmt="csv", header=True)


@check(
    "text_export",
    "select "
    + ", ".join(
        f"coalesce(cast({c} as varchar), 'None') {c}"
        for c in ("numpedven", "codfiltransffat", "codmodal", "dtpedido", "numlote")
    )
    + " from erp_order",
)
def _(v):
    columns = v.erp_order.select("numpedven", "codfiltransffat", "codmodal", "dtpedido", "numlote")
    return display.text_export(columns, null_text="None")


# ---- projections, filters, predicates


@check(
    "project",
    """select cd_agenda, nu_etiqueta_lote etiqueta, 'AGRUPADA' tp_etiqueta, cd_endereco from label_grouped""",
)
def _(v):
    return v.label_grouped.select(
        "cd_agenda", F.col("nu_etiqueta_lote").alias("etiqueta"), F.lit("AGRUPADA").alias("tp_etiqueta"), "cd_endereco"
    )


STATUS_SQL = """
    case when fllibfat = 'N' then '1-Nao Liberado' when sitcarga = 2 then '6-Conferido Aguardando Fat'
         when sitcarga = 8 then '8-Venda Pendente SEFAZ' when sitcarga = 9 then '9-Bloqueado Expedicao'
         when sitcarga = 14 then '14-Eficiencia Energetica' when t.flseparacao = 'N' then '3-Lote montado'
         when t.flseparacao in ('B', 'R') then '4-Lote em Separacao' when t.flseparacao = 'C' then '5-Lote em Conferencia'
         else '2-Liberado' end"""
LOT_JOIN = "from erp_order o left join erp_lot t on t.nlote = o.numlote and t.codfil = o.filorig"


def with_lot(v: Views) -> DataFrame:
    return backlog.with_lot_state(backlog.with_lot_flags(v.erp_order, v.erp_lot))


@check("classify_case", f"select numpedven, {STATUS_SQL} status {LOT_JOIN}")
def _(v):
    return with_lot(v).select("numpedven", backlog.line_status().alias("status"))


@check(
    "decode_values",
    """select numpedven, case tipoped when 0 then 'VENDAS' when 2 then 'ABA' end tipo_pedido,
              case codfil when 200 then 'SITE' else 'REDE' end canal from erp_order""",
)
def _(v):
    return v.erp_order.select(
        "numpedven",
        codes.decode_values(F.col("tipoped"), backlog.ORDER_KINDS).alias("tipo_pedido"),
        codes.decode_values(F.col("codfil"), {200: "SITE"}, "REDE").alias("canal"),
    )


@check(
    "class_code_map",
    """select cd_endereco, case cd_classe when '26ACE' then 'ACESSORIOS' when '26BEB' then 'BEBIDAS'
              when '26TV' then 'TV - IMAGEM' when 'VND' then 'VENDIDOS' end ds_classe from location""",
)
def _(v):
    return v.location.select("cd_endereco", codes.class_name(F.col("cd_classe")).alias("ds_classe"))


@check(
    "in_filter",
    """select numpedven, sitcarga from (select numpedven, cast(sitcarga as bigint) sitcarga, codfiltransffat
       from erp_order) where sitcarga in (0, 1, 2, 8, 9, 14) and codfiltransffat not in (17, 9)""",
)
def _(v):
    kept = F.col("sitcarga").isin(*backlog.OPEN_LOADS) & ~F.col("codfiltransffat").isin(17, 9)
    return v.erp_order.filter(kept).select("numpedven", "sitcarga")


@check("nvl_guard_filter", "select numpedven, flcredlista from erp_order where coalesce(flcredlista, 'X') <> 'G'")
def _(v):
    return filters.filter_ne_keep_null(v.erp_order, "flcredlista", "G").select("numpedven", "flcredlista")


@check("neq_filter_sql", f"select numpedven, {i8('codfiltransffat')} codfiltransffat from erp_order where codfiltransffat <> 98")
def _(v):
    return v.erp_order.filter(F.col("codfiltransffat") != 98).select("numpedven", "codfiltransffat")


@check("neq_filter_keep_missing", "select pedido, regional from delivery where regional <> 'CORREIOS' or regional is null")
def _(v):
    return filters.filter_ne_keep_null(v.delivery, "regional", "CORREIOS").select("pedido", "regional")


@check(
    "compound_not",
    f"""select nu_pedido_origem, cd_produto, {i8('h.cd_situacao')} cab, {i8('l.cd_situacao')} lin
        from order_header h join order_line l using (nu_pedido_origem)
        where not (h.cd_situacao <> 64 and l.cd_situacao = 64)""",
)
def _(v):
    heads = v.order_header.select("nu_pedido_origem", F.col("cd_situacao").alias("cab"))
    lines = v.order_line.select("nu_pedido_origem", "cd_produto", F.col("cd_situacao").alias("lin"))
    hidden = filters.closed_line_of_open_order(F.col("cab"), F.col("lin"), warehouse.CLOSED)
    return heads.join(lines, "nu_pedido_origem").filter(~hidden)


@check(
    "or_of_ands",
    """select numpedven from erp_order
       where sitcarga in (0, 1, 2, 8, 9, 14) and tpped = 'E' and filorig = 2650 and coalesce(flcredlista, '') <> 'G'
         and ((tpnota in (55, 536, 655, 665) and status = 4)
              or (tpnota = 51 and status = 5 and coalesce(fltransffatnf, '') <> 'S'))""",
)
def _(v):
    return v.erp_order.filter(backlog.eligible()).select("numpedven")


@check(
    "prefix_filter",
    """select nu_tarefa, cd_endereco from task join pick_event using (nu_tarefa)
       where cd_aplicacao like 'CSE020%' and cd_endereco not like 'T99%'""",
)
def _(v):
    tasks = v.task.filter(F.col("cd_aplicacao").startswith("CSE020")).select("nu_tarefa")
    picks = v.pick_event.filter(~F.col("cd_endereco").startswith("T99"))
    return picks.join(tasks, "nu_tarefa").select("nu_tarefa", "cd_endereco")


@check(
    "range_text_filter",
    "select cd_endereco from location where substr(cd_endereco, 4, 3) between '000' and '037'",
)
def _(v):
    return v.location.filter(F.substring("cd_endereco", 4, 3).between("000", "037")).select("cd_endereco")


@check(
    "recent_rows",
    f"""select nu_pedido, {at('dt_addrow')} dt_addrow from order_header
        where dt_addrow >= timestamp '2001-08-02' - interval 400 day""",
)
def _(v):
    rows = filters.recent_rows(v.order_header, "dt_addrow", "2001-08-02", 400)
    return rows.select("nu_pedido", "dt_addrow")


@check(
    "recent_business_rows",
    f"""select nu_pedido, {at('dt_separacao')} dt_separacao from pick_event
        where cast(dt_separacao as date) - if(hour(dt_separacao) < 6, 1, 0) >= date '2024-01-23'""",
)
def _(v):
    recent = filters.recent_business_days(F.col("dt_separacao"), reports.PICK_AS_OF, 7)
    return v.pick_event.filter(recent).select("nu_pedido", "dt_separacao")


@check("pending_mask", "select pedido, transp_corrigida, status_prazo from x_pending")
def _(v):
    return delivery.pending_deliveries(v.delivery).select("pedido", "transp_corrigida", "status_prazo")


@check("sales_not_scheduled", f"select numpedven, item, {n6('valtotal')} valtotal from x_sales")
def _(v):
    return closing.sales_not_scheduled(reports.orders_listed(v)).select("numpedven", "item", "valtotal")


# ---- joins


@check(
    "inner_join_composite",
    f"""select h.nu_pedido, l.cd_produto, {n6('qt_separar')} qt_separar
        from order_header h join order_line l
          on l.cd_empresa = h.cd_empresa and l.nu_pedido_origem = h.nu_pedido_origem and l.cd_situacao <> 68""",
)
def _(v):
    lines = v.order_line.filter(F.col("cd_situacao") != 68).drop("cd_situacao")
    joined = v.order_header.join(lines, ["cd_empresa", "nu_pedido_origem"])
    return joined.select("nu_pedido", "cd_produto", "qt_separar")


@check(
    "comma_join",
    f"""select cd_carga, {n6('qt')} qt, {n6('m3')} m3, {at('dt_separacao')} dt_separacao from (
          select h.cd_carga, round(qt_separado, 0) qt, cast({M3} as decimal(18,0)) * 0.000001 m3, dt_separacao
          from pick_event p, order_header h, product g
          where p.cd_empresa = h.cd_empresa and p.nu_pedido = h.nu_pedido and p.cd_produto = g.cd_produto
            and qt_separado > 0 and tp_pedido not in ('RMN'))""",
)
def _(v):
    return warehouse.production_rows(v.pick_event, v.order_header, v.product)


@check(
    "left_join",
    f"select p.lote, {n6('qty')} programacao, {n6('picked')} separado from x_plan p left join x_done d on d.lote = p.lote",
)
def _(v):
    window = dict(as_of=reports.LOT_AS_OF, window_days=reports.LOT_DAYS)
    plan = warehouse.programmed_lots(v.order_header, v.order_line, v.product, **window)
    done = warehouse.picked_lots(v.pick_lot, v.product, **window)
    return plan.join(done, "lote", "left").select("lote", "programacao", "separado")


@check("legacy_outer_join", f"select numpedven, numlote, t.flseparacao {LOT_JOIN}")
def _(v):
    return with_lot(v).select("numpedven", "numlote", "flseparacao")


@check("multi_left_join", "select cd_endereco, ds_classe_produto, ds_area_armaz, ds_tipo_endereco, ds_posto from x_places")
def _(v):
    return reports.profile(v).select(
        "cd_endereco", "ds_classe_produto", "ds_area_armaz", "ds_tipo_endereco", "ds_posto"
    )


@check(
    "null_rejecting_left_join",
    """select d.cd_agenda, r.cd_produto_master from divergent_appointment d
       left join receipt r on r.cd_empresa = d.cd_empresa and r.cd_agenda = d.cd_agenda where r.cd_situacao in (10, 11)""",
)
def _(v):
    open_lines = v.receipt.filter(F.col("cd_situacao").isin(*receiving.OPEN_RECEIPTS))
    joined = v.divergent_appointment.join(open_lines, ["cd_empresa", "cd_agenda"])
    return joined.select("cd_agenda", "cd_produto_master")


@check(
    "lookup_scalar",
    """select nu_etiqueta, cd_produto,
              (select ds_produto from product p where p.cd_produto = s.cd_produto) ds_produto from label_single s""",
)
def _(v):
    named = joins.lookup_one(v.label_single, v.product.select("cd_produto", "ds_produto"), ["cd_produto"])
    return named.select("nu_etiqueta", "cd_produto", "ds_produto")


@check(
    "lookup_scalar_multi",
    """select numpedven, case when a.rota = 'NORTE' and codmodal = 'COU' then 'SEDEX'
              when a.rota = 'NORTE' and codmodal <> 'COU' then 'FAVORITA' else a.rota end rota
       from erp_order o left join x_routes a on a.praca = o.praca""",
)
def _(v):
    routes = backlog.route_of_area(v.erp_area, v.erp_area_route, v.erp_route)
    joined = v.erp_order.join(routes, "praca", "left")
    return joined.select("numpedven", backlog.delivery_route().alias("rota"))


@check(
    "first_match_lookup",
    f"""select numpedven, {at('''case when codfil = 200 then
              (select min(dthora_int) from erp_site_time s where s.numpedven = o.numpedven) else hrpedido end''')} dtlibfat_mod
        from erp_order o""",
)
def _(v):
    return backlog.release_time(v.erp_order, v.erp_site_time).select("numpedven", "dtlibfat_mod")


@check(
    "left_join_at_most_one",
    f"""select numpedven, i.coditprod, r.numpedcomp, r.codsitprod, {at('reserved_at')} dtreserva
        from erp_item i join erp_order o using (numpedven)
        left join x_reserved r on r.codreserva = o.codreserva and r.coditprod = i.coditprod""",
)
def _(v):
    first = backlog.first_reservations(v.erp_reservation)
    lines = v.erp_item.select("numpedven", "coditprod").join(v.erp_order.select("numpedven", "codreserva"), "numpedven")
    joined = lines.join(first, ["codreserva", "coditprod"], "left")
    return joined.select("numpedven", "coditprod", "numpedcomp", "codsitprod", "dtreserva")


@check(
    "existence_join",
    f"select coditprod, {i8('codembal')} codembal, item, linha, familia, {n6('cm3 * 0.000001')} cub_unit from x_goods",
)
def _(v):
    return backlog.goods(reports.tables(v)).drop("descricao")


@check(
    "fanout_join",
    """select d.cd_empresa::bigint cd_empresa, d.cd_agenda from divergent_appointment d
       left join invoice i on i.cd_empresa = d.cd_empresa and i.cd_agenda = d.cd_agenda""",
)
def _(v):
    return v.divergent_appointment.join(v.invoice, ["cd_empresa", "cd_agenda"], "left")


@check(
    "parsed_key_join",
    """select p.nu_pedido, t.nu_tarefa, t.nu_separacao, t.cd_grupo_separacao
       from pick_event p join x_tasks t using (nu_tarefa, cd_funcionario, nu_separacao, cd_grupo_separacao)""",
)
def _(v):
    done = warehouse.picks_of_tasks(v.pick_event, v.task)
    return done.select("nu_pedido", "nu_tarefa", "nu_separacao", "cd_grupo_separacao")


@check(
    "salted_join",
    f"""select i.numpedven, i.coditprod, {n6('qtcomp')} qtcomp, o.codmodal, r.numpedcomp
        from erp_item i join erp_order o using (numpedven)
        left join x_reserved r on r.codreserva = o.codreserva and r.coditprod = i.coditprod""",
)
def _(v):
    orders = v.erp_order.select("numpedven", "codreserva", "codmodal")
    items = v.erp_item.select("numpedven", "coditprod", "qtcomp")
    first = backlog.first_reservations(v.erp_reservation).select("codreserva", "coditprod", "numpedcomp")
    lines = joins.salted_join(items, orders, ["numpedven"], salts=8, share=0.0001)
    joined = joins.salted_join(lines, first, ["codreserva", "coditprod"], "left", salts=8, share=0.0001)
    return joined.drop("codreserva")


@check(
    "lookup_merge",
    """select numpedven, o.codmodal, modal_master, cod, filial from erp_order o
       left join mode_map m on m.codmodal = o.codmodal
       left join branch_map b on b.cod = cast(o.codfiltransffat as varchar)""",
)
def _(v):
    orders = v.erp_order.select("numpedven", "codmodal", "codfiltransffat")
    merged = joins.lookup_merge(orders, v.mode_map, {"codmodal": "codmodal"})
    return joins.lookup_merge(merged, v.branch_map, {"codfiltransffat": "cod"}).drop("codfiltransffat")


@check(
    "enrich_topk",
    f"""select l.lote, {n6('t.pedidos')} pedidos, l.pendente_sep
        from (select numlote, count(*) pedidos from erp_order group by 1 order by 2 desc, 1 nulls first limit 10) t
        left join x_lots l on l.lote = t.numlote""",
)
def _(v):
    counts = v.erp_order.groupBy("numlote").agg(F.count(F.lit(1)).cast("double").alias("pedidos"))
    top = ordering.top_rows(counts, ["pedidos"], "numlote", 10)
    pending = reports.lots(v).select("lote", "pendente_sep")
    return top.join(pending, top.numlote == pending.lote, "left").select("lote", "pedidos", "pendente_sep")


# ---- aggregations


@check(
    "agg_sum_min_distinct",
    f"""select lote, {at('first_at')} dt_corte, {i8('state')} cd_situacao, {n6('qty')} programacao,
               {n6('m3')} cub_programada, {i8('orders')} pedidos from x_plan""",
)
def _(v):
    return warehouse.programmed_lots(
        v.order_header, v.order_line, v.product, as_of=reports.LOT_AS_OF, window_days=reports.LOT_DAYS
    )


@check(
    "agg_null_safe_sum",
    f"""select cd_produto, {n6('sum(qt_separar - coalesce(qt_cancelada, 0))')} saldo,
               {n6('sum(coalesce(qt_cancelada, 0))')} cancelado from order_line group by cd_produto""",
)
def _(v):
    cancelled = amounts.zero_if_null(F.col("qt_cancelada"))
    return v.order_line.groupBy("cd_produto").agg(
        F.sum(F.col("qt_separar") - cancelled).alias("saldo"), F.sum(cancelled).alias("cancelado")
    )


@check(
    "agg_volume",
    f"""select lote, {n6('picked')} separado, {n6('checked')} conferido, {n6('picked_m3')} cub_separada,
               {n6('checked_m3')} cub_conferida from x_done""",
)
def _(v):
    return warehouse.picked_lots(v.pick_lot, v.product, as_of=reports.LOT_AS_OF, window_days=reports.LOT_DAYS)


@check(
    "agg_derived_keys",
    f"""with p as (select *, hour(dt_separacao) h, cast(dt_separacao as date) d from pick_event)
        select {day('d - if(h < 6, 1, 0)')} dia, cd_carga, {SHIFT_CASE} turno, {n6('sum(qt_separado)')} qt
        from p group by all""",
)
def _(v):
    ts = F.col("dt_separacao")
    keys = [clock.business_date(ts).alias("dia"), "cd_carga", clock.shift_of_hour(F.hour(ts)).alias("turno")]
    return v.pick_event.groupBy(*keys).agg(F.sum("qt_separado").alias("qt"))


@check(
    "agg_wide_keys",
    reports.grouped_picks(
        f"""
    select cd_funcionario id, nm_funcionario nome, strftime(dt_separacao, '%d/%m/%Y %H:%M:%S') dt_separacao,
           cd_endereco, quadrante, {reports.STATION_CASE} posto, cd_produto, ds_familia, ds_linha,
           nu_pedido_origem, cd_carga lote, nu_tarefa tarefa, {n6('sum(qt_separado)')} qtde_separada
    from named group by all""",
        since="2024-01-27",
    ),
)
def _(v):
    return reports.productivity(v, window_days=3, ordered=False).select(
        "id", "nome", "dt_separacao", "cd_endereco", "quadrante", "posto", "cd_produto", "ds_familia", "ds_linha",
        "nu_pedido_origem", "lote", "tarefa", "qtde_separada",
    )


@check("distinct_rows", "select distinct cd_agenda, cd_produto from label_grouped")
def _(v):
    return v.label_grouped.select("cd_agenda", "cd_produto").distinct()


@check(
    "group_sum_multi",
    f"""select flmovitpedkit kit, {n6('sum(qtcomp)')} pecas, {n6('sum(precounit)')} precos from erp_item group by 1""",
)
def _(v):
    sums = aggregates.group_sums(v.erp_item, "flmovitpedkit", {"pecas": "qtcomp", "precos": "precounit"})
    return sums.withColumnRenamed("flmovitpedkit", "kit")


ITEM_VALUE = "cast(qtcomp as decimal(38,6)) * precounit"


@check(
    "group_sum_filtered",
    f"""select numpedven, {n6(f'sum({ITEM_VALUE})')} valor from erp_item where coalesce(flmovitpedkit, 'X') <> 'S' group by 1""",
)
def _(v):
    plain = filters.filter_ne_keep_null(v.erp_item, "flmovitpedkit", "S")
    valued = plain.withColumn("valor", amounts.line_amount(F.col("qtcomp"), F.col("precounit")))
    return aggregates.group_sums(valued, "numpedven", {"valor": "valor"})


@check(
    "nunique_by_group",
    f"""select coditprod, count(distinct numpedven) pedidos, {n6('sum(qtcomp)')} pecas from erp_item group by 1""",
)
def _(v):
    return aggregates.distinct_counts(v.erp_item, "coditprod", "numpedven", "pedidos", {"pecas": "qtcomp"})


@check("nunique_global", "select count(distinct numlote) lotes from erp_order where sitcarga = 2")
def _(v):
    return v.erp_order.filter(F.col("sitcarga") == 2).agg(F.countDistinct("numlote").alias("lotes"))


@check(
    "conditional_sum",
    f"""select coditprod, {n6("coalesce(sum(qtcomp) filter (flmovitpedkit = 'S'), 0)")} kit,
               {n6("coalesce(sum(qtcomp) filter (flmovitpedkit = 'N'), 0)")} avulso from erp_item group by 1""",
)
def _(v):
    flag, qty = F.col("flmovitpedkit"), F.col("qtcomp")
    return v.erp_item.groupBy("coditprod").agg(
        aggregates.conditional_sum(flag == "S", qty).alias("kit"),
        aggregates.conditional_sum(flag == "N", qty).alias("avulso"),
    )


@check("flag_counts", f"select transp_corrigida, {reports.DUE_COUNTS} from x_pending group by 1")
def _(v):
    rows = delivery.pending_deliveries(v.delivery)
    return rows.groupBy("transp_corrigida").agg(*delivery.due_counts())


@check(
    "total_row",
    """select transp_corrigida, count(*) pedidos from delivery group by 1
       union all select 'Total', count(*) from delivery""",
)
def _(v):
    counts = v.delivery.groupBy("transp_corrigida").agg(F.count(F.lit(1)).alias("pedidos"))
    return aggregates.total_row(counts, "transp_corrigida", ["pedidos"])


@check("grand_totals", f"select {reports.DUE_COUNTS} from x_pending")
def _(v):
    return delivery.due_totals(v.delivery)


@check(
    "global_ratio",
    f"""with t as (select sum(cast(qtcomp as double)) q from erp_item)
        select 'Carteira Atual' tipo, {n6('q')} valor from t union all select 'Capacidade', 1061.0::double
        union all select 'Dias Em Carteira', {n6('q / 1061')} from t""",
)
def _(v):
    days = backlog_views.days_in_backlog(v.erp_item.select(F.col("qtcomp").alias("cubtotal")))
    return days.withColumn("valor", F.round("valor", 6))


PIVOT_CELLS = ", ".join(
    f"count(*) filter (status_prazo = '{s}') \"{s}\"" for s in (delivery.LATER, delivery.TODAY, delivery.OVERDUE)
)


def due_counts(v: Views) -> DataFrame:
    return v.delivery.groupBy("transp_corrigida", "status_prazo").agg(F.count(F.lit(1)).alias("n"))


@check("pivot_sum", f"select regional, {PIVOT_CELLS} from delivery where regional is not null group by 1")
def _(v):
    counted = v.delivery.withColumn("n", F.lit(1))
    due = [delivery.LATER, delivery.TODAY, delivery.OVERDUE]
    return aggregates.pivot_sum(counted, "regional", "status_prazo", "n", due)


@check("pivot_margin", f"""select transp_corrigida, {PIVOT_CELLS}, count(*) "Total" from delivery group by 1""")
def _(v):
    due = [delivery.LATER, delivery.TODAY, delivery.OVERDUE]
    table = aggregates.pivot_sum(due_counts(v), "transp_corrigida", "status_prazo", "n", due)
    return aggregates.pivot_margin(table, "transp_corrigida", due)


@check("two_phase_pivot", f"select transp_corrigida, {PIVOT_CELLS} from delivery group by 1")
def _(v):
    due = [delivery.LATER, delivery.TODAY, delivery.OVERDUE]
    return aggregates.pivot_sum(due_counts(v), "transp_corrigida", "status_prazo", "n", due)


@check(
    "target_gap",
    f"""select {n6('sum(valtotal)')} resultado, {i8('5000000')} meta, {n6('sum(valtotal) - 5000000')} dif,
               sum(valtotal) > 5000000 acima from x_sales""",
)
def _(v):
    return closing.result_vs_target(reports.orders_listed(v), target=5000000)


# ---- order, limit, top-k


@check("order_by_multi", f"select cd_agenda, etiqueta, tp_etiqueta, {at('dt_conferencia')} dt_conferencia from x_received")
def _(v):
    labels = receiving.received_labels(v.label_grouped, v.label_single, company=1590)
    return labels.orderBy("dt_conferencia", "etiqueta", "cd_produto").select(
        "cd_agenda", "etiqueta", "tp_etiqueta", "dt_conferencia"
    )


@check("sort_rows", "select cast(numpedven as varchar) numpedven, codmodal from erp_order")
def _(v):
    return v.erp_order.select(F.col("numpedven").cast("string"), "codmodal").orderBy("numpedven", "codmodal")


@check(
    "topk_rows",
    f"select coditprod, {n6('sum(qtcomp)')} pecas from erp_item group by 1 order by sum(qtcomp) desc, 1 limit 10",
)
def _(v):
    return ordering.top_rows(aggregates.group_sums(v.erp_item, "coditprod", {"pecas": "qtcomp"}), ["pecas"], "coditprod", 10)


@check(
    "topk_two_keys",
    f"select coditprod, {reports.i8('count(*)')} n, {n6('sum(qtcomp)')} pecas from erp_item group by 1 order by 2 desc, 3 desc, 1 limit 26",
)
def _(v):
    rows = v.erp_item.groupBy("coditprod").agg(F.count(F.lit(1)).alias("n"), F.sum("qtcomp").alias("pecas"))
    return ordering.top_rows(rows, ["n", "pecas"], "coditprod", 26)


@check("head_groups", f"select coditprod, {n6('sum(qtcomp)')} pecas from erp_item group by 1 order by 1 limit 10")
def _(v):
    return ordering.first_rows(aggregates.group_sums(v.erp_item, "coditprod", {"pecas": "qtcomp"}), "coditprod", 10)


@check(
    "topk_columns",
    """select transp_corrigida, count(*) filter (regional = 'AUTOMOBILE') "AUTOMOBILE",
              count(*) filter (regional = 'FURNITURE') "FURNITURE", count(*) filter (regional = 'CORREIOS') "CORREIOS",
              count(*) filter (regional = 'FRACIONADO') "FRACIONADO"
       from delivery where regional is not null group by 1""",
)
def _(v):
    counted = v.delivery.withColumn("n", F.lit(1))
    shown = ordering.top_categories(counted, "regional", "n", 5)
    return aggregates.pivot_sum(counted, "transp_corrigida", "regional", "n", shown)


@check("head_then_sort", reports.MATRIX_SQL)
def _(v):
    labels = list(reports.LABELS.values())
    table = aggregates.pivot_sum(delivery.due_today(v.delivery), "transp_corrigida", "rotulo", "n", labels)
    return ordering.head_then_sort(table, "transp_corrigida", 16, "Em Entrega")


# ---- set operations


@check("union_all_labels", f"select cd_agenda, etiqueta, cd_produto, tp_etiqueta, qt_conferido from x_received")
def _(v):
    labels = receiving.received_labels(v.label_grouped, v.label_single, company=1590)
    return labels.select("cd_agenda", "etiqueta", "cd_produto", "tp_etiqueta", "qt_conferido")


@check(
    "union_all_distinct_branches",
    f"""select numpedven, item, {n6('qtcomp')} qtcomp, {n6('precounit')} precounit, familia, modalidade,
               {at('dtlibfat_mod')} dtlibfat_mod
        from x_lines where fllibfat = 'S' and codfiltransffat <> 98""",
)
def _(v):
    t = reports.tables(v)
    return backlog.backlog_lines(t, backlog.listed_orders(t)).select(
        "numpedven", "item", "qtcomp", "precounit", "familia", "modalidade", "dtlibfat_mod"
    )


# ---- scalar functions

TS = "dt_separacao"


@check(
    "fmt_date",
    f"""select nu_pedido, strftime({TS}, '%d/%m/%Y') a, strftime({TS}, '%d/%m/%Y %H:%M') b,
               strftime({TS}, '%d/%m/%Y %H:%M:%S') c, strftime({TS}, '%Y-%m-%d') d, strftime({TS}, '%H') e,
               strftime({TS}, '%H:%M:%S') f from pick_event""",
)
def _(v):
    ts = F.col(TS)
    styles = [
        clock.day_text, clock.minute_text, clock.second_text, clock.iso_day_text, clock.hour_text, clock.clock_text
    ]
    return v.pick_event.select("nu_pedido", *(style(ts).alias(name) for style, name in zip(styles, "abcdef")))


@check("business_date", f"select nu_pedido, {day(f'cast({TS} - interval 6 hour as date)')} dia from pick_event")
def _(v):
    return v.pick_event.select("nu_pedido", clock.business_date(F.col(TS)).alias("dia"))


@check("shift_of_hour", f"select nu_pedido, {SHIFT_CASE} turno from (select *, hour({TS}) h from pick_event)")
def _(v):
    return v.pick_event.select("nu_pedido", clock.shift_of_hour(F.hour(TS)).alias("turno"))


@check("age_days", "select nu_pedido, date_diff('day', cast(dt_addrow as date), date '2001-12-01') dias from order_header")
def _(v):
    return v.order_header.select("nu_pedido", clock.age_days("2001-12-01 15:00:00", F.col("dt_addrow")).alias("dias"))


@check(
    "parse_timestamp",
    f"""select nu_pedido, {at(TS)} segundo, {at(f"try_strptime(if(nu_pedido % 3 = 0, 'x', {at(TS)}), '%Y-%m-%d %H:%M:%S')")} lido
        from pick_event""",
)
def _(v):
    text = F.when(F.col("nu_pedido") % 3 == 0, "x").otherwise(F.date_format(TS, "yyyy-MM-dd HH:mm:ss"))
    return v.pick_event.select(
        "nu_pedido", clock.to_second(F.col(TS)).alias("segundo"), clock.text_to_time(text).alias("lido")
    )


@check("trunc_date", f"select nu_pedido, {day(TS)} dia from pick_event")
def _(v):
    return v.pick_event.select("nu_pedido", F.to_date(TS).alias("dia"))


@check(
    "trunc_num",
    """select nu_pedido, cast(trunc(x * 100) as double) / 100 + 0.0::double cortado
       from (select nu_pedido, (qt_separado - 30) * 0.123 x from pick_event)""",
)
def _(v):
    value = ((F.col("qt_separado") - 30) * F.lit(0.123).cast("decimal(4,3)")).cast("decimal(20,9)")
    return v.pick_event.select("nu_pedido", amounts.truncate_number(value).alias("cortado"))


@check(
    "round_num",
    "select nu_pedido, cast(round((qt_separado - 30) * cast(0.5 as decimal(3,1)), 0) as double) inteiro from pick_event",
)
def _(v):
    half = (F.col("qt_separado") - 30) * F.lit(0.5).cast("decimal(3,1)")
    return v.pick_event.select("nu_pedido", amounts.round_number(half).alias("inteiro"))


@check("null_default", f"select cd_produto, {n6('coalesce(qt_cancelada, 0)')} cancelado from order_line")
def _(v):
    return v.order_line.select("cd_produto", amounts.zero_if_null(F.col("qt_cancelada")).alias("cancelado"))


@check(
    "latest_of",
    f"""select numpedven, {at('''case (dtpedido is null)::int + (dtentrega is null)::int + (hrpedido is null)::int
              when 0 then greatest(hrpedido, dtpedido, dtentrega)
              when 1 then greatest(coalesce(hrpedido, dtpedido), coalesce(dtpedido, dtentrega), coalesce(dtentrega, hrpedido))
              end''')} ultima from erp_order""",
)
def _(v):
    latest = clock.latest_of(F.col("hrpedido"), F.col("dtpedido"), F.col("dtentrega"))
    return v.erp_order.select("numpedven", latest.alias("ultima"))


@check("concat_code", "select coditprod, cast(coditprod as varchar) || coalesce(cast(digitprod as varchar), '') item from erp_item_product")
def _(v):
    item = codes.concat_code(F.col("coditprod"), F.col("digitprod"))
    return v.erp_item_product.select("coditprod", item.alias("item"))


@check(
    "substr_parts",
    """select cd_endereco, cd_endereco[1:1] predio, cd_endereco[1:3] rua, cd_endereco[4:6] coluna,
              cd_endereco[7:9] nivel2, cd_endereco[10:12] sala from location""",
)
def _(v):
    parts = codes.address_parts(F.col("cd_endereco"))
    return v.location.select("cd_endereco", *(part.alias(name) for name, part in parts.items()))


@check(
    "address_block",
    """select cd_endereco, case when p not in ('P', 'B', 'G') or c > 199 then ''
              when c < if(p = 'P', 38, 34) then '1 BLOCO' when c < if(p = 'P', 76, 68) then '2 BLOCO' else '3 BLOCO' end quadrante
       from (select cd_endereco, cd_endereco[1:1] p, cast(cd_endereco[4:6] as int) c from location)""",
)
def _(v):
    parts = codes.address_parts(F.col("cd_endereco"))
    block = codes.address_block(parts["predio"], parts["coluna"])
    return v.location.select("cd_endereco", block.alias("quadrante"))


@check(
    "parity",
    "select cd_endereco, if(right(cd_endereco[4:6], 1) in ('0', '2', '4', '6', '8'), 'PAR', 'IMPAR') posicao from location",
)
def _(v):
    return v.location.select("cd_endereco", codes.parity(F.substring("cd_endereco", 4, 3)).alias("posicao"))


@check(
    "token_number",
    """select nu_tarefa, try_cast(nullif(regexp_extract(variavel, '^([^#]*)#([^#]*)#', 1), '') as bigint) separacao,
              try_cast(nullif(regexp_extract(variavel, '^([^#]*)#([^#]*)#', 2), '') as bigint) grupo from task""",
)
def _(v):
    text = F.col("variavel")
    return v.task.select(
        "nu_tarefa", codes.token_number(text, 0).alias("separacao"), codes.token_number(text, 1).alias("grupo")
    )


@check(
    "fmt_volume_text",
    "select nu_pedido, replace(cast(cast(qt_separado as decimal(18,6)) as varchar), '.', ',') texto from pick_event",
)
def _(v):
    return v.pick_event.select("nu_pedido", display.volume_text(F.col("qt_separado")).alias("texto"))


@check("pad3", "select nu_pedido, lpad(cast(nu_separacao % 100 as varchar), 3, '0') coluna from pick_event")
def _(v):
    return v.pick_event.select("nu_pedido", codes.pad3((F.col("nu_separacao") % 100).cast("string")).alias("coluna"))


@check("unit_volume", f"select cd_produto, {n6(f'cast({M3} as decimal(18,0)) * 0.000001')} m3 from product")
def _(v):
    sides = (F.col("vl_altura"), F.col("vl_largura"), F.col("vl_profundidade"))
    return v.product.select("cd_produto", amounts.unit_volume(*sides).alias("m3"))


@check("line_amounts", f"select numpedven, coditprod, {n6(ITEM_VALUE)} valor from erp_item")
def _(v):
    value = amounts.line_amount(F.col("qtcomp"), F.col("precounit"))
    return v.erp_item.select("numpedven", "coditprod", value.alias("valor"))


@check(
    "parse_decimal_comma",
    f"select numpedven, {n6('qtcomp')} pecas, {n6('precounit')} preco from erp_item",
)
def _(v):
    cells = positional(v)
    return cells.select(
        F.col("NUMPEDVEN").cast("bigint").alias("numpedven"),
        amounts.parse_decimal_comma(F.col("QTCOMP")).alias("pecas"),
        amounts.parse_decimal_comma(F.col("PRECOUNIT")).alias("preco"),
    )


@check(
    "bad_decimal_rows",
    "select count(*) filter (flmovitpedkit = 'S') qtcomp, cast(0 as bigint) precounit from erp_item",
)
def _(v):
    marked = v.erp_item.select(
        F.when(F.col("flmovitpedkit") == "S", "1.234,5").otherwise("12,5").alias("qtcomp"),
        F.replace(F.col("precounit").cast("string"), F.lit("."), F.lit(",")).alias("precounit"),
    )
    return amounts.bad_decimal_rows(marked, ["qtcomp", "precounit"])


@check(
    "fmt_ptbr",
    f"""select numpedven, coditprod, {reports.ptbr('precounit', 0)} normal, {reports.ptbr('precounit', 1)} cubagem,
               replace(format('{{:.1f}}', cast(qtcomp as double) / 128 * 100), '.', ',') || '%' porcentagem,
               'R$ ' || {reports.ptbr('precounit', 2)} dinheiro from erp_item""",
)
def _(v):
    price = F.col("precounit")
    return v.erp_item.select(
        "numpedven",
        "coditprod",
        display.fmt_ptbr(price, "NORMAL").alias("normal"),
        display.fmt_ptbr(price, "CUBAGEM").alias("cubagem"),
        display.fmt_ptbr(F.col("qtcomp").cast("double") / 128, "PORCENTAGEM", 1).alias("porcentagem"),
        display.fmt_ptbr(price, "REAL", 2).alias("dinheiro"),
    )


@check(
    "relabel_status",
    "select pedido, case pedido % 7 "
    + " ".join(f"when {k} then '{label}'" for k, label in reports.LABELS.items())
    + " end rotulo from delivery",
)
def _(v):
    return v.delivery.select("pedido", codes.delivery_label(F.col("status_final")).alias("rotulo"))


@check(
    "prefix_kind",
    "select cd_agenda, if(left(id_agenda_externa, 3) = 'INS', 'LV', 'RECEBIMENTO') tipo_agenda from appointment",
)
def _(v):
    return v.appointment.select("cd_agenda", codes.appointment_kind(F.col("id_agenda_externa")).alias("tipo_agenda"))


# ---- streams


def landed_picks(v: Views, files_per_batch: int = 2) -> tuple[str, DataFrame]:
    """Directory of four landed pick files and a stream over it."""
    path = scratch_dir(v.spark, "landed")
    picks = v.pick_event.withColumn("dt_separacao", F.col("dt_separacao").cast("timestamp"))
    picks.repartition(4).write.parquet(path)
    stream = v.spark.readStream.schema(picks.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return path, stream


@check("stream_snapshot_refresh", reports.shift_sql(f"cast({M3} as decimal(18,0))"))
def _(v):
    landed, arrivals = landed_picks(v, files_per_batch=1)
    target = scratch_dir(v.spark, "published")

    def touched(batch):
        return batch.join(v.order_header, ["cd_empresa", "nu_pedido"]).select(v.order_header.cd_carga)

    def rebuild(spark, changed):
        headers = of_keys(v.order_header, changed, {"cd_carga": "cd_carga"})
        picks = spark.read.parquet(landed)
        if changed is not None:
            picks = Window(headers, ["nu_pedido"]).cut(picks, ["nu_pedido"])
        return warehouse.shift_production(picks, headers, v.product, as_of=reports.SHIFT_AS_OF)

    query = maintain_on_arrival(
        arrivals, touched, rebuild, target, scratch_dir(v.spark, "progress"), slots=16, once=True
    )
    query.awaitTermination()
    return maintained(v.spark, target)


@check("stream_shift_production", reports.shift_sql(f"cast({M3} as decimal(18,0))"))
def _(v):
    _, picks = landed_picks(v, files_per_batch=1)
    stored = scratch_dir(v.spark, "hours")
    query = store_hours(picks, v.order_header, v.product, stored, scratch_dir(v.spark, "progress"), once=True)
    query.awaitTermination()
    return stored_shift_production(v.spark, stored, as_of=reports.SHIFT_AS_OF)
