"""Checks of the complete reports."""

from __future__ import annotations

from checks.registry import SHARED, at, check, day, i8, n6
from checks.views import Views
from lotline.plans import backlog, backlog_views, closing, delivery, receiving, warehouse
from lotline.sources.snapshots import read_snapshot, scratch_dir

MODES = ["CD Entrega", "Courier", "Inauguracao", "Rota"]
LOT_AS_OF, LOT_DAYS = "2001-08-02", 2000
SHIFT_AS_OF = "2024-01-30 12:00:00"
PUTAWAY_AS_OF = "2001-12-01"
BACKLOG_AS_OF = "2000-01-01"
PICK_AS_OF = "2024-01-30"


def tables(v: Views) -> backlog.BacklogTables:
    return backlog.BacklogTables(
        order=v.erp_order,
        item=v.erp_item,
        kit_item=v.erp_kit_item,
        item_product=v.erp_item_product,
        product=v.erp_product,
        product_location=v.erp_product_location,
        pack=v.erp_pack,
        line=v.erp_line,
        family=v.erp_family,
        mode=v.erp_mode,
        lot=v.erp_lot,
        reservation=v.erp_reservation,
        area=v.erp_area,
        area_route=v.erp_area_route,
        route=v.erp_route,
        site_time=v.erp_site_time,
    )


def lots(v: Views, **options):
    if "lot_status" in v.results:
        return v.read_stored("lot_status")
    return warehouse.lot_status(
        v.order_header, v.order_line, v.product, v.pick_lot, as_of=LOT_AS_OF, window_days=LOT_DAYS, **options
    )


def orders_listed(v: Views, **options):
    if "order_backlog" in v.results:
        return v.read_stored("order_backlog")
    return backlog.order_backlog(tables(v), as_of=BACKLOG_AS_OF, **options)


def enriched(v: Views):
    if "backlog_enriched" in v.results:
        return v.read_stored("backlog_enriched")
    return backlog.enrich_backlog(orders_listed(v), v.mode_map, v.branch_map, v.city_map)


def page(v: Views, name: str):
    if "page_sums" in v.results:
        sums = v.read_stored("page_sums")
    else:
        sums = backlog_views.page_sums(enriched(v))
    return backlog_views.page_of(sums, name)


def profile(v: Views):
    return warehouse.location_profile(
        v.location, v.storage_class, v.storage_area, v.location_type, v.location_station, v.station
    )


M3 = "cast(vl_altura as bigint) * cast(vl_largura as bigint) * cast(vl_profundidade as bigint)"
SHIFT_CASE = (
    "case when h between 6 and 13 then '1 TURNO' when h between 14 and 21 then '2 TURNO' else '3 TURNO' end"
)

SHARED["x_plan"] = f"""
    select cd_carga lote, min(dt_addrow) first_at, min(h.cd_situacao) state,
           sum(qt_separar - coalesce(qt_cancelada, 0)) qty, sum({M3} * qt_separar) * 0.000001 m3,
           count(distinct h.nu_pedido_origem) orders
    from order_header h
    join order_line l on l.nu_pedido_origem = h.nu_pedido_origem and l.cd_empresa = h.cd_empresa
    join product using (cd_produto)
    where h.cd_empresa = 12650 and dt_addrow >= timestamp '2001-08-02' - interval 2000 day
      and h.cd_situacao <> 68 and l.cd_situacao <> 68 and (h.cd_situacao = 64 or l.cd_situacao <> 64)
    group by cd_carga"""
SHARED["x_done"] = f"""
    select cd_carga lote, sum(coalesce(qt_separado, 0)) picked, sum(coalesce(qt_conferido, 0)) checked,
           sum({M3} * coalesce(qt_separado, 0)) * 0.000001 picked_m3,
           sum({M3} * coalesce(qt_conferido, 0)) * 0.000001 checked_m3
    from pick_lot join product using (cd_produto)
    where cd_empresa = 12650 and dt_addrow >= timestamp '2001-08-02' - interval 2000 day
    group by cd_carga"""


def lot_sql(pending: str) -> str:
    """Lot status with ``pending`` as the text of what is left, given plan and done."""

    def left(plan: str, done: str) -> str:
        return n6(pending.format(plan=plan, done=done))

    return f"""
    select strftime(first_at, '%d/%m/%Y') data_corte, p.lote, {n6('qty')} programacao, {n6('m3')} cub_programada,
           {i8('orders')} pedidos, {i8('state')} cd_situacao,
           {n6('coalesce(picked, 0)')} separado, {n6('coalesce(picked_m3, 0)')} cub_separada,
           {n6('coalesce(checked, 0)')} conferido, {n6('coalesce(checked_m3, 0)')} cub_conferida,
           {left('qty', 'picked')} pendente_sep, {left('m3', 'picked_m3')} cub_pendente_sep,
           {left('qty', 'checked')} pendente_conf, {left('m3', 'checked_m3')} cub_pendente_conf
    from x_plan p left join x_done d on d.lote = p.lote"""


SHARED["x_lots"] = lot_sql("coalesce({plan} - {done}, 0)")


@check("lot_status", "select * from x_lots")
def _(v):
    return lots(v)


@check("lot_status_full_pending", lot_sql("{plan} - coalesce({done}, 0)"))
def _(v):
    return lots(v, unmatched_pending="full")


def shift_sql(volume: str) -> str:
    return f"""
    with rows_ as (
        select h.cd_carga, round(qt_separado, 0) qt, {volume} cm3, hour(dt_separacao) h,
               cast(dt_separacao as date) - case when hour(dt_separacao) < 6 then 1 else 0 end as dia
        from pick_event p
        join order_header h on h.nu_pedido = p.nu_pedido and h.cd_empresa = p.cd_empresa
        join product using (cd_produto)
        where p.cd_empresa = 12650 and qt_separado > 0 and tp_pedido <> 'RMN')
    select {day('dia')} dt_competencia, cd_carga, {SHIFT_CASE} turno, {n6('sum(qt)')} qt_separado,
           cast(floor(sum(cm3) * 0.000001 * 100) as double) / 100 cubagem, lpad(cast(h as varchar), 2, '0') hora
    from rows_ where dia >= date '2024-01-28'
    group by dia, cd_carga, h"""


def shifts(v: Views, **options):
    return warehouse.shift_production(v.pick_event, v.order_header, v.product, as_of=SHIFT_AS_OF, **options)


@check("shift_production", shift_sql(f"cast({M3} as decimal(18,0))"))
def _(v):
    return shifts(v)


@check("shift_production_weighted", shift_sql(f"{M3} * qt_separado"))
def _(v):
    return shifts(v, weight_by_qty=True)


SHARED["x_received"] = """
    select cd_agenda, nu_etiqueta_lote etiqueta, cd_produto, 'AGRUPADA' tp_etiqueta, qt_conferido, dt_conferencia
    from label_grouped where cd_empresa = 1590 and cd_situacao = 23 and cd_produto <> 11
    union all
    select cd_agenda, nu_etiqueta, cd_produto, 'NORMAL', qt_conferido, dt_conferencia
    from label_single
    where cd_empresa = 1590 and cd_situacao = 23 and cd_produto <> 11 and cd_area_armaz not in (17, 9, 27)"""


def putaway_sql(company: int) -> str:
    return f"""
    with labels as (
        select cd_empresa, cd_agenda, nu_etiqueta_lote etiqueta, dt_conferencia, dt_addrow, cd_produto,
               cd_func_conferencia, qt_conferido, 'AGRUPADA' tp_etiqueta, cd_endereco, cd_situacao
        from label_grouped
        union all
        select cd_empresa, cd_agenda, nu_etiqueta, dt_conferencia, dt_addrow, cd_produto,
               cd_func_conferencia, qt_conferido, 'NORMAL', cd_endereco, cd_situacao
        from label_single where cd_area_armaz not in (17, 9, 27))
    select strftime(dt_conferencia, '%d/%m/%Y %H:%M') data_entrada, cd_agenda, etiqueta,
           {i8("date_diff('day', cast(dt_addrow as date), date '2001-12-01')")} dias, l.cd_produto, ds_produto,
           nm_funcionario, qt_conferido, tp_etiqueta, cd_endereco
    from labels l
    join employee e on e.cd_funcionario = l.cd_func_conferencia
    left join product p on p.cd_produto = l.cd_produto
    where cd_empresa = {company} and cd_situacao = 23 and l.cd_produto <> 11"""


def putaway(v: Views, company: int):
    return receiving.putaway_pending(
        v.label_grouped, v.label_single, v.product, v.employee, as_of=PUTAWAY_AS_OF, company=company
    )


@check("putaway_pending", putaway_sql(1590))
def _(v):
    return putaway(v, 1590)


@check("putaway_pending_second_company", putaway_sql(15350))
def _(v):
    return putaway(v, 15350)


SHARED["x_goods"] = """
    select i.coditprod, k.codembal, concat(i.coditprod, i.digitprod) item, p.descricao,
           cast(k.altura as bigint) * cast(k.largura as bigint) * cast(k.comp as bigint) cm3,
           l.descricao linha, f.descricao familia
    from erp_item_product i
    join erp_product p on p.codprod = i.codprod and coalesce(p.codtpserv, 0) = 0
    join erp_pack k on k.codprod = i.codprod
    join erp_line l on l.codlinha = i.codlinha
    join erp_family f on f.codfam = i.codfam
    where exists (select 1 from erp_product_location s where s.coditprod = i.coditprod and s.codfil = 2650)"""
SHARED["x_orders"] = """
    select o.*, m.descricao modalidade,
           case when o.codfil = 200 then s.first_at else o.hrpedido end dtlibfat_mod
    from erp_order o
    left join erp_mode m on m.codmodal = o.codmodal
    left join (select numpedven, min(dthora_int) first_at from erp_site_time group by numpedven) s
      on s.numpedven = o.numpedven
    where sitcarga in (0, 1, 2, 8, 9, 14) and tpped = 'E' and filorig = 2650
      and flcredlista is distinct from 'G'
      and case tpnota when 51 then status = 5 and fltransffatnf is distinct from 'S'
               else tpnota in (55, 536, 655, 665) and status = 4 end"""
SHARED["x_items"] = """
    select true kit, codfil, tipoped, numpedven, coditprodkit coditprod, codembal, qtcomp, precounit from erp_kit_item
    union all
    select false, codfil, tipoped, numpedven, coditprod, codembal, qtcomp, precounit
    from erp_item where flmovitpedkit is distinct from 'S'"""
SHARED["x_lines"] = """
    select distinct kit, o.numpedven, tpnota, case o.tipoped when 0 then 'VENDAS' when 2 then 'ABA' end tipo_pedido,
           filorig, o.codfil, dtpedido, fllibfat, numlote, dtentrega, codfiltransffat, dtlibfat, item, i.coditprod,
           qtcomp, descricao, cm3, sitcarga, codreserva, linha, familia, dtalter, praca, numpedcli, codrota, codmodal,
           modalidade, codcli, precounit, dtlibfat_mod
    from x_items i
    join x_orders o on o.numpedven = i.numpedven and o.codfil = i.codfil and o.tipoped = i.tipoped
    join x_goods g on g.coditprod = i.coditprod and g.codembal = i.codembal"""
SHARED["x_reserved"] = """
    select codreserva, coditprod, numpedcomp, codsitprod, tipopedido, codreservay, dtentrega reserved_at
    from erp_reservation
    qualify row_number() over (partition by codreserva, coditprod
        order by dtentrega, numpedcomp, codsitprod, tipopedido, codreservay nulls first) = 1"""
SHARED["x_routes"] = """
    select praca, (select t.descricao from erp_area_route l join erp_route t on t.codrota = l.codrota
                   where l.praca = a.praca) rota
    from erp_area a"""
SHARED["x_states"] = """
    select x.*, r.numpedcomp, r.reserved_at, a.rota,
           case when fllibfat = 'N' then '1-Nao Liberado'
                when sitcarga = 2 then '6-Conferido Aguardando Fat'
                when sitcarga = 8 then '8-Venda Pendente SEFAZ'
                when sitcarga = 9 then '9-Bloqueado Expedicao'
                when sitcarga = 14 then '14-Eficiencia Energetica'
                when flseparacao = 'N' then '3-Lote montado'
                when flseparacao in ('B', 'R') then '4-Lote em Separacao'
                when flseparacao = 'C' then '5-Lote em Conferencia'
                else '2-Liberado' end status,
           case when fllibfat is distinct from 'N' then null
                when codsitprod in ('AD', 'AN') then 'Adicional'
                when codsitprod = 'EC' then 'Encomenda'
                when tipopedido = 'T' then 'Roteiro Y'
                when codreservay is not null then 'Roteiro Y'
                when codsitprod not in ('AD', 'AN', 'EC') and tipopedido = 'C' then 'Pedido de Compra' end situacao,
           if(coalesce(numlote, 0) = 0, 'EM CARTEIRA', 'EM PROCESSO') status_operacao,
           if(len(list_filter([dtlibfat_mod, dtpedido, dtentrega], lambda d: d is not null)) >= 2,
              list_max([dtlibfat_mod, dtpedido, dtentrega]), null) latest
    from x_lines x
    left join erp_lot t on t.nlote = x.numlote and t.codfil = x.filorig
    left join x_routes a on a.praca = x.praca
    left join x_reserved r on r.codreserva = x.codreserva and r.coditprod = x.coditprod
    where codfiltransffat <> 98"""
SHARED["x_all"] = """
    select numpedven, tpnota, tipo_pedido, codfiltransffat, if(codfil = 200, 'SITE', 'REDE') canal_vendas, codmodal,
           descricao, modalidade,
           case when rota = 'NORTE' and codmodal = 'COU' then 'SEDEX'
                when rota = 'NORTE' and codmodal <> 'COU' then 'FAVORITA' else rota end descricaorota,
           dtalter data_aprovacao, dtpedido, dtentrega, cast(reserved_at as date) preventrega, dtlibfat_mod, familia,
           filorig, status, item, linha, numlote, numpedcomp, qtcomp, precounit, cm3 * 0.000001 cub_unit,
           status_operacao, situacao,
           case when situacao = 'Roteiro Y' then 'ROT Y' when fllibfat = 'N' then 'VENDA FORNECEDOR'
                when latest > timestamp '2000-01-03' then 'PROGRAMADO' when codmodal = 'INA' then 'ABA INAUGURACAO'
                when sitcarga = 9 then 'BLOQUEADO' else status_operacao end status_operacao_gerencial,
           cm3 * 0.000001 * qtcomp cubtotal, cast(qtcomp as decimal(38,6)) * precounit valtotal, fllibfat
    from x_states"""
SHARED["x_backlog"] = "select * exclude (fllibfat) from x_all where fllibfat = 'S'"
SHARED["x_enriched"] = """
    select b.*, modal_master, cod, filial, rota, cidade
    from x_backlog b
    left join mode_map m on m.codmodal = b.codmodal
    left join branch_map f on f.cod = cast(b.codfiltransffat as varchar)
    left join city_map c on c.rota = b.descricaorota"""


BACKLOG_OUT = f"""
    numpedven, {i8('tpnota')} tpnota, tipo_pedido, {i8('codfiltransffat')} codfiltransffat, canal_vendas, codmodal,
    descricao, modalidade, descricaorota, {at('data_aprovacao')} data_aprovacao, {at('dtpedido')} dtpedido,
    {at('dtentrega')} dtentrega, {day('preventrega')} preventrega, {at('dtlibfat_mod')} dtlibfat_mod, familia,
    {i8('filorig')} filorig, status, item, linha, numlote, numpedcomp, {n6('qtcomp')} qtcomp,
    {n6('precounit')} precounit, {n6('cub_unit')} cub_unit, status_operacao, situacao, status_operacao_gerencial,
    {n6('cubtotal')} cubtotal, {n6('valtotal')} valtotal"""


@check("order_backlog", f"select {BACKLOG_OUT} from x_backlog")
def _(v):
    return orders_listed(v)


@check("order_backlog_all", f"select {BACKLOG_OUT} from x_all")
def _(v):
    return orders_listed(v, released_only=False)


def productivity(v: Views, **options):
    return warehouse.pick_productivity(
        v.pick_event, v.order_header, v.task, v.employee, profile(v), v.product, v.family, v.product_line,
        **{"as_of": PICK_AS_OF, **options},
    )


SHARED["x_places"] = """
    select l.*, ds_area_armaz, ds_tipo_endereco, ds_posto, left(l.cd_endereco, 1) predio, left(l.cd_endereco, 3) rua,
           substring(l.cd_endereco, 4, 3) coluna, substring(l.cd_endereco, 7, 3) nivel2,
           substring(l.cd_endereco, 10, 3) sala, cast(substring(l.cd_endereco, 4, 3) as int) n,
           case when n > 199 or left(l.cd_endereco, 1) not in ('P', 'B', 'G') then ''
                when n <= if(left(l.cd_endereco, 1) = 'P', 37, 33) then '1 BLOCO'
                when n <= if(left(l.cd_endereco, 1) = 'P', 75, 67) then '2 BLOCO' else '3 BLOCO' end quadrante,
           if(n % 2 = 0, 'PAR', 'IMPAR') posicao,
           case id_endereco_baixo when 'S' then 'BAIXO' when 'N' then 'ALTO' end nivel,
           case l.cd_situacao when '42' then 'VAZIO' when '45' then 'OCUPADO' when '47' then 'OCUPADO' end situacao,
           case l.cd_classe when '26ACE' then 'ACESSORIOS' when '26BEB' then 'BEBIDAS'
                when '26TV' then 'TV - IMAGEM' when 'VND' then 'VENDIDOS' end ds_classe_produto
    from location l
    left join storage_area using (cd_area_armaz)
    left join location_type using (cd_tipo_endereco)
    left join location_station k on k.cd_empresa = l.cd_empresa and k.cd_endereco = l.cd_endereco
    left join station s on s.cd_empresa = k.cd_empresa and s.cd_posto = k.cd_posto
    where l.cd_empresa = 12650 and cd_area_armaz not in ('98', '6', '8', '35', '4', '5', '87', '32')"""
SHARED["x_tasks"] = """
    select nu_tarefa, cd_funcionario, try_cast(split_part(variavel, '#', 1) as bigint) nu_separacao,
           try_cast(split_part(variavel, '#', 2) as bigint) cd_grupo_separacao
    from task
    where cd_empresa = 12650 and cd_aplicacao like 'CSE020%' and nu_tarefa is not null
      and len(variavel) - len(replace(variavel, '#', '')) >= 2"""


STATION_CASE = """case ds_posto when 'MERCADO' then 'BENS DE CONSUMO' when 'GENERICO+DOCA+TEC' then 'GENERICO'
                else ds_posto end"""


def grouped_picks(select: str, since: str = "2024-01-23") -> str:
    return f"""
    with picks as (
        select *, hour(dt_separacao) h from pick_event
        where cd_empresa = 12650 and cd_endereco not like 'T99%'
          and cast(dt_separacao as date) - if(hour(dt_separacao) < 6, 1, 0) >= date '{since}'),
    named as (
        select p.*, o.nu_pedido_origem, e.nm_funcionario, g.ds_produto, ds_familia, ds_linha, x.rua, x.predio,
               x.coluna, x.quadrante, x.nivel, x.ds_posto,
               cast({M3.replace('vl_', 'g.vl_')} as decimal(18,0)) * qt_separado * 0.000001 m3
        from picks p
        join x_tasks t using (nu_tarefa, cd_funcionario, nu_separacao, cd_grupo_separacao)
        join x_places x on x.cd_endereco = p.cd_endereco
        left join order_header o on o.nu_pedido = p.nu_pedido
        left join employee e on e.cd_funcionario = p.cd_funcionario
        left join product g on g.cd_produto = p.cd_produto
        left join family f on f.cd_familia = g.cd_familia
        left join product_line n on n.cd_linha = g.cd_linha)
    {select}"""


@check(
    "pick_productivity",
    grouped_picks(f"""
    select {i8('12650')} cd, rua, cd_endereco, strftime(dt_separacao, '%d/%m/%Y %H:%M:%S') dt_separacao,
           strftime(dt_separacao, '%d/%m/%Y') data_separacao,
           {STATION_CASE} posto,
           cd_funcionario id, nm_funcionario nome, {SHIFT_CASE} turno, nu_pedido_origem,
           strftime(dt_separacao, '%H') hs24, {n6('sum(qt_separado)')} qtde_separada,
           replace(cast(cast(sum(m3) as decimal(38,6)) as varchar), '.', ',') m3_separado, {n6('sum(m3)')} m3_valor,
           cd_produto, ds_produto, ds_familia, ds_linha, predio, coluna n_coluna, quadrante, nivel, cd_carga lote,
           nu_tarefa tarefa, nu_separacao separacao, cd_grupo_separacao, cd_endereco_destino doca,
           strftime(dt_separacao, '%H:%M:%S') hora_separacao
    from named
    group by all"""),
)
def _(v):
    return productivity(v)


PROFILE_OUT = f"""
    select {i8('cd_empresa')} cd_empresa, cd_endereco, predio, rua, coluna, nivel2, sala, quadrante, posicao, nivel,
           situacao, cd_classe, ds_classe_produto, cd_area_armaz, ds_area_armaz,
           {i8('cd_tipo_endereco')} cd_tipo_endereco, ds_tipo_endereco, ds_posto
    from x_places"""


@check("location_profile", PROFILE_OUT)
def _(v):
    return profile(v)


def appointments_sql(invoices: str) -> str:
    return f"""
    select {i8('d.cd_empresa')} cd_empresa, strftime(dt_agendamento, '%d/%m/%Y') data_agenda, d.cd_agenda,
           id_agenda_externa, if(id_agenda_externa like 'INS%', 'LV', 'RECEBIMENTO') tipo_agenda,
           cd_produto_master, ds_produto, qt_produto, qt_recebido, qt_sobra
    from divergent_appointment d
    join receipt r on r.cd_empresa = d.cd_empresa and r.cd_agenda = d.cd_agenda
    left join product p on p.cd_produto = r.cd_produto_master
    left join appointment a on a.cd_empresa = d.cd_empresa and a.cd_agenda = d.cd_agenda
    {invoices}
    where d.cd_empresa = 1590 and r.cd_situacao in (10, 11)"""


INVOICES = "left join invoice i on i.cd_empresa = d.cd_empresa and i.cd_agenda = d.cd_agenda"


def appointments(v: Views, **options):
    return receiving.open_appointments(
        v.divergent_appointment, v.receipt, v.product, v.appointment, v.invoice, **options
    )


@check("open_appointments", appointments_sql(INVOICES))
def _(v):
    return appointments(v)


@check("open_appointments_deduped", appointments_sql(""))
def _(v):
    return appointments(v, dedupe_invoices=True)


GATE_SCHEMA = "event_id bigint, event_type string, value double"
GATE_SQL = """
    select cast(event_id as varchar) event_id, coalesce(event_type, '') event_type,
           coalesce(cast(value as varchar), '') value
    from gate_log"""


def gate_csv(v: Views) -> str:
    path = scratch_dir(v.spark, "gate")
    v.gate_log.write.csv(path, header=True)
    return path


@check("gate_snapshot", GATE_SQL)
def _(v):
    target = scratch_dir(v.spark, "gate-copy")
    receiving.gate_snapshot(v.spark, gate_csv(v), target, GATE_SCHEMA)
    return read_snapshot(v.spark, target, fmt="csv", header=True)


@check(
    "backlog_enriched",
    f"select {BACKLOG_OUT}, modal_master, cod, filial, rota, cidade from x_enriched",
)
def _(v):
    return enriched(v)


def ptbr(expr: str, places: int) -> str:
    return f"translate(format('{{:,.{places}f}}', cast({expr} as double)), ',.', '.,')"


def shown_sums(rows: str, key: str, measures: dict[str, tuple[str, int]], total: bool) -> str:
    """Sums by key of ``rows`` as numbers and text, with a row for the total."""
    sums = ", ".join(f"sum({m}) {m}" for m in measures)
    out = ", ".join(f"{n6(m)} {m}, {ptbr(m, places)} {m}_texto" for m, (_, places) in measures.items())
    union = f"union all select 'Total', {sums} from shown" if total else ""
    return f"with shown as ({rows}), al as (select {key}, {', '.join(measures)} from shown {union}) select {key}, {out} from al"


PV = {"pecas": ("qtcomp", 0), "cubagem": ("cubtotal", 1)}


@check(
    "page_sums",
    f"""
    with r as (select * replace (case when modal_master = 'CD Entrega' then numpedven end as numpedven) from x_enriched),
    s as (select grouping(modal_master) grouping_mode, grouping(familia) b, grouping(filial) c, grouping(cidade) d, status, familia, modal_master,
                 filial, cidade, numpedven, {n6('sum(qtcomp)')} qtcomp, {n6('sum(cubtotal)')} cubtotal
          from r group by grouping sets ((status), (familia), (modal_master, status), (filial, modal_master),
                                         (modal_master, cidade, numpedven)))
    select case when b = 0 then 'family' when c = 0 then 'branch' when d = 0 then 'city'
                when grouping_mode = 0 then 'mode' else 'status' end page,
           status, familia, modal_master, filial, cidade, numpedven, qtcomp, cubtotal
    from s""",
)
def _(v):
    return backlog_views.page_sums(enriched(v))


@check(
    "backlog_by_status",
    shown_sums(
        "select status, sum(qtcomp) pecas, sum(cubtotal) cubagem from x_enriched group by 1 order by 1 limit 10",
        "status", PV, True,
    ),
)
def _(v):
    return backlog_views.backlog_by_status(page(v, "status"), display=True)


@check(
    "top_families",
    shown_sums(
        "select familia, sum(qtcomp) pecas, sum(cubtotal) cubagem from x_enriched group by 1 order by 3 desc, 1 limit 10",
        "familia", PV, False,
    ),
)
def _(v):
    return backlog_views.top_families(page(v, "family"), display=True)


@check(
    "modes_in_process",
    shown_sums(
        """select modal_master, sum(qtcomp) pecas, sum(if(status = '2-Liberado', cubtotal, 0)) carteira,
                  sum(if(status = '4-Lote em Separacao', cubtotal, 0)) processo, sum(cubtotal) cubagem
           from x_enriched
           where status in ('2-Liberado', '4-Lote em Separacao') and modal_master is not null group by 1""",
        "modal_master",
        {"pecas": ("", 1), "carteira": ("", 1), "processo": ("", 1), "cubagem": ("", 1)},
        True,
    ),
)
def _(v):
    return backlog_views.modes_in_process(page(v, "mode"), display=True)


@check(
    "days_in_backlog",
    f"""
    with t as (select cast(sum(cubtotal) as double) m3 from x_enriched),
    r as (select 'Carteira Atual' tipo, m3 valor from t union all select 'Capacidade', 1061.0::double
          union all select 'Dias Em Carteira', m3 / 1061 from t)
    select tipo, valor, if(tipo = 'Capacidade', '1061', {ptbr('valor', 1)}) valor_texto from r""",
)
def _(v):
    return backlog_views.days_in_backlog(page(v, "status"), display=True)


def branch_sql(value: str, places: int) -> str:
    cells = ", ".join(f"coalesce(sum({value}) filter (modal_master = '{m}'), 0) \"{m}\"" for m in MODES)
    names = [f'"{m}"' for m in (*MODES, "Total")]
    out = ", ".join(f"{n6(m)} {m}, {ptbr(m, places)} \"{m[1:-1]}_texto\"" for m in names)
    return f"""
    with t as (select filial, {cells}, sum({value}) "Total" from x_enriched
               where filial is not null and modal_master is not null group by filial)
    select filial, {out} from t"""


@check("branch_mode_pieces", branch_sql("qtcomp", 0))
def _(v):
    return backlog_views.branch_mode_pieces(page(v, "branch"), backlog_views.mode_names(v.mode_map), display=True)


@check("branch_mode_volume", branch_sql("cubtotal", 1))
def _(v):
    return backlog_views.branch_mode_volume(page(v, "branch"), MODES, display=True)


@check(
    "delivery_cities",
    f"""
    select cidade, {i8('count(distinct numpedven)')} pedidos, {n6('sum(qtcomp)')} pecas, {n6('sum(cubtotal)')} cubagem,
           {ptbr('sum(qtcomp)', 0)} pecas_texto, {ptbr('sum(cubtotal)', 1)} cubagem_texto
    from x_enriched where modal_master = 'CD Entrega' and cidade is not null group by cidade""",
)
def _(v):
    return backlog_views.delivery_cities(page(v, "city"), display=True)


SHARED["x_sales"] = """
    select * from x_backlog
    where tipo_pedido = 'VENDAS' and status_operacao_gerencial is distinct from 'PROGRAMADO'"""


@check(
    "closing_by_status",
    shown_sums("select status, sum(valtotal) valtotal from x_sales group by 1", "status", {"valtotal": ("", 0)}, True),
)
def _(v):
    return closing.closing_by_status(orders_listed(v), display=True)


@check(
    "closing_top_lots",
    f"""
    select l.lote, {n6('valtotal')} valtotal, pendente_sep, pendente_conf, {ptbr('valtotal', 0)} valtotal_texto
    from (select numlote, sum(valtotal) valtotal from x_sales
          where status_operacao = 'EM PROCESSO' and status <> '6-Conferido Aguardando Fat'
          group by numlote order by 2 desc, 1 limit 10) t
    left join x_lots l on l.lote = t.numlote""",
)
def _(v):
    return closing.closing_top_lots(orders_listed(v), lots(v), display=True)


@check(
    "closing_top_orders",
    f"""
    select numpedven, {n6('sum(valtotal)')} valtotal, {ptbr('sum(valtotal)', 0)} valtotal_texto
    from x_sales where status_operacao <> 'EM PROCESSO'
    group by numpedven order by sum(valtotal) desc, numpedven limit 10""",
)
def _(v):
    return closing.closing_top_orders(orders_listed(v), display=True)


@check(
    "lots_to_invoice",
    """select count(distinct numlote) lotes_para_faturar from x_sales where status = '6-Conferido Aguardando Fat'""",
)
def _(v):
    return closing.lots_to_invoice(orders_listed(v))


@check(
    "result_vs_target",
    f"""
    select {n6('sum(valtotal)')} resultado, {i8('1952000')} meta, {n6('sum(valtotal) - 1952000')} dif,
           sum(valtotal) > 1952000 acima, {ptbr('sum(valtotal)', 0)} resultado_texto, '1.952.000' meta_texto,
           {ptbr('sum(valtotal) - 1952000', 0)} dif_texto from x_sales""",
)
def _(v):
    return closing.result_vs_target(orders_listed(v), display=True)


SHARED["x_pending"] = """
    select * from delivery
    where finalizador = 'PENDENTE' and coalesce(regional, '') not in ('CORREIOS', 'FRACIONADO')"""
DUE_COUNTS = """
    count(*) filter (status_prazo = 'À VENCER') a_vencer, count(*) filter (status_prazo = 'VENCE HOJE') vence_hoje,
    count(*) filter (status_prazo = 'VENCIDO') vencido, count(*) total"""


@check("due_totals", f"select {DUE_COUNTS} from x_pending")
def _(v):
    return delivery.due_totals(v.delivery)


@check(
    "due_by_carrier",
    f"""select transp_corrigida, {DUE_COUNTS} from x_pending group by 1
        order by vence_hoje desc, vencido desc, transp_corrigida limit 26""",
)
def _(v):
    return delivery.due_by_carrier(v.delivery)


LABELS = {
    0: "Endereço Não_Localizado",
    1: "Em Entrega",
    2: "1a_Tentativa Cliente_Ausente",
    3: "Saiu_para Entrega",
    4: "Troca transportadora",
}
MATRIX_SQL = (
    "select transp_corrigida, "
    + ", ".join(f"count(*) filter (pedido % 7 = {k}) \"{label}\"" for k, label in LABELS.items())
    + """ from x_pending where status_prazo = 'VENCE HOJE' and pedido % 7 < 5
    group by transp_corrigida order by transp_corrigida limit 16"""
)


@check("due_today_matrix", MATRIX_SQL)
def _(v):
    return delivery.due_today_matrix(v.delivery)
