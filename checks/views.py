"""Input tables of the reports, derived from the test tables (see FIXTURES.md).

One text serves both engines; ``{name}`` stands for a test table or an earlier
view. No view leaves rows out but for the two halves of the labels and the kit items;
keys that joins shall not match are moved out of range, for example to ``-key``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

VIEWS = {
    "product": """
        select p_partkey cd_produto, p_name ds_produto, p_type cd_familia, p_brand cd_linha,
               cast(p_size as decimal(18,6)) vl_altura, cast(p_size + 10 as decimal(18,6)) vl_largura,
               cast(30 as decimal(18,6)) vl_profundidade
        from {part}""",
    "family": """
        select distinct case when p_type = 'SMALL' then '-SMALL' else p_type end cd_familia, 'FAM ' || p_type ds_familia
        from {part}""",
    "product_line": """
        select distinct p_brand cd_linha, 'LIN ' || p_brand ds_linha from {part}""",
    "employee": """
        select case when c_custkey % 10 = 9 then -c_custkey else c_custkey end cd_funcionario, c_name nm_funcionario
        from {customer}""",
    "order_header": """
        select 12650 cd_empresa, o_orderkey nu_pedido, o_orderkey nu_pedido_origem, o_custkey % 120 cd_carga,
               o_orderdate dt_addrow,
               case o_orderstatus when 'F' then 68 when 'O' then 64 else 10 end cd_situacao,
               case when o_orderpriority = '1-URGENT' then 'RMN' when o_orderpriority = '5-LOW' then null
                    else 'EPP' end tp_pedido
        from {orders}""",
    "order_line": """
        select 12650 cd_empresa, l_orderkey nu_pedido_origem, l_partkey cd_produto,
               cast(l_quantity as decimal(18,6)) qt_separar,
               case when l_returnflag = 'R' then cast(l_linenumber as decimal(18,6)) end qt_cancelada,
               case when l_linestatus = 'F' then 64 when l_linenumber = 7 then 68 else 10 end cd_situacao
        from {lineitem}""",
    "pick_lot": """
        select 12650 cd_empresa, l_suppkey cd_carga, l_partkey cd_produto,
               case when l_linestatus = 'O' then cast(l_quantity as decimal(18,6)) end qt_separado,
               case when l_returnflag = 'A' then cast(l_quantity as decimal(18,6)) end qt_conferido,
               l_shipdate dt_addrow
        from {lineitem}""",
    "pick_event": """
        select 12650 cd_empresa, event_id nu_pedido, event_id % 200 cd_produto, user_id % 20 cd_carga,
               user_id cd_funcionario,
               case when event_type = 'error' then cast(0 as decimal(18,6))
                    else cast(value as decimal(18,6)) end qt_separado,
               ts dt_separacao, event_id % 1000 nu_separacao, user_id % 7 cd_grupo_separacao, event_id nu_tarefa,
               substr('PBGT', cast(event_id % 4 as int) + 1, 1)
                 || lpad(cast(event_id % 90 + 10 as string), 2, '0')
                 || lpad(cast(event_id % 120 as string), 3, '0') || '001001' cd_endereco,
               'DOCA' || cast(user_id % 3 as string) cd_endereco_destino
        from {events}""",
    "task": """
        select 12650 cd_empresa, event_id nu_tarefa, user_id cd_funcionario,
               case when event_id % 11 = 0 then cast(event_id % 1000 as string)
                    when event_id % 11 = 1 then cast(event_id % 1000 as string) || '#' || cast(user_id % 7 as string)
                    when event_id % 11 = 2 then '9999#' || cast(user_id % 7 as string) || '#x'
                    else cast(event_id % 1000 as string) || '#' || cast(user_id % 7 as string) || '#x' end variavel,
               case when event_id % 13 = 0 then 'XYZ001' else 'CSE020A' end cd_aplicacao
        from {events}""",
    "location": """
        select distinct 12650 cd_empresa, cd_endereco,
               case when cast(substr(cd_endereco, 2, 2) as int) % 12 = 7 then null
                    else cast(cast(substr(cd_endereco, 2, 2) as int) % 12 as string) end cd_area_armaz,
               case cast(substr(cd_endereco, 2, 2) as int) % 6 when 0 then '26ACE' when 1 then '26BEB'
                    when 2 then '26TV' when 3 then 'VND' when 4 then '26XXX' end cd_classe,
               case cast(substr(cd_endereco, 4, 3) as int) % 3 when 0 then 'S' when 1 then 'N' end id_endereco_baixo,
               case cast(substr(cd_endereco, 4, 3) as int) % 4 when 0 then '42' when 1 then '45' when 2 then '47'
                    else '50' end cd_situacao,
               cast(substr(cd_endereco, 4, 3) as int) % 5 cd_tipo_endereco,
               cast(substr(cd_endereco, 2, 2) as int) % 11 cd_posto
        from {pick_event}""",
    "storage_class": """
        select distinct case when cd_classe = '26XXX' then '-26XXX' else cd_classe end cd_classe from {location}""",
    "storage_area": """
        select distinct cd_area_armaz, 'AREA ' || cd_area_armaz ds_area_armaz
        from {location} where cd_area_armaz is not null""",
    "location_type": """
        select distinct cd_tipo_endereco, 'TIPO ' || cast(cd_tipo_endereco as string) ds_tipo_endereco
        from {location}""",
    "location_station": """
        select 12650 cd_empresa, cd_endereco, cd_posto from {location}
        union all
        select 12650 cd_empresa,
               case when cast(substr(cd_endereco, 4, 3) as int) % 9 = 0 then cd_endereco else cd_endereco || '-' end cd_endereco,
               (cd_posto + 3) % 11 cd_posto
        from {location}
        union all
        select 15350 cd_empresa, cd_endereco, (cd_posto + 1) % 11 cd_posto from {location}""",
    "station": """
        select distinct 12650 cd_empresa, case when cd_posto = 10 then -10 else cd_posto end cd_posto,
               case cd_posto when 0 then 'COFRE' when 1 then 'MERCADO' when 2 then 'GENERICO+DOCA+TEC'
                    when 4 then 'MERCADO' else 'POSTO ' || cast(cd_posto as string) end ds_posto
        from {location}
        union all
        select distinct 15350 cd_empresa, cd_posto, 'OUTRO ' || cast(cd_posto as string) ds_posto from {location}""",
    "label_grouped": """
        select case when l_suppkey % 2 = 0 then 1590 else 15350 end cd_empresa, l_orderkey cd_agenda,
               l_orderkey * 10 + l_linenumber nu_etiqueta_lote, l_shipdate dt_conferencia, l_shipdate dt_addrow,
               l_partkey cd_produto, l_suppkey cd_func_conferencia, l_quantity qt_conferido,
               case when l_returnflag = 'R' then 23 else 24 end cd_situacao,
               'E' || cast(l_partkey % 50 as string) cd_endereco
        from {lineitem} where l_linestatus = 'F'""",
    "label_single": """
        select case when l_suppkey % 2 = 0 then 1590 else 15350 end cd_empresa, l_orderkey cd_agenda,
               l_orderkey * 10 + l_linenumber nu_etiqueta, l_shipdate dt_conferencia, l_shipdate dt_addrow,
               l_partkey cd_produto, l_suppkey cd_func_conferencia, l_quantity qt_conferido,
               case when l_returnflag = 'R' then 23 else 24 end cd_situacao,
               'E' || cast(l_partkey % 50 as string) cd_endereco,
               case when l_partkey % 30 = 29 then null else l_partkey % 30 end cd_area_armaz
        from {lineitem} where l_linestatus = 'O'""",
    "divergent_appointment": """
        select case when o_orderkey % 2 = 0 then 1590 else 15350 end cd_empresa, o_orderkey cd_agenda
        from {orders} where o_orderstatus <> 'F'""",
    "appointment": """
        select case when o_orderkey % 2 = 0 then 1590 else 15350 end cd_empresa,
               case when o_orderkey % 7 = 0 then -o_orderkey else o_orderkey end cd_agenda,
               case when o_orderkey % 5 = 0 then null
                    when o_orderkey % 3 = 0 then 'INS' || cast(o_orderkey as string)
                    else 'AGE' || cast(o_orderkey as string) end id_agenda_externa,
               o_orderdate dt_agendamento
        from {orders}""",
    "receipt": """
        select case when l_orderkey % 2 = 0 then 1590 else 15350 end cd_empresa, l_orderkey cd_agenda,
               l_partkey cd_produto_master, l_quantity qt_produto, l_quantity - l_linenumber qt_recebido,
               case when l_linenumber > l_quantity then l_linenumber - l_quantity else 0 end qt_sobra,
               case l_returnflag when 'R' then 10 when 'A' then 11 else 12 end cd_situacao
        from {lineitem}""",
    "invoice": """
        select case when l_orderkey % 2 = 0 then 1590 else 15350 end cd_empresa,
               case when l_linenumber > 2 then -l_orderkey else l_orderkey end cd_agenda
        from {lineitem}""",
    "erp_order": """
        select o_orderkey numpedven, case when o_custkey % 3 = 0 then 200 else 300 end codfil,
               case o_orderstatus when 'F' then 0 when 'O' then 2 else 1 end tipoped,
               case when o_orderkey % 4 = 0 then 51 else 55 end tpnota,
               case when o_orderkey % 4 = 0 then 5 else 4 end status,
               case when o_orderkey % 12 = 0 then 'S' end fltransffatnf,
               case o_orderkey % 11 when 0 then 0 when 1 then 1 when 2 then 2 when 3 then 8 when 4 then 9
                    when 5 then 14 when 6 then 3 else 0 end sitcarga,
               case when o_orderkey % 10 = 9 then 'N' else 'S' end fllibfat,
               case when o_orderkey % 29 = 28 then 'S' else 'E' end tpped,
               case when o_orderkey % 31 = 30 then 'G' end flcredlista,
               case when o_orderkey % 23 = 22 then 2651 else 2650 end filorig,
               case when o_custkey % 5 = 0 then 0 when o_custkey % 5 = 1 then null else o_custkey % 50 end numlote,
               case when c_nationkey = 24 then 98 when c_nationkey = 22 then null else c_nationkey end codfiltransffat,
               case when o_custkey % 9 = 0 then null when o_custkey % 7 = 0 then 'COU'
                    when o_custkey % 7 = 1 then 'INA' else 'M' || cast(o_custkey % 7 as string) end codmodal,
               case when o_orderkey % 17 = 0 then null else o_orderdate end dtpedido,
               case when o_orderkey % 13 = 0 then null
                    else o_orderdate + (o_custkey % 10) * interval '1' day end dtentrega,
               case when o_orderkey % 19 = 0 then null
                    else o_orderdate + (o_custkey % 4) * interval '1' day end hrpedido,
               o_orderdate dtlibfat, o_orderdate dtalter, o_custkey % 40 praca, o_custkey codreserva,
               o_custkey codcli, o_custkey % 12 codrota, cast(o_orderkey as string) numpedcli
        from {orders} join {customer} on o_custkey = c_custkey""",
    "erp_item": """
        select codfil, tipoped, l_orderkey numpedven, l_partkey coditprod, 1 + l_linenumber % 2 codembal,
               case when l_returnflag = 'R' then 'S' when l_returnflag = 'A' then 'N' end flmovitpedkit,
               cast(l_quantity as decimal(18,6)) qtcomp, cast(l_extendedprice as decimal(18,6)) precounit
        from {lineitem} join {erp_order} on l_orderkey = numpedven""",
    "erp_kit_item": """
        select codfil, tipoped, l_orderkey numpedven, l_partkey coditprodkit, 1 + l_linenumber % 2 codembal,
               cast(l_quantity as decimal(18,6)) qtcomp, cast(l_extendedprice as decimal(18,6)) precounit
        from {lineitem} join {erp_order} on l_orderkey = numpedven where l_returnflag = 'R'""",
    "erp_item_product": """
        select p_partkey coditprod, case when p_partkey % 10 = 0 then null else p_partkey % 9 end digitprod,
               p_partkey codprod, p_brand codlinha, p_type codfam
        from {part}""",
    "erp_product": """
        select p_partkey codprod, p_name descricao,
               case when p_partkey % 25 = 0 then 1 when p_partkey % 3 = 0 then null else 0 end codtpserv
        from {part}""",
    "erp_product_location": """
        select 2650 codfil, case when p_partkey % 20 = 19 then -p_partkey else p_partkey end coditprod, 0 slot
        from {part}
        union all
        select 2650 codfil, case when p_partkey % 20 = 19 then -p_partkey else p_partkey end coditprod, 1 slot
        from {part}""",
    "erp_pack": """
        select p_partkey codprod, 1 codembal, cast(p_size as decimal(18,6)) altura,
               cast(p_size as decimal(18,6)) largura, cast(40 as decimal(18,6)) comp from {part}
        union all
        select p_partkey codprod, 2 codembal, cast(p_size as decimal(18,6)) altura,
               cast(p_size + 1 as decimal(18,6)) largura, cast(40 as decimal(18,6)) comp from {part}""",
    "erp_line": "select cd_linha codlinha, ds_linha descricao from {product_line}",
    "erp_family": "select cd_familia codfam, ds_familia descricao from {family}",
    "erp_mode": """
        select distinct case when codmodal = 'M6' then '-M6' else codmodal end codmodal, 'MODE ' || codmodal descricao
        from {erp_order}""",
    "erp_lot": """
        select distinct case when o_custkey % 50 % 6 = 5 then -1 - o_custkey % 50 else o_custkey % 50 end nlote, 2650 codfil,
               case o_custkey % 50 % 6 when 0 then 'N' when 1 then 'B' when 2 then 'R' when 3 then 'C'
                    else 'X' end flseparacao
        from {orders}""",
    "erp_reservation": """
        select case when l_returnflag = 'N' then -o_custkey else o_custkey end codreserva, l_partkey coditprod,
               l_shipdate dtentrega,
               case l_linenumber when 1 then 'AD' when 2 then 'AN' when 3 then 'EC' else 'NO' end codsitprod,
               case when l_linenumber in (4, 5) then 'C' when l_linenumber = 6 then 'T' else 'Z' end tipopedido,
               case when l_linenumber = 7 then 1 end codreservay, l_orderkey * 10 + l_linenumber numpedcomp
        from {lineitem} join {orders} on l_orderkey = o_orderkey""",
    "erp_area": """
        select distinct o_custkey % 40 praca, 'PRACA ' || cast(o_custkey % 40 as string) descricao from {orders}""",
    "erp_area_route": """
        select distinct case when o_custkey % 40 = 39 then -39 else o_custkey % 40 end praca,
               o_custkey % 40 % 12 codrota
        from {orders}""",
    "erp_route": """
        select distinct o_custkey % 40 % 12 codrota,
               case when o_custkey % 40 % 12 in (0, 4) then 'NORTE'
                    else 'ROTA_' || cast(o_custkey % 40 % 12 as string) end descricao
        from {orders}""",
    "erp_site_time": """
        select case when o_orderkey % 6 = 5 then -o_orderkey else o_orderkey end numpedven, o_orderdate dthora_int
        from {orders}
        union all
        select case when o_orderkey % 6 = 5 or o_orderkey % 2 = 1 then -o_orderkey else o_orderkey end numpedven,
               o_orderdate + interval '1' day dthora_int
        from {orders}""",
    "mode_map": """
        select distinct case when codmodal = 'M5' then '-M5' else codmodal end codmodal,
               case codmodal when 'COU' then 'Courier' when 'INA' then 'Inauguracao' when 'M2' then 'CD Entrega'
                    when 'M3' then 'CD Entrega' else 'Rota' end modal_master
        from {erp_order}""",
    "branch_map": """
        select cast(case when n_nationkey = 23 then -23 else n_nationkey end as string) cod, n_name filial from {nation}""",
    "city_map": """
        select distinct case when descricao in ('NORTE', 'ROTA_11') then '-' || descricao else descricao end rota,
               'CITY_' || substr(descricao, 6, 2) cidade
        from {erp_route}
        union all select 'SEDEX', 'CITY_S'
        union all select 'FAVORITA', 'CITY_F'""",
    "delivery": """
        select o_orderkey pedido, 'NATION_' || cast(c_nationkey as string) transp_corrigida,
               case when o_orderstatus = 'F' then 'ENTREGUE' else 'PENDENTE' end finalizador,
               case substr(o_orderpriority, 1, 1) when '1' then 'VENCIDO' when '2' then 'VENCE HOJE'
                    when '3' then 'VENCE HOJE' else 'À VENCER' end status_prazo,
               case o_orderkey % 7 when 0 then 'Endere o do Cliente Destino n o Localizado'
                    when 1 then 'Em rota de entrega' when 2 then '1a Tentativa Cliente Ausente'
                    when 3 then 'Saiu para Entrega' when 4 then 'Troca de transportadora'
                    when 5 then '' else 'Outro' end status_final,
               case c_mktsegment when 'MACHINERY' then 'CORREIOS' when 'HOUSEHOLD' then 'FRACIONADO'
                    when 'BUILDING' then null else c_mktsegment end regional
        from {orders} join {customer} on o_custkey = c_custkey""",
    "kpi_cells": """
        select cast(o_orderkey % 5 as int) pos, cast(count(*) as string) value from {orders} group by o_orderkey % 5""",
    "gate_log": """
        select event_id, case when event_id % 5 = 0 then null else event_type end event_type,
               case when event_id % 7 = 0 then null else value end value
        from {events}""",
}


# Schemas of stored views, read once as a catalog would keep them.
_STORED_SCHEMAS: dict[str, StructType] = {}


def _sources(name: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", VIEWS[name])


class Views:
    """The tables and views of one data directory as DataFrames, built when first used."""

    def __init__(
        self, spark: SparkSession, sf_dir: str, stored: str | None = None, results: tuple[str, ...] = ()
    ):
        self.spark, self.sf_dir, self.stored, self.results = spark, sf_dir, stored, results
        self._built: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._build(name)
        return self._built[name]

    def _build(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in VIEWS:
            raise AttributeError(name)
        if self.stored:
            return self.read_stored(name)
        sources = {source: getattr(self, source) for source in _sources(name)}
        return self.spark.sql(VIEWS[name], **sources)

    def read_stored(self, name: str) -> DataFrame:
        path = f"{self.stored}/{name}"
        if path not in _STORED_SCHEMAS:
            _STORED_SCHEMAS[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_STORED_SCHEMAS[path]).parquet(path)


def with_views(sql: str, extra: dict[str, str]) -> str:
    """``sql`` for DuckDB with the views it needs in front, in order of use."""
    texts = {name: text.format_map({s: s for s in (*BASE, *VIEWS)}) for name, text in VIEWS.items()} | extra
    pattern = re.compile(r"\b(" + "|".join(sorted(texts, key=len, reverse=True)) + r")\b")
    seen: set[str] = set()
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in pattern.findall(text):
            if name not in seen:
                seen.add(name)
                visit(texts[name])
                needed.append(name)

    visit(sql)
    if not needed:
        return sql
    views = ",\n".join(f"{name} as ({texts[name]})" for name in needed)
    body = sql.lstrip()
    return f"with {views}" + (f",\n{body[5:]}" if body.startswith("with ") else f"\n{body}")
