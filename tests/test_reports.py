"""Reports against hand-written rows, for what the test tables do not reach."""

import datetime as dt
from decimal import Decimal

import pytest

from checks import reports
from checks.views import Views
from lotline.plans import backlog, backlog_views, closing, delivery, receiving, warehouse
from pyspark.sql import functions as F
from tests.conftest import SF_DIR
from tests.test_operators import scans

D = Decimal


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture
def floor(spark):
    """Headers, lines, products and picks of three lots."""
    header = spark.createDataFrame(
        [
            (12650, 1, 1, 7, dt.datetime(2024, 1, 5, 8), 10, "EPP"),
            (12650, 2, 2, 7, dt.datetime(2024, 1, 4, 8), 64, "EPP"),
            (12650, 3, 3, 8, dt.datetime(2024, 1, 5, 9), 10, None),
            (12650, 4, 4, 9, dt.datetime(2023, 12, 1), 10, "EPP"),
            (12650, 5, 5, 9, dt.datetime(2024, 1, 5), 68, "EPP"),
            (999, 6, 6, 9, dt.datetime(2024, 1, 5), 10, "RMN"),
        ],
        "cd_empresa int, nu_pedido int, nu_pedido_origem int, cd_carga int, dt_addrow timestamp_ntz, cd_situacao int, tp_pedido string",
    )
    line = spark.createDataFrame(
        [
            (12650, 1, 1, D(10), D(2), 10),
            (12650, 1, 1, D(5), None, 64),  # closed line of an open order
            (12650, 1, 1, D(5), None, 68),  # cancelled
            (12650, 2, 1, D(4), None, 64),  # closed line of a closed order
            (12650, 3, 1, D(6), None, 64),  # the only line is closed: no lot 8
        ],
        "cd_empresa int, nu_pedido_origem int, cd_produto int, qt_separar decimal(18,6), qt_cancelada decimal(18,6), cd_situacao int",
    )
    product = spark.createDataFrame(
        [(1, D(100), D(100), D(100))],
        "cd_produto int, vl_altura decimal(18,6), vl_largura decimal(18,6), vl_profundidade decimal(18,6)",
    )
    pick = spark.createDataFrame(
        [(12650, 99, 1, D(1), None, dt.datetime(2024, 1, 5))],
        "cd_empresa int, cd_carga int, cd_produto int, qt_separado decimal(18,6), qt_conferido decimal(18,6), dt_addrow timestamp_ntz",
    )
    return header, line, product, pick


def test_lot_without_picks(floor):
    header, line, product, pick = floor
    got = warehouse.lot_status(header, line, product, pick, as_of="2024-01-06").collect()
    assert len(got) == 1
    lot = got[0]
    assert (lot.lote, lot.data_corte, lot.programacao, lot.pedidos, lot.cd_situacao) == (7, "04/01/2024", 12, 2, 10)
    assert (lot.cub_programada, lot.separado, lot.pendente_sep, lot.pendente_conf) == (14, 0, 0, 0)
    full = warehouse.lot_status(header, line, product, pick, as_of="2024-01-06", unmatched_pending="full").first()
    assert (full.pendente_sep, full.cub_pendente_conf) == (12, 14)


def test_lot_status_window_and_options(floor):
    header, line, product, pick = floor
    assert warehouse.lot_status(header, line, product, pick, as_of="2024-01-09 09:00:00").count() == 1
    later = warehouse.lot_status(header, line, product, pick, as_of="2024-01-10 08:00:01")
    assert later.count() == 0
    with pytest.raises(ValueError):
        warehouse.lot_status(header, line, product, pick, as_of="2024-01-06", unmatched_pending="other")


def test_shift_production_night_and_weights(spark, floor):
    header, _, product, _ = floor
    picks = spark.createDataFrame(
        [
            (12650, 1, 1, D("2.5"), dt.datetime(2024, 1, 5, 5, 59, 59)),
            (12650, 1, 1, D(1), dt.datetime(2024, 1, 5, 6, 0)),
            (12650, 1, 1, D(0), dt.datetime(2024, 1, 5, 7, 0)),  # nothing picked
            (12650, 3, 1, D(1), dt.datetime(2024, 1, 5, 8, 0)),  # order without type
            (12650, 1, 1, D(3), dt.datetime(2024, 1, 4, 5, 0)),  # business date 3 January
            (12650, 1, 1, D(1), dt.datetime(2024, 1, 4, 22, 0)),
        ],
        "cd_empresa int, nu_pedido int, cd_produto int, qt_separado decimal(18,6), dt_separacao timestamp_ntz",
    )
    got = rows(warehouse.shift_production(picks, header, product, as_of="2024-01-06 10:00:00"))
    assert got == [
        ("2024-01-04", 7, "3 TURNO", D(3), D("1.00"), "05"),
        ("2024-01-04", 7, "3 TURNO", D(1), D("1.00"), "22"),
        ("2024-01-05", 7, "1 TURNO", D(1), D("1.00"), "06"),
    ]
    weighted = warehouse.shift_production(picks, header, product, as_of="2024-01-06", weight_by_qty=True)
    assert rows(weighted)[0][4] == D("2.50")


def test_pick_productivity_merges_orders_of_one_origin(spark):
    v = Views(spark, SF_DIR)
    salted = warehouse.pick_productivity(
        v.pick_event, v.order_header, v.task, v.employee, reports.profile(v), v.product, v.family, v.product_line,
        as_of=reports.PICK_AS_OF, salts=4, ordered=False,
    )
    plain = reports.productivity(v)
    assert len(plain.columns) == 28
    assert sorted(rows(salted), key=str) == sorted(rows(plain), key=str)


def test_stations_of_an_address(spark):
    """One row per station of the own company; a pick counts once per station under its label."""
    links = [(12650, "P10002001001", 1), (12650, "P10002001001", 4), (15350, "P10002001001", 2), (12650, "P10003001001", 9)]
    links = spark.createDataFrame(links, "cd_empresa int, cd_endereco string, cd_posto int")
    stations = [(12650, 1, "MERCADO"), (12650, 4, "MERCADO"), (15350, 1, "OTHER"), (15350, 2, "OTHER")]
    stations = spark.createDataFrame(stations, "cd_empresa int, cd_posto int, ds_posto string")
    v = Views(spark, SF_DIR)
    at = v.location.limit(1).drop("cd_endereco", "cd_area_armaz")
    at = at.withColumn("cd_area_armaz", F.lit("1")).crossJoin(
        spark.createDataFrame([("P10002001001",), ("P10003001001",), ("P10004001001",)], "cd_endereco string")
    )
    places = warehouse.location_profile(at, v.storage_class, v.storage_area, v.location_type, links, stations)
    got = sorted((r.cd_endereco, r.ds_posto) for r in places.collect())
    assert got == [
        ("P10002001001", "MERCADO"), ("P10002001001", "MERCADO"), ("P10003001001", None), ("P10004001001", None),
    ]

    def picked(location):
        picks = warehouse.pick_productivity(
            v.pick_event.withColumn("cd_endereco", F.lit("P10002001001")), v.order_header, v.task, v.employee, location,
            v.product, v.family, v.product_line, as_of=reports.PICK_AS_OF, ordered=False,
        )
        return picks.groupBy("posto").agg(F.count("*").alias("n"), F.sum("qtde_separada").alias("qt")).collect()

    (twice,), (once,) = picked(places), picked(places.dropDuplicates(["cd_endereco"]))
    assert (twice.posto, twice.n, twice.qt) == ("BENS DE CONSUMO", once.n, 2 * once.qt)


def test_area_with_two_routes_fails(spark):
    area = spark.createDataFrame([(1,), (2,), (3,)], "praca int")
    links = [(1, 10), (2, 20), (4, 10)]
    route = spark.createDataFrame([(10, "NORTE"), (20, "SUL")], "codrota int, descricao string")

    def routes(rows):
        return backlog.route_of_area(area, spark.createDataFrame(rows, "praca int, codrota int"), route)

    assert sorted(rows(routes(links))) == [(1, "NORTE"), (2, "SUL")]
    with pytest.raises(Exception, match="not unique"):
        routes([*links, (2, 10)]).collect()


def test_putaway_drops_labels_without_area(spark):
    schema = (
        "cd_empresa int, cd_agenda int, {label} int, dt_conferencia timestamp_ntz, dt_addrow timestamp_ntz, "
        "cd_produto int, cd_func_conferencia int, qt_conferido double, cd_situacao int, cd_endereco string"
    )
    at = dt.datetime(2024, 1, 5, 23, 59)
    grouped = spark.createDataFrame(
        [(1590, 1, 10, at, at, 5, 1, 2.0, 23, "E1"), (1590, 1, 11, at, at, 11, 1, 2.0, 23, "E1")],
        schema.format(label="nu_etiqueta_lote"),
    )
    single = spark.createDataFrame(
        [
            (1590, 1, 20, at, at, 5, 1, 2.0, 23, "E1", 17),
            (1590, 1, 21, at, at, 5, 1, 2.0, 23, "E1", None),
            (1590, 1, 22, at, at, 6, 1, 2.0, 23, "E1", 3),
            (1590, 1, 23, at, at, 6, 2, 2.0, 23, "E1", 3),  # checker unknown
        ],
        schema.format(label="nu_etiqueta") + ", cd_area_armaz int",
    )
    product = spark.createDataFrame([(5, "five")], "cd_produto int, ds_produto string")
    employee = spark.createDataFrame([(1, "ana")], "cd_funcionario int, nm_funcionario string")
    got = receiving.putaway_pending(grouped, single, product, employee, as_of="2024-01-07 00:00:00", company=1590)
    assert [(r.etiqueta, r.dias, r.ds_produto, r.tp_etiqueta, r.data_entrada) for r in got.collect()] == [
        (10, 2, "five", "AGRUPADA", "05/01/2024 23:59"),
        (22, 2, None, "NORMAL", "05/01/2024 23:59"),
    ]


STATE = "fllibfat string, sitcarga int, flseparacao string"


def test_line_status_order(values):
    data = [
        ("N", 2, "N"), ("S", 2, "N"), ("S", 8, None), ("S", 9, "C"), ("S", 14, "B"), ("S", 0, "N"), ("S", 1, "B"),
        ("S", 0, "R"), ("S", 0, "C"), ("S", 0, "X"), ("S", 0, None), (None, None, None),
    ]
    assert values(backlog.line_status(), data, STATE) == [
        "1-Nao Liberado", "6-Conferido Aguardando Fat", "8-Venda Pendente SEFAZ", "9-Bloqueado Expedicao",
        "14-Eficiencia Energetica", "3-Lote montado", "4-Lote em Separacao", "4-Lote em Separacao",
        "5-Lote em Conferencia", "2-Liberado", "2-Liberado", "2-Liberado",
    ]


def test_line_situation(values):
    data = [
        ("N", "AD", "T", None), ("N", "AN", "C", 1), ("N", "EC", "T", 1), ("N", "NO", "T", None), ("N", "NO", "C", 1),
        ("N", "NO", "C", None), ("N", None, "C", None), ("N", "NO", "Z", None), ("S", "AD", "T", 1), (None, "AD", "T", 1),
    ]
    got = values(backlog.line_situation(), data, "fllibfat string, codsitprod string, tipopedido string, codreservay int")
    assert got == [
        "Adicional", "Adicional", "Encomenda", "Roteiro Y", "Roteiro Y", "Pedido de Compra", None, None, None, None,
    ]


def test_managerial_state_order(values):
    as_of, late, edge = "2024-01-01 12:00:00", dt.datetime(2024, 1, 3, 12, 0, 1), dt.datetime(2024, 1, 3, 12)
    data = [
        ("Roteiro Y", "N", late, "INA", 9), ("Adicional", "N", late, "INA", 9), (None, "S", late, "INA", 9),
        (None, "S", edge, "INA", 9), (None, "S", None, "COU", 9), (None, "S", edge, "COU", 0), (None, None, late, "COU", 9),
    ]
    schema = "situacao string, fllibfat string, dt_maxima timestamp_ntz, codmodal string, sitcarga int"
    lines = [(*r, "EM PROCESSO") for r in data]
    assert values(backlog.managerial_state(as_of), lines, schema + ", status_operacao string") == [
        "ROT Y", "VENDA FORNECEDOR", "PROGRAMADO", "ABA INAUGURACAO", "BLOQUEADO", "EM PROCESSO", "EM PROCESSO",
    ]


def test_delivery_route_without_mode(values):
    data = [("NORTE", "COU"), ("NORTE", "M2"), ("NORTE", None), ("ROTA_1", "COU"), (None, "COU")]
    assert values(backlog.delivery_route(), data, "rota string, codmodal string") == [
        "SEDEX", "FAVORITA", "NORTE", "ROTA_1", None,
    ]


def test_operation_state(values):
    assert values(backlog.operation_state(), [(None,), (0,), (5,)], "numlote int") == [
        "EM CARTEIRA", "EM CARTEIRA", "EM PROCESSO",
    ]


def test_eligibility(spark):
    base = dict(
        tpnota=55, status=4, fltransffatnf=None, sitcarga=0, tpped="E", filorig=2650, flcredlista=None,
        fllibfat="S", codfiltransffat=1,
    )
    changes = [
        ({}, True), ({"tpnota": 51, "status": 5}, True), ({"tpnota": 51, "status": 5, "fltransffatnf": "S"}, False),
        ({"tpnota": 51}, False), ({"status": 5}, False), ({"sitcarga": 3}, False), ({"tpped": None}, False),
        ({"filorig": 1}, False), ({"flcredlista": "G"}, False), ({"flcredlista": "X"}, True), ({"fllibfat": "N"}, False),
        ({"codfiltransffat": 98}, False), ({"codfiltransffat": None}, False),
    ]
    schema = (
        "n int, tpnota int, status int, fltransffatnf string, sitcarga int, tpped string, filorig int, "
        "flcredlista string, fllibfat string, codfiltransffat int"
    )
    df = spark.createDataFrame([(i, *(base | change).values()) for i, (change, _) in enumerate(changes)], schema)
    kept = {r.n for r in df.filter(backlog.eligible() & backlog.listed()).collect()}
    assert kept == {i for i, (_, wanted) in enumerate(changes) if wanted}


def test_backlog_branches_are_distinct_apart(spark):
    """Copies within kits or within plain items vanish; the same line in both stays twice."""
    v = Views(spark, SF_DIR)
    t = reports.tables(v)
    doubled = backlog.BacklogTables(
        **{**t.__dict__, "item": t.item.unionByName(t.item), "kit_item": t.kit_item.unionByName(t.kit_item)}
    )
    once, twice = (backlog.backlog_lines(x, backlog.listed_orders(x)) for x in (t, doubled))
    assert sorted(rows(once), key=str) == sorted(rows(twice), key=str)


def test_equal_lines_of_two_kinds_are_one(spark):
    """Kinds without label look alike: their lines are equal, but an item meets orders of its own kind only."""
    t = reports.tables(Views(spark, SF_DIR))
    kinds = {"tipoped": F.lit(7)}
    other = {name: getattr(t, name).filter("tipoped = 1").withColumns(kinds) for name in ("order", "item", "kit_item")}
    once = sorted(rows(backlog.backlog_lines(t, backlog.listed_orders(t))), key=str)
    for added in (other, {"order": other["order"]}, {"item": other["item"], "kit_item": other["kit_item"]}):
        more = {name: getattr(t, name).unionByName(df) for name, df in added.items()}
        x = backlog.BacklogTables(**{**t.__dict__, **more})
        assert sorted(rows(backlog.backlog_lines(x, backlog.listed_orders(x))), key=str) == once


def test_whole_lines_are_not_shuffled_to_be_distinct(spark):
    t = reports.tables(Views(spark, SF_DIR))
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        plan = backlog.backlog_lines(t, backlog.listed_orders(t))._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    dealt = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert dealt and not any("ordered#" in line for line in dealt)


def test_site_movements_meet_site_orders_only(spark):
    orders = spark.createDataFrame(
        [(200, 1, "2024-01-01 08:00:00"), (300, 1, "2024-01-02 08:00:00"), (200, 2, "2024-01-03 08:00:00"), (200, None, None)],
        "codfil int, numpedven long, hrpedido string",
    ).withColumn("hrpedido", F.col("hrpedido").cast("timestamp"))
    moves = spark.createDataFrame([(1, "2024-02-02 08:00:00"), (1, "2024-02-01 08:00:00"), (2, None), (None, "2024-02-01 08:00:00")], "numpedven long, at string")
    told = backlog.release_time(orders, moves.select("numpedven", F.col("at").cast("timestamp").alias("dthora_int")))
    got = {(r.codfil, r.numpedven): str(r.dtlibfat_mod) for r in told.collect()}
    assert got == {(200, 1): "2024-02-01 08:00:00", (300, 1): "2024-01-02 08:00:00", (200, 2): "None", (200, None): "None"}


def test_backlog_is_the_same_salted_and_cut(spark):
    v = Views(spark, SF_DIR)
    plain = sorted(rows(reports.orders_listed(v)), key=str)
    assert sorted(rows(reports.orders_listed(v, salts=4)), key=str) == plain
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "2000")
    try:
        assert sorted(rows(reports.orders_listed(v)), key=str) == plain
        cut = warehouse.pick_productivity(
            v.pick_event, v.order_header, v.task, v.employee, reports.profile(v), v.product, v.family, v.product_line,
            as_of=reports.PICK_AS_OF,
        )
        cut_rows = sorted(rows(cut), key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert cut_rows == sorted(rows(reports.productivity(v)), key=str)


def test_hot_order_is_split_at_run_time(spark):
    """A third of the picks in one order: the join spreads them, the sums stay whole."""
    picks = spark.range(0, 60000, 1, 8).select(
        F.lit(12650).alias("cd_empresa"),
        F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 9000).alias("nu_pedido"),
        (F.col("id") % 50).alias("cd_produto"),
        F.lit(1).cast("decimal(18,6)").alias("qt_separado"),
        F.expr("timestamp_ntz '2024-01-05 08:00:00' + (id % 3600) * interval '1' second").alias("dt_separacao"),
    )
    headers = spark.range(9000).select(
        F.lit(12650).alias("cd_empresa"),
        F.col("id").alias("nu_pedido"),
        (F.col("id") % 10).alias("cd_carga"),
        F.lit("EPP").alias("tp_pedido"),
    )
    product = spark.range(50).select(
        F.col("id").alias("cd_produto"),
        *(F.lit(100).cast("decimal(18,6)").alias(c) for c in ("vl_altura", "vl_largura", "vl_profundidade")),
    )
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        report = warehouse.shift_production(picks, headers, product, as_of="2024-01-06")
        got = report.collect()
        plan = report._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert sum(r.qt_separado for r in got) == 60000
    assert {r.cd_carga: r.qt_separado for r in got}[5] >= 20000
    assert "skew=true" in plan


ENRICHED = "status string, familia string, qtcomp decimal(18,6), cubtotal decimal(18,6), modal_master string, filial string, cidade string, numpedven int"


@pytest.fixture
def page(spark):
    return spark.createDataFrame(
        [
            ("2-Liberado", "F1", D(10), D("1.5"), "Rota", "B1", "C1", 1),
            ("4-Lote em Separacao", None, D(5), D("2.5"), "Rota", None, "C1", 1),
            ("4-Lote em Separacao", "F1", D(1), D("0.5"), None, "B1", None, 2),
            (None, "F2", D(2), D("4"), "CD Entrega", "B2", "C2", 3),
            ("3-Lote montado", "F2", D(2), D("4"), "CD Entrega", "B2", None, 4),
        ],
        ENRICHED,
    )


def test_status_total_is_the_sum_of_shown_rows(page):
    got = rows(backlog_views.backlog_by_status(page))
    assert got[0] == (None, D(2), D(4)) and got[-1] == ("Total", D(20), D("12.5"))
    assert rows(backlog_views.backlog_by_status(page, display=True))[-1][3:] == ("20", "12,5")


def test_families_keep_the_group_without_name(page):
    assert [r[0] for r in rows(backlog_views.top_families(page))] == ["F2", None, "F1"]


def test_modes_leave_out_rows_without_mode(page):
    assert rows(backlog_views.modes_in_process(page)) == [
        ("Rota", D(15), D("1.5"), D("2.5"), D(4)),
        ("Total", D(15), D("1.5"), D("2.5"), D(4)),
    ]


def test_branch_table_leaves_out_missing_keys(page):
    got = rows(backlog_views.branch_mode_pieces(page, ["CD Entrega", "Rota"]))
    assert got == [("B1", 0, D(10), D(10)), ("B2", D(4), 0, D(4))]


def test_delivery_cities(page):
    assert rows(backlog_views.delivery_cities(page)) == [("C2", 1, D(2), D(4))]


def test_days_in_backlog(page):
    got = dict(rows(backlog_views.days_in_backlog(page, capacity=5)))
    assert got == {"Carteira Atual": 12.5, "Capacidade": 5.0, "Dias Em Carteira": 2.5}


SALES = "tipo_pedido string, status_operacao_gerencial string, status_operacao string, status string, numlote int, numpedven int, valtotal decimal(18,6)"


def test_closing_reports(spark):
    sales = spark.createDataFrame(
        [
            ("VENDAS", "EM PROCESSO", "EM PROCESSO", "4-Lote em Separacao", 7, 1, D(100)),
            ("VENDAS", "EM PROCESSO", "EM PROCESSO", "4-Lote em Separacao", 8, 2, D(300)),
            ("VENDAS", None, "EM PROCESSO", "6-Conferido Aguardando Fat", 9, 3, D(50)),
            ("VENDAS", "EM PROCESSO", "EM PROCESSO", "6-Conferido Aguardando Fat", 9, 4, D(50)),
            ("VENDAS", "PROGRAMADO", "EM CARTEIRA", "2-Liberado", None, 5, D(999)),
            ("VENDAS", "EM CARTEIRA", "EM CARTEIRA", "2-Liberado", None, 6, D(20)),
            ("ABA", "EM CARTEIRA", "EM CARTEIRA", "2-Liberado", None, 7, D(999)),
            (None, "EM CARTEIRA", "EM CARTEIRA", "2-Liberado", None, 8, D(999)),
        ],
        SALES,
    )
    lots = spark.createDataFrame([(8, 5, 6)], "lote int, pendente_sep int, pendente_conf int")
    assert rows(closing.closing_top_lots(sales, lots)) == [(8, D(300), 5, 6), (None, D(100), None, None)]
    assert rows(closing.closing_top_orders(sales)) == [(6, D(20))]
    assert rows(closing.lots_to_invoice(sales)) == [(1,)]
    assert rows(closing.result_vs_target(sales, 500)) == [(D(520), 500, D(20), True)]
    assert rows(closing.closing_by_status(sales))[-1] == ("Total", D(520))


DELIVERY = "transp_corrigida string, finalizador string, status_prazo string, status_final string, regional string"


def test_delivery_reports(spark):
    data = [
        ("", "PENDENTE", "VENCE HOJE", "Em rota de entrega", None),
        ("A", "PENDENTE", "VENCE HOJE", "Outro", "SUL"),
        ("A", "PENDENTE", "VENCIDO", "Em rota de entrega", "SUL"),
        ("B", "PENDENTE", "VENCE HOJE", "Saiu para Entrega", "SUL"),
        ("B", "PENDENTE", "VENCE HOJE", "Em rota de entrega", "SUL"),
        ("B", "PENDENTE", "VENCE HOJE", "Em rota de entrega", "CORREIOS"),
        ("C", "ENTREGUE", "VENCE HOJE", "Em rota de entrega", "SUL"),
        (None, "PENDENTE", "À VENCER", "", "SUL"),
    ]
    df = spark.createDataFrame(data, DELIVERY)
    assert rows(delivery.due_totals(df)) == [(1, 4, 1, 6)]
    by_carrier = rows(delivery.due_by_carrier(df))
    assert by_carrier == [("B", 0, 2, 0, 2), ("A", 0, 1, 1, 2), ("", 0, 1, 0, 1), (None, 1, 0, 0, 1)]
    matrix = delivery.due_today_matrix(df)
    assert matrix.columns == ["transp_corrigida", "Em Entrega", "Saiu_para Entrega"]
    assert rows(matrix) == [("", 1, 0), ("B", 1, 1)]


def test_totals_cover_all_carriers(spark):
    deliveries = Views(spark, SF_DIR).delivery
    totals = delivery.due_totals(deliveries).first()
    carriers = delivery.due_by_carrier(deliveries, n=1000)
    sums = carriers.agg(*(F.sum(c) for c in ("a_vencer", "vence_hoje", "vencido", "total"))).first()
    assert tuple(totals) == tuple(sums)


def test_orders_without_lot_go_past_the_join_with_lots(spark):
    orders = spark.createDataFrame(
        [(1, 7, 2650), (2, 0, 2650), (3, None, 2650), (4, 8, 2650), (5, 7, 9), (6, 50, 2650)],
        "numpedven int, numlote int, filorig int",
    )
    lots = spark.createDataFrame(
        [(7, 2650, "N"), (7, 2650, "N"), (8, 2650, None), (50, 2650, "B")], "nlote long, codfil long, flseparacao string"
    )
    plain = orders.join(lots.withColumnsRenamed({"nlote": "numlote", "codfil": "filorig"}), ["numlote", "filorig"], "left")
    for salts in (0, 4):
        flagged = backlog.with_lot_flags(orders, lots, salts)
        told = backlog.with_lot_state(flagged).select("numpedven", "flseparacao")
        assert sorted(rows(told), key=str) == sorted(rows(plain.select("numpedven", "flseparacao")), key=str)
    # A lot 0 that exists is a lot like others.
    zero = lots.unionByName(spark.createDataFrame([(0, 2650, "C")], lots.schema))
    assert rows(backlog.with_lot_state(backlog.with_lot_flags(orders, zero)).filter("numlote = 0").select("flseparacao")) == [("C",)]


def test_items_read_twice(spark, tmp_path_factory):
    place = tmp_path_factory.mktemp("t")  # the plan shows the start of a path only
    t = reports.tables(Views(spark, SF_DIR))
    t.item.write.parquet(f"{place}/items")
    stored = backlog.BacklogTables(**{**t.__dict__, "item": spark.read.parquet(f"{place}/items")})
    lines = backlog.backlog_lines(stored, backlog.listed_orders(stored), salts=8)
    assert scans(lines, "items") == 2


def test_pages_from_their_sums_equal_pages_from_rows(spark, page, tmp_path_factory):
    modes = ["CD Entrega", "Rota"]
    views = {
        "status": [backlog_views.backlog_by_status, backlog_views.days_in_backlog],
        "family": [backlog_views.top_families],
        "mode": [backlog_views.modes_in_process],
        "branch": [lambda r: backlog_views.branch_mode_pieces(r, modes), lambda r: backlog_views.branch_mode_volume(r, modes)],
        "city": [backlog_views.delivery_cities],
    }
    sums = backlog_views.page_sums(page)
    assert rows(sums.select("page").distinct().orderBy("page")) == [(name,) for name in sorted(views)]
    for name, builders in views.items():
        for build in builders:
            assert rows(build(backlog_views.page_of(sums, name))) == rows(build(page))
    place = tmp_path_factory.mktemp("t")
    page.write.parquet(f"{place}/rows")
    assert scans(backlog_views.page_sums(spark.read.parquet(f"{place}/rows")), "rows") == 1
    assert backlog_views.page_sums(page.limit(0)).count() == 0


def test_matrix_reads_the_deliveries_once(spark, tmp_path_factory):
    place = tmp_path_factory.mktemp("t")
    v = Views(spark, SF_DIR)
    v.delivery.write.parquet(f"{place}/due")
    stored = spark.read.parquet(f"{place}/due")
    assert scans(delivery.due_today(stored), "due") == 1
    matrix = delivery.due_today_matrix(stored)  # has read them
    assert scans(matrix, "due") == 0 and rows(matrix) == rows(delivery.due_today_matrix(v.delivery))


def test_too_many_modes_are_no_columns(spark):
    names = spark.range(501).select(F.col("id").cast("string").alias("modal_master"))
    with pytest.raises(ValueError, match="more than 500"):
        backlog_views.mode_names(names)
    assert len(backlog_views.mode_names(names.limit(500))) == 500
