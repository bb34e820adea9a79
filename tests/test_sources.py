"""Sources, sinks and streams on new directories."""

import datetime as dt
import os
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from checks import reports
from checks.views import Views
from lotline.plans import receiving, warehouse
from lotline.sources import parts, sheets, tables
from lotline.sources.parts import append_batch, fold_slot, parts_of, read_parts
from lotline.sources.records import csv_records
from lotline.sources.snapshots import current_snapshot, read_snapshot, scratch_dir, write_snapshot
from lotline.streaming import shifts
from lotline.streaming.refresh import maintain_on_arrival, maintained, of_keys, refresh_on_arrival
from lotline.streaming.shifts import (
    batch_hours,
    compact_hours,
    hourly_production,
    store_hours,
    stored_shift_production,
)
from tests.conftest import SF_DIR


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_scratch_is_below_the_shared_folder(spark):
    path = scratch_dir(spark, "x")
    assert path.startswith(spark.conf.get("spark.checkpoint.dir") + "/x-")


def test_jdbc_options_need_a_split():
    split = {"partitionColumn": "id", "lowerBound": 0, "upperBound": 100, "numPartitions": 4}
    got = tables.jdbc_options("t", {"url": "jdbc:x", "password_env": "PW", **split}, env={"PW": "secret"})
    assert got["dbtable"] == "t" and got["password"] == "secret" and got["numPartitions"] == "4"
    assert "password_env" not in got
    assert tables.jdbc_options("(select 1) q", {"url": "jdbc:x", "numPartitions": 1}, env={})["numPartitions"] == "1"
    with pytest.raises(ValueError):
        tables.jdbc_options("t", {"url": "jdbc:x"}, env={})
    with pytest.raises(ValueError):
        tables.jdbc_options("t", {"url": "jdbc:x", "numPartitions": 4}, env={})


def test_positional_and_headed(spark):
    path = scratch_dir(spark, "sheet")
    spark.createDataFrame([("1", "2,5", None)], "a string, b string, c string").write.csv(path, header=False)
    assert rows(sheets.read_positional(spark, path, ["X", "Y", "Z"])) == [("1", "2,5", "")]
    headed = scratch_dir(spark, "sheet")
    spark.createDataFrame([("1", "x", "y")], "`A 1` string, b string, c string").write.csv(headed, header=True)
    got = sheets.read_headed(spark, headed, 2)
    assert got.columns == ["A 1", "b"] and rows(got) == [("1", "x")]


def test_csv_fill_with_and_without_schema(spark):
    path = scratch_dir(spark, "gate")
    df = spark.createDataFrame([(1, None, 2.5), (2, "x", None)], "id int, t string, v double")
    df.write.csv(path, header=True)
    want = [("1", "", "2.5"), ("2", "x", "")]
    assert rows(sheets.read_csv_fill(spark, path)) == want
    assert rows(sheets.read_csv_fill(spark, path, "id int, t string, v double")) == want


def test_lookups_are_text(spark):
    path = scratch_dir(spark, "lookups")
    for tab in ("modes", "branches", "cities"):
        spark.createDataFrame([(1, None)], "k int, v string").write.csv(f"{path}/{tab}", header=True)
    got = sheets.read_lookups(spark, path, fmt="csv")
    assert set(got) == {"modes", "branches", "cities"}
    assert rows(got["cities"]) == [("1", None)]


def test_kpi_block(spark):
    cells = spark.createDataFrame([(1, "b"), (0, "a"), (3, "d")], "pos int, value string")
    assert rows(sheets.kpi_block(cells, ["v", "w", "x", "y"])) == [("a", "b", None, "d")]


def test_snapshot_is_replaced_and_survives_a_failed_run(spark):
    path = scratch_dir(spark, "snap")
    assert write_snapshot(spark.range(5).toDF("x"), path) == 5
    first = current_snapshot(spark, path)
    broken = spark.range(3).select(F.raise_error(F.lit("no")).cast("long").alias("x"))
    with pytest.raises(Exception):
        write_snapshot(broken, path)
    assert current_snapshot(spark, path) == first
    assert write_snapshot(spark.range(2).toDF("x"), path) == 2
    assert rows(read_snapshot(spark, path)) == [(0,), (1,)]
    assert rows(spark.read.parquet(first)) == [(i,) for i in range(5)]
    write_snapshot(spark.range(1).toDF("x"), path)
    assert sorted(os.listdir(path)) == sorted(
        ["CURRENT", ".CURRENT.crc", *(x for x in os.listdir(path) if x.startswith("snapshot-"))]
    )
    assert len([x for x in os.listdir(path) if x.startswith("snapshot-")]) == 2
    with pytest.raises(FileNotFoundError):
        current_snapshot(spark, scratch_dir(spark, "none"))


def test_snapshot_csv_header(spark):
    path = scratch_dir(spark, "snap")
    write_snapshot(spark.range(2).toDF("x"), path, fmt="csv")
    assert rows(read_snapshot(spark, path, fmt="csv")) == [("0",), ("1",)]
    write_snapshot(spark.range(2).toDF("x"), path, fmt="csv", header=True)
    got = read_snapshot(spark, path, fmt="csv", header=True)
    assert got.columns == ["x"] and rows(got) == [("0",), ("1",)]


def test_empty_snapshot(spark):
    path = scratch_dir(spark, "snap")
    assert write_snapshot(spark.range(0).toDF("x"), path) == 0
    assert read_snapshot(spark, path).count() == 0


def test_gate_snapshot_count(spark):
    v = Views(spark, SF_DIR)
    target = scratch_dir(spark, "gate")
    assert receiving.gate_snapshot(spark, reports.gate_csv(v), target, reports.GATE_SCHEMA) == v.events.count()


def landed(v, path, lower, upper):
    part = v.pick_event.filter((F.col("nu_pedido") >= lower) & (F.col("nu_pedido") < upper))
    part.withColumn("dt_separacao", F.col("dt_separacao").cast("timestamp")).write.mode("append").parquet(path)


def test_stream_equals_batch_whatever_the_order_of_landing(spark):
    v = Views(spark, SF_DIR)
    source, stored, progress = (scratch_dir(spark, x) for x in ("in", "hours", "progress"))

    def run():
        schema = spark.read.parquet(source).schema
        picks = spark.readStream.schema(schema).parquet(source)
        store_hours(picks, v.order_header, v.product, stored, progress, once=True).awaitTermination()

    for lower, upper in ((600, 10**9), (300, 600), (0, 300)):  # newest first
        landed(v, source, lower, upper)
        run()
    expected = rows(reports.shifts(v))
    assert rows(stored_shift_production(spark, stored, as_of=reports.SHIFT_AS_OF)) == expected
    days = parts_of(spark, stored).slots()
    assert compact_hours(spark, stored) == sum(len(folders) > 1 for folders in days.values()) > 0
    assert {day: len(folders) for day, folders in parts_of(spark, stored).slots().items()} == dict.fromkeys(days, 1)
    assert rows(stored_shift_production(spark, stored, as_of=reports.SHIFT_AS_OF)) == expected
    assert compact_hours(spark, stored) == 0


def test_late_rows_are_counted(spark):
    v = Views(spark, SF_DIR)
    source, stored, progress = (scratch_dir(spark, x) for x in ("in", "hours", "progress"))
    landed(v, source, 0, 10**9)
    schema = spark.read.parquet(source).schema

    def run():
        picks = spark.readStream.schema(schema).parquet(source)
        store_hours(picks, v.order_header, v.product, stored, progress, once=True).awaitTermination()
        compact_hours(spark, stored)
        return read_parts(spark, stored).agg(F.sum("qt")).first()[0]

    late = hourly_production(v.pick_event.filter("nu_pedido < 10"), v.order_header, v.product).agg(F.sum("qt")).first()[0]
    before = run()
    landed(v, source, 0, 10)  # the oldest picks once more
    assert late > 0 and run() == before + late


def test_refresh_publishes_each_arrival(spark):
    v = Views(spark, SF_DIR)
    source, target, progress = (scratch_dir(spark, x) for x in ("in", "out", "progress"))
    landed(v, source, 0, 300)
    schema = spark.read.parquet(source).schema

    def rebuild(session):
        return session.read.parquet(source).groupBy("cd_carga").agg(F.count("*").alias("n"))

    def run():
        arrivals = spark.readStream.schema(schema).parquet(source)
        refresh_on_arrival(arrivals, rebuild, target, progress, once=True).awaitTermination()
        return read_snapshot(spark, target).agg(F.sum("n")).first()[0]

    assert run() == 300
    landed(v, source, 300, 400)
    assert run() == 400


def test_many_batches_are_one_scan_and_fold_by_day(spark):
    path = scratch_dir(spark, "hours")
    hours = spark.range(2).selectExpr(
        "timestamp '2024-01-05 08:00:00' + id * interval '1' day inicio", "id cd_carga", "1.5d qt", "id m3"
    ).selectExpr("inicio", "cd_carga", "cast(qt as decimal(38,6)) qt", "cast(m3 as decimal(38,15)) m3", "to_date(inicio) dia")
    hours = spark.createDataFrame(hours.collect(), hours.schema).coalesce(1)
    for batch in range(40):
        append_batch(hours.filter(f"cd_carga = {batch % 2}"), path, "dia", "s", batch)
    append_batch(hours, path, "dia", "s", 39)  # repeated
    report = stored_shift_production(spark, path, as_of="2024-01-06 12:00:00")
    assert sorted((r.cd_carga, r.qt_separado) for r in report.collect()) == [(0, 30), (1, 30)]
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1
    before = parts_of(spark, path)
    assert [len(folders) for folders in before.slots().values()] == [20, 20]
    after = fold_slot(spark, path, before, "2024-01-05", "dia", shifts._sum_up)
    assert [len(after.slots()[day]) for day in ("2024-01-05", "2024-01-06")] == [1, 20]
    assert after.slots()["2024-01-06"] == before.slots()["2024-01-06"]
    assert fold_slot(spark, path, before, "2024-01-05", "dia", shifts._sum_up) == after  # an older state folds nothing
    assert rows(stored_shift_production(spark, path, as_of="2024-01-06 12:00:00")) == rows(report)


def test_failed_rename_fails_the_batch_which_is_repeated(spark, monkeypatch):
    v = Views(spark, SF_DIR)
    source, stored, progress = (scratch_dir(spark, x) for x in ("in", "hours", "progress"))
    landed(v, source, 0, 10**9)
    schema, rename, calls = spark.read.parquet(source).schema, parts._rename, []

    def run():
        picks = spark.readStream.schema(schema).parquet(source)
        store_hours(picks, v.order_header, v.product, stored, progress, once=True).awaitTermination()

    def broken(*args):
        calls.append(args)
        raise OSError("no rename today")

    monkeypatch.setattr(parts, "_rename", broken)
    with pytest.raises(Exception, match="no rename today"):
        run()
    assert calls and parts_of(spark, stored) == parts.Parts()
    monkeypatch.setattr(parts, "_rename", rename)
    run()
    run()
    assert rows(stored_shift_production(spark, stored, as_of=reports.SHIFT_AS_OF)) == rows(reports.shifts(v))


def test_a_taken_number_is_not_overwritten(spark, monkeypatch):
    path = scratch_dir(spark, "parts")
    one = spark.range(1).selectExpr("id", "'a' slot")
    first = append_batch(one, path, "slot", "x", 0)
    assert not parts._publish(spark, path, first)
    stale, seen = parts.Parts(), []

    def late(spark_, path_):  # another writer was faster once
        seen.append(1)
        return stale if len(seen) < 3 else real(spark_, path_)

    real = parts.parts_of
    monkeypatch.setattr(parts, "parts_of", late)
    assert len(append_batch(one, path, "slot", "y", 0).live) == 2
    assert read_parts(spark, path).count() == 2


def test_orders_of_a_batch_are_cut_in_their_scan(spark):
    v = Views(spark, SF_DIR)
    plan = batch_hours(v.pick_event, v.order_header, v.product)._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    at = next(i for i, line in enumerate(lines) if "BroadcastHashJoin [_at#" in line)
    scan = next(i for i, line in enumerate(lines[at:], at) if "FileScan" in line)
    assert "o_orderkey" in lines[scan] and not any("Exchange" in line for line in lines[at:scan])


def test_a_batch_of_one_lot_reads_and_writes_that_lot(spark):
    source, base, target, progress = (scratch_dir(spark, x) for x in ("in", "orders", "out", "progress"))
    start = dt.datetime(2024, 1, 1)
    orders = [(12650, n, n, n % 40, start + dt.timedelta(hours=6 * (n % 40)), 10, "EPP") for n in range(200)]
    names = "cd_empresa int, nu_pedido long, nu_pedido_origem long, cd_carga long, dt_addrow timestamp_ntz, cd_situacao int, tp_pedido string"
    spark.createDataFrame(orders, names).write.parquet(base)
    header = spark.read.parquet(base)
    line = header.selectExpr(
        "cd_empresa", "nu_pedido_origem", "1 cd_produto", "10 cd_situacao", "cast(5 as decimal(18,6)) qt_separar",
        "cast(0 as decimal(18,6)) qt_cancelada",
    )
    product = spark.range(1).selectExpr(
        "1 cd_produto", *(f"cast(100 as decimal(18,6)) {c}" for c in ("vl_altura", "vl_largura", "vl_profundidade"))
    )
    schema = "cd_empresa int, cd_produto int, cd_carga long, dt_addrow timestamp_ntz, qt_separado decimal(18,6), qt_conferido decimal(18,6)"
    clock_ = {"as_of": start + dt.timedelta(days=5), "since": start + dt.timedelta(days=5)}
    read = []

    def land(lots, hours):
        picks = [(12650, 1, lot, start + dt.timedelta(hours=hours), D(2), D(1)) for lot in lots]
        spark.createDataFrame(picks, schema).coalesce(1).write.mode("append").parquet(source)

    def rebuild(session, changed):
        picks = of_keys(session.read.schema(schema).parquet(source), changed, {"cd_carga": "lote"})
        headers = of_keys(header, changed, {"cd_carga": "lote"})
        read.append((headers.select("cd_carga").distinct().count(), picks.count()))
        return warehouse.lot_status(headers, line, product, picks, as_of=clock_["as_of"])

    def touched(batch):
        aged = warehouse.aged_lots(header, spark.read.schema(schema).parquet(source), **clock_)
        return batch.select(F.col("cd_carga").alias("lote")).unionByName(aged)

    def run():
        arrivals = spark.readStream.schema(schema).parquet(source)
        maintain_on_arrival(arrivals, touched, rebuild, target, progress, slots=1000, once=True).awaitTermination()
        whole = rebuild(spark, None)
        read.pop()
        got = maintained(spark, target)
        assert got.columns == whole.columns and sorted(rows(got), key=str) == sorted(rows(whole), key=str)
        return dict(parts_of(spark, target).live)

    land(range(40), 48)
    before = run()
    land([7], 54)
    after = run()
    changed = {slot for slot in before if before[slot] != after.get(slot)}
    assert read[1] == (1, 2) and len(before) > 30 and len(changed) == 1 and set(before) == set(after)
    # Time goes on: lots that leave the window go, although nothing arrived for them.
    clock_["as_of"] = start + dt.timedelta(days=6, hours=1)
    land([8], 55)
    left = run()
    assert 0 < len(left) < len(after) and read[2][0] < 10


def test_shift_window_reaches_the_scan(spark):
    v = Views(spark, SF_DIR)
    plan = warehouse.shift_production(v.pick_event, v.order_header, v.product, as_of=reports.SHIFT_AS_OF)
    assert "GreaterThanOrEqual(ts,2024-01-28T06:00)" in plan._jdf.queryExecution().executedPlan().toString()


CELLS = [("1", 'he said "hi", ok', "  a "), ("2", "two\nlines", ""), ("3", "a,b", None)]


def test_snapshot_cells_come_back_as_they_were(spark):
    path = scratch_dir(spark, "cells")
    write_snapshot(spark.createDataFrame(CELLS, "a string, b string, c string"), path, fmt="csv", header=True)
    assert rows(read_snapshot(spark, path, fmt="csv", header=True)) == rows(
        spark.createDataFrame(CELLS, "a string, b string, c string")
    )


def test_sheet_cells_with_quotes_breaks_and_blanks(spark):
    path = scratch_dir(spark, "cells")
    text = 'a,b,c\n1,"he said ""hi"", ok",  a \n2,"two\nlines",\n'
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    expected = [("1", 'he said "hi", ok', "  a "), ("2", "two\nlines", "")]
    assert [tuple(r) for r in sheets.read_headed(spark, path).collect()] == expected
    assert [tuple(r) for r in sheets.read_csv_fill(spark, path).collect()] == expected
    positional = sheets.read_positional(spark, path, ["a", "b", "c"]).collect()
    assert [tuple(r) for r in positional][1:] == expected


def test_repeated_product_fails_the_report(spark):
    v = Views(spark, SF_DIR)
    twice = v.product.unionAll(v.product)
    plan = receiving.putaway_pending(v.label_grouped, v.label_single, twice, v.employee, as_of="2001-12-01", company=1590)
    with pytest.raises(Exception, match="not unique"):
        plan.collect()


def test_records_with_breaks_are_read_by_many_tasks(spark):
    path = scratch_dir(spark, "gate")
    cells = ['"in ""quotes"""', '"two\nlines, here"', "plain", "", '"\n\n"', '"a\r\nb"', '"' + "long\n" * 700 + '"', "7"]
    table = [[cells[(i * 7 + j * (1 + i % 5)) % len(cells) if i % 3 == 0 else 2] for j in range(3)] for i in range(1200)]
    for name, eol, part in (("one", "\n", table), ("two", "\r\n", table[:50])):
        text = eol.join(["a,b c,d", *(f"{i}," + ",".join(row[1:]) for i, row in enumerate(part))]) + eol
        spark.createDataFrame([(text[:-1],)], "value string").coalesce(1).write.text(f"{path}/{name}")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        lines = spark.read.text(f"{path}/one")
        assert lines.rdd.getNumPartitions() > 8
        # The border of a byte range lies within quotes somewhere.
        records = csv_records(spark, f"{path}/one")
        assert records.count() == 1201
        for place in ("one", "two"):
            for read in (sheets.read_csv_fill, sheets.read_headed):
                split, whole = read(spark, f"{path}/{place}", split=True), read(spark, f"{path}/{place}")
                assert split.columns == whole.columns == ["a", "b c", "d"] and rows(split) == rows(whole)
        kind = "a int, b string, d string"
        typed = sheets.read_csv_fill(spark, f"{path}/one", kind, split=True)
        assert rows(typed) == rows(sheets.read_csv_fill(spark, f"{path}/one", kind))
        names = ["x", "y", "z"]
        assert rows(sheets.read_positional(spark, f"{path}/one", names, split=True)) == rows(
            sheets.read_positional(spark, f"{path}/one", names)
        )
        target = scratch_dir(spark, "gate-out")
        assert receiving.gate_snapshot(spark, f"{path}/one", target) == 1200
        assert rows(read_snapshot(spark, target, fmt="csv", header=True, split=True)) == rows(
            read_snapshot(spark, target, fmt="csv", header=True)
        )
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_records_of_headers_alone_and_of_open_quotes(spark):
    path = scratch_dir(spark, "gate")
    spark.createDataFrame([("a,b",)], "value string").coalesce(1).write.text(f"{path}/head")
    assert rows(sheets.read_headed(spark, f"{path}/head", split=True)) == []
    spark.createDataFrame([('a,b\n1,"x\ny',)], "value string").coalesce(1).write.text(f"{path}/open")
    assert [r.text for r in csv_records(spark, f"{path}/open").orderBy("number").collect()] == ["a,b", '1,"x\ny']
