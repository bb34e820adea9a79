"""Operators against hand-written rows."""

import pytest
from pyspark.sql import functions as F

import checks.operators  # noqa: F401
from checks.registry import BUILDERS
from checks.views import Views
from lotline.operators import aggregates, filters, joins, ordering
from tests.conftest import SF_DIR


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_missing_values_in_filters(spark):
    df = spark.createDataFrame([("G",), ("X",), (None,)], "f string")
    assert rows(filters.filter_ne_keep_null(df, "f", "G")) == [("X",), (None,)]
    assert rows(df.filter(F.col("f") != "G")) == [("X",)]


def test_closed_line_of_open_order(spark):
    df = spark.createDataFrame([(64, 64), (10, 64), (10, 10), (None, 64), (10, None)], "a int, b int")
    kept = df.filter(~filters.closed_line_of_open_order(F.col("a"), F.col("b"), 64))
    assert rows(kept) == [(64, 64), (10, 10)]


def test_first_per_key_is_the_smallest(spark):
    data = [(1, 5, "b"), (1, 3, "z"), (1, 3, "a"), (2, 9, None), (2, 9, "q"), (None, 1, "n")]
    df = spark.createDataFrame(data, "k int, d int, s string")
    got = joins.first_per_key(df, ["k"], ["d"], ["d", "s"])
    assert sorted(rows(got), key=str) == sorted([(1, 3, "a"), (2, 9, None), (None, 1, "n")], key=str)


def test_require_unique(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (None, "d")], "k int, s string")
    assert rows(joins.require_unique(df, ["k"])) == [(1, "a"), (2, "b")]  # a NULL key is never looked up
    with pytest.raises(Exception, match="not unique"):
        joins.require_unique(df.unionByName(df), ["k"]).collect()


def test_lookup_merge_fans_out_and_keeps_unmatched(spark):
    fact = spark.createDataFrame([(1, 10), (2, 20), (3, None)], "id int, code int")
    dim = spark.createDataFrame([("10", "x"), ("10", "y"), (None, "z")], "cod string, nome string")
    got = joins.lookup_merge(fact, dim, {"code": "cod"})
    assert got.columns == ["id", "code", "cod", "nome"]
    assert sorted(rows(got), key=str) == sorted(
        [(1, 10, "10", "x"), (1, 10, "10", "y"), (2, 20, None, None), (3, None, None, None)], key=str
    )


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_plain_join(spark, how):
    left = spark.range(900).select(
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 40).alias("k"),
        F.col("id").alias("v"),
    )
    right = spark.range(60).select((F.col("id") % 30).alias("k"), F.col("id").alias("w"))
    plain = left.join(right, ["k"], how)
    salted = joins.salted_join(left, right, ["k"], how, salts=6)
    assert salted.columns == plain.columns
    assert sorted(rows(salted), key=str) == sorted(rows(plain), key=str)
    assert spark.range(1).select(joins.hot_keys(left, ["k"], 0.2)).first()[0] == [left.select(F.xxhash64(F.lit(7).cast("long"))).first()[0]]
    placed = joins.salted_join(left, right, ["k"], how, salts=6, share=0.2)
    assert placed.count() == plain.count()


def test_salted_join_spreads_equal_rows_of_a_hot_key(spark):
    left = spark.range(0, 3000, 1, 16).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"))
    right = left.distinct().withColumn("name", F.col("k") * 2)
    joined = joins.salted_join(left, right, ["k"], salts=8)
    assert joined.count() == 3000 and joined.filter("k = 1 and name = 2").count() == 1001
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = joins.salted_join(left, right, ["k"], salts=8).groupBy(F.spark_partition_id()).count()
        assert max(r[1] for r in rows(sizes)) < 2000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_salted_join_rejects_other_kinds(spark):
    with pytest.raises(ValueError):
        joins.salted_join(spark.range(1), spark.range(1), ["id"], "full", salts=2)


def scans(df, name):
    """Scans of the table stored as ``name`` in the plan, without those that reuse another."""
    session = df.sparkSession
    session.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        session.conf.unset("spark.sql.adaptive.enabled")
    return sum("Scan parquet" in line and f"/{name}]" in line for line in plan.split("\n"))


def test_salted_join_reads_its_left_side_twice(spark, tmp_path_factory):
    place = tmp_path_factory.mktemp("t")  # the plan shows the start of a path only
    spark.range(4000).select((F.col("id") % 9).alias("k"), "id").write.parquet(f"{place}/left")
    left = spark.read.parquet(f"{place}/left")
    joined = joins.salted_join(left, spark.range(9).withColumnRenamed("id", "k"), ["k"], salts=8, share=0.05)
    assert joined.count() == 4000 and scans(joined, "left") == 2


def test_window_cuts_facts_by_bits(spark):
    facts = spark.range(1000).select((F.col("id") % 100).alias("k"), "id")
    keys = spark.createDataFrame([(3,), (3,), (None,), (5,)], "k int")  # a narrower type than that of the facts
    window = joins.Window(keys, ["k"])
    cut = window.cut(facts, ["k"])
    assert {r[0] for r in rows(cut)} == {3, 5} and cut.count() == 20 and cut.columns == ["k", "id"]
    assert "BroadcastHashJoin" in cut._jdf.queryExecution().executedPlan().toString()
    hit, rest = window.split(facts.unionByName(spark.createDataFrame([(None, 7)], "k long, id long")), ["k"])
    assert hit.count() == 20 and rest.count() == 981 and rest.filter("k is null").count() == 1
    assert window.cut(facts.limit(0), ["k"]).count() == 0 and joins.Window(keys.limit(0), ["k"]).cut(facts, ["k"]).count() == 0


def test_window_reads_its_rows_once_for_all_keys(spark, tmp_path_factory):
    place = tmp_path_factory.mktemp("t")  # the plan shows the start of a path only
    spark.range(5000).selectExpr("id a", "id % 70 b").write.parquet(f"{place}/picked")
    chosen = spark.read.parquet(f"{place}/picked").filter("a < 50")
    window = joins.Window(chosen, ["a"], ["b"], ["a", "b"])
    facts = spark.range(3000).selectExpr("id a", "id % 70 b")
    cuts = [window.cut(facts, keys).agg(F.count("*").alias("n")) for keys in (["a"], ["b"], ["a", "b"])]
    both = cuts[0].unionByName(cuts[1]).unionByName(cuts[2])
    assert [r.n for r in both.collect()] == [50, sum(i % 70 < 50 for i in range(3000)), 50]
    assert scans(both, "picked") == 1


def test_window_cuts_at_a_hundred_times_the_keys(spark):
    # sf0.1 has 91,875 orders in the selection.
    window = joins.Window(spark.range(9_187_500).selectExpr("id * 3 as k"), ["k"])
    facts = spark.range(1_500_000).selectExpr("id * 31 + 1 as k")
    others = facts.filter("k % 3 <> 0 or k >= 27562500")
    assert window.cut(others, ["k"]).count() < 0.1 * others.count()
    inside = facts.filter("k % 3 = 0 and k < 27562500")
    assert window.cut(inside, ["k"]).count() == inside.count()


def test_window_has_one_plan_at_any_size(spark):
    def shape(n):
        rows_ = joins.Window(spark.range(n), ["id"]).cut(spark.range(10 * n), ["id"])
        return [line.split("(")[0].strip(" :+-*") for line in rows_._jdf.queryExecution().optimizedPlan().toString().split("\n")]

    few, many = shape(10), shape(10_000_000)
    assert [x.split("#")[0] for x in few][:3] == [x.split("#")[0] for x in many][:3]


def test_lookup_one_judges_the_keys_in_use(spark):
    fact = spark.createDataFrame([(1, 10), (2, 20), (3, None), (4, 99)], "id int, k int")
    dim = spark.createDataFrame([(10, "a"), (20, "b"), (77, "x"), (77, "y"), (None, "z")], "k long, name string")
    got = joins.lookup_one(fact, dim, ["k"])
    assert got.columns == ["id", "k", "name"]
    assert sorted(rows(got)) == [(1, 10, "a"), (2, 20, "b"), (3, None, None), (4, 99, None)]
    with pytest.raises(Exception, match="not unique"):
        joins.lookup_one(fact, dim.unionByName(dim), ["k"]).collect()


def test_total_row_tells_null_group_from_total(spark):
    df = spark.createDataFrame([("b", 1), (None, 2), ("a", 3)], "k string, n int")
    assert rows(aggregates.total_row(df, "k", ["n"])) == [(None, 2), ("a", 3), ("b", 1), ("Total", 6)]


def test_pivot_drops_missing_keys_and_fills_zero(spark):
    data = [("x", "a", 1), ("x", "b", 2), ("y", "a", 3), (None, "a", 9), ("z", None, 9)]
    df = spark.createDataFrame(data, "i string, c string, n int")
    table = aggregates.pivot_sum(df, "i", "c", "n", ["a", "b"])
    assert sorted(rows(table)) == [("x", 1, 2), ("y", 3, 0)]
    assert rows(aggregates.pivot_margin(table, "i", ["a", "b"])) == [("x", 1, 2, 3), ("y", 3, 0, 3)]


def test_conditional_sum_is_zero_without_match(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    got = df.groupBy("k").agg(aggregates.conditional_sum(F.col("k") == "a", F.col("n")).alias("s"))
    assert sorted(rows(got)) == [("a", 1), ("b", 0)]


def test_top_rows_settle_ties_by_key(spark):
    df = spark.createDataFrame([("c", 5, 1), ("a", 5, 1), ("b", 5, 2), ("d", 1, 9)], "k string, n int, m int")
    assert [r[0] for r in rows(ordering.top_rows(df, ["n"], "k", 2))] == ["a", "b"]
    assert [r[0] for r in rows(ordering.top_rows(df, ["n", "m"], "k", 3))] == ["b", "a", "c"]
    assert [r[0] for r in rows(ordering.first_rows(df, "k", 3))] == ["a", "b", "c"]


def test_top_categories_in_order(spark):
    df = spark.createDataFrame([("a", 1), ("b", 3), ("c", 3), ("a", 1), (None, 99)], "c string, n int")
    assert ordering.top_categories(df, "c", "n", 2) == ["b", "c"]


def test_head_then_sort_takes_first_keys_then_orders(spark):
    df = spark.createDataFrame([("a", 1), ("b", 5), ("c", 9)], "k string, `Em Entrega` int")
    assert [r[0] for r in rows(ordering.head_then_sort(df, "k", 2, "Em Entrega"))] == ["b", "a"]
    assert [r[0] for r in rows(ordering.head_then_sort(df, "k", 2, "absent"))] == ["a", "b"]


def test_recent_rows_reach_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = filters.recent_rows(df, "o_orderdate", "2001-01-01", 5)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate,2000-12-27T00:00)" in plan


def test_distinct_counts_hold_few_pairs_in_a_task(spark):
    pairs = [("a", 1, 2), ("a", 1, 3), ("a", None, 5), ("b", None, None), (None, 4, 1), (None, 5, 1), ("a", 2, 1)]
    df = spark.createDataFrame(pairs, "k string, v int, q int")
    found = aggregates.distinct_counts(df, "k", "v", "n", {"total": "q"})
    assert sorted(rows(found), key=str) == sorted([("a", 2, 11), ("b", 0, None), (None, 2, 2)], key=str)
    assert rows(aggregates.distinct_counts(df.limit(0), "k", "v", "n", {"total": "q"})) == []
    tasks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    query = BUILDERS["nunique_by_group"](Views(spark, SF_DIR))
    assert f", {tasks}), REPARTITION_BY_NUM" in query._jdf.queryExecution().executedPlan().toString()
