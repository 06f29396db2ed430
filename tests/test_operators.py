"""Operators of §2.12 on small frames."""

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

from ledgerlens.operators import quality as Q
from ledgerlens.operators import windows as W
from ledgerlens.operators.targets import target_attainment


def _df(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_period_growth_by_group(spark):
    df = _df(spark, [("a", 1, D("10.00")), ("a", 2, D("-5.00")), ("a", 3, D("5.00")),
                     ("b", 1, D("0.00")), ("b", 2, D("7.00"))],
             "g string, m int, v decimal(20,2)")
    got = {(r.g, r.m): (r.prev, r.growth_pct)
           for r in W.period_growth(df, "v", ["m"], ["g"], "prev").collect()}
    assert got == {("a", 1): (None, None), ("a", 2): (D("10.00"), D("-150.00")),
                   ("a", 3): (D("-5.00"), D("-200.00")),
                   ("b", 1): (None, None), ("b", 2): (D("0.00"), None)}


def test_running_total_and_moving_average(spark):
    df = _df(spark, [(i, D(v)) for i, v in enumerate(["1.00", "2.00", "4.00", "8.00"])],
             "i int, v decimal(20,2)")
    x = W.moving_average(W.running_total(df, "v", ["i"], name="rt"), "v", ["i"], rows=2, name="ma")
    rows = x.orderBy("i").collect()
    assert [r.rt for r in rows] == [D("1.00"), D("3.00"), D("7.00"), D("15.00")]
    assert [r.ma for r in rows] == [D("1.00"), D("1.50"), D("3.00"), D("6.00")]


def test_share_rank_and_top_n(spark):
    df = _df(spark, [("x", "p", 5), ("x", "q", 5), ("x", "r", 3), ("y", "s", 1)],
             "g string, k string, v int")
    share = {r.k: r.s for r in W.share_of_total(df, "v", "s").collect()}
    assert share == {"p": D("35.71"), "q": D("35.71"), "r": D("21.43"), "s": D("7.14")}
    dense = {r.k: r.r for r in W.rank_by(df, [F.desc("v")], "r").collect()}
    assert dense == {"p": 1, "q": 1, "r": 2, "s": 3}
    ties = sorted(r.k for r in W.top_n_per_group(df, ["g"], [F.desc("v")], 1).collect())
    assert ties == ["p", "q", "s"]                      # ties kept
    one = sorted(r.k for r in W.top_n_per_group(df, ["g"], [F.desc("v"), "k"], 1,
                                                 keep_ties=False).collect())
    assert one == ["p", "s"]


def test_pareto_threshold(spark):
    df = _df(spark, [("a", D("50.00")), ("b", D("30.00")), ("c", D("20.00"))],
             "k string, revenue decimal(20,2)")
    got = {r.k: r.grp for r in W.pareto(df, "revenue", ["k"], 80, group_name="grp",
                                        top_label="top", rest_label="rest").collect()}
    assert got == {"a": "top", "b": "top", "c": "rest"}     # 80 % exactly is still top
    got = {r.k: r.grp for r in W.pareto(df, "revenue", ["k"], 50, group_name="grp",
                                        top_label="top", rest_label="rest").collect()}
    assert got == {"a": "top", "b": "rest", "c": "rest"}


def test_quality_operators(spark):
    df = _df(spark, [("1", dt.date(2020, 1, 1)), ("1", None), (None, dt.date(2020, 3, 1))],
             "id string, d date")
    assert Q.null_profile(df, {"id": "n_id", "d": "n_d"}).first().asDict() == {"n_id": 1, "n_d": 1}
    assert [r.asDict() for r in Q.duplicate_keys(df, ["id"]).collect()] == [{"id": "1", "cnt": 2}]
    r = Q.date_range(df, "d").first()
    assert (r.earliest_order, r.latest_order, r.total_days) == (
        dt.date(2020, 1, 1), dt.date(2020, 3, 1), 60)
    assert [x.id for x in Q.distinct_values(df, ["id"]).collect()] == [None, "1"]
    parent = _df(spark, [("1",)], "id string")
    assert Q.orphan_count(df, parent, ["id"]).first().orphan_rows == 1   # the NULL key
    assert Q.count_rows_where(df, F.col("d").isNull(), "n").first().n == 1
    counts = {r.table_name: r.total_rows for r in Q.row_counts({"a": df, "b": parent}).collect()}
    assert counts == {"a": 3, "b": 1}


def test_target_attainment_left_join(spark):
    targets = _df(spark, [("Jan", "K", D("10.00")), ("Feb", "K", D("10.00"))],
                  "month_of_order_date string, category string, target decimal(18,2)")
    actual = _df(spark, [("Jan", "K", D("12.00")), ("Mar", "K", D("99.00"))],
                 "sale_month string, category string, actual_revenue decimal(20,2)")
    got = {r.month_of_order_date: r.actual_revenue for r in target_attainment(
        targets, actual, [("month_of_order_date", "sale_month"), ("category", "category")]).collect()}
    assert got == {"Jan": D("12.00"), "Feb": D("0.00")}     # no Mar: targets drive the join
