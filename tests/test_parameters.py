"""Report parameters and small operators."""

import datetime as dt

from pyspark.sql import functions as F

from ledgerlens.functions.columns import month_label_start
from ledgerlens.operators.histogram import text_histogram
from ledgerlens.plans import reports as R
from ledgerlens.sources.csv import read_sales_tables


def test_month_label_start(spark):
    df = spark.createDataFrame([("Jan-95",), ("Apr-18",), ("Dec-69",), ("Jan-02",)], "m string")
    got = [r[0] for r in df.select(month_label_start("m")).collect()]
    assert got == [dt.date(1995, 1, 1), dt.date(2018, 4, 1), dt.date(2069, 12, 1),
                   dt.date(2002, 1, 1)]


def test_target_vs_actual_chronological(tiny):
    months = [r["month"] for r in R.target_vs_actual(tiny, sort_by_month=True).collect()]
    assert months == ["Apr-18", "Apr-18", "Jun-18", "Jan-19", "Feb-19"]
    months = [r["month"] for r in R.target_vs_actual(tiny).collect()]
    assert months == sorted(months)


def test_rfm_score_order(tiny):
    as_computed = {r["customer_name"]: r for r in R.rfm_segments(tiny).collect()}
    best_high = {r["customer_name"]: r for r in R.rfm_segments(tiny, "best_is_high").collect()}
    # Asha spends most (250.00), Chen bought last (2019-01-02); 3 customers
    assert as_computed["Asha"]["m_score"] == 1 and as_computed["Chen"]["r_score"] == 1
    assert best_high["Asha"]["m_score"] == 3 and best_high["Chen"]["r_score"] == 3


def test_customer_grain_parameter(tiny):
    by_name = R.clv_customers(tiny, grain=("customer_name",))
    assert by_name.columns[0] == "customer_name" and "state" not in by_name.columns
    assert by_name.count() == 3
    assert R.top_customers(tiny, 2, grain=("customer_name",)).count() == 2


def test_text_histogram_unit(spark):
    df = spark.createDataFrame([("a",)] * 7 + [("b",)] * 2, "k string")
    got = {r["k"]: (r["n"], r["bar"]) for r in text_histogram(
        df, ["k"], F.count(F.lit(1)), "#", "n", "bar", unit=2).collect()}
    assert got == {"a": (7, "###"), "b": (2, "#")}


def test_csv_bundle_runs_reports(spark, tmp_path):
    (tmp_path / "o.csv").write_bytes(
        b"Order ID,Order Date,CustomerName,State,City\r\n"
        b"B-1,01-04-2018,Orla,Northmark,Tarn\r\nB-2,02-05-2018,Emre,Eastmark,Quill\r\n")
    (tmp_path / "d.csv").write_bytes(
        b"Order ID,Amount,Profit,Quantity,Category,Sub-Category,PaymentMode\r\n"
        b"B-1,100.00,10.00,1,Furniture,Chairs,UPI\r\nB-2,50.00,-5.00,2,Clothing,Saree,COD\r\n")
    (tmp_path / "t.csv").write_bytes(
        b"Month of Order Date,Category,Target\r\nApr-18,Furniture,90.00\r\nMay-18,Clothing,60.00\r\n")
    t = read_sales_tables(spark, str(tmp_path / "o.csv"), str(tmp_path / "d.csv"),
                          str(tmp_path / "t.csv"))
    status = {r["category"]: r["target_status"] for r in R.target_vs_actual(t).collect()}
    assert status == {"Furniture": "HIT ✓", "Clothing": "MISS ✗"}
    assert R.monthly_trend(t).count() == 2


def test_stage_csv_with_rejects_and_cli(spark, tmp_path):
    import csv as pycsv

    from ledgerlens.__main__ import main
    from ledgerlens.sources.staging import stage_csv_tables
    (tmp_path / "o.csv").write_bytes(
        b"Order ID,Order Date,CustomerName,State,City\r\n"
        b"B-1,01-04-2018,Orla,Southmark ,Fenn\r\nB-2,31-02-2018,Emre,Eastmark,Quill\r\n"
        b"B-3,02-05-2018,Emre,Eastmark,Quill\r\n")
    (tmp_path / "d.csv").write_bytes(
        b"Order ID,Amount,Profit,Quantity,Category,Sub-Category,PaymentMode\r\n"
        b"B-1,100.00,10.00,1,Furniture,Chairs,UPI\r\nB-3,50.00,-5.00,2,Clothing,Saree,COD\r\n")
    (tmp_path / "t.csv").write_bytes(b"Month of Order Date,Category,Target\r\nApr-18,Furniture,90.00\r\n")
    paths = [str(tmp_path / f) for f in ("o.csv", "d.csv", "t.csv")]
    t, rejects = stage_csv_tables(spark, *paths, trim=True)
    assert [r.reason for r in rejects["order_list"].collect()] == ["bad order_date"]
    assert {r.state for r in t.order_list.collect()} == {"Southmark", "Eastmark"}
    assert R.business_summary(t).first()["total_orders"] == 2
    out = tmp_path / "out"
    assert main(["--orders", paths[0], "--details", paths[1], "--targets", paths[2],
                 "--out", str(out), "--format", "csv", "--report", "state_performance"]) == 0
    part = next((out / "state_performance").glob("part-*.csv"))
    rows = list(pycsv.DictReader(part.open()))
    assert {r["state"] for r in rows} == {"Southmark ", "Eastmark"}
    assert next((out / "_rejects" / "order_list").glob("part-*.csv")).read_text().count("B-2") == 1


def test_stage_once_open_later(spark, tmp_path):
    from ledgerlens.sources.staging import open_staged, stage_tables
    loc = str(tmp_path / "staged")
    first = stage_tables(spark, "/root/testdata/sf0.001", location=loc)
    again = open_staged(spark, loc)
    a = sorted(tuple(r) for r in R.executive_summary(first).collect())
    b = sorted(tuple(r) for r in R.executive_summary(again).collect())
    assert a == b and len(a) > 0


def test_views_for_ad_hoc_sql(spark, tiny):
    assert tiny.register_views("tiny_") == ["tiny_order_list", "tiny_order_details",
                                            "tiny_sales_target", "tiny_sales_fact"]
    got = {r.m: r.rev for r in spark.sql(
        "SELECT date_format(order_date, 'yyyy-MM-01') AS m, SUM(amount) AS rev "
        "FROM tiny_sales_fact GROUP BY 1").collect()}
    want = {r.order_month: r.total_revenue for r in R.monthly_trend(tiny).collect()}
    assert got == want
    assert spark.sql("SELECT COUNT(*) FROM tiny_order_details").first()[0] == 7


def test_cli_stage_to_then_staged(spark, tmp_path):
    from ledgerlens.__main__ import main
    from ledgerlens.sources.staging import open_staged
    staged = str(tmp_path / "kept")
    assert main(["--warehouse", "/root/testdata/sf0.001", "--stage-to", staged]) == 0
    out = tmp_path / "out"
    assert main(["--staged", staged, "--out", str(out), "--report", "monthly_trend",
                 "--report", "dq_row_counts"]) == 0
    months = spark.read.parquet(str(out / "monthly_trend")).count()
    assert months == R.monthly_trend(open_staged(spark, staged)).count() > 0
    counts = {r.table_name: r.total_rows for r in spark.read.parquet(str(out / "dq_row_counts")).collect()}
    assert counts["order_list"] == spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()
