"""CSV files in the original format, load accounting and sinks."""

import datetime as dt
import json
import os
from decimal import Decimal as D

import pytest

from ledgerlens.operators.materialize import file_system
from ledgerlens.plans import reports as R
from ledgerlens.plans import roundtrip as RT
from ledgerlens.plans.catalog import REPORTS
from ledgerlens.plans.compare import compare, duckdb_connection
from ledgerlens.sources import csv, schemas
from ledgerlens.sources import export as E
from ledgerlens.sources.staging import load_csv_tables
from tests.fixtures import DETAILS, ORDERS, TARGETS

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", list(RT.QUERIES))
def test_queries_match_sql(spark, name):
    df = RT.QUERIES[name](spark, SF)
    assert df.count() > 0
    outcome = compare(name, df, duckdb_connection(SF), RT.roundtrip_sql()[name])
    assert outcome.ok, outcome.detail


def test_written_csv_has_the_original_format(spark, tmp_path):
    rows = [("O1", dt.date(2018, 4, 1), "Asha ", "Kerala ", None)]
    path = E.write_csv(spark.createDataFrame(rows, schemas.ORDER_LIST).coalesce(1), str(tmp_path / "o"))
    (name,) = [f for f in os.listdir(path) if f.endswith(".csv")]
    with open(f"{path}/{name}", "rb") as f:
        assert f.read() == b"Order ID,Order Date,CustomerName,State,City\r\nO1,01-04-2018,Asha ,Kerala ,\r\n"
    assert [tuple(r) for r in csv.read_order_list(spark, path).collect()] == rows


def test_strict_read_gives_back_what_was_written(spark, tmp_path):
    for name, rows, schema, read in [
            ("o", ORDERS, schemas.ORDER_LIST, csv.read_order_list),
            ("d", DETAILS, schemas.ORDER_DETAILS, csv.read_order_details),
            ("t", TARGETS, schemas.SALES_TARGET, csv.read_sales_target)]:
        df = spark.createDataFrame(rows, schema).repartition(3)
        back = read(spark, E.write_csv(df, str(tmp_path / name)))
        assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


@pytest.fixture
def files(tmp_path):
    def write(name, header, lines):
        path = tmp_path / name
        path.write_bytes("\r\n".join([",".join(header), *lines, ""]).encode())
        return str(path)
    return {
        "orders": write("o.csv", schemas.ORDER_HEADER, [
            "O1,01-04-2018,Asha,Goa,Panaji", "O2,2018-04-02,Binu,Goa,Panaji", "O3,,Chen,Goa,Panaji"]),
        "details": write("d.csv", schemas.DETAIL_HEADER, [
            "O1,10.00,1.00,1,A,B,COD", "O1,ten,1.00,1,A,B,COD", "O1,10.00,1.00,1,A,B,COD,extra",
            "O2,10.001,1.00,1,A,B,COD", "O2,10.00,1.00,one,A,B,COD"]),
        "targets": write("t.csv", schemas.TARGET_HEADER, [])}


def test_lines_are_counted_in_the_pass_that_stores_them(spark, files):
    tables, loads = load_csv_tables(spark, files["orders"], files["details"], files["targets"])
    assert {n: (x.lines, x.loaded, x.rejected) for n, x in loads.items()} == {
        "order_list": (3, 2, 1), "order_details": (5, 1, 4), "sales_target": (0, 0, 0)}
    bad = {r["raw_line"]: r["reason"] for r in loads["order_details"].rejects.collect()}
    assert bad == {
        "O1,ten,1.00,1,A,B,COD": "bad amount", "O1,10.00,1.00,1,A,B,COD,extra": "malformed line",
        "O2,10.001,1.00,1,A,B,COD": "amount loses digits", "O2,10.00,1.00,one,A,B,COD": "bad quantity"}
    assert R.business_summary(tables).first()["total_orders"] == 1
    # rejects are stored: they do not read the file again
    os.remove(files["details"])
    assert loads["order_details"].rejects.count() == 4 and loads["order_details"].good.count() == 1


def test_ignoring_case_adds_up_sums(spark, tmp_path):
    def write(name, header, lines):
        (tmp_path / name).write_bytes("\r\n".join([",".join(header), *lines, ""]).encode())
        return str(tmp_path / name)
    paths = [write("o.csv", schemas.ORDER_HEADER, ["O1,01-04-2018,ASHA,Goa,P", "O2,02-04-2018,asha,GOA,P"]),
             write("d.csv", schemas.DETAIL_HEADER, ["O1,10.00,1.00,1,Lamps,x,m", "O2,5.00,1.00,1,lamps,X,m"]),
             write("t.csv", schemas.TARGET_HEADER, ["Apr-18,LAMPS,3.00"])]
    tables, _ = load_csv_tables(spark, *paths, ignore_case=True)
    s = R.business_summary(tables).first()
    assert (s["unique_customers"], s["states_covered"], s["product_categories"], s["sub_categories"]) == (1, 1, 1, 1)
    assert [r["revenue"] for r in R.pareto_subcategories(tables).collect()] == [D("15.00")]
    assert [r["monetary"] for r in R.rfm_segments(tables).collect()] == [D("15.00")]


@pytest.mark.parametrize("kind", E.FORMATS)
def test_manifest_notices_changes(spark, tiny, tmp_path, kind):
    folder = str(tmp_path / kind)
    names = ("monthly_trend", "dq_nulls_orders", "loss_making_subcategories", "dq_duplicate_orders")
    E.write_results(spark, {n: lambda n=n: REPORTS[n](tiny) for n in names}, folder, kind)
    seen = {r["report"]: r for r in E.verify(spark, folder).collect()}
    assert set(seen) == set(names) and all(r["same_rows"] for r in seen.values())
    assert seen["dq_duplicate_orders"]["rows_read"] == 0
    back = E.read_result(spark, folder, "monthly_trend")
    assert back.schema.simpleString() == REPORTS["monthly_trend"](tiny).schema.simpleString()
    # one value of one row changes: same number of rows, other digest
    REPORTS["dq_nulls_orders"](tiny).selectExpr("null_order_id + 1 null_order_id", "null_order_date",
                                                "null_customer", "null_state", "null_city").write.mode(
        "overwrite").format(kind).option("header", True).save(f"{folder}/dq_nulls_orders")
    seen = {r["report"]: r for r in E.verify(spark, folder).collect()}
    assert not seen["dq_nulls_orders"]["same_rows"] and seen["dq_nulls_orders"]["rows_read"] == 1
    assert seen["monthly_trend"]["same_rows"]


def test_no_manifest_no_results(spark, tiny, tmp_path):
    folder = str(tmp_path / "half")

    def fails():
        raise RuntimeError("stop")

    E.write_results(spark, {"a": lambda: tiny.order_list}, folder)
    with pytest.raises(RuntimeError):
        E.write_results(spark, {"a": lambda: tiny.order_list, "b": fails}, folder)
    with pytest.raises(FileNotFoundError):
        E.verify(spark, folder)
    with pytest.raises(ValueError):
        E.write_results(spark, {}, folder, "orc")
    fs, path = file_system(spark, folder)
    assert fs.exists(path)


def test_text_survives_csv(spark, tmp_path):
    rows = [("a,b", 'say "x"', None), ("", " lead and trail ", "\\N?"), ("line\nbreak", "é✓", "")]
    df = spark.createDataFrame(rows, "x string, y string, z string")
    for kind in E.FORMATS:
        folder = str(tmp_path / kind)
        E.write_results(spark, {"t": lambda: df}, folder, kind)
        assert E.verify(spark, folder).first()["same_rows"], kind
        assert json.loads(open(f"{folder}/{E.MANIFEST}").read())["results"][0]["rows"] == 3


def test_sorted_loss_lines_are_dealt_once(spark, tiny):
    """No exchange between the join and the sort."""
    plan = R.loss_making_lines(tiny)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and "REBALANCE" not in plan
