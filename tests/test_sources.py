"""CSV readers (file format of the original data) and the warehouse mapping."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerlens.sources import csv as S
from ledgerlens.sources import schemas

ORDERS_CSV = ("Order ID,Order Date,CustomerName,State,City\r\n"
              "X-901,07-02-2021,Orla,Northmark,Tarn\r\n"
              "X-902,07-02-2021,Emre,Eastmark,Quill\r\n"
              "X-903,11-02-2021,Sunniva,Westmark ,Longhaven-by-the-Sea\r\n")

TARGET_CSV = ("Month of Order Date,Category,Target\r\n"
              "Feb-21,Lamps,310.25\r\n"
              "Mar-21,Lamps,289.75\r\n")


def _write(tmp_path, name, text):
    p = tmp_path / name
    p.write_bytes(text.encode("ascii"))
    return str(p)


def test_read_orders_keeps_values_as_written(spark, tmp_path):
    df = S.read_order_list(spark, _write(tmp_path, "orders.csv", ORDERS_CSV))
    rows = df.orderBy("order_id").collect()
    assert [r.order_date for r in rows] == [dt.date(2021, 2, 7)] * 2 + [dt.date(2021, 2, 11)]
    assert rows[2].state == "Westmark "          # trailing blank preserved
    assert rows[2].city == "Longhaven-by-the-Sea"  # no stray carriage return
    cleaned = S.clean_text(df).where(F.col("order_id") == "X-903").first()
    assert cleaned.state == "Westmark"


def test_read_targets(spark, tmp_path):
    df = S.read_sales_target(spark, _write(tmp_path, "t.csv", TARGET_CSV))
    assert df.schema == schemas.SALES_TARGET
    assert df.agg(F.sum("target")).first()[0] == D("600.00")


def test_lenient_load_splits_rejects(spark, tmp_path):
    text = ORDERS_CSV + "X-904,31-02-2021,Bad,Date,X\r\nX-905,15-02-2021,Ok,Northmark,Tarn\r\n"
    good, rejected = S.read_with_rejects(spark, _write(tmp_path, "o2.csv", text), schemas.ORDER_LIST)
    assert sorted(r.order_id for r in good.collect()) == ["X-901", "X-902", "X-903", "X-905"]
    (bad,) = rejected.collect()
    assert bad.reason == "bad order_date" and bad.raw_line.startswith("X-904")


def test_lenient_load_details_types(spark, tmp_path):
    text = ("Order ID,Amount,Profit,Quantity,Category,Sub-Category,PaymentMode\r\n"
            "X-901,310.00,-48.50,7,Lamps,Desk,Cash\r\n"
            "X-902,abc,10.00,1,Rugs,Round,Card\r\n"
            "X-903,66.00,,5,Rugs,Long,\r\n"
            "X-904,10.005,1.00,5,Rugs,Long,Card\r\n"
            "X-905,10.50,1.0000,5,Rugs,Long,Card\r\n")
    good, rejected = S.read_with_rejects(spark, _write(tmp_path, "d.csv", text), schemas.ORDER_DETAILS)
    rows = {r.order_id: r for r in good.collect()}
    assert rows["X-901"].amount == D("310.00") and rows["X-901"].profit == D("-48.50")
    assert rows["X-903"].profit is None and rows["X-903"].payment_mode is None
    assert rows["X-905"].profit == D("1.00")
    assert sorted(r.reason for r in rejected.collect()) == ["amount loses digits", "bad amount"]


@pytest.mark.parametrize("bad", ["X-1,31-02-2021,Bad,Date,X\r\n", "X-1,07-02-2021,Short\r\n"])
def test_strict_load_fails_on_any_bad_record(spark, tmp_path, bad):
    """Also for reports that would read one column only."""
    path = _write(tmp_path, "bad.csv", ORDERS_CSV + bad)
    with pytest.raises(Exception, match="(?i)malformed|parse|FAILFAST"):
        S.read_order_list(spark, path).select("order_id").count()


def test_exchanged_header_columns_are_refused(spark, tmp_path):
    path = _write(tmp_path, "h.csv", ORDERS_CSV.replace("State,City", "City,State"))
    with pytest.raises(Exception, match="header does not conform"):
        S.read_order_list(spark, path)
    with pytest.raises(Exception, match="header does not conform"):
        S.read_with_rejects(spark, path, schemas.ORDER_LIST)[0].select("order_id").collect()


def test_case_insensitive_grouping(spark):
    df = spark.createDataFrame([("Goa",), ("GOA",), ("goa",)], "state string")
    assert S.normalise_case(df, ["state"]).groupBy("state").count().count() == 1


def test_warehouse_mapping_types(spark):
    from ledgerlens.sources.warehouse import Warehouse
    w = Warehouse(spark, "/root/testdata/sf0.001")
    d = w.details(["order_id", "amount", "profit", "quantity", "category", "sub_category",
                   "payment_mode"])
    assert [f.dataType.simpleString() for f in d.schema.fields] == [
        "bigint", "decimal(12,2)", "decimal(13,2)", "int", "string", "string", "string"]
    o = w.orders(["order_id", "order_date", "customer_name", "state", "city"])
    assert o.count() == spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()
    assert d.count() == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()


def test_case_insensitive_load(spark, tmp_path):
    from ledgerlens.plans import reports as R
    from ledgerlens.sources.staging import stage_csv_tables
    orders = ORDERS_CSV + "X-906,12-02-2021,ORLA,NORTHMARK,tarn\r\n"
    details = ("Order ID,Amount,Profit,Quantity,Category,Sub-Category,PaymentMode\r\n"
               "X-901,310.00,-48.50,7,Lamps,Desk,Cash\r\nX-906,10.00,1.00,1,LAMPS,desk,cash\r\n")
    paths = [_write(tmp_path, n, t) for n, t in
             [("o.csv", orders), ("d.csv", details), ("t.csv", TARGET_CSV)]]
    for ignore, customers, modes in ((False, 2, 2), (True, 1, 1)):
        tables, _ = stage_csv_tables(spark, *paths, ignore_case=ignore)
        assert R.business_summary(tables).first()["unique_customers"] == customers
        assert R.payment_mode_performance(tables).count() == modes


def test_checkpoint_dir_is_the_sessions(spark):
    from ledgerlens.session import checkpoint_dir
    assert checkpoint_dir(spark) == spark.sparkContext.getCheckpointDir()


def test_local_checkpoint_folder_needs_a_local_master(monkeypatch):
    from ledgerlens import session

    class Conf:
        def get(self, name, default=None):
            return "file:/tmp/x"

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="local folder"):
        session.checkpoint_dir(Session())
