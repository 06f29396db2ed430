"""Edge cases: empty tables, negative previous values, NULL customers."""

import datetime as dt
from decimal import Decimal as D

import pytest

from ledgerlens.plans.catalog import REPORTS
from ledgerlens.plans import reports as R
from ledgerlens.sources import schemas
from ledgerlens.sources.tables import from_frames


@pytest.fixture(scope="module")
def empty(spark):
    return from_frames(spark.createDataFrame([], schemas.ORDER_LIST),
                       spark.createDataFrame([], schemas.ORDER_DETAILS),
                       spark.createDataFrame([], schemas.SALES_TARGET))


@pytest.mark.parametrize("name", list(REPORTS))
def test_every_report_runs_on_empty_tables(empty, name):
    rows = REPORTS[name](empty).collect()
    global_aggregates = {"dq_row_counts", "dq_nulls_orders", "dq_nulls_details", "dq_nulls_targets",
                         "dq_orphan_details", "dq_date_range", "dq_bad_amounts",
                         "business_summary", "target_overall", "loss_summary"}
    assert len(rows) == (3 if name == "dq_row_counts" else 1 if name in global_aggregates else 0)


def test_empty_summary_values(empty):
    (r,) = R.business_summary(empty).collect()
    assert r["total_orders"] == 0 and r["total_revenue"] is None and r["avg_order_value"] is None
    assert r["loss_making_orders"] is None      # SUM over no rows
    (r,) = R.dq_nulls_orders(empty).collect()
    assert r["null_order_id"] is None
    (r,) = R.loss_summary(empty).collect()
    assert r["loss_order_count"] == 0 and r["loss_as_pct_of_revenue"] is None


@pytest.fixture(scope="module")
def signed(spark):
    orders = [("A", dt.date(2020, 1, 5), "Ann", "S1", "C1"),
              ("B", dt.date(2020, 2, 5), None, "S1", "C1"),
              ("C", dt.date(2020, 3, 5), None, "S2", "C2")]
    details = [("A", D("100.00"), D("-20.00"), 1, "K", "k1", "P"),
               ("B", D("50.00"), D("10.00"), 1, "K", "k1", "P"),
               ("C", D("80.00"), D("-10.00"), 1, "K", "k2", "P")]
    return from_frames(spark.createDataFrame(orders, schemas.ORDER_LIST),
                       spark.createDataFrame(details, schemas.ORDER_DETAILS),
                       spark.createDataFrame([], schemas.SALES_TARGET))


def test_growth_divides_by_signed_previous(signed):
    rows = R.monthly_trend(signed).collect()
    # profit -20 -> 10: (10 - -20) * 100 / -20 = -150 (signed denominator)
    assert rows[1]["mom_profit_growth_pct"] == D("-150.00")
    # profit 10 -> -10: (-10 - 10) * 100 / 10 = -200
    assert rows[2]["mom_profit_growth_pct"] == D("-200.00")
    assert rows[1]["mom_revenue_growth_pct"] == D("-50.00")


def test_null_customer_is_one_group_but_not_counted_as_distinct(signed):
    (r,) = R.business_summary(signed).collect()
    assert r["unique_customers"] == 1          # COUNT(DISTINCT) ignores NULL
    rfm = {r["customer_name"]: r["frequency"] for r in R.rfm_segments(signed).collect()}
    assert rfm == {"Ann": 1, None: 2}          # GROUP BY keeps the NULL group
    acq = [(r["acquisition_month"], r["new_customers"]) for r in R.customer_acquisition(signed).collect()]
    assert acq == [("2020-01-01", 1), ("2020-02-01", 1)]
    # cohorts join on the name, so the NULL customer never appears
    assert [r["cohort_size"] for r in R.cohort_retention(signed).collect()] == [1]


def test_zero_revenue_margin_is_null(spark):
    orders = [("A", dt.date(2020, 1, 5), "Ann", "S", "C")]
    details = [("A", D("0.00"), D("0.00"), 1, "K", "k", "P")]
    t = from_frames(spark.createDataFrame(orders, schemas.ORDER_LIST),
                    spark.createDataFrame(details, schemas.ORDER_DETAILS),
                    spark.createDataFrame([("Jan-20", "K", D("0.00"))], schemas.SALES_TARGET))
    (r,) = R.category_performance(t).collect()
    assert r["profit_margin_pct"] is None and r["revenue_share_pct"] is None
    (r,) = R.target_vs_actual(t).collect()
    assert r["variance_pct"] is None and r["target_status"] == "HIT ✓"
