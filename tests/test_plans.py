"""Physical-plan properties that matter at scale."""

import re

import pytest

from ledgerlens.plans import reports as R
from ledgerlens.sources.staging import staged_tables

SF = "/root/testdata/sf0.01"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def staged(spark):
    return staged_tables(spark, SF)


def _windows(p: str):
    """(partition spec, order spec) of every Window operator."""
    return re.findall(r"Window \[.*?\], \[(.*?)\], \[(.*?)\]", p)


@pytest.mark.parametrize("report", [R.rfm_segments, R.clv_customers, R.customer_leaderboard,
                                    R.clv_segment_summary, R.rfm_segment_summary])
def test_customer_grain_has_no_unpartitioned_window_over_customers(staged, report):
    p = plan(report(staged))
    wins = _windows(p)
    # quartiles are compared with selected boundaries: no window at all
    assert bool(wins) == (report is R.customer_leaderboard)
    for part, order in wins:
        # the only unpartitioned windows run over the summary with one row
        # per partition or over a handful of segment rows
        if part.strip() == "":
            assert "_part" in order or report in (R.clv_segment_summary, R.rfm_segment_summary), (
                part, order)


def test_orphan_check_is_anti_join(staged):
    assert "LeftAnti" in plan(R.dq_orphan_details(staged))


@pytest.mark.parametrize("report,columns", [
    (R.monthly_trend, ["amount", "order_date", "profit", "quantity"]),  # sums per order: no order_id
    (R.category_performance, ["amount", "category", "order_id", "profit", "quantity"]),
    (R.pareto_subcategories, ["amount", "category", "sub_category"])])
def test_reports_scan_one_staged_table_with_pruned_columns(staged, report, columns):
    p = plan(report(staged))
    assert "Join" not in p
    (schema,) = re.findall(r"ReadSchema: struct<([^>]*)>", p)
    assert sorted(re.findall(r"(\w+):", schema)) == columns


def test_filter_pushed_to_scan(staged):
    p = plan(R.dq_bad_amounts(staged))
    assert "PushedFilters: [IsNotNull(amount), LessThanOrEqual(amount,0.00)]" in p


def test_market_entry_is_aggregate_not_window(staged):
    p = plan(R.market_entry_timeline(staged))
    assert "Window" not in p
    assert "partial_min" in p


def test_top_customers_is_distributed_top_k(staged):
    assert "TakeOrderedAndProject" in plan(R.top_customers(staged))


@pytest.mark.parametrize("report", [R.business_summary, R.state_performance, R.top_cities,
                                    R.executive_summary])
def test_no_row_is_repeated_for_distinct_counts(staged, report):
    assert "Expand" not in plan(report(staged))


@pytest.mark.parametrize("report", [
    R.monthly_trend, R.quarterly_summary, R.day_of_week_performance, R.category_performance,
    R.subcategory_performance, R.loss_making_subcategories, R.top_customers,
    R.payment_mode_performance, R.payment_preference_by_state, R.top_payment_per_category,
    R.business_summary, R.state_performance, R.top_cities, R.executive_summary])
def test_distinct_orders_need_no_exchange_by_order(staged, report):
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan(report(staged)))
    assert not [e for e in exchanges if "order_id" in e]


def test_targets_scan_the_fact_once(staged):
    from ledgerlens.sources.warehouse import Warehouse
    p = plan(Warehouse.targets_from(staged))
    assert p.count("FileScan") == 1


def test_orphan_rows_are_counted_before_the_exchange(staged):
    """Lines are bucketed by order: they are counted, and joined, where they
    are; only the order ids move."""
    p = plan(R.dq_orphan_details(staged))
    assert re.search(r"HashAggregate\(keys=\[order_id", p)
    moved = re.findall(r"Exchange hashpartitioning\(order_id.*\n(?:.*\n){1,4}?.*FileScan.*", p)
    assert len(moved) <= 1 and not any("order_details" in m for m in moved)


def test_hot_order_can_be_split_without_staging(spark):
    """The join of entry()'s plan is not bound to the aggregate above it."""
    from __spark_entry__ import entry
    assert "REBALANCE" in entry(spark)._jdf.queryExecution().executedPlan().toString()
