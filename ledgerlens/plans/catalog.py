"""Registry of reports: name -> report function over ``SalesTables``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.plans import fine_grain
from ledgerlens.plans import reports as R
from ledgerlens.sources.tables import SalesTables
from ledgerlens.sources.staging import mapped_tables, staged_tables

Report = Callable[[SalesTables], DataFrame]

# In the order of the original analysis script.
REPORTS: dict[str, Report] = {
    "dq_row_counts": R.dq_row_counts,
    "dq_nulls_orders": R.dq_nulls_orders,
    "dq_nulls_details": R.dq_nulls_details,
    "dq_nulls_targets": R.dq_nulls_targets,
    "dq_duplicate_orders": R.dq_duplicate_orders,
    "dq_orphan_details": R.dq_orphan_details,
    "dq_date_range": R.dq_date_range,
    "dq_distinct_category_pairs": R.dq_distinct_category_pairs,
    "dq_distinct_payment_modes": R.dq_distinct_payment_modes,
    "dq_distinct_target_categories": R.dq_distinct_target_categories,
    "dq_bad_amounts": R.dq_bad_amounts,
    "business_summary": R.business_summary,
    "monthly_trend": R.monthly_trend,
    "quarterly_summary": R.quarterly_summary,
    "day_of_week_performance": R.day_of_week_performance,
    "ytd_running_totals": R.ytd_running_totals,
    "target_vs_actual": R.target_vs_actual,
    "target_hit_rate": R.target_hit_rate,
    "target_overall": R.target_overall,
    "target_best_months": R.target_best_months,
    "category_performance": R.category_performance,
    "subcategory_performance": R.subcategory_performance,
    "loss_making_subcategories": R.loss_making_subcategories,
    "top_subcategories_per_category": R.top_subcategories_per_category,
    "pareto_subcategories": R.pareto_subcategories,
    "top_customers": R.top_customers,
    "customer_acquisition": R.customer_acquisition,
    "rfm_segments": R.rfm_segments,
    "rfm_segment_summary": R.rfm_segment_summary,
    "state_performance": R.state_performance,
    "top_cities": R.top_cities,
    "top_category_per_state": R.top_category_per_state,
    "market_entry_timeline": R.market_entry_timeline,
    "payment_mode_performance": R.payment_mode_performance,
    "payment_preference_by_state": R.payment_preference_by_state,
    "top_payment_per_category": R.top_payment_per_category,
    "margin_ranking": R.margin_ranking,
    "profit_moving_average": R.profit_moving_average,
    "loss_making_lines": R.loss_making_lines,
    "loss_summary": R.loss_summary,
    "clv_customers": R.clv_customers,
    "clv_segment_summary": R.clv_segment_summary,
    "cohort_retention": R.cohort_retention,
    "customer_leaderboard": R.customer_leaderboard,
    "category_mom_growth": R.category_mom_growth,
    "weekday_histogram": R.weekday_histogram,
    "executive_summary": R.executive_summary,
}


# They read the mapped orders or lines once and no fact: staging would write
# all lines several times over for them.
READ_ONCE = {"dq_nulls_orders", "dq_nulls_details", "dq_duplicate_orders", "dq_orphan_details",
             "dq_date_range", "dq_distinct_category_pairs", "dq_distinct_payment_modes",
             "dq_bad_amounts", "loss_summary"}


def run_on_warehouse(name: str) -> Callable[[SparkSession, str], DataFrame]:
    report = (REPORTS | fine_grain.REPORTS)[name]
    tables = mapped_tables if name in READ_ONCE else staged_tables

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return report(tables(spark, sf_dir))

    run.__name__ = name
    run.__doc__ = report.__doc__
    return run
