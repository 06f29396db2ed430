"""The report catalogue: every result-producing statement of the sales
analysis, as a DataFrame plan over ``SalesTables``.

Each report asks the tables only for the columns it uses, so the scans
read only those columns and only the stored tables they come from.
Aggregation always happens before any window; windows without PARTITION
BY only ever see bounded aggregates (months, days, weekdays, categories,
sub-categories, states, cities, payment modes, segments). Customer-grain
rankings go through ``ledgerlens.operators.ranking``.

Ties in ROW_NUMBER, NTILE, LIMIT and running sums are broken by the
business keys named in each report, so every result is deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.columns import (
    MONEY, day_name, day_of_week, growth_pct, mean, money, month_key, month_label_start,
    month_start, pct_of, ratio_pct,
)
from ledgerlens.operators import customers as C
from ledgerlens.operators import measures as M
from ledgerlens.operators import quality as Q
from ledgerlens.operators import windows as W
from ledgerlens.operators.histogram import text_histogram
from ledgerlens.operators.targets import actual_by_month_label, target_attainment
from ledgerlens.plans import labels as L
from ledgerlens.sources.tables import SalesTables

LINE = ("amount", "profit", "quantity")


# --------------------------------------------------------------- data quality

def dq_row_counts(t: SalesTables) -> DataFrame:
    """Row count of each of the three tables (table_name, total_rows)."""
    return Q.row_counts({
        "order_list": t.orders("order_id"),
        "order_details": t.details("order_id"),
        "sales_target": t.sales_target.select("category"),
    })


def dq_nulls_orders(t: SalesTables) -> DataFrame:
    """NULL count per column of order_list."""
    return Q.null_profile(t.orders("order_id", "order_date", "customer_name", "state", "city"), {
        "order_id": "null_order_id", "order_date": "null_order_date",
        "customer_name": "null_customer", "state": "null_state", "city": "null_city"})


def dq_nulls_details(t: SalesTables) -> DataFrame:
    """NULL count per column of order_details (sub_category not profiled)."""
    # sub_category is not profiled, as in the original checks
    return Q.null_profile(
        t.details("order_id", "amount", "profit", "quantity", "category", "payment_mode"), {
            "order_id": "null_order_id", "amount": "null_amount", "profit": "null_profit",
            "quantity": "null_quantity", "category": "null_category",
            "payment_mode": "null_payment"})


def dq_nulls_targets(t: SalesTables) -> DataFrame:
    """NULL count per column of sales_target."""
    return Q.null_profile(t.sales_target, {
        "month_of_order_date": "null_month", "category": "null_category", "target": "null_target"})


def dq_duplicate_orders(t: SalesTables) -> DataFrame:
    """Order ids occurring more than once in order_list, with their count."""
    return Q.duplicate_keys(t.orders("order_id"), ["order_id"], "cnt")


def dq_orphan_details(t: SalesTables) -> DataFrame:
    """Order lines whose order id has no order (anti join), counted."""
    return Q.orphan_count(t.details("order_id"), t.orders("order_id"), ["order_id"])


def dq_date_range(t: SalesTables) -> DataFrame:
    """First and last order date and the days between them."""
    return Q.date_range(t.orders("order_date"), "order_date")


def dq_distinct_category_pairs(t: SalesTables) -> DataFrame:
    """Distinct (category, sub_category) of the order lines."""
    return Q.distinct_values(t.details("category", "sub_category"), ["category", "sub_category"])


def dq_distinct_payment_modes(t: SalesTables) -> DataFrame:
    """Distinct payment modes of the order lines."""
    return Q.distinct_values(t.details("payment_mode"), ["payment_mode"])


def dq_distinct_target_categories(t: SalesTables) -> DataFrame:
    """Distinct categories of the target table."""
    return Q.distinct_values(t.sales_target, ["category"])


def dq_bad_amounts(t: SalesTables) -> DataFrame:
    """Order lines with amount <= 0, counted."""
    return Q.count_rows_where(t.details("amount"), F.col("amount") <= 0, "bad_amount_rows")


# ------------------------------------------------------------ overall summary

def business_summary(t: SalesTables) -> DataFrame:
    """One-row KPI set over the sales fact (orders, customers, states, cities, categories, units,
    revenue, profit, mean line value, margin, loss lines)."""
    fact = t.sales(["customer_name", "state", "city"], LINE)
    x = M.measures(fact, [], [
        M.orders("total_orders"),
        M.units("total_units_sold"),
        M.revenue("total_revenue"),
        M.profit("total_profit"),
        M.avg_line_value("avg_order_value"),
        M.margin_pct("overall_profit_margin_pct"),
        M.loss_lines("loss_making_orders")],
        distinct={"unique_customers": "customer_name", "states_covered": "state",
                  "cities_covered": "city"})
    pairs = t.sales([], ["category", "sub_category"], orders=False)
    # one-row subqueries: the pairs are a small table of their own, if staged
    kinds = {n: pairs.select(c).distinct().agg(F.count(c).cast(T.LongType())).scalar() for n, c in
             [("product_categories", "category"), ("sub_categories", "sub_category")]}
    x = x.select("*", *[c.alias(n) for n, c in kinds.items()])
    first = ["total_orders", "unique_customers", "states_covered", "cities_covered",
             "product_categories", "sub_categories"]
    return x.select(*first, *[c for c in x.columns if c not in first])


# ------------------------------------------------------------------ trends

def monthly_trend(t: SalesTables) -> DataFrame:
    """Per month: revenue, profit, orders, units, margin, previous revenue and month-over-month
    growth of revenue and profit."""
    fact = t.sales(["order_date"], LINE)
    monthly = M.measures(fact, [month_start("order_date").alias("m")], [
        M.revenue("total_revenue"), M.profit("total_profit"), M.orders("total_orders"),
        M.units("units_sold")])
    x = W.with_previous(monthly, {"total_revenue": "prev_month_revenue",
                                  "total_profit": "_prev_profit"}, ["m"])
    return (x.select(
        month_key("m").alias("order_month"), "total_revenue", "total_profit", "total_orders",
        "units_sold",
        ratio_pct("total_profit", "total_revenue").alias("profit_margin_pct"),
        "prev_month_revenue",
        growth_pct("total_revenue", "prev_month_revenue").alias("mom_revenue_growth_pct"),
        growth_pct("total_profit", "_prev_profit").alias("mom_profit_growth_pct"))
        .orderBy("order_month"))


def quarterly_summary(t: SalesTables) -> DataFrame:
    """Per calendar year and quarter: orders, revenue, profit, margin."""
    fact = t.sales(["order_date"], ["amount", "profit"])
    return (M.measures(fact, [F.year("order_date").cast(T.LongType()).alias("yr"),
                              F.quarter("order_date").cast(T.LongType()).alias("qtr")], [
        M.orders("total_orders"), M.revenue("total_revenue"), M.profit("total_profit"),
        M.margin_pct("profit_margin_pct")])
        .orderBy("yr", "qtr"))


def day_of_week_performance(t: SalesTables) -> DataFrame:
    """Per weekday: orders, revenue, profit, mean line value."""
    fact = t.sales(["order_date"], ["amount", "profit"])
    return (M.measures(fact, [day_name("order_date").alias("day_of_week"),
                              day_of_week("order_date").alias("day_num")], [
        M.orders("total_orders"), M.revenue("total_revenue"), M.profit("total_profit"),
        M.avg_line_value("avg_order_value")])
        .orderBy("day_num"))


def ytd_running_totals(t: SalesTables) -> DataFrame:
    """Per day: revenue and profit with running totals restarting each calendar year."""
    fact = t.sales(["order_date"], ["amount", "profit"])
    daily = M.measures(fact, ["order_date"], [M.revenue("daily_revenue"), M.profit("daily_profit")])
    daily = daily.withColumn("_yr", F.year("order_date"))
    x = W.running_total(daily, "daily_revenue", ["order_date"], ["_yr"], "ytd_revenue")
    x = W.running_total(x, "daily_profit", ["order_date"], ["_yr"], "ytd_profit")
    return (x.select("order_date", "daily_revenue", "daily_profit",
                     F.col("ytd_revenue").cast(MONEY).alias("ytd_revenue"),
                     F.col("ytd_profit").cast(MONEY).alias("ytd_profit"))
            .orderBy("order_date"))


# --------------------------------------------------------- sales vs target

def _target_rows(t: SalesTables) -> DataFrame:
    actual = actual_by_month_label(t.fact(["order_date"], ["category", "amount"]))
    return target_attainment(t.sales_target, actual,
                             [("month_of_order_date", "sale_month"), ("category", "category")])


def target_vs_actual(t: SalesTables, sort_by_month: bool = False) -> DataFrame:
    """Sorted by month label text, as originally (Apr, Aug, Dec, ...);
    ``sort_by_month`` sorts chronologically instead."""
    x = _target_rows(t)
    return (x.select(
        F.col("month_of_order_date").alias("month"), "category",
        money("target").alias("target_revenue"),
        "actual_revenue",
        money(F.col("actual_revenue") - F.col("target")).alias("variance"),
        growth_pct("actual_revenue", "target").alias("variance_pct"),
        F.when(F.col("actual_revenue") >= F.col("target"), L.TARGET_HIT)
         .otherwise(L.TARGET_MISS).alias("target_status"))
        .orderBy(month_label_start("month") if sort_by_month else F.col("month"), "category"))


def target_hit_rate(t: SalesTables) -> DataFrame:
    """Per category: months at or above target, months below, and the hit rate."""
    x = _target_rows(t).withColumn(
        "status", F.when(F.col("actual_revenue") >= F.col("target"), L.HIT).otherwise(L.MISS))
    hits = M.count_where(F.col("status") == L.HIT, "months_hit")
    return (x.groupBy("category").agg(
        hits,
        M.count_where(F.col("status") == L.MISS, "months_missed"),
        F.count(F.lit(1)).cast(T.LongType()).alias("total_months"))
        .withColumn("hit_rate_pct", ratio_pct("months_hit", "total_months"))
        .orderBy(F.desc("hit_rate_pct"), "category"))


def target_overall(t: SalesTables) -> DataFrame:
    """Total target, total actual, their difference and the difference in percent of target."""
    x = _target_rows(t)
    sums = x.agg(F.sum("target").alias("_t"), F.sum("actual_revenue").alias("_a"))
    return sums.select(
        money("_t").alias("total_target"),
        money("_a").alias("total_actual"),
        money(F.col("_a") - F.col("_t")).alias("total_variance"),
        growth_pct(F.col("_a"), F.col("_t")).alias("overall_achievement_pct"))


def target_best_months(t: SalesTables) -> DataFrame:
    """Per month label: summed target, actual, variance, variance in percent, rank by variance."""
    actual = actual_by_month_label(t.sales(["order_date"], ["amount"]), by=())
    monthly_target = (t.sales_target.groupBy("month_of_order_date")
                      .agg(F.sum("target").cast(MONEY).alias("total_target")))
    x = target_attainment(monthly_target, actual, [("month_of_order_date", "sale_month")])
    x = x.withColumn("_var", F.col("actual_revenue") - F.col("total_target"))
    x = W.rank_by(x, [F.desc("_var")], "best_month_rank", kind="rank")
    return (x.select(
        F.col("month_of_order_date").alias("month"),
        money("total_target").alias("monthly_target"),
        "actual_revenue",
        money("_var").alias("variance"),
        growth_pct("actual_revenue", "total_target").alias("achievement_pct"),
        "best_month_rank")
        .orderBy(F.desc("achievement_pct"), "month"))


# ---------------------------------------------------- category / sub-category

def category_performance(t: SalesTables) -> DataFrame:
    """Per category: orders, units, revenue, profit, mean line value, margin, revenue share and
    dense rank by revenue."""
    fact = t.fact([], ["category", *LINE])
    x = M.measures(fact, ["category"], [
        M.orders("total_orders"), M.units("units_sold"), M.revenue("total_revenue"),
        M.profit("total_profit"), M.avg_line_value("avg_order_value"),
        M.margin_pct("profit_margin_pct"), M.raw_sum("amount", "_rev")])
    x = W.share_of_total(x, "_rev", "revenue_share_pct")
    x = W.rank_by(x, [F.desc("_rev")], "revenue_rank")
    return x.drop("_rev").orderBy(F.desc("total_revenue"), "category")


def _subcategory_measures(t: SalesTables) -> DataFrame:
    fact = t.fact([], ["category", "sub_category", *LINE])
    return M.measures(fact, ["category", "sub_category"], [
        M.orders("total_orders"), M.units("units_sold"), M.revenue("total_revenue"),
        M.profit("total_profit"), M.margin_pct("profit_margin_pct"),
        M.raw_sum("profit", "_profit")])


def subcategory_performance(t: SalesTables) -> DataFrame:
    """Per (category, sub_category): orders, units, revenue, profit, margin and dense rank by
    profit."""
    x = W.rank_by(_subcategory_measures(t), [F.desc("_profit")], "profit_rank")
    return x.drop("_profit").orderBy(F.desc("total_profit"), "category", "sub_category")


def loss_making_subcategories(t: SalesTables) -> DataFrame:
    """Sub-categories whose total profit is negative."""
    fact = t.fact([], ["category", "sub_category", "amount", "profit"])
    x = M.measures(fact, ["category", "sub_category"], [
        M.revenue("total_revenue"), M.profit("total_profit"), M.orders("total_orders"),
        M.raw_sum("profit", "_profit")])
    return (x.where(F.col("_profit") < 0).drop("_profit")
            .orderBy("total_profit", "category", "sub_category"))


def top_subcategories_per_category(t: SalesTables, n: int = 3) -> DataFrame:
    """Top ``n`` sub-categories by profit inside each category, ties kept."""
    fact = t.sales([], ["category", "sub_category", "profit"], orders=False)
    x = M.measures(fact, ["category", "sub_category"], [
        M.profit("total_profit"), M.raw_sum("profit", "_profit")])
    x = W.top_n_per_group(x, ["category"], [F.desc("_profit")], n, "profit_rank")
    return x.drop("_profit").orderBy("category", "profit_rank", "sub_category")


def pareto_subcategories(t: SalesTables, threshold: int = L.PARETO_THRESHOLD) -> DataFrame:
    """Sub-categories by revenue with cumulative share and an 80/20 group."""
    fact = t.sales([], ["category", "sub_category", "amount"], orders=False)
    x = M.measures(fact, ["category", "sub_category"], [M.revenue("revenue")])
    x = W.pareto(x, "revenue", ["category", "sub_category"], threshold,
                 top_label=L.PARETO_TOP, rest_label=L.PARETO_REST)
    return x.orderBy(F.desc("revenue"), "category", "sub_category")


# ------------------------------------------------------------------ customers

CUSTOMER_PLACE = ("customer_name", "state", "city")


def top_customers(t: SalesTables, n: int = 10, grain: tuple = CUSTOMER_PLACE) -> DataFrame:
    """Top ``n`` customers (``grain``) by spend with orders, units, profit, mean line value, first
    and last purchase."""
    fact = t.sales([*grain, "order_date"], LINE)
    x = M.measures(fact, list(grain), [
        M.orders("total_orders"), M.units("total_units"), M.revenue("total_spent"),
        M.profit("profit_generated"), M.avg_line_value("avg_order_value"),
        M.first("order_date", "first_purchase"), M.last("order_date", "last_purchase")])
    # distributed top-k: each task keeps its best n, the driver merges them
    return x.orderBy(F.desc("total_spent"), *grain).limit(n)


def customer_acquisition(t: SalesTables) -> DataFrame:
    """New customers per month of their first order (all orders) and the running total."""
    first = C.first_purchase_month(t.orders("customer_name", "order_date"))
    monthly = first.groupBy("acquisition_month").agg(
        F.count(F.lit(1)).cast(T.LongType()).alias("new_customers"))
    x = W.running_total(monthly, "new_customers", ["acquisition_month"], name="cumulative_customers")
    return (x.select(month_key("acquisition_month").alias("acquisition_month"), "new_customers",
                     F.col("cumulative_customers").cast(T.LongType()).alias("cumulative_customers"))
            .orderBy("acquisition_month"))


def _max_order_date(t: SalesTables):
    return t.orders("order_date").agg(F.max("order_date")).scalar()


def rfm_segments(t: SalesTables, score_order: str = "as_computed",
                 grain: tuple = ("customer_name",), as_of: str = L.RFM_AS_OF) -> DataFrame:
    """Per customer: recency days, frequency, monetary, NTILE(4) scores, their total and the
    segment. ``as_of`` is the date that recency scores count from."""
    scored = C.rfm_scores(t.sales([*grain, "order_date"], ["amount"]), as_of=as_of,
                          score_order=score_order, grain=grain)
    return (scored.select(
        *grain,
        F.datediff(_max_order_date(t), "last_purchase_date").cast(T.LongType()).alias("recency_days"),
        "frequency", "monetary", "r_score", "f_score", "m_score",
        (F.col("r_score") + F.col("f_score") + F.col("m_score")).alias("rfm_total"),
        C.rfm_segment(F.col("r_score"), F.col("f_score"), F.col("m_score")).alias("customer_segment"))
        .orderBy(F.desc("rfm_total"), *grain))


def rfm_segment_summary(t: SalesTables, score_order: str = "as_computed",
                        grain: tuple = ("customer_name",), as_of: str = L.RFM_AS_OF) -> DataFrame:
    """Per RFM segment: customers, revenue, mean spend and shares of customers and revenue."""
    scored = C.rfm_scores(t.sales([*grain, "order_date"], ["amount"]), as_of=as_of,
                          score_order=score_order, grain=grain)
    seg = scored.withColumn("customer_segment",
                            C.rfm_segment(F.col("r_score"), F.col("f_score"), F.col("m_score")))
    x = seg.groupBy("customer_segment").agg(
        F.count(F.lit(1)).cast(T.LongType()).alias("customer_count"),
        money(F.sum("monetary")).alias("total_revenue"),
        mean("monetary").alias("avg_spend"),
        F.sum("monetary").cast(MONEY).alias("_rev"))
    x = W.share_of_total(x, "customer_count", "pct_customers")
    x = W.share_of_total(x, "_rev", "pct_revenue")
    return x.drop("_rev").orderBy(F.desc("total_revenue"), "customer_segment")


# ------------------------------------------------------------------ regions

def state_performance(t: SalesTables) -> DataFrame:
    """Per state: orders, customers, units, revenue, profit, margin, mean line value, dense ranks
    by revenue and profit."""
    fact = t.sales(["state", "customer_name"], LINE)
    x = M.measures(fact, ["state"], [
        M.orders("total_orders"), M.units("units_sold"),
        M.revenue("total_revenue"), M.profit("total_profit"), M.margin_pct("profit_margin_pct"),
        M.avg_line_value("avg_order_value"),
        M.raw_sum("amount", "_rev"), M.raw_sum("profit", "_profit")],
        distinct={"unique_customers": "customer_name"})
    x = W.rank_by(x, [F.desc("_rev")], "revenue_rank")
    x = W.rank_by(x, [F.desc("_profit")], "profit_rank")
    return x.drop("_rev", "_profit").orderBy(F.desc("total_revenue"), "state")


def top_cities(t: SalesTables, n: int = 15) -> DataFrame:
    """Top ``n`` (city, state) by revenue with orders, customers, profit, mean line value and
    dense rank."""
    fact = t.sales(["city", "state", "customer_name"], ["amount", "profit"])
    x = M.measures(fact, ["city", "state"], [
        M.orders("total_orders"), M.revenue("total_revenue"),
        M.profit("total_profit"), M.avg_line_value("avg_order_value"),
        M.raw_sum("amount", "_rev")], distinct={"unique_customers": "customer_name"})
    x = W.rank_by(x, [F.desc("_rev")], "city_rank")
    return x.drop("_rev").orderBy(F.desc("total_revenue"), "city", "state").limit(n)


def top_category_per_state(t: SalesTables) -> DataFrame:
    """Best-selling category of each state by revenue (ties by category name)."""
    fact = t.fact(["state"], ["category", "amount"])
    x = M.measures(fact, ["state", "category"], [M.revenue("revenue"), M.raw_sum("amount", "_rev")])
    x = W.top_n_per_group(x, ["state"], [F.desc("_rev"), "category"], 1, "_rn", keep_ties=False)
    return (x.select("state", F.col("category").alias("top_category"), "revenue")
            .orderBy(F.desc("revenue"), "state"))


def market_entry_timeline(t: SalesTables) -> DataFrame:
    """First order of each state (earliest date, then lowest order id) with its customer and city."""
    # earliest (order_date, order_id) per state as a MIN over a struct:
    # partial aggregation per task, no window over all orders of a state
    orders = t.orders("order_id", "order_date", "customer_name", "state", "city")
    first = orders.groupBy("state").agg(
        F.min(F.struct("order_date", "order_id", "customer_name", "city")).alias("f"))
    return (first.select("state", F.col("f.order_id").alias("order_id"),
                         F.col("f.order_date").alias("first_order_date"),
                         F.col("f.customer_name").alias("first_customer"),
                         F.col("f.city").alias("first_city"))
            .orderBy("first_order_date", "order_id"))


# ------------------------------------------------------------ payment modes

def payment_mode_performance(t: SalesTables) -> DataFrame:
    """Per payment mode: orders, units, revenue, profit, mean line value, shares of orders and
    revenue."""
    fact = t.fact([], ["payment_mode", *LINE])
    x = M.measures(fact, ["payment_mode"], [
        M.orders("total_orders"), M.units("units_sold"), M.revenue("total_revenue"),
        M.profit("total_profit"), M.avg_line_value("avg_order_value"),
        M.raw_sum("amount", "_rev")])
    # order shares divide by the sum of per-mode distinct counts: an order
    # paid two ways counts once for each mode
    x = W.share_of_total(x, "total_orders", "pct_orders")
    x = W.share_of_total(x, "_rev", "pct_revenue")
    return x.drop("_rev").orderBy(F.desc("total_revenue"), "payment_mode")


def payment_preference_by_state(t: SalesTables) -> DataFrame:
    """Payment modes ranked by distinct orders inside each state."""
    fact = t.fact(["state"], ["payment_mode", "amount"])
    x = M.measures(fact, ["state", "payment_mode"], [M.orders("orders"), M.revenue("revenue")])
    x = W.rank_by(x, [F.desc("orders")], "preference_rank", by=["state"])
    return x.orderBy("state", "preference_rank", "payment_mode")


def top_payment_per_category(t: SalesTables) -> DataFrame:
    """Most used payment mode of each category by distinct orders (ties by mode)."""
    fact = t.fact([], ["category", "payment_mode"])
    x = M.measures(fact, ["category", "payment_mode"], [M.orders("orders")])
    x = W.top_n_per_group(x, ["category"], [F.desc("orders"), "payment_mode"], 1, "_rn",
                          keep_ties=False)
    return (x.select("category", F.col("payment_mode").alias("preferred_payment_mode"), "orders")
            .orderBy("category"))


# ------------------------------------------------------------- profitability

def margin_ranking(t: SalesTables) -> DataFrame:
    """Sub-categories ranked by their rounded margin percentage."""
    fact = t.sales([], ["category", "sub_category", "amount", "profit"], orders=False)
    x = M.measures(fact, ["category", "sub_category"], [
        M.revenue("revenue"), M.profit("profit"), M.margin_pct("margin_pct")])
    # ranked on the rounded margin, as reported
    x = W.rank_by(x, [F.desc("margin_pct")], "margin_rank")
    return x.orderBy(F.desc("margin_pct"), "category", "sub_category")


def profit_moving_average(t: SalesTables, rows: int = 3) -> DataFrame:
    """Monthly profit with the average over the current and ``rows - 1`` previous months."""
    fact = t.sales(["order_date"], ["profit"])
    monthly = M.measures(fact, [month_start("order_date").alias("m")], [M.profit("monthly_profit")])
    x = W.moving_average(monthly, "monthly_profit", ["m"], rows, name="moving_avg_3m")
    return x.select(month_key("m").alias("order_month"), "monthly_profit", "moving_avg_3m").orderBy(
        "order_month")


def loss_making_lines(t: SalesTables) -> DataFrame:
    """Every order line with negative profit, with its order's attributes."""
    fact = t.fact(["order_date", "customer_name", "state", "city"],
                  ["category", "sub_category", "payment_mode", *LINE], rebalanced=False)
    return (fact.where(F.col("profit") < 0).select(
        "order_id", "order_date", "customer_name", "state", "city", "category", "sub_category",
        "payment_mode", money("amount").alias("revenue"), money("profit").alias("profit"),
        F.col("quantity").cast(T.LongType()).alias("quantity"))
        .orderBy("profit", "order_id"))


def loss_summary(t: SalesTables) -> DataFrame:
    """Loss lines (orphans included): count, revenue, total loss and loss in percent of all
    revenue."""
    # all order lines, orphans included; one pass with conditional sums
    d = t.details("amount", "profit")
    loss = F.col("profit") < 0
    sums = d.agg(
        F.sum(F.when(loss, 1).otherwise(0)).alias("_n"),
        F.sum(F.when(loss, F.col("amount"))).alias("_rev"),
        F.sum(F.when(loss, F.col("profit"))).alias("_loss"),
        F.sum("amount").alias("_all"))
    return sums.select(
        F.coalesce(F.col("_n"), F.lit(0)).cast(T.LongType()).alias("loss_order_count"),
        money("_rev").alias("loss_order_revenue"),
        money("_loss").alias("total_loss"),
        pct_of(F.abs(F.col("_loss")), F.col("_all")).alias("loss_as_pct_of_revenue"))


# ------------------------------------------------------- customer lifetime

def clv_customers(t: SalesTables, grain: tuple = CUSTOMER_PLACE) -> DataFrame:
    """Per customer (``grain``): lifetime orders, spend, profit, first and last order, lifespan,
    mean line value, spend quartile and label."""
    grain = list(grain)
    fact = t.sales([*grain, "order_date"], ["amount", "profit"])
    base = M.measures(fact, grain, [
        M.orders("total_orders"), M.revenue("total_spent"), M.profit("profit_generated"),
        M.first("order_date", "first_order"), M.last("order_date", "last_order"),
        M.avg_line_value("avg_order_value")])
    base = base.withColumn("lifespan_days",
                           F.datediff("last_order", "first_order").cast(T.LongType()))
    x = C.clv_quartiles(base, grain)
    return (x.select(*grain, "total_orders", "total_spent",
                     "profit_generated", "first_order", "last_order", "lifespan_days",
                     "avg_order_value", "clv_quartile",
                     C.clv_segment(F.col("clv_quartile")).alias("clv_segment"))
            .orderBy(F.desc("total_spent"), *grain))


def clv_segment_summary(t: SalesTables, grain: tuple = ("customer_name",)) -> DataFrame:
    """Per spend quartile: customers, revenue, mean spend and revenue share."""
    fact = t.sales(list(grain), ["amount"])
    base = M.measures(fact, list(grain), [M.revenue("total_spent")])
    x = C.clv_quartiles(base, list(grain))
    s = x.groupBy("clv_quartile").agg(
        F.count(F.lit(1)).cast(T.LongType()).alias("customers"),
        money(F.sum("total_spent")).alias("total_revenue"),
        mean("total_spent").alias("avg_clv"),
        F.sum("total_spent").cast(MONEY).alias("_rev"))
    s = W.share_of_total(s, "_rev", "pct_revenue")
    return (s.select("clv_quartile", C.clv_segment(F.col("clv_quartile")).alias("segment"),
                     "customers", "total_revenue", "avg_clv", "pct_revenue")
            .orderBy("clv_quartile"))


def cohort_retention(t: SalesTables, max_index: int = 11) -> DataFrame:
    """Per monthly acquisition cohort: size, months since cohort (0..``max_index``), active
    customers and retention rate."""
    orders = t.orders("customer_name", "order_date").where(F.col("customer_name").isNotNull())
    x = C.cohort_retention(orders, max_index)
    return (x.select(month_key("cohort_month").alias("cohort_month"), "cohort_size", "month_index",
                     "active_customers", "retention_rate_pct")
            .orderBy("cohort_month", "month_index"))


# ----------------------------------------------------------- leaderboards

def customer_leaderboard(t: SalesTables, grain: tuple = ("customer_name", "state")) -> DataFrame:
    """Customer grain must include ``state`` (the in-state rank's partition)."""
    grain = list(grain)
    fact = t.sales(grain, ["amount", "profit"])
    base = M.measures(fact, grain, [M.revenue("total_revenue"), M.profit("total_profit")])
    x = C.leaderboard(base, "total_revenue", "state", share="revenue_share_pct", grain=grain)
    return (x.select(*grain, "total_revenue", "total_profit", "overall_rank",
                     "rank_in_state", "revenue_share_pct")
            .orderBy("overall_rank", *grain))


def category_mom_growth(t: SalesTables) -> DataFrame:
    """Per category and month: revenue, previous month's revenue and growth."""
    fact = t.fact(["order_date"], ["category", "amount"])
    x = M.measures(fact, ["category", month_start("order_date").alias("m")], [M.revenue("revenue")])
    x = W.period_growth(x, "revenue", ["m"], ["category"], "prev_month", "mom_growth_pct")
    return (x.select("category", month_key("m").alias("order_month"), "revenue", "prev_month",
                     "mom_growth_pct")
            .orderBy("category", "order_month"))


def weekday_histogram(t: SalesTables, orders_per_mark: int = 1) -> DataFrame:
    """Orders per weekday with a text bar of one mark per
    ``orders_per_mark`` orders (1 = one mark per order, as originally
    written; a bar longer than a string can hold needs a coarser unit)."""
    orders = t.orders("order_id", "order_date")
    x = text_histogram(orders, [day_name("order_date").alias("day_name"),
                                day_of_week("order_date").alias("_dow")],
                       F.count_distinct("order_id"), L.HISTOGRAM_MARK,
                       count_name="order_count", bar_name="histogram", unit=orders_per_mark,
                       unit_name="orders_per_mark")
    return x.orderBy("_dow").drop("_dow")


# -------------------------------------------------------- executive summary

EXECUTIVE_VIEW = "v_executive_summary"


def executive_summary_frame(t: SalesTables) -> DataFrame:
    """Monthly executive summary: orders, customers, active states, units, revenue, profit, mean
    line value, margin, loss lines."""
    fact = t.sales(["order_date", "customer_name", "state"], LINE)
    x = M.measures(fact, [month_start("order_date").alias("m")], [
        M.orders("total_orders"), M.units("units_sold"),
        M.revenue("total_revenue"), M.profit("total_profit"),
        M.avg_line_value("avg_order_value"), M.margin_pct("profit_margin_pct"),
        M.loss_lines("loss_orders")],
        distinct={"unique_customers": "customer_name", "active_states": "state"})
    first = ["total_orders", "unique_customers", "active_states"]
    return x.select(month_key("m").alias("month"), *first,
                    *[c for c in x.columns if c not in ("m", *first)])


def create_executive_view(t: SalesTables, name: str = EXECUTIVE_VIEW) -> None:
    """CREATE OR REPLACE VIEW: registers the plan, stores no data."""
    executive_summary_frame(t).createOrReplaceTempView(name)


def executive_summary(t: SalesTables) -> DataFrame:
    """SELECT * FROM the view; the consumer sorts (the view's own order
    is not relied on)."""
    create_executive_view(t)
    return t.spark.table(EXECUTIVE_VIEW).orderBy("month")

