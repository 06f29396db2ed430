"""Reports at grains that grow with the data: the windows of the original
reports over days, customers and orders instead of months and categories.

Each starts from the smallest staged table that can answer, and no step of
it lies in one task (``ledgerlens.operators.sequences``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.columns import growth_pct
from ledgerlens.operators import measures as M
from ledgerlens.operators import sequences as S
from ledgerlens.operators.ranking import asc
from ledgerlens.plans import labels as L
from ledgerlens.plans.oracle import PREFIX, growth, money, pct, rdiv
from ledgerlens.sources.tables import SalesTables


def pareto_customers(t: SalesTables, grain: tuple = ("customer_name", "state", "city"),
                     threshold: int = L.PARETO_THRESHOLD) -> DataFrame:
    """Customers by revenue with the cumulative share and an 80/20 group (ties
    by name and place)."""
    spent = M.measures(t.sales(list(grain), ["amount"]), list(grain), [M.revenue("revenue")])
    x = S.pareto(spent, "revenue", list(grain), threshold)
    return x.select(*grain, "revenue", "cumulative_pct", "pareto_group").orderBy(F.desc("revenue"), *grain)


def daily_revenue_trend(t: SalesTables, rows: int = 7) -> DataFrame:
    """Per day with sales: revenue, that of the day before in the series,
    growth, mean of the last ``rows`` such days and the running total."""
    daily = M.measures(t.sales(["order_date"], ["amount"]), ["order_date"], [M.revenue("revenue")])
    daily = daily.where(F.col("order_date").isNotNull())
    day = [asc("order_date")]
    x = S.moving_average(daily, "revenue", day, rows, name="moving_avg")
    x = S.running_total(x, "revenue", day, name="running_revenue")
    x = S.with_previous(x, {"revenue": "prev_revenue"}, day)
    return x.select("order_date", "revenue", "prev_revenue",
                    growth_pct("revenue", "prev_revenue").alias("growth_pct"), "moving_avg",
                    F.col("running_revenue").cast(T.DecimalType(20, 2)).alias("running_revenue")
                    ).orderBy("order_date")


def customer_order_gaps(t: SalesTables) -> DataFrame:
    """Every order with the customer's order before (by date, then id): its
    date and the days between. A customer with a third of all orders is
    spread over tasks like any others."""
    orders = t.orders("customer_name", "order_date", "order_id")
    x = S.with_previous(orders, {"order_date": "prev_order_date"}, [asc("order_date"), asc("order_id")],
                        ["customer_name"])
    return x.select("customer_name", "order_id", "order_date", "prev_order_date",
                    F.datediff("order_date", "prev_order_date").cast(T.LongType()).alias("days_between"))


REPORTS: dict[str, Callable[[SalesTables], DataFrame]] = {
    "pareto_customers": pareto_customers,
    "daily_revenue_trend": daily_revenue_trend,
    "customer_order_gaps": customer_order_gaps,
}

SQL: dict[str, str] = {
    "pareto_customers": PREFIX + f""",
g AS (SELECT customer_name, state, city, {money('SUM(amount)')} AS revenue FROM sales_fact GROUP BY 1, 2, 3),
c AS (SELECT g.*, SUM(revenue) OVER (ORDER BY revenue DESC, customer_name, state, city
                                     ROWS UNBOUNDED PRECEDING) AS cum, SUM(revenue) OVER () AS tot FROM g)
SELECT customer_name, state, city, revenue, {pct('cum', 'tot')} AS cumulative_pct,
       CASE WHEN cum * 100 <= tot * {L.PARETO_THRESHOLD} THEN '{L.PARETO_TOP}' ELSE '{L.PARETO_REST}' END
         AS pareto_group
FROM c""",
    "daily_revenue_trend": PREFIX + f""",
g AS (SELECT order_date, {money('SUM(amount)')} AS revenue FROM sales_fact GROUP BY 1),
w AS (SELECT g.*, LAG(revenue) OVER d AS prev_revenue, SUM(revenue) OVER (d ROWS 6 PRECEDING) AS s,
             COUNT(*) OVER (d ROWS 6 PRECEDING) AS n, SUM(revenue) OVER (d ROWS UNBOUNDED PRECEDING) AS r
      FROM g WINDOW d AS (ORDER BY order_date))
SELECT order_date, revenue, prev_revenue, {growth('revenue', 'prev_revenue')} AS growth_pct,
       {rdiv('CAST(s * 100 AS HUGEINT)', 'n * 100', 1)} AS moving_avg,
       CAST(r AS DECIMAL(20,2)) AS running_revenue
FROM w""",
    "customer_order_gaps": PREFIX + """,
w AS (SELECT customer_name, order_id, order_date,
             LAG(order_date) OVER (PARTITION BY customer_name ORDER BY order_date, order_id) AS prev_order_date
      FROM order_list)
SELECT *, CAST(datediff('day', prev_order_date, order_date) AS BIGINT) AS days_between FROM w""",
}
