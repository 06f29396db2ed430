"""Independent SQL (DuckDB dialect) for every report.

Each statement starts from the stored warehouse tables (views named
``orders customer nation region lineitem part``), rebuilds the three sales
tables with the same mapping as ``ledgerlens.sources.warehouse`` and then
runs the report as written in SQL. It shares no code path with the Spark
plans; the only shared choices are output names, output types, tie-breaks
and the fixed label texts.

A statement is put together from measures (``MEASURES``) that are
aggregated once by the report's keys; ranks, shares and earlier periods
are then written over that aggregate without using the window the plan
uses: a rank counts the larger values, a quartile comes from the rank's
arithmetic, an earlier period is a join on the period before it.

Rounding: DuckDB divides decimals in floating point, so every rounded
quotient is computed exactly in integers instead: both operands scaled to
whole cents, then ``sign * ((|n| * 200 * mult + |d|) // (2 * |d|))``,
which is ROUND(n * mult / d, 2) half away from zero, NULL when d = 0.
"""

from __future__ import annotations

from ledgerlens.plans import labels as L


def money(expr: str) -> str:
    return f"CAST(ROUND({expr}, 2) AS DECIMAL(20,2))"


def cents(expr: str) -> str:
    """An exact 2-place decimal as whole cents (HUGEINT)."""
    return f"CAST(({expr}) * 100 AS HUGEINT)"


def rdiv(num: str, den: str, mult: int = 1) -> str:
    """ROUND(num * mult / den, 2) for integer-valued num and den."""
    n, d = f"({num})", f"({den})"
    return (f"CAST(CAST(sign({n}) * sign({d}) * ((abs({n}) * {200 * mult} + abs({d})) "
            f"// (2 * abs(NULLIF({d}, 0)))) AS DECIMAL(38,0)) * 0.01 AS DECIMAL(20,2))")


def pct(num_money: str, den_money: str) -> str:
    """ROUND(num * 100 / NULLIF(den, 0), 2) on money values."""
    return rdiv(cents(num_money), cents(den_money), 100)


def growth(cur: str, prev: str) -> str:
    return rdiv(f"{cents(cur)} - {cents(prev)}", cents(prev), 100)


def avg_money(col: str) -> str:
    """ROUND(AVG(col), 2) for a money column."""
    return rdiv(cents(f"SUM({col})"), f"COUNT({col}) * 100", 1)


def share_count(num: str, den: str) -> str:
    return rdiv(num, den, 100)


BIG = "BIGINT"

PREFIX = f"""
WITH order_list AS (
    SELECT o.o_orderkey AS order_id,
           CAST(o.o_orderdate AS DATE) AS order_date,
           c.c_name AS customer_name,
           r.r_name AS state,
           n.n_name AS city
    FROM orders o
    LEFT JOIN customer c ON o.o_custkey = c.c_custkey
    LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
    LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
),
line_base AS (
    SELECT l.l_orderkey AS order_id,
           CAST(ROUND(CAST(l.l_extendedprice AS DECIMAL(12,2))
                      * (CAST(1 AS DECIMAL(3,2)) - CAST(l.l_discount AS DECIMAL(3,2))), 2)
                AS DECIMAL(12,2)) AS amount,
           l.l_quantity AS qty_raw,
           p.p_retailprice AS price_raw,
           CAST(l.l_quantity AS INTEGER) AS quantity,
           p.p_type AS category,
           p.p_brand AS sub_category,
           l.l_returnflag || '-' || l.l_linestatus AS payment_mode
    FROM lineitem l
    LEFT JOIN part p ON l.l_partkey = p.p_partkey
),
order_details AS (
    SELECT order_id, amount,
           CAST(amount - CAST(CAST(qty_raw AS DECIMAL(4,0)) * CAST(price_raw AS DECIMAL(10,2)) * 2
                              AS DECIMAL(12,2)) AS DECIMAL(13,2)) AS profit,
           quantity, category, sub_category, payment_mode
    FROM line_base
),
sales_fact AS (
    SELECT ol.order_id, ol.order_date, ol.customer_name, ol.state, ol.city,
           od.amount, od.profit, od.quantity, od.category, od.sub_category, od.payment_mode
    FROM order_list ol
    JOIN order_details od ON ol.order_id = od.order_id
),
target_cells AS (
    SELECT strftime(order_date, '%b-%y') AS month_of_order_date, month(order_date) AS k,
           category, SUM(amount) AS revenue
    FROM sales_fact GROUP BY 1, 2, 3
),
sales_target AS (
    SELECT c.month_of_order_date, c.category,
           CAST((CAST(t.tot * 100 AS HUGEINT) * (c.k + 80)) // 800000 AS DECIMAL(18,2)) AS target
    FROM (SELECT month_of_order_date, k, category FROM target_cells
          UNION
          SELECT 'Jan-02', 1, category FROM (SELECT DISTINCT category FROM target_cells)) c
    JOIN (SELECT category, SUM(revenue) AS tot FROM target_cells GROUP BY category) t
      ON c.category = t.category
)"""

# name -> aggregate over rows of the sales fact
MEASURES = {
    "orders": "COUNT(DISTINCT order_id)",
    "customers": "COUNT(DISTINCT customer_name)",
    "states": "COUNT(DISTINCT state)",
    "cities": "COUNT(DISTINCT city)",
    "categories": "COUNT(DISTINCT category)",
    "subs": "COUNT(DISTINCT sub_category)",
    "units": "CAST(SUM(quantity) AS BIGINT)",
    "revenue": money("SUM(amount)"),
    "profit": money("SUM(profit)"),
    "mean_line": avg_money("amount"),
    "margin": pct("SUM(profit)", "SUM(amount)"),
    "loss_lines": "CAST(COUNT(*) FILTER (profit < 0) AS BIGINT)",
    "first_day": "MIN(order_date)",
    "last_day": "MAX(order_date)",
}
MONTH = "strftime(order_date, '%Y-%m-01')"


def grouped(keys: dict[str, str], measures: dict[str, str], source: str = "sales_fact",
            where: str = "TRUE") -> str:
    """(SELECT keys, measures ... GROUP BY keys) with output names as dict
    keys; measure values name entries of MEASURES or are SQL."""
    items = [f"{sql} AS {name}" for name, sql in keys.items()]
    items += [f"{MEASURES.get(sql, sql)} AS {name}" for name, sql in measures.items()]
    tail = f" GROUP BY {', '.join(keys.values())}" if keys else ""
    return f"(SELECT {', '.join(items)} FROM {source} WHERE {where}{tail})"


def same(*columns: str) -> dict[str, str]:
    return {c: c for c in columns}


def dense_rank(table: str, value: str, by: str = "", me: str = "g") -> str:
    """1 + the distinct larger values (a NULL is smaller than any)."""
    group = f" AND o.{by} IS NOT DISTINCT FROM {me}.{by}" if by else ""
    mine = f"{me}.{value}"
    return (f"(SELECT 1 + COUNT(DISTINCT o.{value}) FROM {table} o "
            f"WHERE (o.{value} > {mine} OR ({mine} IS NULL AND o.{value} IS NOT NULL)){group})")


def in_order(*names: str) -> str:
    """ORDER BY items of a report's total order: -name descends."""
    return ", ".join(f"{n[1:]} DESC NULLS LAST" if n[0] == "-" else f"{n} ASC NULLS FIRST"
                     for n in names)


def quartile(*order: str) -> str:
    """Quartile from the row number i of n rows: the first n mod 4 quartiles
    hold one row more."""
    i = f"(ROW_NUMBER() OVER (ORDER BY {in_order(*order)}) - 1)"
    n = "(COUNT(*) OVER ())"
    long = f"(({n} % 4) * ({n} // 4 + 1))"
    return (f"CAST(CASE WHEN {i} < {long} THEN {i} // ({n} // 4 + 1) + 1 "
            f"ELSE {n} % 4 + ({i} - {long}) // ({n} // 4) + 1 END AS BIGINT)")


def total(value: str, table: str) -> str:
    return f"(SELECT SUM({value}) FROM {table})"


def label(key: str, texts: tuple) -> str:
    return f"list_extract({list(texts)!r}, {key})"


def top_of(key: str, pick: str, value: str, table: str) -> str:
    """For each key the ``pick`` of its largest value, first by name."""
    return (f"SELECT {key}, list_extract(list({pick} ORDER BY {in_order('-' + value, pick)}), 1) AS pick, "
            f"MAX({value}) AS best FROM {table} GROUP BY {key}")


BODIES: dict[str, str] = {}

# ---- data quality
BODIES["dq_row_counts"] = "\n" + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, (SELECT COUNT(*) FROM {t}) AS total_rows"
    for t in ("order_list", "order_details", "sales_target"))

for _report, _table, _columns in [
    ("dq_nulls_orders", "order_list", {
        "order_id": "order_id", "order_date": "order_date", "customer_name": "customer",
        "state": "state", "city": "city"}),
    ("dq_nulls_details", "order_details", {
        "order_id": "order_id", "amount": "amount", "profit": "profit", "quantity": "quantity",
        "category": "category", "payment_mode": "payment"}),
    ("dq_nulls_targets", "sales_target", {
        "month_of_order_date": "month", "category": "category", "target": "target"}),
]:
    BODIES[_report] = "\nSELECT " + ", ".join(
        f"CASE WHEN COUNT(*) > 0 THEN COUNT(*) - COUNT({c}) END AS null_{o}"
        for c, o in _columns.items()) + f" FROM {_table}"

BODIES["dq_duplicate_orders"] = """
SELECT DISTINCT order_id, n AS cnt
FROM (SELECT order_id, COUNT(*) OVER (PARTITION BY order_id) AS n FROM order_list) WHERE n > 1"""
BODIES["dq_orphan_details"] = """
SELECT COUNT(*) AS orphan_rows FROM order_details d
WHERE NOT EXISTS (FROM order_list o WHERE o.order_id = d.order_id)"""
BODIES["dq_date_range"] = """
SELECT lo AS earliest_order, hi AS latest_order, CAST(hi - lo AS BIGINT) AS total_days
FROM (SELECT MIN(order_date) AS lo, MAX(order_date) AS hi FROM order_list)"""
BODIES["dq_distinct_category_pairs"] = """
SELECT category, sub_category FROM order_details GROUP BY ALL"""
BODIES["dq_distinct_payment_modes"] = """
SELECT payment_mode FROM order_details GROUP BY ALL"""
BODIES["dq_distinct_target_categories"] = """
SELECT category FROM sales_target GROUP BY ALL"""
BODIES["dq_bad_amounts"] = """
SELECT COUNT(*) FILTER (amount <= 0) AS bad_amount_rows FROM order_details"""

# ---- summaries over one grouping
_SUMMARY = {"total_orders": "orders", "unique_customers": "customers"}
BODIES["business_summary"] = "\nFROM " + grouped({}, {
    **_SUMMARY, "states_covered": "states", "cities_covered": "cities",
    "product_categories": "categories", "sub_categories": "subs", "total_units_sold": "units",
    "total_revenue": "revenue", "total_profit": "profit", "avg_order_value": "mean_line",
    "overall_profit_margin_pct": "margin", "loss_making_orders": "loss_lines"})
BODIES["executive_summary"] = "\nFROM " + grouped({"month": MONTH}, {
    **_SUMMARY, "active_states": "states", "units_sold": "units", "total_revenue": "revenue",
    "total_profit": "profit", "avg_order_value": "mean_line", "profit_margin_pct": "margin",
    "loss_orders": "loss_lines"})
BODIES["quarterly_summary"] = "\nFROM " + grouped(
    {"yr": "CAST(year(order_date) AS BIGINT)", "qtr": "CAST(quarter(order_date) AS BIGINT)"},
    {"total_orders": "orders", "total_revenue": "revenue", "total_profit": "profit",
     "profit_margin_pct": "margin"})
BODIES["day_of_week_performance"] = "\nFROM " + grouped(
    {"day_of_week": "dayname(order_date)", "day_num": "CAST(dayofweek(order_date) + 1 AS BIGINT)"},
    {"total_orders": "orders", "total_revenue": "revenue", "total_profit": "profit",
     "avg_order_value": "mean_line"})
BODIES["loss_making_subcategories"] = "\nFROM " + grouped(
    same("category", "sub_category"),
    {"total_revenue": "revenue", "total_profit": "profit", "total_orders": "orders"}) + \
    " WHERE total_profit < 0"
BODIES["top_customers"] = "\nFROM " + grouped(
    same("customer_name", "state", "city"),
    {"total_orders": "orders", "total_units": "units", "total_spent": "revenue",
     "profit_generated": "profit", "avg_order_value": "mean_line", "first_purchase": "first_day",
     "last_purchase": "last_day"}) + \
    f" ORDER BY {in_order('-total_spent', 'customer_name', 'state', 'city')} LIMIT 10"

# ---- periods: the period before is joined by its position
_BY_MONTH = grouped({"order_month": MONTH}, {
    "total_revenue": "revenue", "total_profit": "profit", "total_orders": "orders",
    "units_sold": "units", "profit_margin_pct": "margin"})
BODIES["monthly_trend"] = f""",
g AS (SELECT *, (SELECT COUNT(*) FROM {_BY_MONTH} e WHERE e.order_month < m.order_month) AS i
      FROM {_BY_MONTH} m)
SELECT g.* EXCLUDE (i), b.total_revenue AS prev_month_revenue,
       {growth('g.total_revenue', 'b.total_revenue')} AS mom_revenue_growth_pct,
       {growth('g.total_profit', 'b.total_profit')} AS mom_profit_growth_pct
FROM g LEFT JOIN g b ON b.i = g.i - 1"""
_CATEGORY_MONTH = grouped({"category": "category", "order_month": MONTH}, {"revenue": "revenue"})
BODIES["category_mom_growth"] = f""",
g AS (SELECT *, (SELECT MAX(e.order_month) FROM {_CATEGORY_MONTH} e
                 WHERE e.category = m.category AND e.order_month < m.order_month) AS earlier
      FROM {_CATEGORY_MONTH} m)
SELECT g.category, g.order_month, g.revenue, b.revenue AS prev_month,
       {growth('g.revenue', 'b.revenue')} AS mom_growth_pct
FROM g LEFT JOIN g b ON b.category = g.category AND b.order_month = g.earlier"""
_BY_DAY = grouped(same("order_date"), {"daily_revenue": "revenue", "daily_profit": "profit"})
BODIES["ytd_running_totals"] = f""",
g AS {_BY_DAY}
SELECT d.*, {money('SUM(e.daily_revenue)')} AS ytd_revenue, {money('SUM(e.daily_profit)')} AS ytd_profit
FROM g d JOIN g e ON e.order_date <= d.order_date AND year(e.order_date) = year(d.order_date)
GROUP BY ALL"""
BODIES["profit_moving_average"] = f""",
g AS (SELECT *, ROW_NUMBER() OVER (ORDER BY order_month) AS i
      FROM {grouped({'order_month': MONTH}, {'monthly_profit': 'profit'})})
SELECT m.order_month, m.monthly_profit, {avg_money('e.monthly_profit')} AS moving_avg_3m
FROM g m JOIN g e ON e.i BETWEEN m.i - 2 AND m.i GROUP BY ALL"""
BODIES["customer_acquisition"] = f""",
g AS (SELECT strftime(d, '%Y-%m-01') AS acquisition_month, COUNT(*) AS new_customers
      FROM {grouped(same('customer_name'), {'d': 'first_day'}, 'order_list')} GROUP BY 1)
SELECT a.*, CAST(SUM(b.new_customers) AS BIGINT) AS cumulative_customers
FROM g a JOIN g b ON b.acquisition_month <= a.acquisition_month GROUP BY ALL"""

# ---- targets: sales of a target's month and category, none counting as 0
_TARGETS = """,
g AS (SELECT t.*, COALESCE((SELECT SUM(f.amount) FROM sales_fact f
                            WHERE strftime(f.order_date, '%b-%y') = t.month_of_order_date
                              AND f.category = t.category), 0) AS actual
      FROM sales_target t)"""
BODIES["target_vs_actual"] = _TARGETS + f"""
SELECT month_of_order_date AS month, category, {money('target')} AS target_revenue,
       {money('actual')} AS actual_revenue, {money('actual - target')} AS variance,
       {growth('actual', 'target')} AS variance_pct,
       if(actual >= target, '{L.TARGET_HIT}', '{L.TARGET_MISS}') AS target_status
FROM g"""
BODIES["target_hit_rate"] = _TARGETS + f"""
SELECT category, COUNT(*) FILTER (actual >= target) AS months_hit,
       COUNT(*) - COUNT(*) FILTER (actual >= target) AS months_missed, COUNT(*) AS total_months,
       {share_count('COUNT(*) FILTER (actual >= target)', 'COUNT(*)')} AS hit_rate_pct
FROM g GROUP BY category"""
BODIES["target_overall"] = _TARGETS + f"""
SELECT {money('SUM(target)')} AS total_target, {money('SUM(actual)')} AS total_actual,
       {money('SUM(actual) - SUM(target)')} AS total_variance,
       {growth('SUM(actual)', 'SUM(target)')} AS overall_achievement_pct
FROM g"""
BODIES["target_best_months"] = f""",
s AS (SELECT strftime(order_date, '%b-%y') AS m, SUM(amount) AS sold FROM sales_fact GROUP BY 1),
g AS (SELECT month_of_order_date AS month, SUM(target) AS goal,
             COALESCE(ANY_VALUE(sold), 0) AS actual
      FROM sales_target LEFT JOIN s ON m = month_of_order_date GROUP BY 1)
SELECT month, {money('goal')} AS monthly_target, {money('actual')} AS actual_revenue,
       {money('actual - goal')} AS variance, {growth('actual', 'goal')} AS achievement_pct,
       (SELECT 1 + COUNT(*) FROM g o WHERE o.actual - o.goal > g.actual - g.goal) AS best_month_rank
FROM g"""

# ---- categories and payment modes
_LINES = {"total_orders": "orders", "units_sold": "units", "total_revenue": "revenue",
          "total_profit": "profit"}
BODIES["category_performance"] = f""",
g AS {grouped(same('category'), {**_LINES, 'avg_order_value': 'mean_line', 'profit_margin_pct': 'margin'})}
SELECT *, {pct('total_revenue', total('total_revenue', 'g'))} AS revenue_share_pct,
       {dense_rank('g', 'total_revenue')} AS revenue_rank
FROM g"""
BODIES["subcategory_performance"] = f""",
g AS {grouped(same('category', 'sub_category'), {**_LINES, 'profit_margin_pct': 'margin'})}
SELECT *, {dense_rank('g', 'total_profit')} AS profit_rank FROM g"""
BODIES["top_subcategories_per_category"] = f""",
g AS {grouped(same('category', 'sub_category'), {'total_profit': 'profit'})}
FROM (SELECT *, {dense_rank('g', 'total_profit', 'category')} AS profit_rank FROM g)
WHERE profit_rank <= 3"""
BODIES["margin_ranking"] = f""",
g AS {grouped(same('category', 'sub_category'), {'revenue': 'revenue', 'profit': 'profit', 'margin_pct': 'margin'})}
SELECT *, {dense_rank('g', 'margin_pct')} AS margin_rank FROM g"""
BODIES["pareto_subcategories"] = f""",
g AS (SELECT *, ROW_NUMBER() OVER (ORDER BY {in_order('-revenue', 'category', 'sub_category')}) AS i
      FROM {grouped(same('category', 'sub_category'), {'revenue': 'revenue'})}),
c AS (SELECT a.category, a.sub_category, a.revenue, SUM(b.revenue) AS part,
             (SELECT SUM(revenue) FROM g) AS whole
      FROM g a JOIN g b ON b.i <= a.i GROUP BY ALL)
SELECT category, sub_category, revenue, {pct('part', 'whole')} AS cumulative_pct,
       CASE WHEN part * 100 / NULLIF(whole, 0) <= {L.PARETO_THRESHOLD} THEN '{L.PARETO_TOP}'
            ELSE '{L.PARETO_REST}' END AS pareto_group
FROM c"""
BODIES["payment_mode_performance"] = f""",
g AS {grouped(same('payment_mode'), {**_LINES, 'avg_order_value': 'mean_line'})}
SELECT *, {share_count('total_orders', total('total_orders', 'g'))} AS pct_orders,
       {pct('total_revenue', total('total_revenue', 'g'))} AS pct_revenue
FROM g"""
BODIES["payment_preference_by_state"] = f""",
g AS {grouped(same('state', 'payment_mode'), {'orders': 'orders', 'revenue': 'revenue'})}
SELECT *, {dense_rank('g', 'orders', 'state')} AS preference_rank FROM g"""
BODIES["top_payment_per_category"] = f"""
SELECT category, pick AS preferred_payment_mode, best AS orders FROM (
{top_of('category', 'payment_mode', 'n', grouped(same('category', 'payment_mode'), {'n': 'orders'}))})"""

# ---- regions
_PLACE = {"total_orders": "orders", "unique_customers": "customers", "total_revenue": "revenue",
          "total_profit": "profit", "avg_order_value": "mean_line"}
BODIES["state_performance"] = f""",
g AS {grouped(same('state'), {**_PLACE, 'units_sold': 'units', 'profit_margin_pct': 'margin'})}
SELECT *, {dense_rank('g', 'total_revenue')} AS revenue_rank,
       {dense_rank('g', 'total_profit')} AS profit_rank
FROM g"""
BODIES["top_cities"] = f""",
g AS {grouped(same('city', 'state'), _PLACE)}
SELECT *, {dense_rank('g', 'total_revenue')} AS city_rank FROM g
ORDER BY {in_order('-total_revenue', 'city', 'state')} LIMIT 15"""
BODIES["top_category_per_state"] = f"""
SELECT state, pick AS top_category, best AS revenue FROM (
{top_of('state', 'category', 'v', grouped(same('state', 'category'), {'v': 'revenue'}))})"""
BODIES["market_entry_timeline"] = """
SELECT state, f.order_id, f.order_date AS first_order_date, f.customer_name AS first_customer,
       f.city AS first_city
FROM (SELECT state, arg_min(o, (order_date, order_id)) AS f FROM order_list o GROUP BY state)"""

# ---- losses
BODIES["loss_making_lines"] = f"""
SELECT * EXCLUDE (amount) REPLACE ({money('profit')} AS profit, CAST(quantity AS BIGINT) AS quantity),
       {money('amount')} AS revenue
FROM sales_fact WHERE profit < 0"""
BODIES["loss_summary"] = f"""
SELECT COUNT(*) FILTER (profit < 0) AS loss_order_count,
       {money('SUM(amount) FILTER (profit < 0)')} AS loss_order_revenue,
       {money('SUM(least(profit, 0)) FILTER (profit < 0)')} AS total_loss,
       {pct('SUM(greatest(-profit, 0)) FILTER (profit < 0)', 'SUM(amount)')} AS loss_as_pct_of_revenue
FROM order_details"""

# ---- customers
_SCORES = {"r_score": ("days", "customer_name"), "f_score": ("-frequency", "customer_name"),
           "m_score": ("-monetary", "customer_name")}


def _fits(bounds: dict) -> str:
    return " AND ".join(f"{axis}_score BETWEEN {lo} AND {hi}" for axis, (lo, hi) in bounds.items())


_RFM = f""",
g AS (SELECT customer_name, frequency, monetary, seen,
             datediff('day', seen, DATE '{L.RFM_AS_OF}') AS days
      FROM {grouped(same('customer_name'), {'frequency': 'orders', 'monetary': 'revenue', 'seen': 'last_day'})}),
s AS (SELECT *, {', '.join(f'{quartile(*o)} AS {n}' for n, o in _SCORES.items())} FROM g),
x AS (SELECT *, COALESCE({', '.join(f"CASE WHEN {_fits(b)} THEN '{n}' END" for n, b in L.RFM_RULES)},
                         '{L.RFM_NEEDS_ATTENTION}') AS customer_segment FROM s)"""
BODIES["rfm_segments"] = _RFM + """
SELECT customer_name, CAST((SELECT MAX(order_date) FROM order_list) - seen AS BIGINT) AS recency_days,
       frequency, monetary, r_score, f_score, m_score,
       r_score + f_score + m_score AS rfm_total, customer_segment
FROM x"""
BODIES["rfm_segment_summary"] = _RFM + f""",
y AS (SELECT customer_segment, COUNT(*) AS customer_count, {money('SUM(monetary)')} AS total_revenue,
             {avg_money('monetary')} AS avg_spend
      FROM x GROUP BY 1)
SELECT *, {share_count('customer_count', total('customer_count', 'y'))} AS pct_customers,
       {pct('total_revenue', total('total_revenue', 'y'))} AS pct_revenue
FROM y"""
_LIFETIME = {"total_orders": "orders", "total_spent": "revenue", "profit_generated": "profit",
             "first_order": "first_day", "last_order": "last_day", "avg_order_value": "mean_line"}
BODIES["clv_customers"] = f""",
g AS (SELECT *, {quartile('-total_spent', 'customer_name', 'state', 'city')} AS clv_quartile
      FROM {grouped(same('customer_name', 'state', 'city'), _LIFETIME)})
SELECT *, CAST(last_order - first_order AS BIGINT) AS lifespan_days,
       {label('clv_quartile', L.CLV_SEGMENTS)} AS clv_segment
FROM g"""
BODIES["clv_segment_summary"] = f""",
g AS (SELECT *, {quartile('-total_spent', 'customer_name')} AS clv_quartile
      FROM {grouped(same('customer_name'), {'total_spent': 'revenue'})})
SELECT clv_quartile, {label('clv_quartile', L.CLV_SEGMENTS)} AS segment, COUNT(*) AS customers,
       {money('SUM(total_spent)')} AS total_revenue, {avg_money('total_spent')} AS avg_clv,
       {pct('SUM(total_spent)', total('total_spent', 'g'))} AS pct_revenue
FROM g GROUP BY clv_quartile"""
BODIES["customer_leaderboard"] = f""",
g AS {grouped(same('customer_name', 'state'), {'total_revenue': 'revenue', 'total_profit': 'profit'})},
v AS (SELECT total_revenue, COUNT(*) AS n FROM g GROUP BY 1),
w AS (SELECT a.total_revenue, 1 + COALESCE(SUM(b.n), 0) AS overall_rank
      FROM v a LEFT JOIN v b ON b.total_revenue > a.total_revenue
                             OR (a.total_revenue IS NULL AND b.total_revenue IS NOT NULL) GROUP BY 1),
d AS (SELECT a.state, a.total_revenue, 1 + COUNT(DISTINCT b.total_revenue) AS rank_in_state
      FROM g a LEFT JOIN g b ON b.state IS NOT DISTINCT FROM a.state
                            AND (b.total_revenue > a.total_revenue
                                 OR (a.total_revenue IS NULL AND b.total_revenue IS NOT NULL))
      GROUP BY 1, 2)
SELECT g.*, CAST(overall_rank AS BIGINT) AS overall_rank, rank_in_state,
       {pct('g.total_revenue', total('total_revenue', 'g'))} AS revenue_share_pct
FROM g JOIN w ON w.total_revenue IS NOT DISTINCT FROM g.total_revenue
JOIN d ON d.total_revenue IS NOT DISTINCT FROM g.total_revenue AND d.state IS NOT DISTINCT FROM g.state"""
BODIES["cohort_retention"] = f""",
g AS (SELECT customer_name, MIN(order_date) AS born,
             list_distinct(list(date_trunc('month', order_date))) AS months
      FROM order_list WHERE customer_name IS NOT NULL GROUP BY 1),
c AS (SELECT strftime(born, '%Y-%m-01') AS cohort_month,
             datediff('month', born, unnest(months)) AS month_index FROM g)
SELECT cohort_month, CAST(size AS BIGINT) AS cohort_size, CAST(month_index AS BIGINT) AS month_index,
       COUNT(*) AS active_customers, {share_count('COUNT(*)', 'size')} AS retention_rate_pct
FROM c JOIN (SELECT strftime(born, '%Y-%m-01') AS cohort_month, COUNT(*) AS size FROM g GROUP BY 1)
USING (cohort_month) WHERE month_index BETWEEN 0 AND 11 GROUP BY cohort_month, size, month_index"""
BODIES["weekday_histogram"] = f"""
SELECT dayname(order_date) AS day_name, COUNT(DISTINCT order_id) AS order_count,
       repeat('{L.HISTOGRAM_MARK}', COUNT(DISTINCT order_id)) AS histogram
FROM order_list GROUP BY 1"""


def oracle_sql() -> dict[str, str]:
    return {name: PREFIX + body for name, body in BODIES.items()}
