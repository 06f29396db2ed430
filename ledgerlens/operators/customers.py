"""Customer-grain operators: RFM scores, lifetime-value quartiles,
acquisition cohorts and the revenue leaderboard.

Customer grain grows with the data. Nothing here uses a window without
PARTITION BY on customer rows: quartiles come from ``ledgerlens.operators.selection``, global ranks from
``ledgerlens.operators.ranking``, totals from one-row scalar subqueries,
and per-customer aggregates are built with map-side partial aggregation
(a customer holding a third of all orders collapses to one row per task
before the exchange).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.columns import month_start, pct_of
from ledgerlens.operators import measures as M
from ledgerlens.operators.numbering import ordered
from ledgerlens.operators.ranking import asc, desc, with_overall_and_group_rank
from ledgerlens.operators.selection import with_tiles
from ledgerlens.plans import labels as L


def quartile_scores(base: DataFrame, scores: dict[str, list], k: int = 4,
                    grain: Sequence[str] = ("customer_name",)) -> DataFrame:
    """Add one NTILE(k) column per ``{name: order}``; each order is made
    total with the grain columns ascending. ``base`` is written once, and
    the boundaries of all scores are selected from it together."""
    return with_tiles(base, {name: [*order, *[asc(g) for g in grain]] for name, order in scores.items()}, k)


def rfm_segment(r: Column, f: Column, m: Column) -> Column:
    """Segment rules tried in order; the first match wins."""
    score = {"r": r, "f": f, "m": m}
    out = F.lit(L.RFM_NEEDS_ATTENTION)
    for segment, bounds in reversed(L.RFM_RULES):
        fits = F.lit(True)
        for axis, (low, high) in bounds.items():
            fits = fits & score[axis].between(low, high)
        out = F.when(fits, segment).otherwise(out)
    return out


SCORE_ORDERS = ("as_computed", "best_is_high")


def rfm_scores(fact: DataFrame, as_of: str = L.RFM_AS_OF, k: int = 4,
               score_order: str = "as_computed",
               grain: Sequence[str] = ("customer_name",)) -> DataFrame:
    """Per customer (``grain``) of order lines or rows per order: last
    purchase, frequency (distinct orders),
    monetary (revenue) and NTILE(k) scores.

    ``score_order="as_computed"`` (default) orders r_score by days since
    ``as_of`` ascending (most recent first), f_score by frequency and
    m_score by monetary, both descending, so score 1 is the *best*
    quartile on each axis, as the original computes it (its segment
    rules read the scores the other way). ``"best_is_high"`` reverses the
    three orders so that score ``k`` is the best. Ties are broken by the
    grain columns ascending.
    """
    if score_order not in SCORE_ORDERS:
        raise ValueError(f"score_order must be one of {SCORE_ORDERS}")
    base = (M.measures(fact, list(grain), [
                M.last("order_date", "last_purchase_date"), M.orders("frequency"),
                M.revenue("monetary")])
            .withColumn("days_since_as_of",
                        F.datediff(F.lit(as_of).cast(T.DateType()), "last_purchase_date")))
    best_high = score_order == "best_is_high"
    return quartile_scores(base, {
        "r_score": [desc("days_since_as_of") if best_high else asc("days_since_as_of")],
        "f_score": [asc("frequency") if best_high else desc("frequency")],
        "m_score": [asc("monetary") if best_high else desc("monetary")],
    }, k=k, grain=grain)


def clv_segment(q: Column) -> Column:
    return (F.when(q == 1, L.CLV_SEGMENTS[0]).when(q == 2, L.CLV_SEGMENTS[1])
            .when(q == 3, L.CLV_SEGMENTS[2]).otherwise(L.CLV_SEGMENTS[3]))


def clv_quartiles(base: DataFrame, grain: Sequence[str], value: str = "total_spent",
                  k: int = 4, name: str = "clv_quartile") -> DataFrame:
    """NTILE(k) by ``value`` descending, ties by ``grain`` ascending."""
    return quartile_scores(base, {name: [desc(value)]}, k=k, grain=grain)


def share_of_grand_total(df: DataFrame, value: str, name: str) -> DataFrame:
    """value * 100 / SUM(value) over all rows; the total is a one-row
    scalar subquery evaluated once, not a single-partition window."""
    total = df.agg(F.sum(value)).scalar()
    return df.withColumn(name, pct_of(F.col(value), total))


def leaderboard(base: DataFrame, value: str = "total_revenue", partition: str = "state",
                overall: str = "overall_rank", within: str = "rank_in_state",
                share: str | None = None, grain: Sequence[str] = ()) -> DataFrame:
    """RANK over all rows and DENSE_RANK within ``partition``, both by
    ``value`` descending; optionally ``share``: value in percent of the
    grand total (a one-row scalar subquery). Both ranks come from one table,
    written in the order of ``value`` while the result is built; ``grain``
    spreads rows that share one value."""
    stored = ordered(base, [F.desc(value), *[F.asc(g) for g in grain]], "ranking")
    out = with_overall_and_group_rank(stored, desc(value), partition, overall, within)
    if not share:
        return out
    return out.withColumn(share, pct_of(F.col(value), stored.agg(F.sum(value)).scalar()))


def activity_months(orders: DataFrame) -> DataFrame:
    """Distinct (customer_name, activity_month) with each customer's
    cohort month (the first month with an order).

    A customer's months are collected as a set, pre-aggregated in every
    task and shuffled once by customer (bounded by the number of months);
    its smallest element is the cohort month."""
    months = orders.groupBy("customer_name").agg(
        F.collect_set(month_start("order_date")).alias("_months"))
    return months.select("customer_name", F.array_min("_months").alias("cohort_month"),
                         F.explode("_months").alias("activity_month"))


def cohort_retention(orders: DataFrame, max_index: int = 11) -> DataFrame:
    """Active customers per (cohort month, months since cohort), for
    month indexes 0..max_index, with the cohort's size.

    Every customer is active in its own cohort month, so the cohort size
    is the index-0 count, read with a window over the (cohort, index)
    cells, a table bounded by months x months, whatever the number of
    customers; no second pass over customers is needed."""
    act = activity_months(orders).withColumn(
        "month_index", F.months_between("activity_month", "cohort_month").cast(T.LongType()))
    cells = (act.groupBy("cohort_month", "month_index")
             .agg(F.count("customer_name").cast(T.LongType()).alias("active_customers")))
    size = F.max(F.when(F.col("month_index") == 0, F.col("active_customers"))).over(
        Window.partitionBy("cohort_month"))
    return (cells.withColumn("cohort_size", size)
            .where(F.col("month_index").between(0, max_index))
            .withColumn("retention_rate_pct", pct_of(F.col("active_customers"), F.col("cohort_size"))))


def first_purchase_month(orders: DataFrame) -> DataFrame:
    """(customer_name, acquisition month start) from all orders."""
    return (orders.groupBy("customer_name").agg(F.min("order_date").alias("first_order_date"))
            .select("customer_name", month_start("first_order_date").alias("acquisition_month")))
