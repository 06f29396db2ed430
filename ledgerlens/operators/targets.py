"""Sales against target.

Actuals are aggregated to the target's grain *before* the join, so the
join is between two small tables (one row per month label and category)
and Spark broadcasts or hashes it cheaply. The target table is the left
side: a target without sales counts as 0 actual revenue (a miss), sales
without a target row do not appear.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.columns import MONEY, month_label


def actual_by_month_label(fact: DataFrame, by: Sequence[str] = ("category",),
                          name: str = "actual_revenue") -> DataFrame:
    """SUM(amount) per (``MMM-yy`` month label, *by*), column ``sale_month``."""
    return (fact.groupBy(month_label("order_date").alias("sale_month"), *by)
            .agg(F.round(F.sum("amount"), 2).cast(MONEY).alias(name)))


def target_attainment(targets: DataFrame, actual: DataFrame,
                      on: Sequence[tuple[str, str]],
                      actual_col: str = "actual_revenue") -> DataFrame:
    """Left join of targets to actuals; ``actual_col`` is 0 where there
    were no sales. ``on`` pairs (target column, actual column)."""
    a = actual.select(*[F.col(ac).alias("_a_" + tc) for tc, ac in on], actual_col)
    cond = [F.col(tc) == F.col("_a_" + tc) for tc, _ in on]
    joined = targets.join(a, cond, "left")
    return (joined.withColumn(actual_col, F.coalesce(F.col(actual_col), F.lit(0).cast(MONEY)))
            .drop(*["_a_" + tc for tc, _ in on]))
