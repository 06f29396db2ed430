"""Window operators over *bounded* inputs.

Everything here runs a Spark Window. A window without PARTITION BY moves
its whole input into one task, so these operators are meant for inputs
whose size does not grow with the data: one row per month, day, weekday,
category, sub-category, state, city or payment mode, produced by an
aggregate first. Rankings and shares at customer grain, which do grow
with the data, use ``ledgerlens.operators.ranking`` instead.

Orders are given as Columns (``F.desc("revenue")``) or column names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.columns import MONEY, growth_pct, pct_of
from ledgerlens.plans import labels as L


def _w(order: Sequence[Column | str], by: Sequence[Column | str] = ()):
    return Window.partitionBy(*by).orderBy(*order)


def with_previous(df: DataFrame, values: dict[str, str], order: Sequence[Column | str],
                  by: Sequence[str] = ()) -> DataFrame:
    """LAG(value, 1) for each ``{value: output_name}``; each lag is
    evaluated once and reused by any growth expression built on it."""
    w = _w(order, by)
    return df.select("*", *[F.lag(v).over(w).alias(out) for v, out in values.items()])


def period_growth(df: DataFrame, value: str, order: Sequence[Column | str], by: Sequence[str] = (),
                  prev_name: str = "prev", growth_name: str = "growth_pct") -> DataFrame:
    """Previous period's value and growth in percent against it.

    NULL growth for the first period and when the previous value is 0; a
    negative previous value divides by the signed value."""
    return (with_previous(df, {value: prev_name}, order, by)
            .withColumn(growth_name, growth_pct(value, prev_name)))


def running_total(df: DataFrame, value: str, order: Sequence[Column | str], by: Sequence[str] = (),
                  name: str = "running_total") -> DataFrame:
    """SUM(value) OVER (PARTITION BY by ORDER BY order ROWS UNBOUNDED
    PRECEDING .. CURRENT ROW). ``order`` must be total for a stable result."""
    w = _w(order, by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.sum(value).over(w))


def moving_average(df: DataFrame, value: str, order: Sequence[Column | str], rows: int = 3,
                   by: Sequence[str] = (), name: str = "moving_avg") -> DataFrame:
    """ROUND(AVG(value) over the current and ``rows - 1`` preceding rows, 2),
    computed as exact decimal SUM / COUNT."""
    w = _w(order, by).rowsBetween(-(rows - 1), Window.currentRow)
    s = F.sum(F.col(value).cast(MONEY)).over(w)
    n = F.count(value).over(w).cast(T.DecimalType(20, 0))
    return df.withColumn(name, F.round(s / F.nullif(n, F.lit(0).cast(T.DecimalType(20, 0))), 2).cast(MONEY))


def share_of_total(df: DataFrame, value: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """value * 100 / SUM(value) OVER (PARTITION BY by), rounded to 2."""
    total = F.sum(value).over(Window.partitionBy(*by))
    return df.withColumn(name, pct_of(F.col(value), total))


def rank_by(df: DataFrame, order: Sequence[Column | str], name: str, by: Sequence[str] = (),
            kind: str = "dense_rank") -> DataFrame:
    fn = {"dense_rank": F.dense_rank, "rank": F.rank, "row_number": F.row_number}[kind]
    return df.withColumn(name, fn().over(_w(order, by)).cast(T.LongType()))


def top_n_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], n: int,
                    name: str = "rank", keep_ties: bool = True) -> DataFrame:
    """Rows ranked ``<= n`` inside each ``by`` group.

    ``keep_ties`` uses DENSE_RANK (every row of the top ``n`` values);
    otherwise ROW_NUMBER with ``order`` as a total order. The rank filter
    lets Spark insert a per-partition group limit before the exchange."""
    kind = "dense_rank" if keep_ties else "row_number"
    return rank_by(df, order, name, by, kind).where(F.col(name) <= n)


def share_at_most(part: str, total: str, percent: int) -> Column:
    """part / total * 100 <= percent without a rounded quotient: the sign
    of the total decides which side is larger; not true for a zero total."""
    gap = F.col(part) * 100 - F.col(total) * percent
    return F.when(F.col(total) > 0, gap <= 0).when(F.col(total) < 0, gap >= 0).otherwise(False)


def pareto(df: DataFrame, value: str, tiebreak: Sequence[str], threshold: int = L.PARETO_THRESHOLD,
           pct_name: str = "cumulative_pct", group_name: str = "pareto_group",
           top_label: str = L.PARETO_TOP, rest_label: str = L.PARETO_REST) -> DataFrame:
    """Cumulative share of ``value`` in descending order and an 80/20 label.

    A row is a top driver while its cumulative share is at most
    ``threshold`` percent, so the row that crosses the threshold is not.
    The share is that of the signed total: over a zero total it is NULL
    and no row is a top driver; over a negative one it falls as the
    running sum grows."""
    order = [F.desc(value)] + [F.asc(c) for c in tiebreak]
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = F.sum(value).over(w)
    total = F.sum(value).over(Window.partitionBy())
    return (df.withColumn("_cum", cum).withColumn("_tot", total)
            .withColumn(pct_name, pct_of(F.col("_cum"), F.col("_tot")))
            .withColumn(group_name, F.when(share_at_most("_cum", "_tot", threshold), F.lit(top_label))
                        .otherwise(F.lit(rest_label)))
            .drop("_cum", "_tot"))
