"""Named aggregate measures over the sales fact, and ``measures``.

A measure is a few parts and a formula over them, so that it can be
computed from order lines and from sums of lines, per order or per pair of
category and sub-category (``SalesTables.sales``). Each has its output type fixed (see
``ledgerlens.functions.columns``). Semantics as in the reports:

* ``orders``       COUNT(DISTINCT order_id)
* ``avg_line_value`` the mean amount per *order line* (not per order)
* ``loss_lines``   number of *lines* with profit < 0
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.columns import MONEY, mean_of, money, ratio_pct

# columns of the tables that hold sums of lines, beside the sums named as the
# columns of a line: lines with an amount, lines with a loss
AMOUNT_LINES, LOSS_LINES = "amount_lines", "loss_lines"


@dataclass(frozen=True)
class Part:
    """A part: its value over order lines (None where it counts orders, which
    lines repeat) and over rows that hold sums of lines."""
    over_lines: Column | None
    over_sums: Column


@dataclass(frozen=True)
class Measure:
    name: str
    parts: tuple[Part, ...]
    formula: Callable[..., Column]

    def result(self, *values: Column) -> Column:
        return self.formula(*values).alias(self.name)


def holds_sums(fact: DataFrame) -> bool:
    """Whether the rows of ``fact`` are sums of lines (per order or pair)."""
    return LOSS_LINES in fact.columns


def orders(name: str = "total_orders") -> Measure:
    return Measure(name, (Part(None, F.count(F.lit(1))),), lambda n: n.cast(T.LongType()))


def units(name: str = "units_sold") -> Measure:
    return Measure(name, (_sum("quantity"),), lambda s: s.cast(T.LongType()))


def _sum(column: str) -> Part:
    return Part(F.sum(column), F.sum(column))


def revenue(name: str = "total_revenue") -> Measure:
    return Measure(name, (_sum("amount"),), money)


def profit(name: str = "total_profit") -> Measure:
    return Measure(name, (_sum("profit"),), money)


def avg_line_value(name: str = "avg_order_value") -> Measure:
    return Measure(name, (_sum("amount"), Part(F.count("amount"), F.sum(AMOUNT_LINES))), mean_of)


def margin_pct(name: str = "profit_margin_pct") -> Measure:
    return Measure(name, (_sum("profit"), _sum("amount")), ratio_pct)


def loss_lines(name: str = "loss_orders") -> Measure:
    lines = F.sum(F.when(F.col("profit") < 0, 1).otherwise(0))
    return Measure(name, (Part(lines, F.sum(LOSS_LINES)),), lambda s: s.cast(T.LongType()))


def raw_sum(col: str, name: str) -> Measure:
    """Unrounded SUM kept for ranking and shares (exact decimal)."""
    return Measure(name, (_sum(col),), lambda s: s.cast(MONEY))


def first(col: str, name: str) -> Measure:
    """The least value of a column of the order."""
    return Measure(name, (Part(F.min(col), F.min(col)),), lambda x: x)


def last(col: str, name: str) -> Measure:
    """The greatest value of a column of the order."""
    return Measure(name, (Part(F.max(col), F.max(col)),), lambda x: x)


def count_where(cond: Column, name: str) -> Column:
    """SUM(CASE WHEN cond THEN 1 ELSE 0 END): NULL over no rows, like SQL."""
    return F.sum(F.when(cond, 1).otherwise(0)).cast(T.LongType()).alias(name)


def line_sums() -> list[Column]:
    """The aggregates that make a table of sums (per order or pair)."""
    return [*[F.sum(c).alias(c) for c in ("amount", "profit", "quantity")],
            F.count("amount").alias(AMOUNT_LINES),
            F.sum(F.when(F.col("profit") < 0, 1).otherwise(0)).alias(LOSS_LINES)]


def measures(fact: DataFrame, keys: Sequence[Column | str], wanted: Sequence[Measure],
             distinct: dict[str, str] | None = None) -> DataFrame:
    """GROUP BY ``keys`` with the given measures and COUNT(DISTINCT column) per
    ``{name: column}`` of ``distinct``.

    Over rows per order, orders are counted. Over lines they are distinct
    order ids: one such count groups by (keys, order_id) first, which needs
    no exchange where the lines are bucketed by order_id.

    A second distinct count in one aggregate would make Spark repeat every
    row. So one at most is taken with the measures; every other is an
    aggregate of its own, which reads the keys and that column only and is
    joined by the keys (few rows where the column has few values). No set of
    values is built in one buffer."""
    sums = holds_sums(fact)
    if sums and "order_id" not in fact.columns and any(
            p.over_lines is None for m in wanted for p in m.parts):
        raise ValueError("rows without an order cannot count orders")
    found = [m.result(*[_first_value(p, sums) for p in m.parts]) for m in wanted]
    apart = dict(distinct or {})
    if apart and (sums or not any(p.over_lines is None for m in wanted for p in m.parts)):
        name = next(iter(apart))
        found.append(F.count_distinct(apart.pop(name)).cast(T.LongType()).alias(name))
    out = fact.groupBy(*keys).agg(*found) if keys else fact.agg(*found)
    names = out.columns[:len(keys)]
    for name, col in apart.items():
        if not keys:
            values = fact.select(col).distinct().agg(F.count(col).cast(T.LongType()))
            out = out.withColumn(name, values.scalar())
            continue
        one = fact.groupBy(*keys).agg(F.count_distinct(col).cast(T.LongType()).alias(name))
        one = one.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(names)], name)
        on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(names)]
        out = out.join(one, on).drop(*[f"_k{i}" for i in range(len(names))])
    return out


def _first_value(part: Part, sums: bool) -> Column:
    if sums:
        return part.over_sums
    return F.count_distinct("order_id") if part.over_lines is None else part.over_lines
