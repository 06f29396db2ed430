"""The three sales tables as one bundle, with column-aware projection.

Reports ask for the columns they use (``tables.orders("order_id",
"order_date")``); a source that builds a table from several stored tables
(the warehouse mapping) then joins only the stored tables those columns
need. Plain sources simply project. Tables are built lazily, on first
use, so a report pays only for the tables it touches.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cached_property

from pyspark.sql import DataFrame

from ledgerlens.operators.measures import AMOUNT_LINES, LOSS_LINES

# columns of a line that the tables of sums hold, and what these are grouped by
SUMMED = ("amount", "profit", "quantity")
COUNTED = (AMOUNT_LINES, LOSS_LINES)
PAIR = ("category", "sub_category")

Projector = Callable[[Sequence[str]], DataFrame]
Loader = Callable[[], DataFrame]


class SalesTables:
    def __init__(self, order_list: DataFrame | Loader, order_details: DataFrame | Loader,
                 sales_target: DataFrame | Loader, orders_projector: Projector | None = None,
                 details_projector: Projector | None = None,
                 fact_table: DataFrame | None = None, order_sums: DataFrame | None = None,
                 pair_sums: DataFrame | None = None):
        self._loaders = {"order_list": order_list, "order_details": order_details,
                         "sales_target": sales_target}
        self.orders_projector = orders_projector
        self.details_projector = details_projector
        self.fact_table = fact_table
        self.order_sums = order_sums
        self.pair_sums = pair_sums

    def _load(self, name: str) -> DataFrame:
        x = self._loaders[name]
        return x if isinstance(x, DataFrame) else x()

    @cached_property
    def order_list(self) -> DataFrame:
        return self._load("order_list")

    @cached_property
    def order_details(self) -> DataFrame:
        return self._load("order_details")

    @cached_property
    def sales_target(self) -> DataFrame:
        return self._load("sales_target")

    def orders(self, *cols: str) -> DataFrame:
        cols = _dedupe(cols)
        if self.orders_projector is not None:
            return self.orders_projector(cols)
        return self.order_list.select(*cols)

    def details(self, *cols: str) -> DataFrame:
        cols = _dedupe(cols)
        if self.details_projector is not None:
            return self.details_projector(cols)
        return self.order_details.select(*cols)

    def fact(self, order_cols: Sequence[str], detail_cols: Sequence[str],
             rebalanced: bool = True) -> DataFrame:
        """Order lines joined to their order (inner join on order_id); read
        from the staged fact when there is one."""
        if self.fact_table is not None:
            return self.fact_table.select(*_dedupe(["order_id", *order_cols, *detail_cols]))
        from ledgerlens.operators.fact import sales_fact
        return sales_fact(self.orders("order_id", *order_cols),
                          self.details("order_id", *detail_cols), rebalanced=rebalanced)

    def sales(self, order_cols: Sequence[str], line_cols: Sequence[str],
              orders: bool = True) -> DataFrame:
        """The smallest staged table from which ``measures`` can aggregate the
        named columns of the fact: sums per (category, sub-category) where
        no column of an order is asked for and ``orders`` are not counted,
        sums per order where amounts are all that is asked of a line, else
        the lines themselves."""
        kinds = [c for c in line_cols if c not in SUMMED]
        wanted = _dedupe([*order_cols, *line_cols])
        if self.pair_sums is not None and not order_cols and not orders and set(kinds) <= set(PAIR):
            return self.pair_sums.select(*wanted, *COUNTED)
        if self.order_sums is not None and not kinds:
            return self.order_sums.select(*_dedupe(["order_id", *wanted]), *COUNTED)
        return self.fact(order_cols, line_cols)

    @property
    def spark(self):
        return self.fact([], []).sparkSession

    def register_views(self, prefix: str = "") -> list[str]:
        """Register the tables as temporary views (``order_list``,
        ``order_details``, ``sales_target``, ``sales_fact``) for ad-hoc
        Spark SQL; returns the view names."""
        views = {"order_list": self.order_list, "order_details": self.order_details,
                 "sales_target": self.sales_target,
                 "sales_fact": self.fact([c for c in self.order_list.columns if c != "order_id"],
                                         [c for c in self.order_details.columns if c != "order_id"])}
        for name, df in views.items():
            df.createOrReplaceTempView(prefix + name)
        return [prefix + n for n in views]


def _dedupe(cols: Sequence[str]) -> list[str]:
    out: list[str] = []
    for c in cols:
        if c not in out:
            out.append(c)
    return out


def from_frames(order_list: DataFrame, order_details: DataFrame,
                sales_target: DataFrame) -> SalesTables:
    return SalesTables(order_list, order_details, sales_target)
