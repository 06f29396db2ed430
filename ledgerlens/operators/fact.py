"""The sales fact: one row per order line, with its order's attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame


def sales_fact(orders: DataFrame, details: DataFrame, key: str = "order_id",
               rebalanced: bool = True) -> DataFrame:
    """Inner equi-join of order lines to orders on ``key``.

    Lines without an order (orphans) and orders without lines drop out.
    Spark picks the strategy from size statistics: a sort-merge join that
    shuffles both sides on ``key`` at scale, a broadcast of the order side
    when it is small. The rebalance after the join frees it from the
    partitioning that an aggregate above would take over, so that AQE may
    split an order with very many lines; later aggregates collapse its
    lines before their own exchange. Not ``rebalanced``: what sorts the
    lines deals them anew anyway.
    """
    fact = orders.join(details, key, "inner")
    return fact.hint("rebalance") if rebalanced else fact
