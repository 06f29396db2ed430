"""Sales tables derived from the warehouse tables (Parquet).

Mapping (one row per stored row; every left join is on the dimension's
primary key, so it never adds or drops rows):

order_list
    order_id       o_orderkey
    order_date     o_orderdate as DATE
    customer_name  c_name       (customer via o_custkey)
    state          r_name       (region of the customer's nation)
    city           n_name       (nation of the customer)

order_details
    order_id       l_orderkey
    amount         ROUND(price(12,2) * (1 - discount(3,2)), 2) as DECIMAL(12,2)
    profit         amount - quantity * p_retailprice * 2, DECIMAL(13,2)
    quantity       l_quantity as INT
    category       p_type
    sub_category   p_brand
    payment_mode   l_returnflag || '-' || l_linestatus

sales_target
    one row per (MMM-yy month, category) that has sales, plus a
    ``Jan-02`` row per category (a month without sales); target =
    FLOOR(category revenue * (80 + month number) / 8000) as DECIMAL(18,2).

Only the stored tables a report needs are read: a report on order dates
and amounts reads ``orders`` and ``lineitem`` and nothing else.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.columns import month_label
from ledgerlens.sources.schemas import DETAIL_COLUMNS, ORDER_COLUMNS, TARGET_COLUMNS, WAREHOUSE
from ledgerlens.sources.tables import SalesTables

# Constants of this mapping (our own choice for the warehouse data, see the
# module doc); the reports do not depend on them.
EXTRA_TARGET_MONTH = "Jan-02"   # a month label with no sales
EXTRA_TARGET_MONTH_NUMBER = 1
TARGET_BASE = 80
TARGET_DIVISOR_CENTS = 800000   # 8000 in currency units, times 100 cents
PROFIT_COST_FACTOR = 2

AMOUNT_TYPE = T.DecimalType(12, 2)
PROFIT_TYPE = T.DecimalType(13, 2)
TARGET_TYPE = T.DecimalType(18, 2)


class Warehouse:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        """The stored table with its declared schema, resolved once per
        Warehouse (the file listing happens at resolution, not per use)."""
        if name not in self._tables:
            reader = self.spark.read
            if name in WAREHOUSE:
                reader = reader.schema(WAREHOUSE[name])
            self._tables[name] = reader.parquet(f"{self.root}/{name}.parquet")
        return self._tables[name]

    # -- order_list -------------------------------------------------------
    def orders(self, cols: Sequence[str]) -> DataFrame:
        unknown = set(cols) - set(ORDER_COLUMNS)
        if unknown:
            raise ValueError(f"not an order_list column: {sorted(unknown)}")
        need_customer = bool({"customer_name", "state", "city"} & set(cols))
        need_nation = bool({"state", "city"} & set(cols))
        need_region = "state" in cols
        o = self.table("orders").select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_orderdate").cast(T.DateType()).alias("order_date"),
            F.col("o_custkey"))
        if need_customer:
            c = self.table("customer").select(
                F.col("c_custkey").alias("o_custkey"),
                F.col("c_name").alias("customer_name"),
                F.col("c_nationkey").alias("n_nationkey"))
            o = o.join(c, "o_custkey", "left")
        if need_nation:
            n = self.table("nation").select(
                "n_nationkey", F.col("n_name").alias("city"), F.col("n_regionkey").alias("r_regionkey"))
            o = o.join(n, "n_nationkey", "left")
        if need_region:
            r = self.table("region").select("r_regionkey", F.col("r_name").alias("state"))
            o = o.join(r, "r_regionkey", "left")
        return o.select(*cols)

    # -- order_details ----------------------------------------------------
    def details(self, cols: Sequence[str]) -> DataFrame:
        unknown = set(cols) - set(DETAIL_COLUMNS)
        if unknown:
            raise ValueError(f"not an order_details column: {sorted(unknown)}")
        need_part = bool({"profit", "category", "sub_category"} & set(cols))
        amount = F.round(
            F.col("l_extendedprice").cast(AMOUNT_TYPE)
            * (F.lit(1).cast(T.DecimalType(3, 2)) - F.col("l_discount").cast(T.DecimalType(3, 2))),
            2).cast(AMOUNT_TYPE)
        d = self.table("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey"),
            F.col("l_quantity"),
            amount.alias("amount"),
            F.col("l_quantity").cast(T.IntegerType()).alias("quantity"),
            F.concat(F.col("l_returnflag"), F.lit("-"), F.col("l_linestatus")).alias("payment_mode"))
        if need_part:
            p = self.table("part").select(
                F.col("p_partkey").alias("l_partkey"),
                F.col("p_type").alias("category"),
                F.col("p_brand").alias("sub_category"),
                F.col("p_retailprice"))
            d = d.join(p, "l_partkey", "left")
            cost = (F.col("l_quantity").cast(T.DecimalType(4, 0))
                    * F.col("p_retailprice").cast(T.DecimalType(10, 2))
                    * F.lit(PROFIT_COST_FACTOR).cast(T.DecimalType(1, 0))).cast(AMOUNT_TYPE)
            d = d.withColumn("profit", (F.col("amount") - cost).cast(PROFIT_TYPE))
        return d.select(*cols)

    # -- sales_target -----------------------------------------------------
    def targets(self) -> DataFrame:
        return self.targets_from(SalesTables(
            lambda: self.orders(ORDER_COLUMNS), lambda: self.details(DETAIL_COLUMNS),
            lambda: None, orders_projector=self.orders, details_projector=self.details))

    @staticmethod
    def targets_from(tables: SalesTables) -> DataFrame:
        """Target rows derived from the sales of ``tables`` (see module doc):
        one aggregate of the fact by month and category, the rest on its
        rows. """
        fact = tables.fact(["order_date"], ["category", "amount"])
        monthly = (fact.groupBy(month_label("order_date").alias("month_of_order_date"),
                                F.month("order_date").alias("k"), "category")
                   .agg(F.sum("amount").alias("revenue")))
        # months are few: every category's cells fit a row
        cells = monthly.groupBy("category").agg(
            F.sum("revenue").alias("tot"),
            F.collect_set(F.struct("month_of_order_date", "k")).alias("cells"))
        extra = F.struct(F.lit(EXTRA_TARGET_MONTH).alias("month_of_order_date"),
                         F.lit(EXTRA_TARGET_MONTH_NUMBER).alias("k"))
        # an equi-join never matches a NULL category, so it has no target
        cells = cells.where(F.col("category").isNotNull()).select(
            "category", "tot", F.explode(F.array_union("cells", F.array(extra))).alias("c"))
        # integer arithmetic in cents: FLOOR is exact, no rounded quotient
        target = F.expr(f"(tot_cents * (c.k + {TARGET_BASE})) div {TARGET_DIVISOR_CENTS}")
        return (cells
                .withColumn("tot_cents", (F.col("tot") * F.lit(100)).cast(T.DecimalType(38, 0)))
                .select(F.col("c.month_of_order_date").alias("month_of_order_date"), "category",
                        target.cast(TARGET_TYPE).alias("target")))

    def sales_tables(self) -> SalesTables:
        return SalesTables(
            order_list=lambda: self.orders(ORDER_COLUMNS),
            order_details=lambda: self.details(DETAIL_COLUMNS),
            sales_target=lambda: self.targets().select(*TARGET_COLUMNS),
            orders_projector=self.orders,
            details_projector=self.details)


def warehouse_tables(spark: SparkSession, root: str) -> SalesTables:
    return Warehouse(spark, root).sales_tables()
