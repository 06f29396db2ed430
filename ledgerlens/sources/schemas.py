"""Declared schemas of the three sales tables.

The schema is fixed before load; nothing is inferred. Keys as declared:
order_list.order_id is the primary key, order_details.order_id refers to
it, and (month_of_order_date, category) is the key of sales_target.
Spark enforces none of these; the data-quality operators check them.
"""

from pyspark.sql import types as T

ORDER_LIST = T.StructType([
    T.StructField("order_id", T.StringType()),
    T.StructField("order_date", T.DateType()),
    T.StructField("customer_name", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("city", T.StringType()),
])

ORDER_DETAILS = T.StructType([
    T.StructField("order_id", T.StringType()),
    T.StructField("amount", T.DecimalType(10, 2)),
    T.StructField("profit", T.DecimalType(10, 2)),
    T.StructField("quantity", T.IntegerType()),
    T.StructField("category", T.StringType()),
    T.StructField("sub_category", T.StringType()),
    T.StructField("payment_mode", T.StringType()),
])

SALES_TARGET = T.StructType([
    T.StructField("month_of_order_date", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("target", T.DecimalType(10, 2)),
])

# Header names of the three files.
ORDER_HEADER = ("Order ID", "Order Date", "CustomerName", "State", "City")
DETAIL_HEADER = ("Order ID", "Amount", "Profit", "Quantity", "Category", "Sub-Category", "PaymentMode")
TARGET_HEADER = ("Month of Order Date", "Category", "Target")
HEADERS = {tuple(ORDER_LIST.names): ORDER_HEADER, tuple(ORDER_DETAILS.names): DETAIL_HEADER,
           tuple(SALES_TARGET.names): TARGET_HEADER}

ORDER_COLUMNS = [f.name for f in ORDER_LIST.fields]
DETAIL_COLUMNS = [f.name for f in ORDER_DETAILS.fields]
TARGET_COLUMNS = [f.name for f in SALES_TARGET.fields]


# Stored warehouse tables (Parquet) read by the mapping. Declared, not
# inferred: no footer reads at planning time, and a file whose columns
# changed type fails at read instead of silently changing results.
def _s(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


WAREHOUSE = {
    "orders": _s(("o_orderkey", T.LongType()), ("o_custkey", T.LongType()),
                 ("o_orderstatus", T.StringType()), ("o_totalprice", T.DoubleType()),
                 ("o_orderdate", T.TimestampNTZType()), ("o_orderpriority", T.StringType())),
    "customer": _s(("c_custkey", T.LongType()), ("c_name", T.StringType()),
                   ("c_nationkey", T.IntegerType()), ("c_acctbal", T.DoubleType()),
                   ("c_mktsegment", T.StringType())),
    "nation": _s(("n_nationkey", T.IntegerType()), ("n_name", T.StringType()),
                 ("n_regionkey", T.IntegerType())),
    "region": _s(("r_regionkey", T.IntegerType()), ("r_name", T.StringType())),
    "lineitem": _s(("l_orderkey", T.LongType()), ("l_partkey", T.LongType()),
                   ("l_suppkey", T.LongType()), ("l_linenumber", T.IntegerType()),
                   ("l_quantity", T.DoubleType()), ("l_extendedprice", T.DoubleType()),
                   ("l_discount", T.DoubleType()), ("l_tax", T.DoubleType()),
                   ("l_returnflag", T.StringType()), ("l_linestatus", T.StringType()),
                   ("l_shipdate", T.TimestampNTZType())),
    "part": _s(("p_partkey", T.LongType()), ("p_name", T.StringType()), ("p_brand", T.StringType()),
               ("p_type", T.StringType()), ("p_size", T.IntegerType()),
               ("p_retailprice", T.DoubleType())),
}
