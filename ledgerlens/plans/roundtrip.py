"""Sources and sinks as queries: what is written in the original file format
is read again by the sources, and what a sink wrote is read back.

Each query starts from the warehouse tables, writes below the shared
folder, and returns rows that SQL over the warehouse tables gives as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.operators.materialize import remove_at_exit, scratch_path
from ledgerlens.plans import reports as R
from ledgerlens.plans.catalog import REPORTS
from ledgerlens.plans.oracle import PREFIX, oracle_sql
from ledgerlens.sources import csv, schemas
from ledgerlens.sources.export import FORMATS, verify, write_csv, write_results
from ledgerlens.sources.staging import mapped_tables, staged_tables
from ledgerlens.sources.tables import SalesTables

Query = Callable[[SparkSession, str], DataFrame]


def _retyped(schema: T.StructType, like: DataFrame) -> T.StructType:
    """A file's schema with the types of the mapped table (its ids are
    numbers and its money is wider than in the original files)."""
    return T.StructType([T.StructField(f.name, like.schema[f.name].dataType) for f in schema.fields])


def _exported(spark: SparkSession, df: DataFrame, label: str) -> str:
    path = scratch_path(spark, f"csv-{label}")
    write_csv(df, path)
    remove_at_exit(spark, path)
    return path


def csv_orders_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders as a CSV file in the original format, read strictly: first
    order of each state (all columns of the file)."""
    t = mapped_tables(spark, sf_dir)
    path = _exported(spark, t.order_list, "orders")
    orders = csv.read_order_list(spark, path, _retyped(schemas.ORDER_LIST, t.order_list))
    return R.market_entry_timeline(SalesTables(orders, t.order_details, t.sales_target))


def csv_targets_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The targets as a CSV file, read strictly: target and actual by month
    and category."""
    t = staged_tables(spark, sf_dir)
    path = _exported(spark, t.sales_target, "targets")
    targets = csv.read_sales_target(spark, path, _retyped(schemas.SALES_TARGET, t.sales_target))
    return R.target_vs_actual(SalesTables(t.order_list, t.order_details, targets,
                                          fact_table=t.fact_table))


def csv_details_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order lines as CSV files, read strictly and joined to their orders:
    all loss lines (all columns of the file)."""
    t = mapped_tables(spark, sf_dir)
    path = _exported(spark, t.order_details, "details")
    details = csv.read_order_details(spark, path, _retyped(schemas.ORDER_DETAILS, t.order_details))
    return R.loss_making_lines(SalesTables(t.order_list, details, t.sales_target))


def _spoilt(df: DataFrame, faults: list[tuple[str, Column, Column]]) -> DataFrame:
    """``df`` as text, with ``(column, condition, text)`` written in place of
    values: what a careless export could hold."""
    texts = {f.name: F.date_format(f.name, csv.ORDER_DATE_FORMAT) if isinstance(f.dataType, T.DateType)
             else F.col(f.name).cast("string") for f in df.schema.fields}
    for column, condition, text in faults:
        texts[column] = F.when(condition, text).otherwise(texts[column])
    return df.select(*[x.alias(c) for c, x in texts.items()])


def load_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lenient load of files with planted bad lines: ``table_name, outcome,
    line_count`` for all lines, loaded and rejected ones (counted in the pass
    that stores them) and every reason (counted in the stored rejects).

    Orders whose id is divisible by 7 have another date format; lines with a
    quantity divisible by 10 have no number as amount, those with 5 over a
    quantity in words, and those with 7 over a third decimal of the profit."""
    t = mapped_tables(spark, sf_dir)
    quantity = F.col("quantity") % 10
    spoilt = {
        "order_list": _spoilt(t.order_list, [
            ("order_date", F.col("order_id") % 7 == 0, F.date_format("order_date", "yyyy/MM/dd"))]),
        "order_details": _spoilt(t.order_details, [
            ("amount", quantity == 0, F.lit("n/a")), ("quantity", quantity == 5, F.lit("five")),
            ("profit", quantity == 7, F.concat(F.col("profit").cast("string"), F.lit("5")))])}
    kinds = {"order_list": (schemas.ORDER_LIST, t.order_list),
             "order_details": (schemas.ORDER_DETAILS, t.order_details)}
    rows, reasons = [], None
    for name, df in spoilt.items():
        folder = scratch_path(spark, f"load-{name}")
        load = csv.load_csv(spark, _exported(spark, df, name), _retyped(*kinds[name]), folder)
        remove_at_exit(spark, folder)
        rows += [(name, "lines", load.lines), (name, "loaded", load.loaded),
                 (name, "rejected", load.rejected)]
        one = load.rejects.groupBy("reason").count().select(
            F.lit(name).alias("table_name"), F.col("reason").alias("outcome"),
            F.col("count").alias("line_count"))
        reasons = one if reasons is None else reasons.union(one)
    return spark.createDataFrame(rows, "table_name string, outcome string, line_count long").union(reasons)


SINK_REPORTS = ("monthly_trend", "target_vs_actual", "loss_making_subcategories", "top_customers")


def sink_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports written in every format with a manifest, read back and
    compared: ``report, format, rows_written, rows_read, same_rows``."""
    t = staged_tables(spark, sf_dir)
    out = None
    for kind in FORMATS:
        folder = scratch_path(spark, f"sink-{kind}")
        write_results(spark, {name: lambda name=name: REPORTS[name](t) for name in SINK_REPORTS},
                      folder, kind)
        remove_at_exit(spark, folder)
        seen = verify(spark, folder)
        out = seen if out is None else out.union(seen)
    return out


QUERIES: dict[str, Query] = {
    "csv_orders_source": csv_orders_source,
    "csv_targets_source": csv_targets_source,
    "csv_details_source": csv_details_source,
    "load_accounting": load_accounting,
    "sink_manifest": sink_manifest,
}

_ACCOUNTING = """,
o AS (SELECT CASE WHEN order_id % 7 = 0 THEN 'bad order_date' END AS fault FROM order_list),
d AS (SELECT CASE quantity % 10 WHEN 0 THEN 'bad amount' WHEN 5 THEN 'bad quantity'
             WHEN 7 THEN 'profit loses digits' END AS fault FROM order_details),
f AS (SELECT 'order_list' AS table_name, fault FROM o
      UNION ALL SELECT 'order_details', fault FROM d)
SELECT table_name, 'lines' AS outcome, COUNT(*) AS line_count FROM f GROUP BY 1
UNION ALL SELECT table_name, 'loaded', COUNT(*) - COUNT(fault) FROM f GROUP BY 1
UNION ALL SELECT table_name, 'rejected', COUNT(fault) FROM f GROUP BY 1
UNION ALL SELECT table_name, fault, COUNT(*) FROM f WHERE fault IS NOT NULL GROUP BY 1, 2"""


def _sink_sql() -> str:
    sql = oracle_sql()
    counts = [f"SELECT '{name}' AS report, COUNT(*) AS n FROM ({sql[name]})" for name in SINK_REPORTS]
    kinds = ", ".join(f"('{k}')" for k in FORMATS)
    return (f"SELECT report, format, n AS rows_written, n AS rows_read, TRUE AS same_rows "
            f"FROM ({' UNION ALL '.join(counts)}), (VALUES {kinds}) AS k(format)")


def roundtrip_sql() -> dict[str, str]:
    """SQL over the warehouse tables for the same rows."""
    sql = oracle_sql()
    return {"csv_orders_source": sql["market_entry_timeline"],
            "csv_targets_source": sql["target_vs_actual"],
            "csv_details_source": sql["loss_making_lines"],
            "load_accounting": PREFIX + _ACCOUNTING,
            "sink_manifest": _sink_sql()}
