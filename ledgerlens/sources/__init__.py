"""Sources: explicit-schema readers and the warehouse mapping."""

from ledgerlens.sources.csv import (
    clean_text, normalise_case, read_order_details, read_order_list, read_sales_tables,
    read_sales_target, read_with_rejects,
)
from ledgerlens.sources.tables import SalesTables, from_frames
from ledgerlens.sources.warehouse import Warehouse, warehouse_tables

__all__ = [
    "SalesTables", "Warehouse", "clean_text", "from_frames", "normalise_case",
    "read_order_details", "read_order_list", "read_sales_tables", "read_sales_target",
    "read_with_rejects",
    "warehouse_tables",
]
