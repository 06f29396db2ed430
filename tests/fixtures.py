"""Tiny hand-made sales tables (ties, NULLs, zero amounts, an orphan line,
an order without lines, a calendar-year boundary, a name in two places)."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

from ledgerlens.sources import schemas
from ledgerlens.sources.tables import from_frames

ORDERS = [
    ("O1", dt.date(2018, 4, 1), "Asha", "Goa", "Panaji"),
    ("O2", dt.date(2018, 4, 1), "Asha", "Kerala", "Kochi"),     # same name, 2nd place; date tie
    ("O3", dt.date(2018, 6, 15), "Binu", "Kerala", "Kochi"),    # zero-revenue month
    ("O4", dt.date(2019, 1, 2), "Chen", "Goa", "Panaji"),       # new calendar year
    ("O5", dt.date(2019, 1, 2), "Dara", "Goa", "Panaji"),       # no lines
]

DETAILS = [
    ("O1", D("100.00"), D("10.00"), 2, "Furniture", "Chairs", "UPI"),
    ("O1", D("50.00"), D("-5.00"), 1, "Clothing", "Saree", "COD"),      # 2 modes in one order
    ("O2", D("100.00"), D("20.00"), 1, "Furniture", "Tables", "UPI"),
    ("O3", D("0.00"), D("0.00"), 1, "Clothing", "Saree", "COD"),        # amount <= 0
    ("O4", D("200.00"), D("-40.00"), 4, "Furniture", "Chairs", "Card"),  # loss
    ("O4", D("25.01"), D("0.01"), 1, "Electronics", "Phones", None),     # NULL mode
    ("O9", D("30.00"), D("-3.00"), 1, "Clothing", "Shirt", "COD"),       # orphan
]

TARGETS = [
    ("Apr-18", "Furniture", D("200.00")),
    ("Apr-18", "Clothing", D("60.00")),
    ("Jun-18", "Clothing", D("0.00")),
    ("Jan-19", "Furniture", D("150.00")),
    ("Feb-19", "Furniture", D("100.00")),
]


def tiny_tables(spark):
    return from_frames(
        spark.createDataFrame(ORDERS, schemas.ORDER_LIST),
        spark.createDataFrame(DETAILS, schemas.ORDER_DETAILS),
        spark.createDataFrame(TARGETS, schemas.SALES_TARGET))
