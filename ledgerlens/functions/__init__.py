"""Column expressions shared by every report."""

from ledgerlens.functions.columns import (
    MONEY, PCT, as_count, day_name, day_of_week, growth_pct, mean, money,
    month_key, month_label, month_label_start, month_start, pct_of, ratio_pct,
)

__all__ = [
    "MONEY", "PCT", "as_count", "day_name", "day_of_week", "growth_pct", "mean",
    "money", "month_key", "month_label", "month_label_start", "month_start", "pct_of",
    "ratio_pct",
]
