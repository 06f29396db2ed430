"""Typed column expressions.

Every report rounds money and percentages to two places. Output types are
fixed so that results compare exactly with an independent SQL engine:
money and percentages DECIMAL(20,2), counts and ranks BIGINT, month keys
as ``yyyy-MM-01`` text, dates as DATE.

Ratios are computed on DECIMAL operands (never on doubles), so the
quotient keeps at least 14 fractional digits before ROUND, which rounds
half away from zero on decimals.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(20, 2)
PCT = T.DecimalType(20, 2)
_INT_AS_DECIMAL = T.DecimalType(20, 0)


def _factor(k: int) -> Column:
    """Small integer literal typed DECIMAL(3,0), so products keep precision."""
    return F.lit(k).cast(T.DecimalType(3, 0))


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _exact(x) -> Column:
    """Operand for an exact division: integral values become DECIMAL(20,0),
    decimals are narrowed to DECIMAL(20,2) so the quotient keeps scale."""
    return _c(x).cast(MONEY)


def money(x) -> Column:
    """ROUND(x, 2) as DECIMAL(20,2)."""
    return F.round(_c(x), 2).cast(MONEY)


def as_count(x) -> Column:
    return _c(x).cast(T.LongType())


def ratio_pct(num, den, scale: int = 100) -> Column:
    """ROUND(num * scale / NULLIF(den, 0), 2); NULL when den is 0 or NULL."""
    n = _exact(num) * _factor(scale)
    d = F.nullif(_exact(den), F.lit(0).cast(MONEY))
    return F.round(n / d, 2).cast(PCT)


def pct_of(num, den) -> Column:
    """Share in percent, num * 100 / den, rounded to 2 places."""
    return ratio_pct(num, den, 100)


def mean_of(total, count) -> Column:
    """ROUND(total / count, 2) on decimals; NULL when the count is 0."""
    n = F.nullif(_c(count).cast(_INT_AS_DECIMAL), F.lit(0).cast(_INT_AS_DECIMAL))
    return F.round(_c(total).cast(MONEY) / n, 2).cast(MONEY)


def mean(x) -> Column:
    """ROUND(AVG(x), 2) computed as SUM/COUNT on decimals (no double step)."""
    return mean_of(F.sum(_c(x)), F.count(_c(x)))


def growth_pct(current, previous) -> Column:
    """ROUND((current - previous) * 100 / NULLIF(previous, 0), 2).

    A negative previous value divides by the signed value, as written."""
    cur, prev = _exact(current), _exact(previous)
    return F.round((cur - prev) * _factor(100) / F.nullif(prev, F.lit(0).cast(MONEY)), 2).cast(PCT)


def month_start(d) -> Column:
    """First day of the month as DATE (the grouping key)."""
    return F.trunc(_c(d), "month")


def month_key(d) -> Column:
    """Month as text ``yyyy-MM-01`` (the reported key)."""
    return F.date_format(_c(d), "yyyy-MM-01")


def month_label(d) -> Column:
    """Month as text ``MMM-yy``, e.g. ``Apr-18`` (the target table's key)."""
    return F.date_format(_c(d), "MMM-yy")


def month_label_start(label) -> Column:
    """First day of the month named by an ``MMM-yy`` label, for sorting
    labels chronologically. Two-digit years 70-99 are 1970-1999 and 00-69
    are 2000-2069."""
    lab = _c(label)
    mon = F.month(F.to_date(F.concat(F.substring(lab, 1, 3), F.lit("-2000")), "MMM-yyyy"))
    yy = F.substring(lab, 5, 2).cast(T.IntegerType())
    year = F.when(yy >= 70, yy + 1900).otherwise(yy + 2000)
    return F.make_date(year, mon, F.lit(1))


def day_name(d) -> Column:
    """Full English weekday name, e.g. ``Sunday``."""
    return F.date_format(_c(d), "EEEE")


def day_of_week(d) -> Column:
    """Weekday number, Sunday = 1 .. Saturday = 7."""
    return F.dayofweek(_c(d)).cast(T.LongType())
