"""Running sums, earlier rows and moving frames over inputs that grow.

``ledgerlens.operators.windows`` has the same for inputs of bounded size: a
window without PARTITION BY runs in one task there, and one with it puts
a whole group into one. Here the rows are range-partitioned by group and
order, written once (``numbering.ordered``), and every partition is worked
on alone:

* a running sum adds the sums of the group's earlier partitions, from a
  table with one row per partition and group;
* a row that looks ``n`` rows back finds them in its partition or in its
  *halo*, the last ``n`` rows before the partition, which are carried over
  from the ends of earlier partitions (at most ``n`` rows each).

So neither a long series nor a group that holds a third of all rows lies in
one task. Orders must be total; groups are compared null-safely. An empty
input gives no rows. Jobs run while the result is built (the write).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.columns import MONEY, growth_pct, pct_of
from ledgerlens.operators.numbering import PART, POSITION, ordered
from ledgerlens.operators.ranking import Key
from ledgerlens.operators.windows import share_at_most
from ledgerlens.plans import labels as L

_BEFORE = (Window.unboundedPreceding, -1)


def _stored(df: DataFrame, order: Sequence[Key], by: Sequence[str]) -> DataFrame:
    return ordered(df, [*[F.asc(b) for b in by], *[k.sort_col() for k in order]], "sequence")


def _joined(rows: DataFrame, carried: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows with the carried columns of their partition and group."""
    if not by:
        return rows.join(F.broadcast(carried), PART)  # one row per partition
    side = carried.select(F.col(PART).alias("_at"), *[F.col(b).alias(f"_g{i}") for i, b in enumerate(by)],
                          *[c for c in carried.columns if c not in (PART, *by)])
    on = F.col(PART) == F.col("_at")
    for i, b in enumerate(by):
        on = on & F.col(b).eqNullSafe(F.col(f"_g{i}"))
    return rows.join(side, on).drop("_at", *[f"_g{i}" for i in range(len(by))])


def _running(stored: DataFrame, value: str, by: Sequence[str], name: str) -> DataFrame:
    here = Window.partitionBy(PART, *by).orderBy(POSITION).rowsBetween(*_upto())
    earlier = Window.partitionBy(*by).orderBy(PART).rowsBetween(*_BEFORE)  # a row per partition
    carried = stored.groupBy(PART, *by).agg(F.sum(value).alias("_sum"))
    carried = carried.select(PART, *by, F.sum("_sum").over(earlier).alias("_carried"))
    rows = _joined(stored.withColumn("_local", F.sum(value).over(here)), carried, by)
    # SUM over no values is NULL, so is the sum of two of these
    both = F.coalesce(F.col("_local") + F.col("_carried"), "_local", "_carried")
    return rows.withColumn(name, both).drop("_local", "_carried")


def _upto():
    return Window.unboundedPreceding, Window.currentRow


def running_total(df: DataFrame, value: str, order: Sequence[Key], by: Sequence[str] = (),
                  name: str = "running_total") -> DataFrame:
    """SUM(value) OVER (PARTITION BY by ORDER BY order ROWS UNBOUNDED
    PRECEDING .. CURRENT ROW)."""
    return _running(_stored(df, order, by), value, by, name).drop(PART, POSITION)


def pareto(df: DataFrame, value: str, tiebreak: Sequence[str], threshold: int = L.PARETO_THRESHOLD,
           pct_name: str = "cumulative_pct", group_name: str = "pareto_group",
           top_label: str = L.PARETO_TOP, rest_label: str = L.PARETO_REST) -> DataFrame:
    """As :func:`ledgerlens.operators.windows.pareto`, for any number of rows."""
    stored = _stored(df, [Key(value, False), *[Key(c) for c in tiebreak]], ())
    total = stored.agg(F.sum(value)).scalar()
    rows = _running(stored, value, (), "_cum").withColumn("_tot", total)
    label = F.when(share_at_most("_cum", "_tot", threshold), F.lit(top_label)).otherwise(F.lit(rest_label))
    return rows.withColumn(pct_name, pct_of(F.col("_cum"), F.col("_tot"))).withColumn(
        group_name, label).drop("_cum", "_tot", PART, POSITION)


def _with_halo(stored: DataFrame, n: int) -> DataFrame:
    """``stored`` with the last ``n`` rows before every partition added to it at
    negative positions."""
    parts = stored.groupBy(PART).agg(F.count(F.lit(1)).alias("_n"))
    parts = parts.withColumn("_start", F.coalesce(F.sum("_n").over(
        Window.orderBy(PART).rowsBetween(*_BEFORE)), F.lit(0)))  # one row per partition
    ends = stored.join(F.broadcast(parts), PART).filter(F.col(POSITION) >= F.col("_n") - n)
    ends = ends.withColumn("_index", F.col("_start") + F.col(POSITION)).drop("_n", "_start", PART, POSITION)
    # the row at index i is looked back to from partitions that start at i + 1 to i + n
    starts = parts.select(F.col("_start").alias("_to"), PART)
    halo = ends.withColumn("_to", F.explode(F.sequence(F.col("_index") + 1, F.col("_index") + n))).join(
        F.broadcast(starts), "_to").withColumn(POSITION, F.col("_index") - F.col("_to"))
    return stored.unionByName(halo.drop("_index", "_to"))


def with_previous(df: DataFrame, values: dict[str, str], order: Sequence[Key], by: Sequence[str] = (),
                  n: int = 1) -> DataFrame:
    """LAG(value, n) for each ``{value: output_name}``."""
    rows = _with_halo(_stored(df, order, by), n)
    w = Window.partitionBy(PART, *by).orderBy(POSITION)
    rows = rows.select("*", *[F.lag(v, n).over(w).alias(out) for v, out in values.items()])
    return rows.filter(F.col(POSITION) >= 0).drop(PART, POSITION)


def period_growth(df: DataFrame, value: str, order: Sequence[Key], by: Sequence[str] = (),
                  prev_name: str = "prev", growth_name: str = "growth_pct") -> DataFrame:
    """As :func:`ledgerlens.operators.windows.period_growth`."""
    return with_previous(df, {value: prev_name}, order, by).withColumn(
        growth_name, growth_pct(value, prev_name))


def moving_average(df: DataFrame, value: str, order: Sequence[Key], rows: int = 3,
                   by: Sequence[str] = (), name: str = "moving_avg") -> DataFrame:
    """As :func:`ledgerlens.operators.windows.moving_average`."""
    if rows < 1:
        raise ValueError("a frame has one row at least")
    back = rows - 1
    stored = _stored(df, order, by)
    wide = _with_halo(stored, back) if back else stored
    w = Window.partitionBy(PART, *by).orderBy(POSITION).rowsBetween(-back, Window.currentRow)
    count = F.nullif(F.count(value).over(w).cast(T.DecimalType(20, 0)), F.lit(0).cast(T.DecimalType(20, 0)))
    average: Column = F.round(F.sum(F.col(value).cast(MONEY)).over(w) / count, 2).cast(MONEY)
    return wide.withColumn(name, average).filter(F.col(POSITION) >= 0).drop(PART, POSITION)
