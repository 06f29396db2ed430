"""Exact global ranking without a single-partition window.

``ROW_NUMBER/NTILE/RANK/DENSE_RANK() OVER (ORDER BY ...)`` without
PARTITION BY makes Spark move every row into one task. Here, for every
size of input:

1. The rows are range-partitioned by (partition keys, order, grain),
   sorted inside each partition, and written once with the number of the
   partition and the position in it (``numbering.ordered``). The grain
   makes the order total, so rows that share one value are spread.
2. Inside each partition a window tells where a new group or a new value
   begins; the last row before a partition comes from a table with one
   row per partition.
3. Counts, value changes and begins of groups are summed over earlier
   partitions in that table and added to the local numbers.

Nothing is sampled to the driver or looked up per row, and no step joins
on the ranked value.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.operators.numbering import PART, POSITION, ordered


@dataclass(frozen=True)
class Key:
    """One sort key: column name and direction (Spark default null order:
    NULLS FIRST ascending, NULLS LAST descending)."""
    name: str
    ascending: bool = True

    def sort_col(self) -> Column:
        return F.asc(self.name) if self.ascending else F.desc(self.name)


def asc(name: str) -> Key:
    return Key(name, True)


def desc(name: str) -> Key:
    return Key(name, False)


_WORK = ("_rn", "_rank", "_dense", "_all")


def numbered(df: DataFrame, order: Sequence[Key], partition_by: Sequence[str] = (),
             values: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``_rn``, ``_rank``, ``_dense`` and ``_all`` (long): the
    row number in its group, RANK and DENSE_RANK by the columns ``values``,
    and the number of rows of all groups.

    ``order`` should be total (end it with the grain key); ``values`` are
    the leading columns of ``order`` that are ranked."""
    stored = ordered(df, [*[F.asc(p) for p in partition_by], *[k.sort_col() for k in order]],
                     label="ranking")
    group = F.struct(F.lit(0).alias("g"), *[F.col(p).alias(f"g{i}") for i, p in enumerate(partition_by)])
    value = F.struct(F.lit(0).alias("v"), *[F.col(v).alias(f"v{i}") for i, v in enumerate(values)])
    rows = stored.withColumn("_group", group).withColumn("_value", value)
    # one row per partition from here to the carried columns
    parts = Window.orderBy(PART)
    earlier = parts.rowsBetween(Window.unboundedPreceding, -1)
    tails = rows.groupBy(PART).agg(
        F.max_by(F.struct("_group", "_value"), POSITION).alias("last"), F.count(F.lit(1)).alias("rows"))
    tails = tails.select(PART, F.lag("last").over(parts).alias("_before"),
                         F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("_offset"),
                         F.sum("rows").over(parts.rowsBetween(
                             Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"))
    here = Window.partitionBy(PART).orderBy(POSITION)
    seen = F.coalesce(F.lag(F.struct("_group", "_value")).over(here), F.col("_before"))
    rows = rows.join(F.broadcast(tails), PART).withColumn("_seen", seen)
    rows = rows.withColumn("_new_group", F.col("_seen").isNull()
                           | ~F.col("_seen._group").eqNullSafe(F.col("_group")))
    rows = rows.withColumn("_new", F.col("_new_group")
                           | ~F.col("_seen._value").eqNullSafe(F.col("_value")))
    upto = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    index = F.col("_offset") + F.col(POSITION)
    rows = rows.withColumn("_index", index).withColumn(
        "_changes", F.sum(F.col("_new").cast("long")).over(upto))
    marks = {"_begin": F.when(F.col("_new"), F.col("_index")),
             "_first": F.when(F.col("_new_group"), F.col("_index")),
             "_base": F.when(F.col("_new_group"), F.col("_changes"))}
    rows = rows.withColumns(marks)
    carried = rows.groupBy(PART).agg(
        F.max("_changes").alias("changes"), F.max("_begin").alias("begin"),
        F.max("_first").alias("first"), F.max("_base").alias("base"))
    carried = carried.withColumn("_c0", F.coalesce(F.sum("changes").over(earlier), F.lit(0)))
    carried = carried.select(
        PART, "_c0", F.max("begin").over(earlier).alias("_begin0"),
        F.max("first").over(earlier).alias("_first0"),
        F.max(F.col("base") + F.col("_c0")).over(earlier).alias("_base0"))
    rows = rows.join(F.broadcast(carried), PART)
    first = F.coalesce(F.max("_first").over(upto), F.col("_first0"))
    begin = F.coalesce(F.max("_begin").over(upto), F.col("_begin0"))
    base = F.coalesce(F.max(F.col("_base") + F.col("_c0")).over(upto), F.col("_base0"))
    return rows.select(
        *[f"`{c}`" for c in df.columns], (F.col("_index") - first + 1).alias("_rn"),
        (begin - first + 1).alias("_rank"),
        (F.col("_changes") + F.col("_c0") - base + 1).alias("_dense"), "_all")


def with_row_number(df: DataFrame, order: Sequence[Key], name: str = "row_number",
                    partition_by: Sequence[str] = ()) -> DataFrame:
    """ROW_NUMBER() OVER (PARTITION BY partition_by ORDER BY order)."""
    x = numbered(df, order, partition_by)
    return x.withColumn(name, F.col("_rn")).drop(*_WORK)


def with_ntile(df: DataFrame, k: int, order: Sequence[Key], name: str = "ntile",
               partition_by: Sequence[str] = ()) -> DataFrame:
    """NTILE(k) OVER (PARTITION BY partition_by ORDER BY order).

    With N rows, q = N div k and r = N mod k, the first r tiles hold
    q + 1 rows and the rest q, as in SQL."""
    x = numbered(df, order, partition_by)
    if partition_by:
        sizes = x.groupBy(*[F.col(p).alias(f"_p{i}") for i, p in enumerate(partition_by)]).agg(
            F.max("_rn").alias("_n"))
        x = x.join(sizes, [F.col(p).eqNullSafe(F.col(f"_p{i}")) for i, p in enumerate(partition_by)])
    else:
        x = x.withColumn("_n", F.col("_all"))
    x = x.withColumn("_q", F.expr(f"_n div {int(k)}")).withColumn("_r", F.expr(f"_n % {int(k)}"))
    tile = F.expr("CASE WHEN _rn <= _r * (_q + 1) THEN (_rn + _q) div (_q + 1) "
                  "ELSE _r + (_rn - _r * (_q + 1) + _q - 1) div _q END")
    return x.withColumn(name, tile.cast(T.LongType())).select(
        *[f"`{c}`" for c in df.columns if c != name], name)


def with_rank(df: DataFrame, order: Sequence[Key], name: str = "rank",
              partition_by: Sequence[str] = (), dense: bool = False,
              grain: Sequence[str] = ()) -> DataFrame:
    """RANK() (or DENSE_RANK()) OVER (PARTITION BY partition_by ORDER BY order).

    ``grain`` breaks ties in the layout only: with it, rows that share one
    value are spread over tasks."""
    x = numbered(df, [*order, *[asc(g) for g in grain]], partition_by, [k.name for k in order])
    return x.withColumn(name, F.col("_dense" if dense else "_rank")).drop(*_WORK)


def with_overall_and_group_rank(stored: DataFrame, value: Key, group: str, overall: str,
                                within: str) -> DataFrame:
    """RANK() over all rows and DENSE_RANK() inside each ``group``, both by
    ``value``, from one ordered table.

    ``stored`` is :func:`ledgerlens.operators.numbering.ordered` by ``value``
    and the grain, so a value or a group may span many partitions. Both ranks
    are ranks inside the partition plus what is carried over from earlier
    ones: rows and where a value that goes on began, from a table with one
    row per partition; distinct values of the group, less those that go on,
    from a table with one row per partition and group. Nothing is ordered
    by group, and no step joins on the ranked value."""
    by = value.sort_col()
    here = Window.partitionBy(PART).orderBy(by)
    rows = stored.withColumn("_rank", F.rank().over(here)).withColumn(
        "_dense", F.dense_rank().over(Window.partitionBy(PART, group).orderBy(by)))
    v = F.struct(F.lit(0).alias("_"), F.col(value.name).alias("v"))  # never null itself
    parts = Window.orderBy(PART)  # one row per partition
    earlier = parts.rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(PART).agg(F.min_by(v, POSITION).alias("top"), F.max_by(v, POSITION).alias("end"),
                                  F.max("_rank").alias("last"), F.count(F.lit(1)).alias("rows"))
    ends = ends.withColumn("_offset", F.coalesce(F.sum("rows").over(earlier), F.lit(0))).withColumn(
        "_goes_on", F.coalesce(F.col("top").eqNullSafe(F.lag("end").over(parts)), F.lit(False)))
    begun = F.when(~F.col("_goes_on") | (F.col("last") > 1), F.col("_offset") + F.col("last"))
    ends = ends.withColumn("_begun", begun).select(
        PART, "_offset", F.when(F.col("_goes_on"), F.max("_begun").over(earlier)).alias("_began"))
    per_group = Window.partitionBy(group).orderBy(PART)  # as many rows as partitions
    shares = rows.groupBy(PART, group).agg(
        F.min_by(v, POSITION).alias("top"), F.max_by(v, POSITION).alias("end"),
        F.max("_dense").alias("values"))
    again = F.coalesce(F.col("top").eqNullSafe(F.lag("end").over(per_group)), F.lit(False)).cast("long")
    shares = shares.withColumn("_again", again).select(
        F.col(PART).alias("_at"), F.col(group).alias("_group"),
        (F.coalesce(F.sum("values").over(per_group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
         - F.sum("_again").over(per_group.rowsBetween(Window.unboundedPreceding, Window.currentRow))
         ).alias("_carried"))
    rows = rows.join(F.broadcast(ends), PART)
    rows = rows.join(shares, (F.col(PART) == F.col("_at")) & F.col(group).eqNullSafe(F.col("_group")))
    kept = [f"`{c}`" for c in stored.columns if c not in (PART, POSITION)]
    first = F.col("_rank") == 1
    return rows.select(
        *kept, F.when(first & F.col("_began").isNotNull(), F.col("_began"))
        .otherwise(F.col("_offset") + F.col("_rank")).alias(overall),
        (F.col("_dense") + F.col("_carried")).alias(within))
