"""Consecutive global row numbers without a single-task sort.

The rows are range-partitioned by the ordering keys, sorted inside each
partition and written once; a row's position inside its partition is
part of what is written. The number of a row is its position plus the
row count of all earlier partitions, one small row per partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.operators.materialize import materialize

# monotonically_increasing_id() keeps the partition in the bits above
# these and the position inside the partition in these
_POSITION_BITS = 33
PART, POSITION = "_part", "_position"


def ordered(df: DataFrame, keys: list[Column | str], label: str = "ordered") -> DataFrame:
    """``df`` written once in the order of ``keys``, with the number of the
    row's partition (``_part``) and its position in it (``_position``).
    Partitions follow each other in the order of the keys."""
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    stored = materialize(placed.withColumn(POSITION, F.monotonically_increasing_id()), label)
    return stored.withColumn(PART, F.shiftright(POSITION, _POSITION_BITS)).withColumn(
        POSITION, F.col(POSITION).bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)))


def number_rows(df: DataFrame, keys: list[Column | str], number: str = "row_index",
                total: str | None = None, label: str = "numbered") -> DataFrame:
    """``df`` with ``number``: 0, 1, 2, ... in the order of ``keys``
    (nulls first, as Spark sorts), and with the row count in ``total``
    when that is named.

    The keys should order the rows totally; rows with equal keys get
    consecutive numbers in an unspecified order. Equal keys are not split
    between partitions, so a key that repeats without bound needs a
    further key. An empty input gives an empty result.
    """
    stored = ordered(df, keys, label)
    # one row per partition of the write: bounded by the partition count
    counts = stored.groupBy(PART).agg((F.max(POSITION) + 1).alias("n"))
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding,
                                                  Window.unboundedFollowing)
    offsets = counts.select(
        PART, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"),
        *([F.sum("n").over(everything).alias(total)] if total else []))
    kept = [f"`{c}`" for c in df.columns if c not in (number, total)]
    return stored.join(F.broadcast(offsets), PART).select(
        *kept, (F.col("_offset") + F.col(POSITION)).alias(number), *([total] if total else []))
