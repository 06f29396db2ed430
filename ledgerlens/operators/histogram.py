"""Text histogram: a count per group with a bar of repeated marks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


# the longest bar that a string can hold
LONGEST_BAR = (1 << 31) - 64


def text_bar(count: Column, mark: str, unit: int = 1, unit_name: str = "unit") -> Column:
    """``mark`` repeated once per ``unit`` counted (rounded down). A bar
    that no string can hold is an error that names the parameter."""
    marks = F.call_function("div", count.cast(T.LongType()), F.lit(unit).cast(T.LongType()))
    message = F.concat(F.lit("a bar of "), marks.cast("string"),
                       F.lit(f" marks is too long for a string; raise {unit_name}"))
    return F.when(marks <= LONGEST_BAR // len(mark.encode()), F.repeat(
        F.lit(mark), F.least(marks, F.lit(LONGEST_BAR)).cast(T.IntegerType()))).otherwise(
        F.raise_error(message).cast("string"))


def text_histogram(df: DataFrame, by: Sequence[Column | str], count: Column, mark: str,
                   count_name: str = "count", bar_name: str = "histogram",
                   unit: int = 1, unit_name: str = "unit") -> DataFrame:
    """GROUP BY ``by``: the ``count`` aggregate and its text bar.

    The bar of a group is built from that group's count only, after the
    aggregation, so no group's rows are ever gathered."""
    agg = df.groupBy(*by).agg(count.cast(T.LongType()).alias(count_name))
    return agg.withColumn(bar_name, text_bar(F.col(count_name), mark, unit, unit_name))
