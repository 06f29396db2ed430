"""Data-quality operators: counts, NULL profiles, keys, orphans, ranges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, total_rows), one row per table: UNION ALL of counts."""
    parts = [df.agg(F.count(F.lit(1)).cast(T.LongType()).alias("total_rows"))
             .select(F.lit(name).alias("table_name"), "total_rows")
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def null_profile(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """One row: for each ``{column: output_name}``, how many rows are NULL.

    SUM(CASE WHEN c IS NULL THEN 1 ELSE 0 END): NULL on an empty table."""
    return df.agg(*[F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)).cast(T.LongType()).alias(out)
                    for c, out in columns.items()])


def duplicate_keys(df: DataFrame, keys: Sequence[str], count_name: str = "cnt") -> DataFrame:
    """Key values occurring more than once, with their count."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).cast(T.LongType()).alias(count_name))
            .where(F.col(count_name) > 1))


def orphan_count(child: DataFrame, parent: DataFrame, keys: Sequence[str],
                 name: str = "orphan_rows") -> DataFrame:
    """Rows of ``child`` with no matching ``parent`` row, counted.

    Rows are counted by key before the shuffle, so a key (or NULL) that
    many rows share is one row per task, and the counts of the keys left by
    an anti join are summed. A NULL child key never matches, so it counts
    as an orphan, as in the outer-join form."""
    counted = child.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return (counted.join(parent.select(*keys), list(keys), "left_anti")
            .agg(F.coalesce(F.sum("_rows"), F.lit(0)).cast(T.LongType()).alias(name)))


def date_range(df: DataFrame, col: str) -> DataFrame:
    """(earliest_order, latest_order, total_days)."""
    return df.agg(F.min(col).alias("earliest_order"), F.max(col).alias("latest_order")).select(
        "earliest_order", "latest_order",
        F.datediff("latest_order", "earliest_order").cast(T.LongType()).alias("total_days"))


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct combinations of ``columns``, sorted by them."""
    return df.select(*columns).distinct().orderBy(*columns)


def count_rows_where(df: DataFrame, cond: Column, name: str) -> DataFrame:
    """COUNT(*) of rows satisfying ``cond`` (pushed to the scan when it can be)."""
    return df.where(cond).agg(F.count(F.lit(1)).cast(T.LongType()).alias(name))
