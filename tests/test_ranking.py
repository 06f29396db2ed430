"""Range-partitioned global ranking equals Spark's single-partition windows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.operators import ranking as RK
from ledgerlens.operators.numbering import number_rows, ordered


@pytest.fixture(scope="module")
def skewed(spark):
    """Heavy ties: a third of the rows share one value, plus NULLs."""
    rnd = random.Random(7)
    rows = []
    for i in range(600):
        if i % 3 == 0:
            v = 100          # hot value: a third of all rows
        elif i % 50 == 1:
            v = None
        else:
            v = rnd.randint(0, 40)
        region = None if i % 17 == 0 else ["n", "s", "e", "w"][rnd.randint(0, 3)] if i % 2 else "n"
        rows.append((f"c{i:04d}", region, v))
    return spark.createDataFrame(rows, "name string, region string, v int")


def _cmp(a, b, key, col_a, col_b):
    got = {r[key]: r[col_a] for r in a.collect()}
    want = {r[key]: r[col_b] for r in b.collect()}
    assert got == want


@pytest.mark.parametrize("ascending", [True, False])
def test_row_number_and_ntile(skewed, ascending):
    key = RK.asc("v") if ascending else RK.desc("v")
    order = [key, RK.asc("name")]
    spark_order = [F.asc("v") if ascending else F.desc("v"), F.asc("name")]
    w = Window.orderBy(*spark_order)
    ref = skewed.select("name", F.row_number().over(w).alias("rn"),
                        F.ntile(4).over(w).alias("q4"), F.ntile(7).over(w).alias("q7"))
    _cmp(RK.with_row_number(skewed, order, "rn"), ref, "name", "rn", "rn")
    _cmp(RK.with_ntile(skewed, 4, order, "q4"), ref, "name", "q4", "q4")
    _cmp(RK.with_ntile(skewed, 7, order, "q7"), ref, "name", "q7", "q7")


@pytest.mark.parametrize("tiles", [3, 5])
def test_partitioned_ntile(skewed, tiles):
    ref = skewed.select("name", F.ntile(tiles).over(
        Window.partitionBy("region").orderBy(F.asc("v"), F.asc("name"))).alias("r"))
    got = RK.with_ntile(skewed, tiles, [RK.asc("v"), RK.asc("name")], "r", partition_by=["region"])
    _cmp(got, ref, "name", "r", "r")


def test_ntile_more_tiles_than_rows(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 2)], "name string, v int")
    got = {r["name"]: r["t"] for r in RK.with_ntile(df, 5, [RK.desc("v"), RK.asc("name")], "t").collect()}
    assert got == {"b": 1, "c": 2, "a": 3}


@pytest.mark.parametrize("dense", [False, True])
def test_global_rank(skewed, dense):
    fn = F.dense_rank if dense else F.rank
    ref = skewed.select("name", fn().over(Window.orderBy(F.desc("v"))).alias("r"))
    got = RK.with_rank(skewed, [RK.desc("v")], "r", dense=dense)
    _cmp(got, ref, "name", "r", "r")


@pytest.mark.parametrize("dense", [False, True])
def test_partitioned_rank(skewed, dense):
    fn = F.dense_rank if dense else F.rank
    ref = skewed.select("name", fn().over(Window.partitionBy("region").orderBy(F.desc("v"))).alias("r"))
    got = RK.with_rank(skewed, [RK.desc("v")], "r", partition_by=["region"], dense=dense)
    _cmp(got, ref, "name", "r", "r")


def test_partitioned_row_number(skewed):
    ref = skewed.select("name", F.row_number().over(
        Window.partitionBy("region").orderBy(F.asc("v"), F.asc("name"))).alias("r"))
    got = RK.with_row_number(skewed, [RK.asc("v"), RK.asc("name")], "r", partition_by=["region"])
    _cmp(got, ref, "name", "r", "r")


def test_layout_does_not_matter(skewed):
    order = [RK.desc("v"), RK.asc("name")]
    one = {r["name"]: r["rn"] for r in RK.with_row_number(skewed, order, "rn").collect()}
    for df in (skewed.repartition(5), skewed.coalesce(1)):
        assert one == {r["name"]: r["rn"] for r in RK.with_row_number(df, order, "rn").collect()}


def test_hot_value_is_spread_over_partitions(spark, skewed):
    """The grain splits the rows of one value between partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stored = ordered(skewed, [F.desc("v"), F.asc("name")])
        parts = stored.groupBy("_part").count().collect()
        hot = stored.where("v = 100").select("_part").distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert hot > 1
    assert max(r["count"] for r in parts) < 3 * 600 / len(parts)


def test_ranks_across_partition_borders(spark):
    """Values that span many partitions, groups of one row, all equal."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for rows in ([(f"n{i:03d}", "a", 1) for i in range(90)],
                     [(f"n{i:03d}", str(i), i) for i in range(90)],
                     [(f"n{i:03d}", str(i // 45), i // 30) for i in range(90)]):
            df = spark.createDataFrame(rows, "name string, region string, v int")
            for by in ([], ["region"]):
                w = Window.partitionBy(*by).orderBy(F.desc("v"))
                ref = df.select("name", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("d"))
                for dense, col in ((False, "r"), (True, "d")):
                    got = RK.with_rank(df, [RK.desc("v")], "r", partition_by=by, dense=dense, grain=["name"])
                    _cmp(got, ref, "name", "r", col)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_empty_input(spark):
    df = spark.createDataFrame([], "name string, v int")
    assert RK.with_ntile(df, 4, [RK.desc("v"), RK.asc("name")], "t").count() == 0
    assert RK.with_rank(df, [RK.desc("v")], "r").count() == 0


def test_number_rows(spark):
    df = spark.createDataFrame([(i * 7919 % 101, None if i % 9 == 0 else i) for i in range(100)],
                               "k int, row_index int")
    rows = number_rows(df, ["k"], total="n").orderBy("k").collect()
    assert [r["row_index"] for r in rows] == list(range(100))
    assert {r["n"] for r in rows} == {100}
    assert number_rows(df.limit(0), ["k"]).count() == 0
