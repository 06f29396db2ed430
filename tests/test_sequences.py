"""Running sums, lags and frames against Spark's own windows."""

import random
from decimal import Decimal as D

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.operators import sequences as S
from ledgerlens.operators import windows as W
from ledgerlens.operators.ranking import asc, desc
from ledgerlens.plans import fine_grain as FG
from ledgerlens.plans.compare import compare, duckdb_connection
from ledgerlens.sources.staging import staged_tables

SF = "/root/testdata/sf0.01"


def series(spark, n, seed=1, groups=("a", "b", None)):
    """A third of all rows in the first group; NULL values among them."""
    rng = random.Random(seed)
    rows = [(groups[0] if i % 3 == 0 else rng.choice(groups), i,
             None if rng.random() < .2 else D(rng.randrange(-900, 900)) / 100) for i in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "g string, at int, v decimal(20,2)").repartition(5)


def same(a, b):
    cols = sorted(b.columns)
    return sorted(map(str, a.select(cols).collect())) == sorted(map(str, b.select(cols).collect()))


@pytest.mark.parametrize("n", [0, 1, 3, 40, 300])
@pytest.mark.parametrize("by", [(), ("g",)])
def test_running_total(spark, n, by):
    df = series(spark, n)
    assert same(S.running_total(df, "v", [asc("at")], by), W.running_total(df, "v", ["at"], by))
    assert same(S.running_total(df, "v", [desc("at")], by), W.running_total(df, "v", [F.desc("at")], by))


@pytest.mark.parametrize("n,rows", [(0, 3), (2, 3), (40, 1), (40, 2), (300, 7), (30, 60)])
@pytest.mark.parametrize("by", [(), ("g",)])
def test_moving_average(spark, n, rows, by):
    """Frames wider than a partition reach over several."""
    df = series(spark, n)
    assert same(S.moving_average(df, "v", [asc("at")], rows, by), W.moving_average(df, "v", ["at"], rows, by))


@pytest.mark.parametrize("back", [1, 2, 25])
@pytest.mark.parametrize("by", [(), ("g",)])
def test_previous_rows(spark, back, by):
    df = series(spark, 60, seed=2)
    got = S.with_previous(df, {"v": "p", "at": "q"}, [asc("at")], by, back)
    w = Window.partitionBy(*by).orderBy("at")
    assert same(got, df.select("*", F.lag("v", back).over(w).alias("p"), F.lag("at", back).over(w).alias("q")))


def test_growth(spark):
    df = series(spark, 50, seed=3)
    assert same(S.period_growth(df, "v", [asc("at")], ["g"]), W.period_growth(df, "v", ["at"], ["g"]))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_pareto(spark, seed):
    df = series(spark, 200, seed).where("v is not null")
    assert same(S.pareto(df, "v", ["at"]), W.pareto(df, "v", ["at"]))


def test_many_small_partitions(spark):
    """Partitions with fewer rows than the frame, some empty."""
    df = series(spark, 11, seed=4)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert same(S.moving_average(df, "v", [asc("at")], 5), W.moving_average(df, "v", ["at"], 5))
        assert same(S.running_total(df, "v", [asc("at")]), W.running_total(df, "v", ["at"]))
        got = S.with_previous(df, {"at": "q"}, [asc("at")], n=4)
        assert same(got, df.withColumn("q", F.lag("at", 4).over(Window.orderBy("at"))))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_no_row_goes_to_a_single_partition(spark):
    """Windows over one task only see a row per partition."""
    df = series(spark, 50)
    for out in (S.pareto(df, "v", ["at"]), S.moving_average(df, "v", [asc("at")], 3),
                S.with_previous(df, {"v": "p"}, [asc("at")])):
        plan = out._jdf.queryExecution().executedPlan().toString()
        for block in plan.split("Exchange SinglePartition")[1:]:
            below = block.split("\n")[1]
            assert "HashAggregate" in below, below


@pytest.mark.parametrize("name", list(FG.REPORTS))
def test_reports_match_sql(spark, name):
    outcome = compare(name, FG.REPORTS[name](staged_tables(spark, SF)), duckdb_connection(SF), FG.SQL[name])
    assert outcome.ok and outcome.types_match, outcome.detail
