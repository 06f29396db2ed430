"""Selected NTILE boundaries against Spark's own window function."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.operators import selection as S
from ledgerlens.operators.ranking import asc, desc


def expected(df, scores, k):
    for name, order in scores.items():
        df = df.withColumn(name, F.ntile(k).over(Window.orderBy(*[o.sort_col() for o in order])))
    return df


def same(df, scores, k):
    got = S.with_tiles(df, scores, k)
    cols = sorted(got.columns)
    return sorted(map(str, got.select(cols).collect())) == sorted(
        map(str, expected(df, scores, k).select(cols).collect()))


@pytest.fixture(params=[(1024, 512), (4, 2), (2, 1)], ids=["production", "small", "least"])
def sizes(request, monkeypatch):
    monkeypatch.setattr(S, "BINS", request.param[0])
    monkeypatch.setattr(S, "FEW", request.param[1])


def people(seed, n, ties=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        money = Decimal(rng.choice([5, rng.randrange(-10 ** 6, 10 ** 6) ** (1 + i % 2)])) / 100
        name = rng.choice(["", "a", "ab", "Customer#0000", "straße", "\U0001f600"]) + str(rng.randrange(n // ties + 1))
        rows.append((name + f"/{i}" if i % 3 else f"{i}", rng.randrange(4) if rng.random() < .9 else None,
                     money if rng.random() < .9 else None, f"2020-01-{rng.randrange(1, 29):02d}"))
    rng.shuffle(rows)
    return rows


KIND = "name string, n int, money decimal(20,2), day string"


@pytest.mark.parametrize("seed,n,k", [(1, 101, 4), (2, 57, 7), (3, 400, 4)])
def test_equals_ntile(spark, sizes, seed, n, k):
    df = spark.createDataFrame(people(seed, n), KIND).withColumn("day", F.to_date("day")).repartition(4)
    assert same(df, {"a": [asc("n"), asc("name")], "b": [desc("money"), asc("name")],
                     "c": [asc("day"), asc("name")], "d": [desc("n"), asc("money"), asc("name")]}, k)


def test_one_value_holds_a_third(spark, sizes):
    rows = [(f"c{i:04d}", 7 if i % 3 == 0 else i, None, None) for i in range(300)]
    df = spark.createDataFrame(rows, KIND)
    assert same(df, {"a": [desc("n"), asc("name")], "b": [asc("n"), asc("name")]}, 4)


def test_grain_of_several_columns_with_nulls(spark, sizes):
    rows = [(a, 1, None, b) for a in ["x", "xy", None, ""] for b in ["p", None, "pq", "\x00"]]
    df = spark.createDataFrame(rows, KIND)
    assert same(df, {"a": [asc("n"), asc("name"), asc("day")]}, 5)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5])
def test_few_rows(spark, sizes, n):
    df = spark.createDataFrame(people(n + 1, n), KIND)
    assert same(df, {"a": [desc("money"), asc("name")]}, 4)


def test_text_without_case(spark, sizes):
    df = spark.createDataFrame([(f"{c}{i}", i % 2, None, None) for i in range(20) for c in "aB"], KIND)
    df = df.withColumn("name", F.collate("name", "UTF8_LCASE"))
    assert same(df, {"a": [asc("n"), asc("name")]}, 3)


def test_wide_numbers(spark, sizes):
    """Bounds far apart, most rows close together."""
    rows = [(f"c{i}", None, Decimal(i) / 100 if i % 50 else Decimal(10 ** 17 + i), None) for i in range(500)]
    assert same(spark.createDataFrame(rows, KIND), {"a": [desc("money"), asc("name")]}, 4)


def test_unsupported_orders_are_refused(spark):
    df = spark.createDataFrame([("a", 1, None, "d")], KIND)
    with pytest.raises(TypeError, match="ascending"):
        S.with_tiles(df, {"a": [desc("name")]}, 4)
    with pytest.raises(TypeError, match="double"):
        S.with_tiles(df.withColumn("x", F.lit(1.5)), {"a": [asc("x")]}, 4)


def test_neither_sort_nor_exchange_per_score(spark):
    df = spark.createDataFrame(people(5, 200), KIND)
    out = S.with_tiles(df, {"a": [asc("n"), asc("name")], "b": [desc("money"), asc("name")]}, 4)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange" not in plan and "Window" not in plan
    assert plan.count("FileScan") == 1
