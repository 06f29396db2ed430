"""Exact top-k search against plain Python integers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import topk as T
from ledgerlens.llm.queries import ORACLE_SQL, op11_topk_search
from ledgerlens.plans.compare import compare, duckdb_connection

KIND = "vec_id long, embedding array<float>"


def whole(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def brute(rows, every=50, k=5, by_distance=False):
    x = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if whole(v)]
    out = []
    for at, (qi, q) in enumerate(x):
        if qi is None or qi % every:
            continue
        scored = []
        for other, (vi, v) in enumerate(x):
            if other != at and len(v) == len(q):
                s = -sum((a - b) ** 2 for a, b in zip(q, v)) if by_distance else sum(
                    a * b for a, b in zip(q, v))
                scored.append((-s, vi is None, vi or 0, vi))
        for rank, (s, _, _, vi) in enumerate(sorted(scored)[:k], 1):
            out.append((qi, rank, vi, -s))
    return sorted(out, key=str)


def have(df):
    return sorted(((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect()), key=str)


def vectors(seed, n, dim, noise=0.3, centres=4):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((centres, dim))
    x = base[rng.integers(0, centres, n)] + noise * rng.standard_normal((n, dim))
    return [(int(i), v) for i, v in zip(rng.permutation(n), x.astype(np.float32).tolist())]


@pytest.mark.parametrize("by_distance", [False, True])
@pytest.mark.parametrize("dim", [1, 6, 32])
def test_equals_brute_force(spark, dim, by_distance):
    rows = vectors(dim, 300, dim)
    df = spark.createDataFrame(rows, KIND).repartition(5)
    # stripes of 16 rows: many blocks and stripes
    found = T.exact_top_k(df, "vec_id % 20 = 0", by_distance=by_distance, cells=16 * dim)
    assert have(found) == brute(rows, 20, by_distance=by_distance)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (50, None), (100, [nan, 1.0]), (150, [inf, 1.0]), (200, [None, 1.0]),
            (250, []), (300, []), (1, [1.0, 2.0]), (2, [-1.0, 0.5]), (3, [0.5]), (350, [0.25]),
            (None, [1.0, 2.0]), (None, [3.0, 2.0]), (50, [1.0, 2.0]), (50, [1.0, 2.0]), (-50, [0.0, 0.0]),
            (4, [-0.001, 0.0])]
    found = T.exact_top_k(spark.createDataFrame(rows, KIND), "vec_id % 50 = 0")
    assert have(found) == brute(rows)


def test_a_third_equal_vectors(spark):
    """Copies tie with each other; each query leaves out only itself."""
    rows = vectors(7, 200, 8)
    rows = [(i, rows[0][1] if at % 3 == 0 else v) for at, (i, v) in enumerate(rows)]
    found = T.exact_top_k(spark.createDataFrame(rows, KIND), "vec_id % 10 = 0", cells=16 * 8)
    assert have(found) == brute(rows, 10)


def test_few_rows_no_queries_and_no_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])]
    df = spark.createDataFrame(rows, KIND)
    assert have(T.exact_top_k(df, "vec_id % 50 = 0")) == brute(rows)
    assert have(T.exact_top_k(df, "vec_id = 77")) == []
    assert have(T.exact_top_k(df.limit(0), "vec_id % 50 = 0")) == []


def test_clashing_columns_are_left_alone(spark):
    rows = vectors(3, 60, 4)
    df = spark.createDataFrame(rows, KIND).selectExpr(
        "*", "1 as row", "'x' as score", "2 as d", "3 as stripe", "4 as asks", "5 as nth", "6 as v")
    assert have(T.exact_top_k(df, "vec_id % 50 = 0")) == brute(rows)


def test_too_large_components_are_an_error(spark):
    df = spark.createDataFrame([(0, [1e30]), (1, [2.0])], KIND)
    with pytest.raises(Exception, match="too large"):
        T.exact_top_k(df, "vec_id % 50 = 0").collect()


def test_bounds_hold_and_tighten():
    """The lower bounds never exceed the distance, and grow with the segments."""
    x = np.random.default_rng(1).integers(-300, 300, (40, 21))
    real = ((x[:, None] - x[None]) ** 2).sum(2)
    before = np.zeros_like(real, dtype=float)
    for count in (1, 3, 21):  # each a refinement of the one before
        f = T.features(x, count)
        lower = ((f[:, None] - f[None]) ** 2).sum(2)
        assert (lower <= real + 1e-6).all() and (lower >= before - 1e-6).all()
        before = lower
    assert np.allclose(before, real)


def test_search_prunes_but_keeps_every_answer():
    """Thresholds leave out pairs without changing the best rows."""
    rng = np.random.default_rng(2)
    v = rng.integers(-200, 200, (500, 16))
    ids = np.arange(500)
    q = v[:40]
    score = q @ v.T
    floor = np.sort(score, axis=1)[:, -5].astype(float)
    i, j, s = T.search(q, v, ids, 5, floor)
    for a in range(40):
        want = sorted((-score[a, b], b) for b in range(500))[:5]
        assert sorted(zip(-s[i == a], j[i == a])) == want


def test_products_of_all_pairs_and_of_single_ones_agree(monkeypatch):
    rng = np.random.default_rng(3)
    for high in (300, 2 ** 27):  # the second leaves the exact range of doubles
        v = rng.integers(-high, high, (200, 5))
        floor = np.full(20, -np.inf)
        assert (T._table(v[:20], v) == np.array([[sum(int(x) * int(y) for x, y in zip(a, b)) for b in v]
                                                 for a in v[:20]])).all()
        found = []
        for share in (0.0, 2.0):  # always, never all pairs
            monkeypatch.setattr(T, "DENSE", share)
            found.append(sorted(zip(*(x.tolist() for x in T.search(v[:20], v, np.arange(200), 4, floor)))))
        assert found[0] == found[1] and len(found[0]) == 80


def test_query_matches_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    df = op11_topk_search(spark, sf_dir)
    assert compare("op11_topk_search", df, duckdb_connection(sf_dir), ORACLE_SQL["op11_topk_search"]).ok
    kinds = dict(df.dtypes)
    assert kinds == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}


def test_only_reachable_stripes_are_shipped(spark):
    """Two far clusters: queries of one do not meet the stripes of the other."""
    rows = [(i, [100.0 + i % 7, 1.0] if i < 64 else [-100.0 - i % 7, 1.0]) for i in range(128)]
    df = spark.createDataFrame([(0, 2, [0.0, 0.0], [1.0, 1.0], 0, 4, 3.0)],
                               "block long, d int, low array<double>, high array<double>, "
                               "least long, most long, floor double")
    stripes = spark.createDataFrame(
        [(0, 2, [0.0, 0.0], [1.0, 1.0], 0, 4), (1, 2, [-9.0, 0.0], [-8.0, 1.0], 64, 82),
         (2, 3, [0.0], [1.0], 0, 4)],
        "stripe long, d int, low array<double>, high array<double>, least long, most long")
    assert [tuple(r) for r in T._reachable(df, stripes, False).collect()] == [(0, 0)]
    found = T.exact_top_k(spark.createDataFrame(rows, KIND), "vec_id % 50 = 0", cells=32)
    assert have(found) == brute(rows)
    assert found.filter(F.col("query_id") == 0).filter("vec_id >= 64").count() == 0
