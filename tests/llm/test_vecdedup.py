"""Vector dedup against all pairs in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import vecdedup as V
from ledgerlens.llm.queries import op7_vector_dedup

KIND = "vec_id long, embedding array<float>"


def brute(rows, cosine=0.95):
    """{row number: (id, n_links, component, kept)}"""
    n = len(rows)
    x = []
    for _, v in rows:
        ok = v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)
        x.append(np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok else None)
    parent, links = list(range(n)), [0] * n

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if x[i] is not None and x[j] is not None and len(x[i]) == len(x[j]) and \
                    (rows[i][1] == rows[j][1] or x[i] @ x[j] >= cosine):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    out = []
    for i, (d, _) in enumerate(rows):
        c = least.get(find(i)) if x[i] is not None else d
        out.append((d, links[i], c, d == c))
    return sorted(out, key=str)


def have(df):
    return sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in df.collect()), key=str)


def groups(seed, sizes, dim=32, noise=0.03):
    rng = np.random.default_rng(seed)
    rows = []
    for size in sizes:
        base = rng.standard_normal(dim)
        base /= np.linalg.norm(base)
        rows += [(base + noise * rng.standard_normal(dim)).astype(np.float32).tolist() for _ in range(size)]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_all_pairs(spark, seed, monkeypatch):
    """Groups larger than window and tile, pairs, single vectors."""
    monkeypatch.setattr(V, "TILE", 16)
    monkeypatch.setattr(V, "BLOCK", 64)
    rows = groups(seed, [90, 40, 2, 2, 3] + [1] * 200)
    assert have(V.near_duplicate_vectors(spark.createDataFrame(rows, KIND))) == brute(rows)


def crowd(seed, n, size, pairs, dim=64):
    """``size`` of the rows at mutual cosine 0.9, with planted pairs at 0.955."""
    rng = np.random.default_rng(seed)

    def units(k):
        x = rng.standard_normal((k, dim))
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def beside(x, cosine):
        y = units(len(x))
        y -= (y * x).sum(axis=1, keepdims=True) * x
        return cosine * x + np.sqrt(1 - cosine ** 2) * y / np.linalg.norm(y, axis=1, keepdims=True)

    near = beside(np.repeat(units(1), size - pairs, axis=0), np.sqrt(0.9))
    x = np.concatenate([near, beside(near[:pairs], 0.955), units(n - size)])
    return list(enumerate(x[rng.permutation(n)].tolist()))


@pytest.mark.parametrize("n, size, neighbours", [(2400, 800, 16), (700, 700, 4)])
def test_crowd_matches_all_pairs(spark, monkeypatch, n, size, neighbours):
    """Many different vectors just below the threshold hide no links; if all
    are in the crowd, all pairs are compared."""
    monkeypatch.setattr(V, "TILE", 128)
    rows = crowd(5, n, size, 150)
    x = np.array([v for _, v in rows])
    linked = x @ x.T >= 0.95
    least = np.arange(n)
    for _ in range(n):
        following = np.where(linked, least, n).min(axis=1)
        if (following == least).all():
            break
        least = following
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in V.near_duplicate_vectors(df, neighbours=neighbours).collect()}
    assert [got[i]["component_id"] for i in range(n)] == least.tolist()
    assert [got[i]["n_links"] for i in range(n)] == (linked.sum(axis=1) - 1).tolist()
    assert [got[i]["kept"] for i in range(n)] == (least == np.arange(n)).tolist()


@pytest.mark.parametrize("seed", range(3))
def test_tile_links_keep_the_components(seed):
    import pyarrow as pa
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((60, 3))
    tile = np.arange(60) // 30 if seed else np.zeros(60, int)
    table = pa.table({"node": [f"{i:02}" for i in range(60)], "tile": tile,
                      "vector": pa.array(x.tolist())})
    out = V._tile_links(0.95)(table).to_pylist()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want, have_parts = list(range(60)), list(range(60))

    def unite(parts, i, j):
        a, b = parts[i], parts[j]
        parts[:] = [min(a, b) if p in (a, b) else p for p in parts]

    for i, j in np.argwhere(unit @ unit.T >= 0.95):
        if not seed or tile[i] != tile[j]:
            unite(want, i, j)
    for r in out:
        unite(have_parts, int(r["a"]), int(r["b"]))
    assert have_parts == want and len(out) == 60 - len(set(want))


def test_edges(spark):
    a, b = [1.0, 0.0, 0.0], [0.96, 0.28, 0.0]
    rows = [(1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [1.0, None, 0.0]), (5, [float("nan"), 1.0, 0.0]),
            (6, [float("inf"), 1.0, 0.0]), (7, a), (8, a), (8, a), (9, b), (None, b), (10, [1e-20, 0.0, 0.0]),
            (11, [3e38, 0.0, 0.0]), (12, [1.0, 0.0]), (13, [0.0, -1.0, 0.0]), (None, [0.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, KIND).withColumn("node", F.lit("x")).withColumn("kept", F.lit(0))
    assert have(V.near_duplicate_vectors(df)) == brute(rows)


def test_threshold_is_in_double_precision(spark):
    kind = "vec_id long, embedding array<double>"
    for c, linked in ((0.95 + 1e-12, True), (0.95 - 1e-12, False)):
        df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [c, float(np.sqrt(1 - c * c))])], kind)
        assert [r["n_links"] for r in V.near_duplicate_vectors(df).collect()] == [int(linked)] * 2


def test_no_rows(spark):
    assert V.near_duplicate_vectors(spark.createDataFrame([], KIND)).count() == 0
    assert have(V.near_duplicate_vectors(spark.createDataFrame([(1, None)], KIND))) == [(1, 0, 1, True)]


def test_passes_grow_slowly():
    assert [V.passes_needed(n) for n in (1, 10_000, 10**6, 10**9)] == sorted(
        V.passes_needed(n) for n in (1, 10_000, 10**6, 10**9))
    assert V.passes_needed(10**9) < 200


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_query_finds_all_pairs(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in
            spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.95
    want = linked.sum() - len(x)
    got = op7_vector_dedup(spark, f"/root/testdata/{sf}").collect()
    assert len(got) == len(rows)
    assert sum(r["n_links"] for r in got) >= 0.99 * want
    per = dict(zip([d for d, _ in rows], linked.sum(axis=1) - 1))
    assert all(r["n_links"] <= per[r["vec_id"]] for r in got)
