"""Vector codes against full comparisons in plain Python integers."""

import hashlib
import math

import numpy as np
import pytest

from ledgerlens.llm import veccodes as V
from ledgerlens.llm.queries import ORACLE_SQL, op13_vector_codes
from ledgerlens.plans.compare import compare, duckdb_connection

KIND = "vec_id long, embedding array<float>, label int"


def whole(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def brute(rows, parts=16, entries=64, rounds=2):
    """Rows (vec_id, code, error, label_error, digest): full rescans."""
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v], label)
            for i, v, label in rows if whole(v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    length = len(kept[0][1])
    fit = [r for r in kept if len(r[1]) == length]
    cut = [length * i // parts for i in range(parts + 1)]

    def part(v, p):
        return v[cut[p]:cut[p + 1]]

    start = [r for r in kept[:entries] if len(r[1]) == length]
    books = [[list(part(r[1], p)) for r in start] for p in range(parts)]

    def near(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(part(v, p), e)), n) for n, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            own = [near(r[1], p)[1] for r in fit]
            new = list(books[p])
            for n in range(len(new)):
                mine = [part(r[1], p) for r, o in zip(fit, own) if o == n]
                if mine:
                    new[n] = [sum(c) // len(mine) for c in zip(*mine)]
            books[p] = new
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out, by_label = [], {}
    for i, v, label in kept:
        code = error = None
        if len(v) == length:
            best = [near(v, p) for p in range(parts)]
            code, error = "".join(f"{n:02x}" for _, n in best), sum(d for d, _ in best)
            by_label[label] = by_label.get(label, 0) + error
        out.append((i, code, error, label))
    return sorted([(i, c, e, by_label.get(label), digest) for i, c, e, label in out], key=str)


def have(df):
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"])
                   for r in df.collect()), key=str)


def vectors(seed, n, dim, centres=5, noise=0.2):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((centres, dim))
    x = base[rng.integers(0, centres, n)] + noise * rng.standard_normal((n, dim))
    label = [None if a == 0 else int(a) for a in rng.integers(0, 4, n)]
    return [(int(i), v, c) for i, v, c in zip(rng.permutation(n), x.astype(np.float32).tolist(), label)]


@pytest.mark.parametrize("dim,parts,entries,rounds", [(32, 16, 64, 2), (7, 3, 5, 4), (4, 4, 2, 0)])
def test_equals_full_comparisons(spark, dim, parts, entries, rounds):
    rows = vectors(dim, 250, dim)
    df = spark.createDataFrame(rows, KIND).repartition(4)
    found = V.compression_report(df, parts=parts, entries=entries, rounds=rounds)
    assert have(found) == brute(rows, parts, entries, rounds)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, [1.0] * 16, 1), (6, None, 1), (7, [nan] * 16, 1), (8, [inf] + [0.0] * 15, 1),
            (9, [None] + [0.0] * 15, 2), (None, [2.0] * 16, 1), (5, [0.5] * 16, None), (10, [0.25] * 3, 1),
            (11, [], None), (12, [-0.001] * 16, None)]
    assert have(V.compression_report(spark.createDataFrame(rows, KIND))) == brute(rows)


def test_a_third_equal_rows_and_fewer_rows_than_entries(spark):
    rows = vectors(3, 40, 16)
    rows = [(i, rows[0][1] if at % 3 == 0 else v, c) for at, (i, v, c) in enumerate(rows)]
    assert have(V.compression_report(spark.createDataFrame(rows, KIND))) == brute(rows)


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame(vectors(4, 80, 16), KIND)
    assert have(V.compression_report(df.limit(0))) == []
    extra = df.selectExpr("*", "1 as code", "'x' as error", "2 as v", "3 as near", "4 as _label")
    assert have(V.compression_report(extra)) == have(V.compression_report(df))


def test_too_large_components_are_an_error(spark):
    df = spark.createDataFrame([(0, [1e30] * 16, 1)], KIND)
    with pytest.raises(Exception, match="too large"):
        V.compression_report(df).collect()


@pytest.mark.parametrize("seed", range(6))
def test_active_comparison_equals_full_one(seed):
    """Few values, so that ties are frequent; some entries stay."""
    rng = np.random.default_rng(seed)
    x, before = rng.integers(-3, 4, (400, 2)), rng.integers(-3, 4, (12, 2))
    code, near = V.assign_part(x, before, None, None, None)
    after = before.copy()
    after[rng.integers(0, 12, 4)] += rng.integers(-2, 3, (4, 2))
    moved = (after != before).any(1)
    got = V.assign_part(x, after, moved, code, near)
    want = V.assign_part(x, after, None, None, None)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_active_comparison_looks_at_moved_entries_only(monkeypatch):
    seen = []
    real = V.distances
    monkeypatch.setattr(V, "distances", lambda x, e: seen.append((len(x), len(e))) or real(x, e))
    x = np.arange(20).reshape(-1, 1)
    entries = np.array([[0], [10], [19]])
    code, near = V.assign_part(x, entries, None, None, None)
    after, moved = np.array([[0], [10], [18]]), np.array([False, False, True])
    seen.clear()
    V.assign_part(x, after, moved, code, near)
    gone = int((code == 2).sum())
    assert seen == [(20 - gone, 1), (gone, 3)]
    seen.clear()
    V.assign_part(x, entries, np.zeros(3, bool), code, near)
    assert seen == []


def test_distances_beyond_doubles_are_exact():
    x, e = np.array([[2 ** 29, 1]]), np.array([[-2 ** 29, 0], [2 ** 29 - 1, 1]])
    assert V.distances(x, e).tolist() == [[2 ** 60 + 1, 1]]


def test_query_matches_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    df = op13_vector_codes(spark, sf_dir)
    assert compare("op13_vector_codes", df, duckdb_connection(sf_dir), ORACLE_SQL["op13_vector_codes"]).ok
    assert dict(df.dtypes) == {"vec_id": "bigint", "code": "string", "error": "bigint",
                               "label_error": "bigint", "codebooks_sha256": "string"}
