"""Near-duplicates against a comparison of all pairs in plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import minhash
from ledgerlens.llm.common import byte_pieces
from ledgerlens.llm.components import connected_components
from ledgerlens.llm.queries import op9_minhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return set()
    return {tuple(w[i:i + 4]) for i in range(max(1, len(w) - 3))}


def brute(rows):
    """[(id, text)] -> sorted (id, n_shingles, component, kept)."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    out = []
    for i, (d, _) in enumerate(rows):
        c = least.get(find(i)) if sets[i] else d
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=str)


def found(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"])
                   for r in df.collect()), key=str)


def near(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"w{rng.randrange(5000)}"
    return out


def corpus(seed, bases=12, copies=9):
    """Groups around base texts, some pairs on either side of 0.8, in a
    large group of copies; chains; shared passages."""
    rng = random.Random(seed)
    rows, passage = [], [f"p{i}" for i in range(60)]
    for b in range(bases):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([5, 30, 120]))]
        for _ in range(copies if b else 60):
            rows.append(" ".join(near(rng, base, rng.choice([0, 1, 2, 4, 6]))))
    for _ in range(25):
        rows.append(" ".join(passage + [f"w{rng.randrange(5000)}" for _ in range(40)]))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_match_all_pairs(docs_of, seed):
    rows = corpus(seed)
    assert found(minhash.near_duplicates(docs_of(rows))) == brute(rows)


@pytest.mark.parametrize("seed", [3, 4])
def test_small_tiles_and_buckets(docs_of, seed, monkeypatch):
    """Nearly all pairs go through the tiles of clusters."""
    monkeypatch.setattr(minhash, "SMALL", 2)
    monkeypatch.setattr(minhash, "TILE", 8)
    rows = corpus(seed)
    assert found(minhash.near_duplicates(docs_of(rows))) == brute(rows)


def test_tile_links_in_blocks_of_columns(monkeypatch):
    import numpy as np
    import pyarrow as pa
    monkeypatch.setattr(minhash, "COLUMNS", 7)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 10_000, 60)
    sets = [np.unique(np.concatenate([rng.choice(base, 52, replace=False),
                                      rng.integers(0, 10_000, k % 9)])) for k in range(24)]
    table = pa.table({"node": list(range(24)), "component": list(range(24)),
                      "tile": [0] * 10 + [1] * 14, "shingles": [s.tolist() for s in sets]})
    links = minhash._tile_links(80)(table).to_pylist()
    want = {(i, j) for i in range(10) for j in range(10, 24)
            if 100 * len(set(sets[i]) & set(sets[j])) >= 80 * len(set(sets[i]) | set(sets[j]))}

    def groups(pairs):
        parent = list(range(24))
        for a, b in pairs:
            x, y = parent[a], parent[b]
            parent = [y if p == x else p for p in parent]
        return {frozenset(i for i in range(24) if parent[i] == p) for p in parent}

    got = {(r["a"], r["b"]) for r in links}
    assert got and got <= want and groups(got) == groups(want)


def test_edge_cases(docs_of):
    long = " ".join(f"x{i % 977}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE\ttwo"), (6, "one two three"),
            (7, long), (8, long + " tail"), (9, "a b c d e"), (9, "a b c d e"), (9, "other words here now"),
            (None, "one two"), (None, "lonely text of five words"), (0, "other words here now")]
    df = docs_of(rows).withColumn("node", F.lit(1)).withColumn("component_id", F.lit("x"))
    assert found(minhash.near_duplicates(df)) == brute(rows)
    kept = sorted(((r["doc_id"], r["text"]) for r in minhash.keep_one(df).collect()), key=str)
    assert kept == sorted([(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (6, "one two three"), (7, long),
                           (9, "a b c d e"), (0, "other words here now"),
                           (None, "lonely text of five words")], key=str)


def test_empty_table(docs_of):
    assert found(minhash.near_duplicates(docs_of([]))) == []
    assert minhash.keep_one(docs_of([])).count() == 0


def test_guarantee_of_the_index():
    """Signatures that differ in 2 * CHUNKS - 1 places share a key."""
    import numpy as np
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, (200, minhash.PLACES)).astype(np.uint64)
    b = a.copy()
    for row in b:
        row[rng.choice(minhash.PLACES, 2 * minhash.CHUNKS - 1, replace=False)] += np.uint64(12345)
    ka, kb = minhash.index_keys(a), minhash.index_keys(b)
    assert all(set(x) & set(y) for x, y in zip(ka.tolist(), kb.tolist()))


def test_pieces_do_not_change_the_words(monkeypatch):
    text = " ".join(f"wörd{i}" for i in range(500))
    whole = minhash.shingle_set(text).tolist()
    monkeypatch.setattr(minhash, "byte_pieces", lambda data: byte_pieces(data, 100))
    assert minhash.shingle_set(text).tolist() == whole
    assert len(whole) == len(shingles(text))


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(50, 60), (60, 50), (70, 70), (None, 5), (55, 60)]
    got = {r["node"]: r["component"] for r in
           connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(2, 41)}, 55: 50, 60: 50}


def test_query_on_the_small_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert found(op9_minhash(spark, sf)) == brute(rows)


@pytest.mark.parametrize("doc_id", [None, 7])
def test_each_text_is_fetched_once_whatever_the_ids(spark, monkeypatch, doc_id):
    """Rows that share an id, or have none, do not meet each other's nodes."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    rows = [(doc_id, " ".join(near(rng, base, 1))) for _ in range(60)] + [(doc_id, " ".join(base))] * 40
    written = {}
    real = minhash.materialize

    def counted(df, label):
        out = real(df, label)
        if label == "shingle-sets":
            written[label] = out.count()
        return out

    monkeypatch.setattr(minhash, "materialize", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(minhash.near_duplicates(df)) == brute(rows)
    assert written["shingle-sets"] == len({text for _, text in rows})
