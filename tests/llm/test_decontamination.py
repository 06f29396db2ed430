"""Decontamination against a scan in plain Python, and its SQL."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import decontamination as D
from ledgerlens.llm.queries import ORACLE_SQL, op5_decontamination
from ledgerlens.plans.compare import compare, duckdb_connection

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, size=13):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i:i + size]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i:i + n])] - {None}
        ids = ",".join(sorted(map(str, found)))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def report(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = D.contamination_report(d, b, **more)
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.fixture(scope="module")
def made():
    rng = random.Random(4)
    vocabulary = ["the", "of", "Zürich", "a1", "Wörter"] + [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([2, 5, 13, 14, 40])))) for i in range(30)]
    items += [(30, items[3][1].upper()), (31, None), (32, ""), (None, "null item id " * 6),
              (33, "same same same same"), (7, "w1 w2 w3")]
    docs = []
    for i in range(60):
        text = rng.choices(vocabulary, k=rng.choice([0, 3, 50, 300]))
        for _ in range(rng.choice([0, 1, 3])):
            w = words(rng.choice(items[:30])[1])
            cut = rng.randrange(0, max(1, len(w) - 13))
            at = rng.randrange(len(text) + 1)
            text[at:at] = [x.upper() if rng.random() < 0.3 else x for x in w[cut:]]
        docs.append((i, rng.choice([" ", ", ", "\n- "]).join(text)))
    docs += [(60, None), (61, ""), (62, "!?"), (63, "same " * 9), (None, items[8][1]), (None, "clean"),
             (5, docs[5][1]), (5, "other text"), (64, "x " * 20_000 + items[9][1])]
    return docs, items


def test_matches_brute_force(spark, made):
    assert report(spark, *made) == brute(*made)


def test_windows_in_blocks(spark, made):
    docs, items = made
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    whole, _ = D.occurrences(d, b)
    parts, _ = D.occurrences(d, b, block=50)
    assert sorted(map(str, whole.collect())) == sorted(map(str, parts.collect()))


@pytest.mark.parametrize("size", [1, 4])
def test_other_window_sizes(spark, made, size):
    assert report(spark, *made, window=size) == brute(*made, size=size)


def test_empty_tables(spark):
    assert report(spark, [], [(1, "a b")]) == []
    assert report(spark, [(1, "a b")], []) == brute([(1, "a b")], [])


def test_removal(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = [(1, f"Before, {item.upper()}! After."), (2, "clean text"), (3, None),
            (4, "lead " * 600 + item), (4, "clean again")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn(
        "n_hit", F.lit("mine")).withColumn("h1", F.lit(1))
    b = spark.createDataFrame([(9, item)], "item_id long, text string")
    kept = D.decontaminate(d, b)
    assert kept.columns == d.columns
    assert {(r["doc_id"], r["text"]) for r in kept.collect()} == {docs[1], docs[2], docs[3], docs[4]}
    cut = {(r["doc_id"], r["text"]) for r in D.decontaminate(d, b, remove="spans").collect()}
    assert cut == {(1, "Before, After."), (2, "clean text"), (3, None), (4, "lead " * 600),
                   (4, "clean again")}
    with pytest.raises(ValueError):
        D.decontaminate(d, b, remove="words")


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    out = compare("op5", op5_decontamination(spark, sf), duckdb_connection(sf),
                  ORACLE_SQL["op5_decontamination"])
    assert out.ok and out.types_match, out.detail
