"""Line dedup against its definition, its SQL, and batch by batch."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import linededup as D
from ledgerlens.llm.queries import ORACLE_SQL, op8_line_dedup
from ledgerlens.plans.compare import compare, duckdb_connection

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def brute(rows, length=40, documents=5):
    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            k = key(line)
            held = holders[k]
            last = max((d for d in held if d is not None), default=None)
            if not (len(k) >= length and len(held) >= documents and doc != last):
                kept.append(line)
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    common = [f"Shared line {i} é " + "x" * n for i, n in enumerate([10, 20, 24, 25, 26, 40, 60, 90])]
    rows = []
    for i in range(80):
        lines = [f"own line {i} {j} " + "y" * 40 for j in range(rng.randrange(4))]
        for _ in range(rng.randrange(6)):
            line = rng.choice(common)
            lines.insert(rng.randrange(len(lines) + 1),
                         rng.choice([line, line.upper().replace("É", "é"), f" \t{line}\r", line + " "]))
        rows.append((i, "\n".join(lines)))
    return rows + [(80, None), (81, ""), (82, "\n\n"), (83, "\n".join([common[5]] * 3)),
                   (None, common[6]), (None, common[6] + "\nmore"), (7, rows[7][1]), (7, common[7]),
                   (84, "\n".join([common[4]] + [f"long text {k} " + "z" * 50 for k in range(3000)]))]


@pytest.mark.parametrize("batches", [1, 4, 7])
def test_matches_brute_force(docs_of, batches):
    rows = corpus(batches)
    docs = docs_of(rows).withColumn("n_lines", F.lit("mine")).withColumn("pos", F.lit(1))
    got = D.dedup_lines(docs, batches=batches)
    assert got.columns == ["doc_id", "text", "lang", "source", "pos", "n_lines", "n_dropped"]
    have = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in got.collect()), key=str)
    assert have == brute(rows)
    assert got.filter("doc_id = 80").first()["text"] is None


def test_all_copies(docs_of):
    rows = [(i, "The very same long line in each and every document") for i in range(300)]
    got = D.dedup_lines(docs_of(rows)).filter("n_dropped = 0").collect()
    assert [r["doc_id"] for r in got] == [299]


def test_no_rows(docs_of):
    assert D.dedup_lines(docs_of([])).count() == 0


def test_runs_hold_each_key_once(spark):
    """Whatever the order of the batches and the compactions."""
    rng = random.Random(3)
    runs, seen = D.LineRuns(fanout=2), {}
    for batch in range(7):
        rows = [(batch * 100 + rng.randrange(20), rng.randrange(40), 0) for _ in range(60)]
        for doc, h, _ in rows:
            seen.setdefault(h, set()).add(doc)
        runs.add(spark.createDataFrame(rows, "doc_id long, h1 long, h2 long"))
    assert [len(level) for level in runs.levels] == [1, 1, 1]
    kept = [r["h1"] for level in runs.levels for run in level for r in run.collect()]
    assert sorted(kept) == sorted(seen)
    shared = {r["h1"]: r["last"] for r in runs.shared(3).collect()}
    assert shared == {h: max(docs) for h, docs in seen.items() if len(docs) >= 3}


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.01"
    out = compare("op8", op8_line_dedup(spark, sf), duckdb_connection(sf), ORACLE_SQL["op8_line_dedup"])
    assert out.ok and out.types_match, out.detail


def test_query_hashes(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in op8_line_dedup(spark, sf).collect()), key=str)
    assert got == sorted(((d, n, k, hashlib.sha256(t.encode()).hexdigest())
                          for d, n, k, t in brute(rows)), key=str)
