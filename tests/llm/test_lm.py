"""LM scoring: exact counts and base score, normalisation, held-out gain."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import lm as L
from ledgerlens.llm.queries import op4_lm_scoring

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + [None]


def base(train, docs):
    c = Counter(t for text in train for t in tokens(text))
    n, v = sum(c.values()), len(c)
    out = []
    for text in docs:
        t = tokens(text)
        s = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t)
        out.append((len(t), sum(c[x] > 0 for x in t), n, s))
    return out


TRAIN = ["the cat sat", "The dog sat on the mat", "", None, "der hund sass auf der matte " * 30,
         "É x y\x0bz\x1cq", "rare words here only once"] * 3
DOCS = [None, "", "  \n", "the cat", "THE unknown éclair É", "der hund " * 20_000, "der hund " * 20_000,
        "y z z\x1cq"]


@pytest.mark.parametrize("frequent,vocabulary", [(200_000, 1400), (5, 3), (1, 0)])
def test_counts_and_base(spark, docs_of, frequent, vocabulary):
    """Also with nearly all words outside the broadcast part."""
    model, counts = L.train(docs_of(list(enumerate(TRAIN))), frequent=frequent, vocabulary=vocabulary)
    docs = docs_of(list(enumerate(DOCS))).withColumn("score", F.lit("x")).withColumn("c", F.lit(1)).withColumn(
        "word", F.lit("w"))
    got = L.score(docs, model, counts)
    assert got.columns == ["doc_id", "text", "lang", "source", "c", "word", "n_tokens", "n_known",
                           "train_tokens", "base_score", "score"]
    for r, want in zip(sorted(got.collect(), key=lambda r: r["doc_id"]), base(TRAIN, DOCS)):
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == want[:3]
        assert abs(r["base_score"] - want[3]) < 1e-6 * abs(want[3])
        assert r["score"] < 0


def test_probabilities_sum_to_one(docs_of):
    """Over all known words, one unknown word per suffix class, and the end."""
    model, counts = L.train(docs_of(list(enumerate(TRAIN))), vocabulary=3)
    assert np.allclose((10.0 ** model.log_prob).sum(axis=1), 1, atol=1e-4)
    inside = Counter()
    for w, i in model.words.items():
        if not model.own[i]:
            inside[model.token_class[i]] += 10 ** (model.log_count[i] - model.class_norm[model.token_class[i]])
    for k in inside:
        assert abs(inside[k] + 0.5 / 10 ** model.class_norm[k] - 1) < 1e-9


def test_training_learns_pairs():
    rng = np.random.default_rng(0)
    true = rng.dirichlet(np.ones(30) * 0.1, size=30)
    pairs = np.round(true * 5000).astype(np.float32)
    p = L.train_pairs(pairs, dimensions=12, epochs=200)
    assert np.allclose((10.0 ** p).sum(axis=1), 1, atol=1e-4)
    unigram = np.log10((pairs.sum(axis=0) + 0.5) / (pairs.sum() + 15))
    assert (pairs * p).sum() > 0.6 * (pairs * unigram).sum() + 0.4 * (pairs * np.log10(true + 1e-9)).sum()


def test_nothing_learned(docs_of):
    model, counts = L.train(docs_of([]))
    r = L.score(docs_of([(1, "a b"), (2, None)]), model, counts).orderBy("doc_id").collect()
    assert [(x["n_tokens"], x["n_known"], x["train_tokens"]) for x in r] == [(3, 0, 0), (1, 0, 0)]
    assert all(math.isfinite(x["score"]) and abs(x["base_score"] - 0) < 1e-9 for x in r)
    assert L.score(docs_of([]), model, counts).count() == 0


def test_threshold_of_counts(spark):
    counts = spark.createDataFrame([(i,) for i in range(1, 1001)], "c long")
    for most in (1, 10, 100, 2000):
        least = L._threshold(counts, most)
        assert counts.filter(F.col("c") >= least).count() <= most
    assert L._threshold(counts, 2000) == 1


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = {r["doc_id"]: (r["text"], r["f"]) for r in docs.withColumn(
        "f", F.crc32(F.col("doc_id").cast("string")) % 5).collect()}
    train = [t for t, f in docs.values() if f != 1]
    rows = op4_lm_scoring(spark, SF).collect()
    want = base(train, [docs[r["doc_id"]][0] for r in rows])
    gain = []
    for r, w in zip(rows, want):
        assert r["held_out"] == (docs[r["doc_id"]][1] == 1)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:3]
        assert abs(r["base_score"] - w[3]) < 1e-6 * abs(w[3])
        if r["held_out"]:
            gain.append((r["score"] - r["base_score"]) / r["n_tokens"])
    assert np.mean(gain) > 0
