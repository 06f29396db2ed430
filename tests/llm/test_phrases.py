"""Phrase collocations against plain Python."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from ledgerlens.llm import phrases as P
from ledgerlens.llm.queries import ORACLE_SQL, op12_collocations
from ledgerlens.plans.compare import compare, duckdb_connection

UPPER = {c: c + 32 for c in range(65, 91)}


def brute(rows, min_count, longest=4, top=2000, cover=80):
    """rows (text, lang) -> (lang, rank, phrase, a, l, r, n, score)"""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i:i + m])] += 1
    cand = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= min_count}
    out = {}
    for (lang, w), a in cand.items():
        if any(100 * b >= cover * a and other == lang and len(x) > len(w)
               and any(x[i:i + len(w)] == w for i in range(len(x))) for (other, x), b in cand.items()):
            continue
        score, k = min((P.SCORE_SCALE * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.setdefault(lang, []).append(
            (-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]], n[lang]))
    return sorted((lang, rank, p.decode(), -a, l, r, total, -s) for lang, found in out.items()
                  for rank, (s, a, p, l, r, total) in enumerate(sorted(found)[:top], 1))


def have(df):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"])
                  for r in df.collect())


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["New", "york", "the", "of", "É", "straße", "x\x0by", "zug", "Α", "a b", "\x1c", "la", "CIty"]
    gaps = [" ", "  ", "\t", ", ", ".", "\n", " \t ", "!?", "\r\n"]
    out = []
    for _ in range(n):
        text = ""
        while rng.random() < 0.95:
            text += rng.choice(["new york city hall", rng.choice(words)]) + rng.choice(gaps)
        out.append((text, rng.choice(["en", "de", None, "und"])))
    return out


@pytest.mark.parametrize("seed,min_count,top", [(1, 4, 2000), (2, 8, 5), (3, 2, 40)])
def test_equals_brute_force(spark, seed, min_count, top):
    rows = corpus(seed, 150)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    assert have(P.mine_collocations(df, min_count, top=top)) == brute(rows, min_count, top=top)


@pytest.mark.parametrize("longest", [2, 3, 5])
def test_other_lengths(spark, longest):
    rows = corpus(9, 80)
    df = spark.createDataFrame(rows, "text string, lang string")
    assert have(P.mine_collocations(df, 5, longest)) == brute(rows, 5, longest)


def test_frequent_groups_joined_with_a_shuffle(spark, monkeypatch):
    """The way taken by large vocabularies gives the same rows."""
    rows = corpus(4, 80)
    df = spark.createDataFrame(rows, "text string, lang string")
    monkeypatch.setattr(P, "BROADCAST_ROWS", 2)
    assert have(P.mine_collocations(df, 4)) == brute(rows, 4)


def places(text):
    return [(w, int(a)) for words, at in P.piece_words(text) for w, a in zip(words, at)]


def test_positions_leave_a_gap_between_pieces(monkeypatch):
    whole = places(b"A b,,c  D.\x1ce f")
    assert whole == [(b"a", 0), (b"b", 1), (b"c", 4), (b"d", 5), (b"\x1ce", 7), (b"f", 8)]
    real = P.byte_pieces
    # parts of a few bytes give the same positions
    for size in (1, 2, 3, 5):
        monkeypatch.setattr(P, "byte_pieces", lambda data, size=size: real(data, size))
        assert places(b"A b,,c  D.\x1ce f") == whole
        assert places(b"aa bb cc\ndd ee") == [(b"aa", 0), (b"bb", 1), (b"cc", 2), (b"dd", 4), (b"ee", 5)]


def test_small_buffers(spark, monkeypatch):
    rows = corpus(6, 60)
    batches = [pa.RecordBatch.from_pydict({"lang": [r[1] or "und" for r in rows],
                                           "text": [r[0] for r in rows]})]
    monkeypatch.setattr(P, "COUNTS_HELD", 3)
    total = Counter()
    for batch in P._word_counts(iter(batches)):
        for lang, word, f in zip(*(c.to_pylist() for c in batch.columns)):
            total[lang, word] += f
    want = Counter((lang or "und", w.decode()) for text, lang in rows
                   for words, _ in P.piece_words(text.encode()) for w in words)
    assert total == want


def test_one_text_holds_a_third_of_all_words(spark):
    rows = corpus(5, 40)
    rows.append((" ".join(["blue whale song"] * 600), "en"))
    df = spark.createDataFrame(rows, "text string, lang string")
    assert have(P.mine_collocations(df, 5)) == brute(rows, 5)


def test_cover_rule_and_ties(spark):
    """'a b' lies in 'a b c' with 80 % of its count: dropped at exactly 80."""
    rows = [("a b c", "en")] * 8 + [("a b", "en")] * 2 + [("p q", "en"), ("q p", "en")] * 5
    found = have(P.mine_collocations(spark.createDataFrame(rows, "text string, lang string"), 5))
    assert found == brute(rows, 5)
    assert [p for _, _, p, *_ in found] == ["a b c", "p q", "q p"] and "a b" not in [r[2] for r in found]


def test_null_empty_and_repeated_rows(spark):
    rows = [(None, "en"), ("", None), (" \t", "en"), (",.;", None)] + [("Un deux", None)] * 6
    df = spark.createDataFrame(rows, "text string, lang string")
    assert have(P.mine_collocations(df, 5)) == [("und", 1, "un deux", 6, 6, 6, 12, 1_000_000)]
    assert have(P.mine_collocations(df.limit(0), 5)) == []
    assert have(P.mine_collocations(df, 7)) == []
    extra = df.selectExpr("*", "1 as doc", "2 as at", "3 as gid", "4 as word", "5 as f", "6 as a")
    assert have(P.mine_collocations(extra, 5)) == have(P.mine_collocations(df, 5))


def test_products_beyond_64_bits(spark):
    big = 4_000_000_000_000_000_000
    found = spark.createDataFrame([("en", 1, "a", big), ("en", 1, "b", big), ("en", 2, "a b", big - 1)],
                                  "lang string, size int, phrase string, f long")
    scored = P._scored(found.filter("size = 2").withColumnRenamed("f", "a"), found).first()
    assert scored["score"] == P.SCORE_SCALE * (big - 1) // (2 * big)
    assert P._uncovered(found.filter("size = 2").withColumnRenamed("f", "a"), 80).count() == 1


def test_joins_need_no_exchange_of_occurrences(spark):
    rows = spark.createDataFrame([(d, at, at % 3) for d in range(40) for at in range(30)],
                                 "doc long, at int, gid long")
    relation = P.Relation(rows, placed=False)
    with P._joined_by_bucket(spark):
        plan = relation.adjacent()._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
    relation.release()


def test_query_matches_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    df = op12_collocations(spark, sf_dir)
    assert compare("op12_collocations", df, duckdb_connection(sf_dir), ORACLE_SQL["op12_collocations"]).ok
    assert [t for c, t in df.dtypes if c not in ("lang", "phrase")] == ["bigint"] * 6


@pytest.mark.parametrize("size,most", [(1, 1), (3, 4), (9, 12), (9, 10**6)])
def test_stretches_keep_pieces_whole(monkeypatch, size, most):
    """Texts cut into parts and stretches give the same pieces."""
    rows = corpus(8, 40) + [(" ".join(["one"] * 30 + ["two,", "three"] * 9), "en")]
    batches = [pa.RecordBatch.from_pydict({"lang": [r[1] or "und" for r in part], "text": [r[0] for r in part]})
               for part in (rows[:25], rows[25:])]
    real, docs = P.byte_pieces, {}
    monkeypatch.setattr(P, "byte_pieces", lambda data: real(data, size))
    for lang, one in P._stretches(iter(batches), most):
        numbers, words, f = one.packed()
        assert f.sum() == (numbers >= 0).sum() and len(set(words)) == len(words)
        docs.setdefault((lang, one.doc), {})[one.at] = [words[c] if c >= 0 else None for c in numbers]
    found = Counter()
    for (lang, _), parts in docs.items():
        assert sorted(parts) == list(range(len(parts)))
        piece = []
        for word in [w for at in sorted(parts) for w in parts[at]] + [None]:
            if word is not None:
                piece.append(word)
            elif piece:
                found[lang, tuple(piece)] += 1
                piece = []
    want = Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text.translate(UPPER)):
            if words := re.findall(r"[^\x20\x09]+", piece):
                want[lang or "und", tuple(w.encode() for w in words)] += 1
    assert found == want


def test_relations_have_rows_of_stretches_not_of_words(spark, monkeypatch):
    """A relation of thousands of entries has a row or few for each task and
    language, and phrases go on from one stretch to the next."""
    rows = corpus(7, 120) + [("blue whale song " * 70_000, "en")]
    sizes, real = [], P._kept

    def kept(*args):
        relation = real(*args)
        sizes.append(relation.rows().count())
        return relation

    monkeypatch.setattr(P, "_kept", kept)
    monkeypatch.setattr(P, "ROWS_OUT", 100_000)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(2)
    assert have(P.mine_collocations(df, 4)) == brute(rows, 4)
    assert len(sizes) == 3 and max(sizes) <= 8
