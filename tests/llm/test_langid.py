"""Language ID: the model against its definition, held-out accuracy, edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import langid as L
from ledgerlens.llm.queries import op2_language_id

SF = "/root/testdata/sf0.01"


def model_of(texts: dict) -> L.Model:
    counts = {}
    for lang, rows in texts.items():
        g = np.concatenate([L.grams(L.symbols(t)) for t in rows])
        counts[lang] = np.unique(g, return_counts=True)
    return L.fit(counts)


def test_probabilities_sum_to_one():
    """Over all symbols after any context, seen or not."""
    m = model_of({"x": ["abra cadabra abba", "baa"], "y": ["xyz zyx abc"]})
    alphabet = [0] + [ord(c) for c in "abcdrxyz"]
    for context in ([0, 0, 0], [ord("a"), ord("b"), ord("b")], [ord("q")] * 3, [ord("a"), ord("q"), ord("a")]):
        total = np.zeros(2)
        for s in alphabet:
            total += np.exp(m._piece(np.array(context + [s], np.uint16)))
        total += np.exp(m._piece(np.array(context + [ord("w")], np.uint16))) * (L._ALPHABET - len(alphabet))
        assert np.allclose(total, 1, atol=1e-4)


def test_symbols_and_pieces(monkeypatch):
    assert L.symbols("Ab,  1c!").tolist() == [0, 0, 0, ord("a"), ord("b"), 0, ord("c"), 0]
    m = model_of({"x": ["the quick brown fox " * 5], "y": ["el zorro marrón " * 5]})
    text = "the fox el zorro " * 40
    whole = m.cross_entropies(text)
    monkeypatch.setattr(L, "CHUNK", 50)
    parts = m.cross_entropies(text)
    assert np.argmin(whole[0]) == np.argmin(parts[0]) and abs(whole[1] - parts[1]) <= 3 * 14


def test_edges(spark, docs_of):
    train = [(i, t, lang, None) for i, (t, lang) in enumerate(
        [("the cat and the dog sat on the mat", "en"), ("der hund und die katze auf der matte", "de")] * 10)]
    train += [(90, None, "en", None), (91, "no label", None, None), (92, "", "de", None)]
    m = L.train(docs_of(train), rows_per_language=1000)
    assert m.languages == ["de", "en"]
    docs = docs_of([(1, None), (2, ""), (3, "12 34 !?"), (4, "The DOG and the cat"),
                    (5, "Die Katze " * 200_000), (5, "Die Katze"), (None, "das und die"),
                    (6, "日本語 日本")]).withColumn("score", F.lit("mine")).withColumn("text_", F.lit(1))
    got = L.identify(docs, m)
    assert got.columns == ["doc_id", "text", "lang", "source", "text_", "lang_pred", "score", "rejected",
                           "cross_entropy"]
    rows = [(r["doc_id"], r["lang_pred"], r["rejected"], 0 <= r["score"] <= 1) for r in got.collect()]
    assert [r[1] for r in rows[:7]] == ["und", "und", "und", "en", "de", "de", "de"]
    assert [r[2] for r in rows[:3]] == [True] * 3 and all(r[3] for r in rows)
    assert rows[7][1] in ("de", "en")  # has letters: a learned language
    assert L.identify(docs_of([]), m).count() == 0


def test_only_texts_go_to_python_and_once(spark, docs_of):
    """No Arrow batches of whole rows, also below a filter on the result."""
    m = model_of({"en": ["the cat and the dog sat on the mat"], "de": ["der hund und die katze"]})
    texts = [None, "", "12", "The dog", "Die Katze", "the cat and die katze"] * 50
    docs = docs_of([(i % 99 or None, t, "x", "s" * 1000) for i, t in enumerate(texts)])
    got = L.identify(docs, m, names=("_l", "_s", "_r", "_h")).filter("not _r").drop("_s")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchEvalPython") == 1 and "InArrow" not in plan and "ArrowEval" not in plan
    want = [(i % 99 or None, t, *m.predict(t)) for i, t in enumerate(texts)]
    assert sorted(map(str, got.select("doc_id", "text", "_l", "_h").collect())) == sorted(
        f"Row(doc_id={d}, text={t!r}, _l={lang!r}, _h={h})" for d, t, lang, _, out, h in want if not out)


def test_nothing_learned(spark, docs_of):
    m = L.train(docs_of([(1, "text", None, None), (2, None, "en", None)]))
    row = L.identify(docs_of([(1, "some text")]), m).first()
    assert (row["lang_pred"], row["score"], row["rejected"]) == ("und", 0.0, True)


def test_rejection_spares_clean_text(spark, docs_of):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    m = L.train(docs)
    junk = "qzxj wvkq zzxq jjqx vvkz xqzj " * 30
    got = L.identify(docs_of([(1, junk), (2, docs.filter("lang = 'en'").first()["text"])]), m).collect()
    assert [r["rejected"] for r in got] == [True, False]


def test_query_on_held_out_rows(spark):
    rows = op2_language_id(spark, SF).collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(truth) and len(held) > 100
    right = sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held)
    assert right > 0.97
    assert sum(r["rejected"] for r in rows) / len(rows) < 0.01


@pytest.mark.parametrize("limit", [3.0])
def test_calibration_without_rows(limit):
    m = model_of({"x": ["abc"], "y": ["xyz"]})
    m.calibrate([])
    assert m.predict("abc")[0] == "x" and not m.predict("abc")[2]


@pytest.mark.parametrize("odd", [None, (0.3, 800_000), (6.0, 1_000_000), (6.0, 1000)])
def test_one_odd_row_leaves_rejection_as_it_was(odd, monkeypatch):
    """A long repetitive, a long mislabelled and a short mislabelled row."""
    m = model_of({"x": ["abc"], "y": ["xyz"]})
    rng = np.random.default_rng(3)
    rows = [("x", np.array([2 + rng.standard_normal() * 3 / np.sqrt(n), 9]), int(n))
            for n in rng.integers(300, 3000, 240)]
    m.calibrate(rows + ([("x", np.array([odd[0], 9]), odd[1])] if odd else []))
    got = []
    for h in (2.1, 3.5):
        monkeypatch.setattr(L.Model, "cross_entropies", lambda self, text: (np.array([h, 9.0]), 1400))
        got.append(m.predict("a")[2])
    assert got == [False, True]


def plain_kneser_ney(texts):
    """-log p(symbol | three before) of interpolated Kneser-Ney, with dicts:
    counts of the longest n-grams, numbers of different symbols before for
    the shorter ones, and one discount an order."""
    levels = [None] * L.ORDER
    levels[-1] = {}
    for t in texts:
        s = L.symbols(t).tolist()
        for i in range(len(s) - L.ORDER + 1):
            g = tuple(s[i:i + L.ORDER])
            levels[-1][g] = levels[-1].get(g, 0) + 1
    for n in range(L.ORDER - 2, -1, -1):
        levels[n] = {}
        for g in levels[n + 1]:
            levels[n][g[1:]] = levels[n].get(g[1:], 0) + 1

    discounts, groups = [], []
    for grams in levels:
        ones, twos = (sum(c == k for c in grams.values()) for k in (1, 2))
        discounts.append(ones / (ones + 2 * twos) if ones and twos else 0.5)
        by_context = {}
        for g, c in grams.items():
            total, kinds = by_context.get(g[:-1], (0, 0))
            by_context[g[:-1]] = total + c, kinds + 1
        groups.append(by_context)

    def p(context, symbol):
        n = len(context)
        below = p(context[1:], symbol) if n else 1 / L._ALPHABET
        if context not in groups[n]:
            return below
        total, kinds = groups[n][context]
        c = levels[n].get((*context, symbol), 0)
        return max(c - discounts[n], 0) / total + discounts[n] * kinds / total * below

    return p


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain_kneser_ney(seed):
    rng = np.random.default_rng(seed)
    texts = {lang: ["".join(rng.choice(list(letters), 60)) for _ in range(8)]
             for lang, letters in (("x", "abcde  "), ("y", "cdefgh é "), ("z", "mmmno "))}
    model = model_of(texts)
    plain = [plain_kneser_ney(texts[lang]) for lang in model.languages]
    for text in [*texts["x"][:3], *texts["z"][:2], "abc fgh", "qqq", "é", "mno abba cade" * 5]:
        s = L.symbols(text).tolist()
        n = len(s) - L.ORDER + 1
        want = [-sum(np.log(p(tuple(s[i:i + L.ORDER - 1]), s[i + L.ORDER - 1])) for i in range(n)) / n
                for p in plain]
        got, counted = model.cross_entropies(text)
        assert counted == n and np.allclose(got, want, rtol=1e-5)
        best = model.predict(text)
        assert best[0] == model.languages[int(np.argmin(want))]
