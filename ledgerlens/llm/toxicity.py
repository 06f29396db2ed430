"""Toxicity: a learned lexicon matched with Levenshtein automata.

Terms are learned from labelled texts: words, and stems that many toxic
words begin with, that occur far more often in toxic texts and in varied
surroundings (so that copies of one text teach nothing). The terms form a
trie. The Levenshtein automata of all terms run over the trie at once, as
one automaton whose states are sets of (trie node, errors) and whose
transitions are worked out when first needed; a word that is near no term
leaves it after a few characters. Words of clean texts that are near a term
are no misspellings of it, unless toxic texts have them far more often.

A hit is as strong as the term's log-odds in the labelled texts; one with
errors counts the words near the term that a single clean text has as clean
hits, as they tell how many more such words other texts hold. Its kind
follows from its errors and its context window: inside quotation marks or
after a word of reporting it is a quotation. The strongest hit of each
kind and the density of hits are weighed by logistic regression.

Learning uses a bounded sample of labelled rows (``SAMPLE_ROWS``, chosen by
a hash); matching and scoring run in Spark tasks over whole texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import spare
from ledgerlens.operators.materialize import materialize, release

SAMPLE_ROWS = 24_000
MIN_SUPPORT = 4  # distinct words a term follows in toxic texts
MIN_RATIO = 30.0  # how much more frequent a term is in toxic texts
STEM_LENGTH = (4, 8)
STEM_ENDINGS = 4  # distinct words that make a stem
CLEAN_NEIGHBOURS = 1  # clean texts that make a word near a term one of its own
WINDOW = 6  # words before a hit that are searched for a sign of quotation
FLUSH = 400_000
MEMO = 200_000  # transitions kept
# Words of reporting (English, German, French, Spanish).
REPORTING = {
    "said", "says", "wrote", "quote", "quoted", "called", "calls", "word", "term",
    "sagte", "schrieb", "zitat", "wort", "nannte", "dit", "citation", "mot",
    "appelle", "dijo", "cita", "palabra", "llama",
}
_OPENING, _CLOSING = "“„«‹", "”»›"
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_KINDS = 6  # (0, 1, 2 errors) x (own words, quoted)
_FEATURES = _KINDS + 1  # and hits in own words per 100 words


def words_of(text: str) -> list[str]:
    """Blank-separated words in lower case without punctuation around."""
    return [_EDGE.sub("", w) for w in text.lower().split()]


def errors_allowed(term: str, stem: bool) -> int:
    """A short term is too near to other words."""
    return (len(term) >= 6) if stem else (len(term) >= 5) + (len(term) >= 9)


class Automaton:
    """All terms with their allowed errors: {term: (is stem, errors)}."""

    def __init__(self, terms: dict[str, tuple[bool, int]]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.end: list[tuple[str, bool, int] | None] = [None]
        # errors that some term below the node allows
        self.most: list[int] = [0]
        for term, (stem, errors) in sorted(terms.items()):
            node = 0
            self.most[0] = max(self.most[0], errors)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.end.append(None)
                    self.most.append(0)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], errors)
            self.end[node] = (term, stem, errors)
        self.sets: list[frozenset] = []
        self.ids: dict[frozenset, int] = {}
        self.memo: dict[tuple[int, str], int] = {}
        self.found: list[tuple[int, tuple]] = []
        self.start = self._state({(0, 0)})

    def _state(self, items: set[tuple[int, int]]) -> int:
        """Id of the state: skipped letters of the terms added, and only the
        fewest errors of a node kept."""
        best: dict[int, int] = {}
        todo = sorted(items, key=lambda x: x[1])
        while todo:
            node, e = todo.pop()
            if e > self.most[node] or best.get(node, 99) <= e:
                continue
            best[node] = e
            todo += [(child, e + 1) for child in self.children[node].values()]
        key = frozenset(best.items())
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            hits = [(e, self.end[n]) for n, e in key if self.end[n] and e <= self.end[n][2]]
            whole = min(((e, t[0]) for e, t in hits if not t[1]), default=None)
            stem = min(((e, t[0]) for e, t in hits if t[1]), default=None)
            self.found.append((whole, stem))
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        items = set()
        for node, e in self.sets[state]:
            items.add((node, e + 1))  # c is one too many
            for x, child in self.children[node].items():
                items.add((child, e if x == c else e + 1))
        if len(self.memo) >= MEMO:
            self.memo.clear()
        self.memo[state, c] = out = self._state(items)
        return out

    def match(self, word: str) -> tuple[int, str] | None:
        """Fewest errors and the term; None if no term is near enough."""
        state, memo = self.start, self.memo
        best = self.found[state][1]
        for c in word:
            following = memo.get((state, c))
            state = self._step(state, c) if following is None else following
            if not self.sets[state]:
                return best
            stem = self.found[state][1]
            if stem and (best is None or stem < best):
                best = stem
        whole = self.found[state][0]
        return whole if whole and (best is None or whole < best) else best


def quoted(words: list[str], raw: list[str], at: int) -> bool:
    """Whether the context window before a word makes it a quotation."""
    window = raw[max(0, at - WINDOW):at + 1]
    open_marks = sum(w[:1] == '"' or w[:1] in _OPENING for w in window)
    closed = sum(w.rstrip(".,;:!?")[-1:] == '"' or w.rstrip(".,;:!?")[-1:] in _CLOSING
                 for w in window[:-1])
    return open_marks > closed or any(w in REPORTING for w in words[max(0, at - 3):at])


@dataclass
class Model:
    terms: dict[str, tuple[bool, int]]
    strength: dict[str, float]
    weights: np.ndarray = field(default_factory=lambda: np.array(
        [-3.0, 1.0, 0.8, 0.7, 0.3, 0.2, 0.1, 0.5]))
    automaton: Automaton | None = None
    cache: dict[str, int] = field(default_factory=dict)
    exempt: frozenset[str] = frozenset()  # words near a term that are no misspellings
    inexact: dict[str, float] = field(default_factory=dict)  # strength of hits with errors

    def __getstate__(self):
        return {"terms": self.terms, "strength": self.strength, "weights": self.weights,
                "automaton": None, "cache": {}, "exempt": self.exempt,
                "inexact": self.inexact}

    def hits(self, text: str) -> list[tuple[int, int, str]]:
        """(index of the word, errors, term) of every hit."""
        if self.automaton is None:
            self.automaton = Automaton(self.terms)
        words, out, cache = words_of(text), [], self.cache
        for i, w in enumerate(words):
            found = cache.get(w, 0)
            if found == 0:
                if len(cache) > FLUSH:
                    cache.clear()
                found = self.automaton.match(w)
                if found and found[0] and w in self.exempt:
                    found = None
                cache[w] = found
            if found is not None:
                out.append((i, *found))
        return out

    def features(self, text: str | None) -> np.ndarray:
        """Strongest hit of each kind, and the logarithm of 1 + hits in own
        words per 100 words."""
        x = np.zeros(_FEATURES)
        if text and self.terms:
            found = self.hits(text)
            if found:
                raw = text.lower().split()
                words = words_of(text)
                own = 0
                for i, e, term in found:
                    quote = quoted(words, raw, i)
                    own += not quote
                    kind = e + 3 * quote
                    strength = self.strength[term]
                    x[kind] = max(x[kind], self.inexact.get(term, strength) if e else strength)
                x[-1] = np.log1p(100 * own / len(words))
        return x

    def score(self, text: str | None) -> float:
        z = self.weights[0] + self.weights[1:] @ self.features(text)
        return float(1 / (1 + np.exp(-z)))

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 400) -> None:
        """Logistic regression with the initial weights as the mean of a
        normal prior; the weights of hits stay positive."""
        prior = self.weights.copy()
        if not len(y):
            return
        design = np.hstack([np.ones((len(x), 1)), x])
        w, strength = prior.copy(), 2.0
        for _ in range(steps):  # projected Newton steps on the diagonal
            p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
            grad = design.T @ (p - y) + strength * (w - prior)
            curve = (design ** 2).T @ (p * (1 - p)) + strength
            w = w - 0.3 * grad / curve
            w[1:] = np.maximum(w[1:], 0)
        self.weights = w


def _document_terms(batches):
    """How many toxic and clean texts have a word, or a beginning of one."""
    counts: dict[tuple[str, bool], list[int]] = {}

    def flush():
        keys = list(counts)
        out = pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys]),
             *(pa.array([counts[k][i] for k in keys], pa.int64()) for i in (0, 1))],
            names=["term", "stem", "clean", "toxic"])
        counts.clear()
        return out

    low, high = STEM_LENGTH
    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1)):
            words = set(words_of(text.as_py()))
            terms = {(w, False) for w in words if len(w) >= 3}
            terms |= {(w[:n], True) for w in words for n in range(low, min(high, len(w) - 1) + 1)}
            for t in terms:
                counts.setdefault(t, [0, 0])[toxic.as_py()] += 1
            if len(counts) > FLUSH:
                yield flush()
    if counts:
        yield flush()


def _surroundings(candidates: dict[str, bool]):
    """Distinct (term, word before, word) in toxic texts."""
    low, high = STEM_LENGTH

    def run(batches):
        for batch in batches:
            seen = set()
            for text in batch.column(0):
                before = ""
                for w in words_of(text.as_py()):
                    if candidates.get(w) is False:
                        seen.add((w, before, w))
                    for n in range(low, min(high, len(w) - 1) + 1):
                        if candidates.get(w[:n] + "*"):
                            seen.add((w[:n] + "*", before, w))
                    before = w
            yield pa.RecordBatch.from_arrays(
                [pa.array([s[i] for s in seen], pa.string()) for i in range(3)],
                names=["term", "before", "word"])
    return run


def _near(model: Model):
    """Words within the errors of a term, with the class of each text that
    has them."""
    def run(batches):
        for batch in batches:
            found, y = [], []
            for text, toxic in zip(batch.column(0), batch.column(1)):
                all_words = words_of(text.as_py())
                near = {(t, all_words[i]) for i, e, t in model.hits(text.as_py()) if e}
                found += near
                y += [toxic.as_py()] * len(near)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([f[i] for f in found], pa.string()) for i in range(2)),
                 pa.array(y, pa.int32())], names=["term", "word", "y"])
    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn terms and weights from the rows of ``docs`` that ``labels``
    names, of which about ``sample_rows`` are taken. Null texts and labels
    are left out; without rows of both classes the model has no terms."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    n = known.count()
    grain = 1 << 30
    share = int(min(1.0, sample_rows / max(n, 1)) * grain)
    chosen = known.filter(F.pmod(F.xxhash64(id_col, F.lit(21)), F.lit(grain)) < share).select(
        F.col(id_col).alias("_id"), (F.col(label_col) > 0).cast("int").alias("y"))
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(
        F.broadcast(chosen), "_id").filter("text is not null")  # bounded by sample_rows
    sample = materialize(sample.select("text", "y").distinct(), "toxicity-sample")
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        release(sample)
        return Model({}, {})
    ratio = (F.col("toxic") / sizes[1]) / ((F.col("clean") + 0.1) / sizes[0])
    rows = (sample.mapInArrow(_document_terms, "term string, stem boolean, clean long, toxic long")
            .groupBy("term", "stem").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
            # at most the distinct terms of the sample
            .filter((F.col("toxic") >= MIN_SUPPORT) & (ratio >= MIN_RATIO)).collect())
    candidates = {r["term"] + "*" * r["stem"]: r["stem"] for r in rows}
    odds = {r["term"] + "*" * r["stem"]: float(np.log(
        (r["toxic"] + 0.5) / (sizes[1] + 1) * (sizes[0] + 1) / (r["clean"] + 0.5))) for r in rows}
    support = (sample.filter("y = 1").select("text")
               .mapInArrow(_surroundings(candidates), "term string, before string, word string")
               .groupBy("term").agg(F.countDistinct("before").alias("before"),
                                    F.countDistinct("word").alias("endings")).collect())
    held = {r["term"] for r in support if r["before"] >= MIN_SUPPORT
            and (not candidates[r["term"]] or r["endings"] >= STEM_ENDINGS)}
    stems: list[str] = []
    for term in sorted((t[:-1] for t in held if candidates[t]), key=len):
        if not term.startswith(tuple(stems)):
            stems.append(term)
    whole = [t for t in held if not candidates[t] and not t.startswith(tuple(stems))]
    terms = {t: (False, errors_allowed(t, False)) for t in whole}
    terms |= {t: (True, errors_allowed(t, True)) for t in stems}
    strength = {t: odds[t + "*" * stem] for t, (stem, _) in terms.items()}
    model = Model(terms, strength)
    # at most the distinct words of the sample
    near = (sample.select("text", "y").mapInArrow(_near(model), "term string, word string, y int")
            .groupBy("term", "word")
            .agg(F.sum(1 - F.col("y")).alias("clean"), F.sum("y").alias("toxic"))
            .filter((F.col("clean") >= CLEAN_NEIGHBOURS) & (ratio < MIN_RATIO)).collect())
    once: dict[str, int] = {}
    for r in near:
        once[r["term"]] = once.get(r["term"], 0) + (r["clean"] == 1)
    base = {r["term"] + "*" * r["stem"]: r["clean"] + 0.5 for r in rows}
    clean = {t: base[t + "*" * stem] for t, (stem, _) in terms.items()}
    inexact = {t: max(0.0, strength[t] + float(np.log(clean[t] / (clean[t] + n))))
               for t, n in once.items()}
    # weights are fitted with each text as one not learned from: what it alone
    # has is not exempt
    model = Model(terms, strength, inexact=inexact,
                  exempt=frozenset(r["word"] for r in near if r["clean"] > 1))
    learned = Model(terms, strength, inexact=inexact, exempt=frozenset(r["word"] for r in near))

    def measure(batches):
        for batch in batches:
            x = [model.features(t.as_py()).tolist() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)],
                                             names=["x", "y"])

    rows = sample.select("text", "y").mapInArrow(measure, "x array<double>, y int").collect()
    learned.fit(np.array([r["x"] for r in rows]).reshape(-1, _FEATURES),
                np.array([r["y"] for r in rows], float))
    release(sample)
    return learned


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, text_col: str = "text",
          threshold: float = 0.7, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the score 0 to 1 and whether
    it reaches the threshold (1 or 0); input columns of these names are
    replaced. Null and empty texts have no hits and get the score of that.
    An empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in (keep or docs.columns) if c not in names]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], 
                         F.col(text_col).alias(spare("text_to_score", kept)))
    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).schema.add(names[0], "double").add(
        names[1], "integer")

    def run(batches):
        for batch in batches:
            scores = np.array([shared.value.score(t.as_py()) for t in batch.column(len(kept))], float)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(kept)], pa.array(scores),
                 pa.array((scores >= threshold).astype(np.int32))], names=[*kept, *names])

    return source.mapInArrow(run, schema)
