"""Language identification with character language models.

One interpolated Kneser-Ney model of order 4 per language, over the
lower-cased letters of a text with every other run of characters as one
boundary. N-grams are hashed to 64 bits without collisions (16 bits a
symbol); each order is one sorted hash array with a column of
log-probabilities per language, so that one binary search serves all
languages. The language with the lowest cross-entropy per
character wins; a text whose cross-entropy is far above what its length
explains is rejected.

Models are fitted on about ``ROWS_PER_LANGUAGE`` labelled rows of each
language (chosen by a hash, whole texts), of which a fifth calibrates
scores and rejection. Counting and prediction run in Spark tasks; the
counts of the bounded sample meet on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import spare
from ledgerlens.operators.materialize import materialize, release

ORDER = 4
ROWS_PER_LANGUAGE = 1200
CHUNK = 1 << 18  # characters of a text handled at a time
UNKNOWN = "und"
# Rejection: this many times a high quantile of the excess of a language's
# calibration rows (below their largest, so that no single row sets it).
REJECT_MARGIN = 3.0
REJECT_QUANTILE = 0.99
REJECT_CHARACTERS = 2000  # a longer text deviates as one of this length does
_ALPHABET = 1 << 16  # uniform floor below the lowest order

_table: np.ndarray | None = None


def _letters() -> np.ndarray:
    """UTF-16 unit -> itself if it belongs to a letter, else 0 (built once
    per process). Halves of pairs beyond the basic plane count as letters."""
    global _table
    if _table is None:
        _table = np.array([i if 0xD800 <= i < 0xE000 or chr(i).isalpha() else 0
                           for i in range(1 << 16)], np.uint16)
    return _table


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def symbols(text: str) -> np.ndarray:
    """UTF-16 units of the lower-cased letters, one 0 for each run of other
    characters, and ORDER - 1 zeros in front."""
    units = _letters()[np.frombuffer(text.lower().encode("utf-16-le", "surrogatepass"), "<u2")]
    kept = units != 0
    kept[1:] |= kept[:-1].copy()
    units = units[kept]
    out = np.zeros(len(units) + ORDER - 1, np.uint16)
    out[ORDER - 1:] = units
    return out


def grams(codes: np.ndarray) -> np.ndarray:
    """The n-gram of order ORDER that ends at each scored position (all but
    the padding), 16 bits a symbol with the last one on top. Dropping the
    low bits gives the suffixes; the low bits are the contexts."""
    codes = np.ascontiguousarray(codes, "<u2")
    return np.ndarray((len(codes) - ORDER + 1,), "<u8", codes, strides=(2,)).astype(np.uint64)


def _suffix(keys: np.ndarray, symbols_dropped: int) -> np.ndarray:
    return keys >> np.uint64(16 * symbols_dropped)


def _context(keys: np.ndarray, order: int) -> np.ndarray:
    return keys & np.uint64((1 << 16 * (order - 1)) - 1)


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the keys in a sorted table, and which are there."""
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and how often each occurs."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.diff(first, append=len(keys))


def _pieces(text: str):
    for start in range(0, max(len(text), 1), CHUNK):
        # each piece starts with the padding as its context
        yield text[start:start + CHUNK]


@dataclass
class Model:
    """``keys[n-1]`` sorted hashes of order n; ``logp[n-1]`` their
    log-probabilities per language; ``contexts[n-1]`` sorted hashes of the
    contexts of order n and ``backoff[n-1]`` the log weight that each
    passes on to the next lower order."""

    languages: list[str]
    keys: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]
    floor: np.ndarray  # per language, for symbols never seen
    temperature: float = 1.0
    mean: np.ndarray | None = None  # median cross-entropy on calibration rows
    spread: np.ndarray | None = None  # its deviation times sqrt(characters)
    limit: np.ndarray | None = None  # per language, in those deviations

    def _piece(self, codes: np.ndarray) -> np.ndarray:
        keys, times = _runs(grams(codes))
        total = np.zeros(len(self.languages))
        at, hit = _find(self.keys[ORDER - 1], keys)
        total += times[hit] @ self.logp[ORDER - 1][at[hit]].astype(np.float64)
        # shorter n-grams count only where the longer one was never seen
        for n in range(ORDER - 1, 0, -1):
            keys, times = keys[~hit], times[~hit]
            if not len(keys):
                return total
            at, known = _find(self.contexts[n], _context(keys, n + 1))
            total += times[known] @ self.backoff[n][at[known]].astype(np.float64)
            keys = _suffix(keys, 1)
            at, hit = _find(self.keys[n - 1], keys)
            total += times[hit] @ self.logp[n - 1][at[hit]].astype(np.float64)
        return total + times[~hit].sum() * self.floor

    def cross_entropies(self, text: str) -> tuple[np.ndarray, int]:
        """Natural-log cross-entropy per character for each language, and
        the number of characters scored."""
        total, n = np.zeros(len(self.languages)), 0
        for piece in _pieces(text):
            codes = symbols(piece)
            if len(codes) >= ORDER:
                total += self._piece(codes)
                n += len(codes) - ORDER + 1
        return -total / max(n, 1), n

    def predict(self, text: str | None) -> tuple[str, float, bool, float | None]:
        """Language, score, rejected, cross-entropy."""
        if not has_letter(text) or not self.languages:
            return UNKNOWN, 0.0, True, None
        h, n = self.cross_entropies(text)
        best = int(np.argmin(h))
        score = 1.0 / np.exp((h[best] - h) * np.sqrt(n) * self.temperature).sum()
        excess = 0.0
        if self.mean is not None:
            excess = (h[best] - self.mean[best]) * np.sqrt(min(n, REJECT_CHARACTERS)) / self.spread[best]
        rejected = self.limit is not None and excess > self.limit[best]
        return self.languages[best], float(score), bool(rejected), float(h[best])

    def calibrate(self, rows: list[tuple[str, np.ndarray, int]]) -> None:
        """Fit temperature and rejection on (language, cross-entropies,
        characters) of rows that were not counted. Every row has the same
        say in rejection: medians and quantiles per language, and lengths
        up to ``REJECT_CHARACTERS``."""
        rows = [r for r in rows if r[0] in self.languages and r[2] > 0]
        size = len(self.languages)
        self.mean, self.spread, self.limit = np.zeros(size), np.ones(size), np.full(size, np.inf)
        if not rows:
            return
        h = np.array([r[1] for r in rows])
        n = np.sqrt([r[2] for r in rows])
        truth = np.array([self.languages.index(r[0]) for r in rows])
        own = h[np.arange(len(rows)), truth]
        grid = 2.0 ** np.arange(-4, 6)
        best_loss = np.inf
        for t in grid:
            z = -h * n[:, None] * t
            loss = (np.logaddexp.reduce(z, axis=1) - z[np.arange(len(rows)), truth]).mean()
            if loss < best_loss - 1e-9:
                best_loss, self.temperature = loss, float(t)
        scale = np.minimum(n, np.sqrt(REJECT_CHARACTERS))
        for k in range(size):
            mine = truth == k
            if mine.any():
                self.mean[k] = np.median(own[mine])
                off = (own[mine] - self.mean[k]) * scale[mine]
                # of a normal distribution, the deviation is 1.4826 such medians
                self.spread[k] = max(1.4826 * np.median(np.abs(off)), 1e-3)
                high = np.quantile(off, REJECT_QUANTILE, method="lower") / self.spread[k]
                self.limit[k] = max(high, 3.0) * REJECT_MARGIN


def fit(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """Model from the sorted distinct n-grams of order ORDER of each
    language and their counts."""
    languages = sorted(counts)
    size = len(languages)
    # per language and order: n-grams and their (continuation) counts
    seen: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    for v in languages:
        levels = [(counts[v][0], counts[v][1].astype(float))]
        for _ in range(ORDER - 1):
            gram, c = np.unique(_suffix(levels[0][0], 1), return_counts=True)
            levels.insert(0, (gram, c.astype(float)))
        seen[v] = levels
    keys = [np.unique(np.concatenate([seen[v][n][0] for v in languages])) for n in range(ORDER)]
    logp, contexts, backoff, prob = [], [], [], None
    floor = np.zeros(size)
    for n in range(ORDER):
        context = _context(keys[n], n + 1)
        if n:
            base = prob[np.searchsorted(keys[n - 1], _suffix(keys[n], 1))]
        else:
            base = np.full((len(keys[0]), size), 1.0 / _ALPHABET)
        known, own = np.unique(context, return_inverse=True)
        weights = np.ones((len(known), size))
        seen_part = np.zeros((len(keys[n]), size))
        for k, v in enumerate(languages):
            gram, c = seen[v][n]
            ones, twos = (c == 1).sum(), (c == 2).sum()
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            groups, member = np.unique(_context(gram, n + 1), return_inverse=True)
            totals = np.bincount(member, c)
            weights[np.searchsorted(known, groups), k] = discount * np.bincount(member) / totals
            seen_part[np.searchsorted(keys[n], gram), k] = (c - discount) / totals[member]
        prob = seen_part + weights[own] * base
        if not n:
            floor = np.log(weights[0] / _ALPHABET)
        logp.append(np.log(prob).astype(np.float32))
        contexts.append(known)
        backoff.append(np.log(weights).astype(np.float32))
    return Model(languages, keys, logp, contexts, backoff, floor)


def _nothing() -> Model:
    """A model that knows no language."""
    return Model([], [np.zeros(0, np.uint64)] * ORDER, [], [], [], np.zeros(0))


def _count(batches):
    """Distinct n-grams of each batch by language, with counts."""
    for batch in batches:
        by_lang: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(batch.column(0), batch.column(1)):
            for piece in _pieces(text.as_py()):
                codes = symbols(piece)
                if len(codes) >= ORDER:
                    by_lang.setdefault(lang.as_py(), []).append(grams(codes))
        for lang, found in by_lang.items():
            gram, count = _runs(np.concatenate(found))
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(gram), pa.string()), pa.array(gram.view(np.int64)),
                 pa.array(count.astype(np.int64))], names=["lang", "gram", "count"])


def train(labelled: DataFrame, text: str = "text", lang: str = "lang",
          row_id: str = "doc_id", rows_per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """Fit and calibrate on a sample of about ``rows_per_language`` rows of
    each language, chosen by a hash of id and text. Rows with a null text
    or language are left out; without rows the model knows no language."""
    spark = labelled.sparkSession
    rows = labelled.select(F.col(row_id).alias("id"), F.col(text).alias("text"),
                           F.col(lang).alias("lang")).filter("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in
             labelled.filter(F.col(lang).isNotNull()).groupBy(F.col(lang).alias("lang"))
             .agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return _nothing()
    grain = 1 << 30
    share = F.lit(0)
    for name, n in sizes.items():
        share = F.when(F.col("lang") == name, F.lit(int(min(1.0, rows_per_language / n) * grain))
                       ).otherwise(share)
    sample = materialize(rows.filter(F.pmod(F.xxhash64("id", "text", F.lit(11)), F.lit(grain)) < share)
                         .withColumn("check", F.pmod(F.xxhash64("text", F.lit(12)), F.lit(5)) == 0),
                         "langid-sample")
    counted = (sample.filter("not check").select("lang", "text")
               .mapInArrow(_count, "lang string, gram long, count long").groupBy("lang", "gram")
               .agg(F.sum("count").alias("count")).toArrow())
    names = np.array(counted.column("lang").to_pylist(), dtype=object)
    gram = counted.column("gram").to_numpy().view(np.uint64)
    count = counted.column("count").to_numpy()
    by = {}
    for v in sorted(set(names)):
        at = np.flatnonzero(names == v)
        at = at[np.argsort(gram[at])]
        by[v] = (gram[at], count[at])
    model = fit(by) if by else _nothing()
    shared = spark.sparkContext.broadcast(model)

    def measure(batches):
        for batch in batches:
            out = [shared.value.cross_entropies(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0].tolist() for x in out], pa.list_(pa.float64())),
                 pa.array([x[1] for x in out], pa.int64())], names=["lang", "h", "n"])

    checks = sample.filter("check").select("lang", "text").mapInArrow(
        measure, "lang string, h array<double>, n long").collect()
    model.calibrate([(r["lang"], np.array(r["h"]), r["n"]) for r in checks])
    shared.unpersist()
    release(sample)
    return model


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None,
             names: tuple[str, str, str, str] = ("lang_pred", "score", "rejected", "cross_entropy")
             ) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the predicted language, the
    score 0 to 1, whether the text is rejected, and the cross-entropy.

    A null text or one without a letter gets ``und``, score 0 and is
    rejected; so does every text if no language was learned. Long texts
    are scored whole, piece by piece. Input columns that have one of the
    new names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in (keep or docs.columns) if c not in names]
    columns = [F.col(f"`{c}`") for c in kept]
    at = spare("prediction", kept)
    # Only texts go to Python, about a hundred rows at a time: Arrow batches
    # of whole rows took hundreds of MB beside an executor's heap. Not
    # deterministic: a filter on the result must not compute it again.
    predict = F.udf(lambda t: shared.value.predict(t),
                    "lang string, score double, rejected boolean, cross_entropy double",
                    useArrow=False).asNondeterministic()
    return docs.select(*columns, predict(F.col(text)).alias(at)).select(*columns, *[
        F.col(at)[field].alias(name)
        for field, name in zip(("lang", "score", "rejected", "cross_entropy"), names)])
