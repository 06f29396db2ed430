"""Language-model scoring with a log-bilinear model.

Tokens are blank-separated words (A-Z lower-cased) and one end per text.
The model predicts a token's class from the class of the token before:
the logarithm of the probability is bilinear in two learned vectors, plus
a bias. Frequent words are classes of their own; the others share classes
by their last bytes, inside which a word has its smoothed share of the
class. The vectors are trained in numpy by noise-contrastive estimation on
the class pair counts of all training documents, with the noise taken in
expectation: each step is a few matrix products. One matrix product also
gives the normalised log-probabilities of every class after every other,
so that scoring a token is a lookup.

Word counts cover all training documents. The most frequent words are
broadcast; tokens outside them are joined with the count table by word.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import spare, word_pieces
from ledgerlens.operators.materialize import materialize

VOCABULARY = 1400  # frequent words with a class of their own, at most
SUFFIX_CLASSES = 509
FREQUENT = 200_000  # words whose counts are broadcast, at most
DIMENSIONS = 40
NOISE = 10.0  # noise tokens for each token
EPOCHS = 60
RATE = 0.05
# A context's prediction and the unigram weigh alike at this many tokens.
CONTEXT_TOKENS = 20.0
FLUSH = 300_000  # distinct words a task holds before it hands them on
END = b""  # no word is empty


def suffix_class(word: bytes) -> int:
    """Class of a word that has none of its own."""
    return (word[-1] * 263 + (word[-2] if len(word) > 1 else 0)) % SUFFIX_CLASSES


def _count_words(batches):
    counts: Counter = Counter()

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()),
                                          pa.array(list(counts.values()), pa.int64())],
                                         names=["word", "c"])
        counts.clear()
        return out

    for batch in batches:
        for text in batch.column(0):
            for words in word_pieces(text.as_py()):
                counts.update(words)
            counts[END] += 1
            if len(counts) > FLUSH:
                yield flush()
    if counts:
        yield flush()


def _threshold(counts: DataFrame, most: int) -> int:
    """The smallest count (of two leading digits) that at most ``most``
    words reach."""
    step = F.pow(F.lit(10.0), F.greatest(F.floor(F.log10("c")) - 1, F.lit(0))).cast("long")
    bins = counts.groupBy((F.col("c") - F.col("c") % step).alias("c")).agg(
        F.count(F.lit(1)).alias("n")).orderBy(F.desc("c")).collect()  # about 90 a power of ten
    total, least = 0, (bins[0]["c"] + 1 if bins else 1)
    for row in bins:
        total += row["n"]
        if total > most:
            break
        least = row["c"]
    return int(least)


@dataclass
class Model:
    words: dict[bytes, int]  # broadcast words -> index
    log_count: np.ndarray  # log10(c + 0.5) by index
    known: np.ndarray  # c > 0 by index
    token_class: np.ndarray  # class by index
    own: np.ndarray  # by index: the word is its class
    class_norm: np.ndarray  # log10 of the normaliser inside a suffix class
    log_prob: np.ndarray  # classes x classes, log10, normalised by row
    n: int
    v: int
    first_suffix: int

    @property
    def base_norm(self) -> float:
        return float(np.log10(self.n + 0.5 * (self.v + 1)))

    def codes(self, words: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """Index of each word (-1: not broadcast), the words without one,
        and all classes."""
        get = self.words.get
        index = np.array([get(w, -1) for w in words], np.int64)
        classes = self.token_class[index]
        out = np.flatnonzero(index < 0)
        rare = [words[i] for i in out]
        if rare:
            classes[out] = [self.first_suffix + suffix_class(w) for w in rare]
        return index, rare, classes


def _class_pairs(model: Model):
    size = len(model.log_prob)

    def run(batches):
        total = np.zeros(size * size, np.int64)
        end = int(model.token_class[model.words[END]])
        held, length = [], 0
        for batch in batches:
            for text in batch.column(0):
                last = end
                for words in word_pieces(text.as_py()):
                    classes = model.codes(words)[2]
                    held.append(np.concatenate([[last], classes[:-1]]) * size + classes)
                    length += len(classes)
                    last = int(classes[-1])
                held.append(np.array([last * size + end]))
                if length > 1 << 20:
                    total += np.bincount(np.concatenate(held), minlength=size * size)
                    held, length = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=size * size)
        at = np.flatnonzero(total)
        for part in np.array_split(at, max(1, len(at) >> 18)):
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])],
                                             names=["pair", "c"])
    return run


def train_pairs(pairs: np.ndarray, dimensions: int = DIMENSIONS, epochs: int = EPOCHS,
                noise: float = NOISE, rate: float = RATE, seed: int = 5) -> np.ndarray:
    """Normalised log10 probabilities (context x class) of a log-bilinear
    model fitted by noise-contrastive estimation to a matrix of counts.

    A token w after h is told from noise by the odds exp(s(h, w)) /
    (noise * q(w)), with q the smoothed unigram and s(h, w) = r_h . q_w +
    b_w. Real pairs weigh as counted; noise pairs by their expectation.
    The fewer tokens a context has, the more the result is mixed with the
    unigram, which keeps it normalised.
    """
    size = len(pairs)
    per_context = pairs.sum(axis=1).astype(np.float64)
    total = per_context.sum()
    unigram = (pairs.sum(axis=0) + 0.5) / (total + 0.5 * size)
    rng = np.random.default_rng(seed)
    bias = np.log(unigram)
    params = [0.1 * rng.standard_normal((size, dimensions)),
              0.1 * rng.standard_normal((size, dimensions)), bias.copy()]
    params = [p.astype(np.float32) for p in params]
    if not total:
        return np.tile(np.log10(unigram).astype(np.float32), (size, 1))
    offset = np.log(noise * unigram).astype(np.float32)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    blocks = np.array_split(np.argsort(-per_context), max(1, size // 256))
    step = 0
    for epoch in range(epochs):
        pace = rate * (1 - epoch / epochs) + 0.002
        for rows in blocks:
            weight = per_context[rows].sum()
            if not weight:
                continue
            step += 1
            context, target, b = params[0][rows], params[1], params[2]
            odds = context @ target.T + b - offset
            real = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            # gradient of the expected log-likelihood by s(h, w)
            g = pairs[rows] * (1 - real) - (noise * per_context[rows, None]
                                            * unigram).astype(np.float32) * real
            g = (g / weight).astype(np.float32)
            grads = [g @ target, g.T @ context, g.sum(axis=0)]
            for p, (m, v), grad, at in zip(params, moments, grads, (rows, slice(None), slice(None))):
                m[at] = 0.9 * m[at] + 0.1 * grad
                v[at] = 0.99 * v[at] + 0.01 * grad * grad
                p[at] += pace * m[at] / (np.sqrt(v[at]) + 1e-8)
    out = np.empty((size, size), np.float32)
    for rows in blocks:
        s = (params[0][rows] @ params[1].T + params[2]).astype(np.float64)
        p = np.exp(s - s.max(axis=1, keepdims=True))
        share = (per_context[rows] / (per_context[rows] + CONTEXT_TOKENS))[:, None]
        out[rows] = np.log10(share * p / p.sum(axis=1, keepdims=True) + (1 - share) * unigram)
    return out


def train(docs: DataFrame, text_col: str = "text", vocabulary: int = VOCABULARY,
          frequent: int = FREQUENT) -> tuple[Model, DataFrame]:
    """The model and the table ``word, c`` of all word counts of ``docs``
    (null texts are empty; each text ends once)."""
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts = materialize(texts.mapInArrow(_count_words, "word binary, c long").groupBy("word")
                         .agg(F.sum("c").alias("c")), "word-counts")
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"),
                        F.count(F.lit(1)).alias("v")).first()
    least = _threshold(counts, frequent)
    # the end has a count of its own, however rare it is
    top = counts.filter((F.col("c") >= least) | (F.octet_length("word") == 0)).toArrow().to_pydict()
    found = {w: c for w, c in zip(top["word"], top["c"])}
    found.setdefault(END, 0)
    words = sorted(found, key=lambda w: (-found[w], w))
    n_own = min(vocabulary, len(words) - 1)
    ranked = [END] + [w for w in words if w != END]
    first_suffix = n_own + 1
    size = first_suffix + SUFFIX_CLASSES
    c = np.array([found[w] for w in ranked], np.int64)
    token_class = np.array([i if i <= n_own else first_suffix + suffix_class(w)
                            for i, w in enumerate(ranked)], np.int64)
    model = Model({w: i for i, w in enumerate(ranked)}, np.log10(c + 0.5), c > 0, token_class,
                  np.arange(len(ranked)) <= n_own, np.zeros(size),
                  np.zeros((size, size), np.float32), int(totals["n"]), int(totals["v"]), first_suffix)
    own = {w for w, i in model.words.items() if i <= n_own}

    def by_suffix(batches):
        n, v = np.zeros(SUFFIX_CLASSES, np.int64), np.zeros(SUFFIX_CLASSES, np.int64)
        for batch in batches:
            for word, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if word not in own:
                    n[suffix_class(word)] += k
                    v[suffix_class(word)] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SUFFIX_CLASSES, dtype=np.int32)),
                                          pa.array(n), pa.array(v)], names=["k", "n", "v"])

    for row in counts.mapInArrow(by_suffix, "k int, n long, v long").groupBy("k").agg(
            F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        model.class_norm[first_suffix + row["k"]] = np.log10(row["n"] + 0.5 * (row["v"] + 1))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def pairs_of(batches):
        yield from _class_pairs(shared.value)(batches)

    # at most size * size rows come to the driver
    seen = texts.mapInArrow(pairs_of, "pair long, c long").groupBy("pair").agg(
        F.sum("c").alias("c")).toArrow()
    matrix = np.zeros(size * size, np.float32)
    matrix[seen.column("pair").to_numpy()] = seen.column("c").to_numpy()
    shared.unpersist()
    model.log_prob = train_pairs(matrix.reshape(size, size))
    return model, counts


def score(docs: DataFrame, model: Model, counts: DataFrame, keep: list[str] | None = None,
          text_col: str = "text") -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``n_tokens``, ``n_known``,
    ``train_tokens``, ``base_score`` (smoothed unigram) and ``score`` (the
    model), both log10 probabilities of the whole text with its end.
    Columns of these names are replaced.

    A null text is empty: one end token. Words never seen in training have
    count 0 in both scores. Without training rows the scores are those of
    uniform classes. An empty table gives no rows.
    """
    names = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kept = [x for x in (keep or docs.columns) if x not in names]
    inner = [spare(x, kept) for x in ("_n_tokens", "_n_known", "_base", "_lm", "_rare")]
    n_tokens, n_known, base, lm, rare_words = inner
    row = spare("_row", kept)
    source = docs.select(*[F.col(f"`{x}`") for x in kept],
                         F.coalesce(F.col(text_col), F.lit("")).alias(spare("text_to_score", kept)))
    schema = docs.select(*[F.col(f"`{x}`") for x in kept]).schema
    for name, kind in zip(inner, (T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType(),
                                  T.ArrayType(T.BinaryType()))):
        schema = schema.add(name, kind)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def one(text: str) -> tuple:
        m = shared.value
        end = m.words[END]
        last, n, known, base, lm, unknown = int(m.token_class[end]), 1, int(m.known[end]), \
            float(m.log_count[end]), 0.0, []
        for words in word_pieces(text):
            index, rare, classes = m.codes(words)
            lm += float(m.log_prob[np.concatenate([[last], classes[:-1]]), classes].sum(dtype=np.float64))
            last = int(classes[-1])
            at = index[index >= 0]
            logs = m.log_count[at]
            base += float(logs.sum())
            shared_class = ~m.own[at]
            # share inside a suffix class; a rare word's own count follows
            lm += float(logs[shared_class].sum()) - float(m.class_norm[classes].sum())
            n += len(words)
            known += int(m.known[at].sum())
            unknown += rare
        lm += float(m.log_prob[last, m.token_class[end]])
        return n, known, base, lm, unknown

    def run(batches):
        for batch in batches:
            out = [one(t.as_py()) for t in batch.column(len(kept))]
            columns = [pa.array([x[i] for x in out], kind) for i, kind in enumerate(
                (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary())))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(kept)], *columns],
                                             names=[*kept, *inner])

    scored = materialize(source.mapInArrow(run, schema).withColumn(
        row, F.monotonically_increasing_id()), "lm-scores")
    rare = scored.select(F.col(row).alias("of"), F.explode(rare_words).alias("word")).join(
        counts, "word", "left")
    rare = rare.groupBy("of").agg(
        F.sum(F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5))).alias("log"),
        F.count("c").alias("known"))
    scored, rare = scored.alias("s"), rare.alias("r")
    rare_log = F.coalesce("r.log", F.lit(0.0))
    return scored.join(rare, F.col(f"s.{row}") == F.col("r.of"), "left").select(
        *[F.col(f"s.`{x}`") for x in kept], F.col(f"s.{n_tokens}").alias("n_tokens"),
        (F.col(f"s.{n_known}") + F.coalesce("r.known", F.lit(0))).alias("n_known"),
        F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col(f"s.{base}") + rare_log - F.col(f"s.{n_tokens}") * F.lit(model.base_norm))
        .alias("base_score"),
        (F.col(f"s.{lm}") + rare_log).alias("score"))
