"""Phrase collocation mining by SETM, on relations.

Texts are split into pieces and those into words. The first occurrence
relation has an entry ``doc, at, gid`` for every occurrence of a frequent word:
``gid`` numbers the word within its language, and positions count the words of
the document and one more at every end of a piece, so that adjacent positions
are adjacent words of a piece. Entries are packed: a row has a stretch of
positions, its gids as numbers of four bytes (-1 where nothing frequent
starts), ``doc`` names a run of texts of one language and ``at`` counts its
stretches. A relation is stored bucketed by document and sorted by (doc, at).
To extend phrases by a word, a relation is merge-joined with itself at
adjacent stretches, which needs no exchange, and adjacent gids become pairs;
the pairs are counted, the frequent ones get numbers, and a semi-join with
them makes the next relation. Both parts of a frequent phrase are frequent, so
nothing is lost.

Counts meet bucket by bucket: a stretch sends each of its different pairs once,
with its count, to the bucket of the pair's hash. There the counts are added
up, and the stretch gets back those of its pairs that are frequent. So no task
holds more than a bucket or a stretch, however many groups are frequent, and
nothing is broadcast or sent to the driver.

Words are cut in Python (bytes, without decoding), and packed entries are
paired, counted and looked up there in numpy; dealing, sorting and joining of
rows is Spark's.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from contextlib import contextmanager
from functools import partial
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import BROADCAST_ROWS, byte_pieces, small_side
from ledgerlens.operators.materialize import materialize, release, remove_at_exit, scratch_path

MIN_COUNT = 30
LONGEST = 4
TOP = 2000
COVER_PERCENT = 80  # a longer phrase with this share of the count takes the place
SCORE_SCALE = 2_000_000
NO_LANG = "und"
PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
ROWS_OUT = 500_000  # positions that a task holds before it returns a stretch
COUNTS_HELD = 1_000_000  # words that it holds before it returns their counts
BUCKET_WORDS = 4_000_000  # words of all texts for each bucket of counts
FEW_BUCKETS = 200  # no more only because there are more partitions: each costs every stretch a row
BATCH_BYTES = "1m"  # rows sent to Python at once
# Parquet would look only after a hundred rows whether a page or row group is full
LARGE_ROWS = {"parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1",
              "parquet.block.size": str(16 << 20)}
MOST_GROUPS = 2**31  # numbers of two groups share 64 bits

# every end of a piece becomes a line feed, a tab a space, A to Z lower case
_FOLD = bytes.maketrans(PIECE_ENDS + b"\tABCDEFGHIJKLMNOPQRSTUVWXYZ",
                        b"\n" * len(PIECE_ENDS) + b" abcdefghijklmnopqrstuvwxyz")


def _cut(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``letters, sizes, at`` of folded data: the words one after another, their
    sizes, and their positions, which leave out a number at every end of a
    piece; the last position is that after the data."""
    data = np.frombuffer(data, np.uint8)
    ends = data == 10
    # of the bytes that split() takes for blanks only spaces are left
    blank = ends | (data == 32)
    edges = np.flatnonzero(np.diff(blank, prepend=True, append=True))
    starts, ends = edges[::2], np.flatnonzero(ends)
    at = np.arange(len(starts) + 1) + np.append(np.searchsorted(ends, starts), len(ends))
    return data[~blank], edges[1::2] - starts, at


def _words(letters: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [
        None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(letters))])


def piece_words(text: bytes):
    """``(words, at)`` of a text, part by part: its words, and their positions,
    which leave out a number at every end of a piece."""
    start = 0
    # a part ends after a blank, within a piece or at its end
    for part in byte_pieces(text.translate(_FOLD)):
        letters, sizes, at = _cut(part)
        if len(sizes):
            yield _words(letters, sizes).to_pylist(), start + at[:-1]
        start += at[-1]


class _Stretch:
    """Positions of texts of one language. Any gap is one position wide."""

    def __init__(self, doc: int, at: int):
        self.doc, self.at, self.end, self.size = doc, at, -1, 0
        self.places, self.letters, self.sizes = [], [], []

    def add(self, letters: np.ndarray, sizes: np.ndarray, steps: np.ndarray) -> None:
        """Words, each so many positions after the one before."""
        places = self.end + np.cumsum(np.minimum(steps, 2), dtype=np.int32)
        self.places.append(places)
        self.letters.append(letters)
        self.sizes.append(sizes)
        self.end = int(places[-1])
        self.size += len(places) + len(letters) // 8

    def packed(self) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """The word's number at every position, -1 at ends, the words by number
        and their counts."""
        words = _words(np.concatenate(self.letters), np.concatenate(self.sizes)).dictionary_encode()
        codes = words.indices.to_numpy()
        out = np.full(self.end + 1, -1, np.int32)
        out[np.concatenate(self.places)] = codes
        return out, words.dictionary.to_pylist(), np.bincount(codes)


def _stretches(batches, most: int):
    """(lang, text) -> ``lang, stretch``, with at most about ``most`` positions
    or eight letters each held at a time. What goes on after a stretch goes on
    in the next one of the same ``doc``."""
    task = TaskContext.get()
    doc = (task.partitionId() if task else 0) << 32
    held, size = {}, 0
    for batch in batches:
        texts = defaultdict(list)
        for lang, text in zip(batch.column("lang").to_pylist(),
                              batch.column("text").cast(pa.binary()).to_pylist()):
            texts[lang].append(text)
        for lang in list(texts):
            # between two texts a piece ends
            last = -2
            start = 0
            for part in byte_pieces(b"\n".join(texts.pop(lang)).translate(_FOLD)):
                letters, sizes, at = _cut(part)
                at += start
                start = at[-1]
                if not len(sizes):
                    continue
                if lang not in held:
                    held[lang] = _Stretch(doc, 0)
                    doc += 1
                before = held[lang].size
                held[lang].add(letters, sizes, np.diff(at[:-1], prepend=last))
                size += held[lang].size - before
                last = at[-2]
                while size > most:
                    longest = max(held, key=lambda name: held[name].size)
                    full = held.pop(longest)
                    size -= full.size
                    yield longest, full
                    if longest == lang:
                        held[lang] = _Stretch(full.doc, full.at + 1)
            if lang in held and held[lang].end < 0:
                del held[lang]
    yield from held.items()


def _strings(words: list[bytes]) -> pa.Array:
    return pa.array(words, pa.binary()).view(pa.string())


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of ``values``, cut into rows at ``ends``."""
    offsets = np.concatenate(([0], ends * values.itemsize)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [
        None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _word_counts(batches):
    """(lang, text) -> partial counts (lang, word, f)."""
    for lang, one in _stretches(batches, COUNTS_HELD):
        _, words, f = one.packed()
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(words)), _strings(words), pa.array(f, pa.int64())],
            names=["lang", "word", "f"])


WORDS = "doc long, at int, lang string, gid binary, words binary, f binary, n long"


def _word_places(batches, most: int):
    """(lang, text) -> stretches of word numbers, with their words and counts."""
    for lang, one in _stretches(batches, most):
        codes, words, f = one.packed()
        yield pa.RecordBatch.from_arrays(
            [pa.array([one.doc]), pa.array([one.at], pa.int32()), pa.array([lang]),
             pa.array([codes.tobytes()]), pa.array([b"\n".join(words)]),
             pa.array([f.astype(np.int64).tobytes()]), pa.array([int(f.sum())])],
            names=["doc", "at", "lang", "gid", "words", "f", "n"])


def _by_bucket(to: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``order, found, ends``: entries ordered by bucket, the buckets that have
    any, and where each ends."""
    order = np.argsort(to.astype(np.uint16) if buckets <= 65536 else to, kind="stable")
    sizes = np.bincount(to, minlength=1)
    found = np.flatnonzero(sizes)
    return order, found, np.cumsum(sizes[found])


DEALT_WORDS = "bucket long, doc long, at int, lang string, words binary, key binary, f binary"


def _dealt_words(batches, buckets: int):
    """Words of a stretch -> a row for each bucket that has some of them."""
    for batch in batches:
        for doc, at, lang, words, f in zip(*(c.to_pylist() for c in batch.columns)):
            words = words.split(b"\n")
            to = np.fromiter(map(crc32, words), np.int64, len(words)) % buckets
            order, found, ends = _by_bucket(to, buckets)
            words = [words[i] for i in order.tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found), pa.array([doc] * len(found)), pa.array([at] * len(found), pa.int32()),
                 pa.array([lang] * len(found)),
                 pa.array([b"\n".join(words[i:j]) for i, j in zip(chain([0], ends), ends)]),
                 _binary(order.astype(np.int32), ends), _binary(np.frombuffer(f, np.int64)[order], ends)],
                names=["bucket", "doc", "at", "lang", "words", "key", "f"])


def _rows_of_buckets(batches):
    """``bucket, rows`` where the rows of a bucket come one after another."""
    last, rows = None, []
    for batch in batches:
        for bucket, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if rows and bucket != last:
                yield last, rows
                rows = []
            last = bucket
            rows.append(row)
    if rows:
        yield last, rows


def _numbers(n: int, bucket: int, buckets: int) -> np.ndarray:
    """Numbers of a bucket's ``n`` groups; no other bucket has them."""
    if n * buckets + bucket >= MOST_GROUPS:
        raise OverflowError(f"more than {MOST_GROUPS} numbers for the frequent groups of {buckets} buckets")
    return np.arange(n) * buckets + bucket


# rows with a doc: what a stretch gets back; rows without: the groups of a bucket
FREQUENT = "doc long, at int, lang string, key binary, gid binary, f binary"


def _frequent(doc, at, lang, key, gid, f) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(doc, pa.int64()), pa.array(at, pa.int32()), pa.array(lang, pa.string()),
         key if isinstance(key, pa.Array) else pa.array(key, pa.binary()),
         gid if isinstance(gid, pa.Array) else pa.array(gid, pa.binary()), pa.array(f, pa.binary())],
        names=["doc", "at", "lang", "key", "gid", "f"])


def _frequent_words(batches, min_count: int, buckets: int):
    """Counts of words -> the frequent ones with their numbers."""
    for bucket, rows in _rows_of_buckets(batches):
        counts, texts = defaultdict(lambda: defaultdict(int)), []
        for _, _, lang, words, _, f in rows:
            words = words.split(b"\n")
            texts.append(words)
            one = counts[lang]
            for word, x in zip(words, np.frombuffer(f, np.int64).tolist()):
                one[word] += x
        often = {lang: [w for w, x in one.items() if x >= min_count] for lang, one in counts.items()}
        free = iter(_numbers(sum(map(len, often.values())), bucket, buckets).tolist())
        number = {lang: dict(zip(words, free)) for lang, words in often.items()}
        for lang, words in often.items():
            if words:
                gid, f = number[lang].values(), map(counts[lang].__getitem__, words)
                yield _frequent([None], [None], [lang], [b"\n".join(words)],
                                [np.fromiter(gid, np.int32).tobytes()], [np.fromiter(f, np.int64).tobytes()])
        back = []
        for (doc, at, lang, _, key, _), words in zip(rows, texts):
            one = number[lang]
            gid = np.fromiter((one.get(w, -1) for w in words), np.int32, len(words))
            kept = gid >= 0
            back.append((doc, at, None, np.frombuffer(key, np.int32)[kept].tobytes(),
                         gid[kept].tobytes(), None))
        yield _frequent(*zip(*back))


def _word_groups(batches):
    """Frequent words of a bucket -> a row for each."""
    for batch in batches:
        for lang, key, gid, f in zip(*(c.to_pylist() for c in batch.columns)):
            words = _strings(key.split(b"\n"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.frombuffer(gid, np.int32).astype(np.int64)), pa.array([lang] * len(words)),
                 words, words, pa.array(np.frombuffer(f, np.int64))],
                names=["gid", "lang", "phrase", "last", "f"])


def _paired(g1: bytes, g2: bytes | None) -> tuple[int, np.ndarray, np.ndarray]:
    """``n, places, keys``: positions of a stretch, those where a pair starts,
    and the pairs; ``g2`` is the stretch after it."""
    one = np.frombuffer(g1, np.int32)
    both = np.concatenate((one, np.frombuffer(g2 or b"", np.int32)[:1]))
    places = np.flatnonzero((both[:-1] >= 0) & (both[1:] >= 0))
    return len(one), places, both[places].astype(np.int64) << 32 | both[places + 1]


DEALT_PAIRS = "bucket long, doc long, at int, key binary, f binary"


def _dealt_pairs(batches, buckets: int):
    """Adjacent stretches -> their different pairs with counts, by bucket."""
    for batch in batches:
        for doc, at, g1, g2 in zip(*(c.to_pylist() for c in batch.columns)):
            keys, f = np.unique(_paired(g1, g2)[2], return_counts=True)
            to = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            order, found, ends = _by_bucket(to % buckets, buckets)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found), pa.array([doc] * len(found), pa.int64()),
                 pa.array([at] * len(found), pa.int32()), _binary(keys[order], ends),
                 _binary(f[order].astype(np.int32), ends)], names=["bucket", "doc", "at", "key", "f"])


def _frequent_pairs(batches, min_count: int, buckets: int):
    """Counts of pairs -> the frequent ones with their numbers."""
    for bucket, rows in _rows_of_buckets(batches):
        docs, ats, keys, f = zip(*rows)
        ends = np.cumsum([len(k) // 8 for k in keys])
        keys = np.frombuffer(b"".join(keys), np.int64)
        pairs, which = np.unique(keys, return_inverse=True)
        # sums below 2^53 are exact
        total = np.bincount(which, np.frombuffer(b"".join(f), np.int32)).astype(np.int64)
        often = total >= min_count
        number = np.full(len(pairs), -1, np.int32)
        number[often] = _numbers(int(often.sum()), bucket, buckets)
        if often.any():
            yield _frequent([None], [None], [None], [pairs[often].tobytes()],
                            [number[often].tobytes()], [total[often].tobytes()])
        gid = number[which]
        kept = gid >= 0
        ends = np.cumsum(kept)[ends - 1]
        yield _frequent(docs, ats, [None] * len(docs), _binary(keys[kept], ends),
                        _binary(gid[kept], ends), [None] * len(docs))


def _pair_groups(batches):
    """Frequent pairs of a bucket -> a row for each."""
    for batch in batches:
        for key, gid, f in zip(*(c.to_pylist() for c in batch.columns)):
            key = np.frombuffer(key, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.frombuffer(gid, np.int32).astype(np.int64)), pa.array(key >> 32),
                 pa.array(key & 0xFFFFFFFF), pa.array(np.frombuffer(f, np.int64))],
                names=["gid", "g1", "g2", "f"])


PACKED = "doc long, at int, gid binary"


def _packed(doc: int, at: int, gid: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([doc]), pa.array([at], pa.int32()), pa.array([gid.tobytes()])], names=["doc", "at", "gid"])


def _kept_words(batches):
    """Word numbers of a stretch and its frequent ones -> gids."""
    for batch in batches:
        for doc, at, codes, key, gid in zip(*(c.to_pylist() for c in batch.columns)):
            codes, key = np.frombuffer(codes, np.int32), np.frombuffer(b"".join(key), np.int32)
            # the last entry is for ends, with number -1
            table = np.full(max(codes.max(), key.max(initial=-1)) + 2, -1, np.int32)
            table[key] = np.frombuffer(b"".join(gid), np.int32)
            yield _packed(doc, at, table[codes])


def _kept_pairs(batches):
    """Adjacent stretches and their frequent pairs -> gids of the pairs."""
    for batch in batches:
        for doc, at, g1, g2, key, gid in zip(*(c.to_pylist() for c in batch.columns)):
            n, places, keys = _paired(g1, g2)
            often = np.frombuffer(b"".join(key), np.int64)
            order = np.argsort(often)
            often, gid = often[order], np.frombuffer(b"".join(gid), np.int32)[order]
            out = np.full(n, -1, np.int32)
            if len(often):
                found = np.minimum(np.searchsorted(often, keys), len(often) - 1)
                same = often[found] == keys
                out[places[same]] = gid[found[same]]
            yield _packed(doc, at, out)


@contextmanager
def _joined_by_bucket(spark: SparkSession):
    """Relations bucketed by document are co-partitioned for a join by
    document and position; Spark would deal them anew by both otherwise.
    Their rows are large, so few are read and sent to Python at once."""
    names = {"spark.sql.requireAllClusterKeysForCoPartition": "false",
             "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false",
             "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES,
             "spark.sql.parquet.columnarReaderBatchSize": "16"}
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n, value in names.items():
            spark.conf.set(n, value)
        yield
    finally:
        for n, value in before.items():
            spark.conf.set(n, value)


def _buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Relation:
    """Rows stored bucketed by ``doc`` and sorted by ``doc, at``. ``placed``
    says that each task already has the rows of few buckets only."""

    def __init__(self, rows: DataFrame, placed: bool):
        self.spark = rows.sparkSession
        self.path = scratch_path(self.spark, "phrases")
        self.name = "ledgerlens_phrases_" + uuid.uuid4().hex
        n = _buckets(self.spark)
        rows = rows if placed else rows.repartition(n, "doc")
        (rows.write.format("parquet").bucketBy(n, "doc").sortBy("doc", "at").options(**LARGE_ROWS)
         .option("path", self.path).saveAsTable(self.name))
        remove_at_exit(self.spark, self.path)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def adjacent(self) -> DataFrame:
        """``doc, at, g1, g2``: the merge-join of the relation with itself at
        adjacent positions; ``g2`` is null where nothing follows."""
        one = self.rows().select("doc", "at", F.col("gid").alias("g1"))
        two = self.rows().filter("at > 0").select(
            "doc", (F.col("at") - 1).alias("at"), F.col("gid").alias("g2"))
        return one.join(two.hint("merge"), ["doc", "at"], "left")

    def release(self) -> None:
        stored = self.rows()
        stored._ledgerlens_path = self.path
        self.spark.sql(f"DROP TABLE {self.name}")
        release(stored)


def _counted(dealt: DataFrame, frequent, min_count: int, buckets: int) -> DataFrame:
    """What ``frequent`` makes of the counts, bucket by bucket."""
    rows = dealt.repartition(_buckets(dealt.sparkSession), "bucket").sortWithinPartitions("bucket")
    return materialize(rows.mapInArrow(partial(frequent, min_count=min_count, buckets=buckets), FREQUENT),
                       "phrase-counts")


def _longer_groups(frequent: DataFrame, groups: DataFrame) -> DataFrame:
    """``gid, lang, phrase, last, f`` of the frequent pairs of groups."""
    counts = frequent.filter("doc IS NULL").select("key", "gid", "f").mapInArrow(
        _pair_groups, "gid long, g1 long, g2 long, f long")
    left = small_side(groups.select(F.col("gid").alias("g1"), "lang", F.col("phrase").alias("_head")),
                      BROADCAST_ROWS)
    right = small_side(groups.select(F.col("gid").alias("g2"), F.col("last")), BROADCAST_ROWS)
    named = counts.join(left, "g1").join(right, "g2").select(
        "gid", "lang", F.concat_ws(" ", "_head", "last").alias("phrase"), "last", "f")
    return materialize(named, "phrase-groups")


def _kept(rows: DataFrame, frequent: DataFrame, keep) -> Relation:
    """The relation ``doc, at, gid`` of the rows' entries whose group is
    frequent. The rows stay where they are; each gets its frequent groups."""
    back = frequent.filter("doc IS NOT NULL").select("doc", "at", "key", "gid")
    back = back.repartition(_buckets(rows.sparkSession), "doc").groupBy("doc", "at").agg(
        F.collect_list(F.struct("key", "gid")).alias("back"))
    both = rows.join(back.hint("merge"), ["doc", "at"]).select(*rows.columns, "back.key", "back.gid")
    return Relation(both.mapInArrow(keep, PACKED), placed=True)


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST,
                     text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """``lang, size, phrase, f`` of every phrase of 1 to ``longest`` words with
    at least ``min_count`` occurrences in its language (overlapping ones
    included, none across pieces), and ``lang, n``: all word occurrences.

    A null text has no words; a null language is ``und``."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    with _joined_by_bucket(spark):
        words = Relation(texts.mapInArrow(partial(_word_places, most=ROWS_OUT), WORDS), placed=False)
        totals = materialize(words.rows().groupBy("lang").agg(F.sum("n").alias("n")), "word-totals")
        n = totals.agg(F.sum("n")).first()[0] or 0
        buckets = max(min(_buckets(spark), FEW_BUCKETS), -(-n // BUCKET_WORDS))
        frequent = _counted(words.rows().select("doc", "at", "lang", "words", "f").mapInArrow(
            partial(_dealt_words, buckets=buckets), DEALT_WORDS), _frequent_words, min_count, buckets)
        groups = materialize(frequent.filter("doc IS NULL").select("lang", "key", "gid", "f").mapInArrow(
            _word_groups, "gid long, lang string, phrase string, last string, f long"), "phrase-groups")
        found = groups.select("lang", F.lit(1).alias("size"), "phrase", "f")
        relation = _kept(words.rows().select("doc", "at", F.col("gid").alias("codes")), frequent, _kept_words)
        words.release()
        release(frequent)
        for size in range(2, longest + 1):
            frequent = _counted(relation.adjacent().mapInArrow(
                partial(_dealt_pairs, buckets=buckets), DEALT_PAIRS), _frequent_pairs, min_count, buckets)
            groups = _longer_groups(frequent, groups)
            found = found.union(groups.select("lang", F.lit(size), "phrase", "f"))
            if size < longest:
                shorter, relation = relation, _kept(relation.adjacent(), frequent, _kept_pairs)
                shorter.release()
            release(frequent)
        relation.release()
    return found, totals


def _exact(column: Column | str) -> Column:
    return F.col(column).cast("decimal(20,0)") if isinstance(column, str) else column.cast("decimal(20,0)")


def _scored(candidates: DataFrame, found: DataFrame) -> DataFrame:
    """Each candidate with the numbers of its lowest-scoring cut."""
    cut = candidates.select("lang", "phrase", "a", F.split("phrase", " ").alias("w"),
                            F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k",
                     F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"),
                     F.array_join(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")), " ").alias("rest"))
    counts = found.select("lang", "phrase", "f")
    heads = small_side(counts.withColumnsRenamed({"phrase": "first", "f": "l"}))
    tails = small_side(counts.withColumnsRenamed({"phrase": "rest", "f": "r"}))
    both = cut.join(heads, ["lang", "first"]).join(tails, ["lang", "rest"])
    score = F.expr(f"CAST({SCORE_SCALE} AS DECIMAL(10,0)) * CAST(a AS DECIMAL(20,0)) "
                   "div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    worst = both.groupBy("lang", "phrase", "a").agg(
        F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("worst"))
    return worst.select("lang", "phrase", "a", "worst.l", "worst.r", "worst.score")


def _uncovered(candidates: DataFrame, percent: int) -> DataFrame:
    """Candidates that no longer candidate contains with at least ``percent``
    of their count."""
    longer = candidates.filter("size > 2").select(
        "lang", F.col("a").alias("above"), F.split("phrase", " ").alias("w"), "size",
        F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m"))
    inside = longer.select("lang", "above", "w", "m",
                           F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)).alias("at"))
    inside = inside.groupBy("lang", F.array_join(F.slice("w", F.col("at"), F.col("m")), " ").alias("phrase")
                            ).agg(F.max("above").alias("above"))
    covered = inside.join(candidates, ["lang", "phrase"]).filter(
        100 * _exact("above") >= percent * _exact("a")).select("lang", "phrase")
    return candidates.join(covered, ["lang", "phrase"], "left_anti")


def mine_collocations(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST,
                      top: int = TOP, cover_percent: int = COVER_PERCENT,
                      text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` collocations of
    every language by score, then count, descending, then phrase ascending.

    Candidates are the phrases of 2 to ``longest`` words with count ``a`` of
    at least ``min_count``. A cut into a first part (count ``l``) and the
    rest (``r``) scores floor(2000000 a / (l + r)), in exact decimals; the
    lowest-scoring cut counts, of equal ones that with the shortest first
    part. Candidates inside a longer one with ``cover_percent`` of their
    count are dropped. ``n``: word occurrences of the language. Null texts
    have no words, null languages are ``und``, repeated rows count as often
    as they occur; an empty table, or one without such phrases, gives no
    rows."""
    found, totals = frequent_phrases(docs, min_count, longest, text_col, lang_col)
    found = materialize(found, "phrases")
    candidates = found.filter("size > 1").withColumnRenamed("f", "a")
    kept = _scored(_uncovered(candidates, cover_percent), found)
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = kept.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
