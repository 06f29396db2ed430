"""Benchmark decontamination: word windows of test items found in documents.

Every item gives its windows of ``WINDOW`` consecutive normalised words (a
shorter item gives itself). The windows are a broadcast hash table, keyed
by one word of the window, its longest: rare words make few candidates.
The words of the documents are scanned once against that table; where a
key word is met, the whole window is compared, so every hit is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ledgerlens.llm.common import BROADCAST_ROWS, lower_ascii, row_digest, small_side
from ledgerlens.operators.materialize import materialize

WINDOW = 13
# a document goes if hits / words is at least one in this many
SHARE = 20
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words in their own case; null for a null text."""
    return F.array_remove(F.split(text, _GAP), "")


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id",
                      text_col: str = "text") -> DataFrame:
    """``item, words, window`` (joined by blanks)``, size``, and the key:
    ``word`` at index ``at`` of the window, in lower case."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"),
                             words_of(lower_ascii(F.col(text_col))).alias("w"))
    items = items.filter(F.size("w") > 0)
    spans = items.select("item", F.col("w"), F.explode(F.sequence(
        F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))).alias("i"))
    spans = spans.select("item", F.slice("w", F.col("i"), F.lit(window)).alias("w")).distinct()
    longest = F.array_max(F.transform("w", lambda x, i: F.struct(
        F.length(x).alias("n"), x.alias("x"), i.alias("i"))))
    return spans.select("item", F.array_join("w", " ").alias("window"), F.size("w").alias("size"),
                        F.lower(longest["x"]).alias("word"), longest["i"].alias("at"))


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                item_text: str = "text", block: int = BROADCAST_ROWS) -> DataFrame:
    """Distinct ``doc_id, h1, h2`` (digest of the text)``, start, size,
    window`` of every window that occurs in a document, joined with
    ``item``. A window table of more than ``block`` rows is broadcast in
    blocks, one scan of the documents each."""
    windows = materialize(benchmark_windows(benchmark, window, item_col, item_text), "windows")
    table = materialize(windows.select("window", "size", "word", "at").distinct(), "window-keys")
    blocks = max(1, -(-table.count() // block))
    h1, h2 = row_digest([F.col(text_col)])
    words = docs.filter(F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), h1.alias("h1"), h2.alias("h2"),
        words_of(F.col(text_col)).alias("w"))
    scanned = words.select("doc_id", "h1", "h2", "w", F.posexplode("w").alias("pos", "x"))
    found = None
    for k in range(blocks):
        part = table.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == k)
        begin = F.col("pos") - F.col("at")
        hits = scanned.join(F.broadcast(part), F.lower("x") == F.col("word")).filter(
            (begin >= 0) & (begin + F.col("size") <= F.size("w"))).filter(
            lower_ascii(F.array_join(F.slice("w", begin + 1, F.col("size")), " ")) == F.col("window"))
        hits = hits.select("doc_id", "h1", "h2", begin.alias("start"), "size", "window")
        found = hits if found is None else found.union(hits)
    return found.distinct(), windows.select("item", "window")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE,
                  id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text: str = "text") -> DataFrame:
    """One row per distinct (id, text) with hits: ``doc_id, h1, h2``, the
    merged ``spans`` (start and end word), ``n_hit``, ``n_items`` and
    ``items_sha256``."""
    found, items = occurrences(docs, benchmark, window, id_col, text_col, item_col, item_text)
    hits = materialize(found, "hits")
    key = ["doc_id", "h1", "h2"]
    by_start = Window.partitionBy(*key).orderBy("start")
    spans = hits.select(*key, "start", (F.col("start") + F.col("size")).alias("stop")).distinct()
    reached = F.coalesce(F.max("stop").over(by_start.rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select(*key, F.greatest("start", reached).alias("start"), "stop").filter(
        "stop > start").groupBy(*key).agg(
        F.sum(F.col("stop") - F.col("start")).cast("long").alias("n_hit"),
        F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    named = hits.select(*key, "window").distinct().join(small_side(items), "window").select(
        *key, "item").distinct().groupBy(*key).agg(F.sort_array(F.collect_list("item")).alias("items"))
    a, b = spans.alias("a"), named.alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key]
    return a.join(b, same, "left").select(
        *[F.col(f"a.{c}") for c in key], "spans", "n_hit",
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"))


def _matched(docs: DataFrame, found: DataFrame, id_col: str, text_col: str, how: str) -> DataFrame:
    h1, h2 = row_digest([F.col(f"d.{text_col}")])
    on = [F.col(f"d.{id_col}").eqNullSafe(F.col("f.doc_id")), h1 == F.col("f.h1"),
          h2 == F.col("f.h2")]
    return docs.alias("d").join(found.alias("f"), on, how)


def _contaminated(n_hit: Column, n_words: Column, share: int) -> Column:
    return (n_hit > 0) & (share * n_hit >= n_words)


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                         share: int = SHARE, id_col: str = "doc_id", text_col: str = "text",
                         item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``n_words``, ``n_hit`` (words
    inside any occurrence), ``n_items``, ``items_sha256`` (ids of the items
    with an occurring window, sorted as strings) and ``contaminated``.

    Null and empty texts have no words; null and empty items have no
    windows; a null item id hits but is not counted or named. Equal rows
    give equal results. Without items nothing is hit. Texts are scanned
    whole.
    """
    found = materialize(contamination(docs, benchmark, window, share, id_col, text_col, item_col,
                                      item_text).drop("spans"), "contamination")
    slim = docs.select(F.col(id_col), F.col(text_col))
    joined = _matched(slim, small_side(found), id_col, text_col, "left")
    n_words = F.coalesce(F.size(words_of(F.col(f"d.{text_col}"))), F.lit(0)).cast("long")
    n_words = F.when(F.col(f"d.{text_col}").isNull(), F.lit(0)).otherwise(n_words)
    out = joined.select(
        F.col(f"d.{id_col}").alias("doc_id"), n_words.cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"))
    return out.withColumn("contaminated", _contaminated(F.col("n_hit"), F.col("n_words"), share))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents",
                  window: int = WINDOW, share: int = SHARE, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id",
                  item_text: str = "text") -> DataFrame:
    """``docs`` without the contaminated documents, or (``remove="spans"``)
    with the hit words and what follows them up to the next word cut out
    of every text. All columns stay; rows without hits are unchanged."""
    found = materialize(contamination(docs, benchmark, window, share, id_col, text_col, item_col,
                                      item_text), "contamination")
    text = F.col(f"d.{text_col}")
    if remove == "documents":
        hit = _matched(docs, small_side(found.drop("spans", "items_sha256")), id_col, text_col, "left")
        return hit.filter(~F.coalesce(_contaminated(F.col("f.n_hit"), F.size(words_of(text)), share),
                                      F.lit(False))).select("d.*")
    if remove != "spans":
        raise ValueError("remove must be 'documents' or 'spans'")
    gaps, words = F.split(text, _WORD), words_of(text)
    pieces = F.zip_with(words, F.slice(gaps, F.lit(2), F.size(words)), lambda w, g: F.concat(w, g))
    kept = F.filter(pieces, lambda p, i: ~F.exists(
        F.col("f.spans"), lambda s: (i >= s["start"]) & (i < s["stop"])))
    cut = F.concat(gaps[0], F.array_join(kept, ""))
    rest = [F.col(f"d.`{c}`") for c in docs.columns]
    at = docs.columns.index(text_col)
    rest[at] = F.when(F.col("f.n_hit") > 0, cut).otherwise(text).alias(text_col)
    return _matched(docs, small_side(found), id_col, text_col, "left").select(*rest)
