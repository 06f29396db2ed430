"""Removal of lines that many documents share.

Distinct line keys are kept in levelled sorted runs, as in a log-structured
merge tree. Documents come in batches; a batch's keys are anti-joined with
the runs, the new ones become a sorted run of their own, and what a batch
adds to keys already in a run is appended beside them. Whenever a level
has ``FANOUT`` runs they are merged into one of the next level. A key is
in one run only; with it come the number of documents that hold it and
the largest of their ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import BROADCAST_ROWS, lower_ascii, row_digest
from ledgerlens.operators.materialize import materialize, release

MIN_LENGTH = 40
MIN_DOCUMENTS = 5
BATCHES = 4
FANOUT = 2
_KEY = ["h1", "h2"]
_STRIPPED = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """Blanks stripped at both ends, A-Z lower-cased."""
    return lower_ascii(F.btrim(line, F.lit(_STRIPPED)))


def split_lines(text: Column) -> Column:
    """Lines of a text; a null or empty one has one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


class LineRuns:
    """The runs: ``h1, h2`` (digest of a key)``, n, last``, each key once
    over all levels, and the additions to keys that were known."""

    def __init__(self, fanout: int = FANOUT):
        self.fanout = fanout
        self.levels: list[list[DataFrame]] = []
        self.additions: list[DataFrame] = []

    def add(self, lines: DataFrame) -> None:
        """Add a batch of ``doc_id, h1, h2``. A document must lie in one
        batch whole; its repeated keys count once, as do rows with equal
        ids. A null id is one document, smaller than all others."""
        keys = lines.groupBy(*_KEY, "doc_id").agg(F.lit(1).alias("one")).groupBy(*_KEY).agg(
            F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))
        keys = materialize(keys, "line-batch")
        new, known = keys, None
        for run in (r for level in self.levels for r in level):
            digests = run.select(*_KEY)
            new = new.join(digests.hint("merge"), _KEY, "left_anti")
            old = keys.join(digests.hint("merge"), _KEY, "left_semi")
            known = old if known is None else known.union(old)
        if known is not None:
            self.additions.append(materialize(known, "line-additions"))
        self._append(0, materialize(new.repartition(*_KEY).sortWithinPartitions(*_KEY), "line-run"))
        release(keys)

    def _append(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        runs = self.levels[level]
        runs.append(run)
        if len(runs) == self.fanout:
            merged = runs[0]
            for r in runs[1:]:
                merged = merged.union(r)
            merged = materialize(merged.repartition(*_KEY).sortWithinPartitions(*_KEY), "line-run")
            release(*runs)
            self.levels[level] = []
            self._append(level + 1, merged)

    def shared(self, min_documents: int) -> DataFrame:
        """``h1, h2, last`` of the keys in at least that many documents."""
        tables = [r for level in self.levels for r in level] + self.additions
        rows = tables[0]
        for t in tables[1:]:
            rows = rows.union(t)
        return rows.groupBy(*_KEY).agg(F.sum("n").alias("n"), F.max("last").alias("last")).filter(
            F.col("n") >= min_documents).drop("n")

    def release(self) -> None:
        release(*(r for level in self.levels for r in level), *self.additions)
        self.levels, self.additions = [], []


def _dropped_positions(docs: DataFrame, min_length: int, min_documents: int, batches: int,
                       id_col: str, text_col: str) -> DataFrame:
    """``doc_id, t1, t2`` (digest of the text)``, dropped`` (positions), for
    the texts that lose lines."""
    t1, t2 = row_digest([F.col(text_col)])
    lines = docs.select(F.col(id_col).alias("doc_id"), t1.alias("t1"), t2.alias("t2"),
                        F.posexplode(split_lines(F.col(text_col))).alias("pos", "line"))
    # a key is never longer than its line
    lines = lines.filter(F.length("line") >= min_length).select(
        "doc_id", "t1", "t2", "pos", line_key(F.col("line")).alias("key"))
    h1, h2 = row_digest([F.col("key")])
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")
    lines = materialize(lines.filter(F.length("key") >= min_length).select(
        "doc_id", "t1", "t2", "pos", h1.alias("h1"), h2.alias("h2"), batch.alias("batch")), "lines")
    runs = LineRuns()
    for i in range(batches):
        runs.add(lines.filter(F.col("batch") == i).select("doc_id", *_KEY))
    shared = materialize(runs.shared(min_documents), "shared-lines")
    runs.release()
    few = shared.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    lost = lines.join(F.broadcast(shared) if few else shared, _KEY).filter(
        ~F.col("doc_id").eqNullSafe(F.col("last"))).select("doc_id", "t1", "t2", "pos").distinct()
    lost = materialize(lost, "lost-lines")
    release(lines, shared)
    small = lost.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    lost = lost.groupBy("doc_id", "t1", "t2").agg(F.collect_list("pos").alias("dropped"))
    return F.broadcast(lost) if small else lost


def dedup_lines(docs: DataFrame, min_length: int = MIN_LENGTH, min_documents: int = MIN_DOCUMENTS,
                batches: int = BATCHES, id_col: str = "doc_id", text_col: str = "text",
                n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """``docs`` without the shared lines, with the number of lines before
    and of those dropped (columns of these names are replaced).

    A line is dropped if its key has at least ``min_length`` code points,
    is found in at least ``min_documents`` documents, and the document is
    not the one with the largest id that holds it. Null texts stay null
    and count one empty line. Rows with one id are one document. Lines that
    stay keep their order; a text may become empty. An empty table gives no
    rows.
    """
    lost = _dropped_positions(docs, min_length, min_documents, batches, id_col, text_col)
    t1, t2 = row_digest([F.col(f"d.{text_col}")])
    text = F.col(f"d.{text_col}")
    lines = split_lines(text)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("l.dropped")),
                       lambda i: F.get(lines, i))
    rest = {c: F.col(f"d.`{c}`") for c in docs.columns if c not in (n_lines, n_dropped)}
    rest[text_col] = F.when(F.col("l.dropped").isNull(), text).otherwise(F.array_join(kept, "\n"))
    on = [F.col(f"d.`{id_col}`").eqNullSafe(F.col("l.doc_id")), t1 == F.col("l.t1"),
          t2 == F.col("l.t2")]
    return docs.alias("d").join(lost.alias("l"), on, "left").select(
        *[v.alias(c) for c, v in rest.items()], F.size(lines).cast("long").alias(n_lines),
        F.coalesce(F.size("l.dropped"), F.lit(0)).cast("long").alias(n_dropped))
