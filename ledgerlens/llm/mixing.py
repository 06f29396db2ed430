"""Mixing sources to target weights by Poisson replication.

Each source has a target repetition rate. A document's number of copies
inverts the Poisson distribution with that mean at a uniform number hashed
from seed, id, text and source, so the mixture is reproducible and
independent of partitions. Rows that agree in these are numbered, and the
number is hashed as well: each is drawn on its own, so that a row repeated
a million times counts like a million rows. Documents are exploded by their
count and shuffled globally by a hash of document and copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import row_digest, small_side
from ledgerlens.operators.materialize import materialize

SEED = 4711
EXPONENT = 0.5  # target weight of a source: its row count to this power
EPOCHS = 1.0
# exp(-rate) must not underflow; a larger rate is a sum of independent parts
_PART = 500.0
_CHUNK = 4096  # equal rows made in one go


def _identity(id_col: str, text_col: str, source_col: str, seed: int) -> Column:
    return F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")),
                       F.md5(F.coalesce(F.col(text_col), F.lit(""))),
                       F.coalesce(F.col(source_col).cast("string"), F.lit("")))


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (with ``_key`` and the digest ``_h1, _h2`` of the whole row),
    each with a key of its own: the second and later rows of a key get their
    number appended.

    Keys are counted first. Rows with a key of their own, nearly all, stay
    where they are; of the others every distinct row is taken once and made
    again as often as it occurs, in chunks that are dealt to all tasks."""
    kinds = rows.groupBy("_key", "_h1", "_h2").agg(F.count(F.lit(1)).alias("_n"))
    repeated = kinds.groupBy("_key").agg(F.sum("_n").alias("_all")).filter("_all > 1").select("_key")
    # as many rows as a key has different rows
    before = Window.partitionBy("_key").orderBy("_h1", "_h2").rowsBetween(Window.unboundedPreceding, -1)
    kinds = materialize(kinds.join(repeated, "_key").select(
        "_h1", "_h2", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")),
        "repeated-rows")
    own, side = rows.drop("_h1", "_h2"), small_side(kinds)
    once = rows.join(side.select("_h1", "_h2"), ["_h1", "_h2"], "left_anti").select(own.columns)
    again = rows.join(side, ["_h1", "_h2"]).dropDuplicates(["_h1", "_h2"])
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {_CHUNK}")))
    again = again.withColumn("_chunk", chunk).repartition("_h1", "_h2", "_chunk")
    last = F.least(F.lit(_CHUNK).cast("long"), F.col("_n") - F.col("_chunk") * _CHUNK)
    again = again.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), last)))
    nth = F.col("_before") + F.col("_chunk") * _CHUNK + F.col("_i")
    again = again.withColumn("_key", F.when(nth == 1, F.col("_key")).otherwise(
        F.concat_ws("~", "_key", nth.cast("string"))))
    return once.unionByName(again.select(own.columns))


def _uniform(key: Column) -> Column:
    """52 bits of an md5 as a double in [0, 1)."""
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long").cast("double") / float(1 << 52)


def _invert(u: Column, rate: Column) -> Column:
    """Smallest k with u < P(X <= k): sums the terms of the distribution.
    The last term considered lies over 20 deviations above the mean."""
    last = F.ceil(rate + 20 * F.sqrt(rate) + 40).cast("int")
    first = F.exp(-rate)
    start = F.struct(first.alias("p"), first.alias("c"), F.lit(0).alias("k"))

    def term(acc: Column, j: Column) -> Column:
        p = acc["p"] * rate / j
        return F.when(u < acc["c"], acc).otherwise(
            F.struct(p.alias("p"), (acc["c"] + p).alias("c"), j.cast("int").alias("k")))

    return F.aggregate(F.sequence(F.lit(1), last), start, term, lambda acc: acc["k"])


def poisson_copies(key: Column, rate: Column) -> Column:
    """Number of copies of the document with this key. The rate is split
    into equal parts of at most 500, each with a number of its own."""
    parts = F.greatest(F.ceil(rate / _PART), F.lit(1)).cast("int")

    def add(acc: Column, i: Column) -> Column:
        own = F.when(i == 1, key).otherwise(F.concat_ws("#", key, i.cast("string")))
        return acc + _invert(_uniform(own), rate / parts)

    return F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), add)


def source_rates(docs: DataFrame, weights: dict | None = None, exponent: float = EXPONENT,
                 epochs: float = EPOCHS, source_col: str = "source") -> DataFrame:
    """``source, n, rate``: mean repetitions of a source's documents so that
    the mixture has ``epochs`` times the rows of ``docs`` and the sources
    their target weights: those of ``weights`` (sources not named there get
    rate 0), else proportional to the row count to the power ``exponent``.
    A null source is a source of its own."""
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(exponent))
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    sizes = materialize(sizes.withColumn("w", weight), "source-sizes")
    rows, weights = sizes.agg(F.sum("n")).scalar(), sizes.agg(F.sum("w")).scalar()
    return sizes.select("source", "n", F.when(
        weights > 0, epochs * rows * F.col("w") / weights / F.col("n")).otherwise(F.lit(0.0))
        .alias("rate"))


def mix(docs: DataFrame, weights: dict | None = None, exponent: float = EXPONENT,
        epochs: float = EPOCHS, seed: int = SEED, id_col: str = "doc_id",
        source_col: str = "source", text_col: str = "text", copy: str = "copy",
        rate: str = "rate", key: str = "mix_key") -> DataFrame:
    """The mixture: every document once for each of its copies, with the
    number of the copy (from 1), its source's rate and its place in the
    shuffled order (``mix_key``; rows are hashed to partitions and sorted by
    it). Columns of ``docs`` with these names are replaced.

    Rows with equal id, text and source are drawn one by one, each under a
    number of its own; which of them gets which number depends on their
    other columns (maps excepted) alone. Null ids, texts and sources count as
    empty in the draw. An empty table gives no rows.
    """
    rates = materialize(source_rates(docs, weights, exponent, epochs, source_col), "rates")
    side = small_side(rates.select(F.col("source").alias("_source"), F.col("rate").alias("_rate")))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    h1, h2 = row_digest([F.col(f"`{f.name}`") for f in docs.schema.fields
                         if "map<" not in f.dataType.simpleString()])
    rows = _numbered(docs.select(whole, F.col(source_col).alias("_of"), h1.alias("_h1"), h2.alias("_h2"),
                                 _identity(id_col, text_col, source_col, seed).alias("_key")))
    rows = rows.join(side, F.col("_of").eqNullSafe(F.col("_source")))
    rows = rows.withColumn("_copies", poisson_copies(F.col("_key"), F.col("_rate")))
    rows = rows.filter("_copies > 0").withColumn(
        "_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    rows = rows.withColumn("_place", F.md5(F.concat_ws("/", "_key", F.col("_copy").cast("string"))))
    rows = rows.repartition("_place").sortWithinPartitions("_place")
    kept = [F.col("_row").getField(c).alias(c) for c in docs.columns if c not in (copy, rate, key)]
    return rows.select(*kept, F.col("_copy").alias(copy), F.col("_rate").alias(rate),
                       F.col("_place").alias(key))
