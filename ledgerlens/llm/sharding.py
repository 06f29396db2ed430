"""Sharding: a reproducible global shuffle into equal shards.

Rows are numbered globally in the order of their id and content
(:func:`ledgerlens.operators.numbering.number_rows`). A keyed Feistel
permutation of the numbers 0 .. N-1 gives each row its position in the
shuffled order; shard and slot follow from the position by division, so
that both can be computed for any row number, and back, without data.

The permutation works on Z_a x Z_b with a = ceil(sqrt(N)) and
b = ceil(N / a); numbers of that domain outside 0 .. N-1 are walked on
along their cycle. Fewer than a of them exist, so one step leads out with
probability below 1 / sqrt(N).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import row_digest
from ledgerlens.operators.numbering import number_rows

N_SHARDS = 40
SEED = 20240611
ROUNDS = 4
# Enough for every N <= 256 (at most 15 numbers lie outside); beyond that a
# row needs more steps with probability below 2^-64, and then fails loudly.
WALK_STEPS = 16


def _div(x: Column, y: Column) -> Column:
    return F.call_function("div", x, y)


def _pass(x: Column, a: Column, b: Column, seed: int, inverse: bool) -> Column:
    """One pass of the network over all rounds."""
    keys = [F.lit(seed + 2 * i).cast("long") for i in range(ROUNDS)]

    def mix(value: Column, key: Column, modulus: Column) -> Column:
        return F.pmod(F.xxhash64(value, key), modulus)

    def forward(acc: Column, key: Column) -> Column:
        left = (acc["l"] + mix(acc["r"], key, a)) % a
        return F.struct(left.alias("l"), ((acc["r"] + mix(left, key + 1, b)) % b).alias("r"))

    def backward(acc: Column, key: Column) -> Column:
        right = F.pmod(acc["r"] - mix(acc["l"], key + 1, b), b)
        return F.struct(F.pmod(acc["l"] - mix(right, key, a), a).alias("l"), right.alias("r"))

    start = F.struct(_div(x, b).alias("l"), (x % b).alias("r"))
    return F.aggregate(F.array(*(keys[::-1] if inverse else keys)), start,
                       backward if inverse else forward, lambda acc: acc["l"] * b + acc["r"])


def feistel(number: Column, total: Column, seed: int = SEED, inverse: bool = False) -> Column:
    """Permutation of 0 .. total-1 applied to ``number`` (both long);
    ``inverse`` undoes it."""
    total = total.cast("long")
    a = F.ceil(F.sqrt(total.cast("double"))).cast("long")
    b = _div(total + a - 1, a)

    def step(x: Column) -> Column:
        return _pass(x, a, b, seed, inverse)

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK_STEPS - 1)), step(number.cast("long")),
                         lambda acc, _: F.when(acc < total, acc).otherwise(step(acc)))
    return walked


def place(number: Column, total: Column, n_shards: int, seed: int = SEED) -> tuple[Column, Column]:
    """Shard and slot of a row number."""
    position = feistel(number, total, seed)
    checked = F.when(position < total, position).otherwise(
        F.raise_error(F.lit("cycle walking did not end")).cast("long"))
    return (checked % n_shards).cast("int"), _div(checked, F.lit(n_shards).cast("long"))


def row_number_at(shard: Column, slot: Column, total: Column, n_shards: int,
                  seed: int = SEED) -> Column:
    """The row number that lies in a slot of a shard."""
    return feistel(slot.cast("long") * n_shards + shard, total, seed, inverse=True)


def assign_shards(docs: DataFrame, n_shards: int = N_SHARDS, seed: int = SEED,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id`` (under that name), ``size`` (UTF-8
    bytes of the text, none for a null, plus 16), ``text_crc32`` (0 for a
    null text), the row's digest ``h1, h2``, ``row_index``, ``shard`` and
    ``slot``.

    Shards differ by at most one row; slots run from 0 without a gap. The
    result depends on the rows alone, not on their order or partitions.
    Rows are identified by all their columns (maps excepted): equal rows
    are counted before the shuffle and numbered as copies, so their places
    are interchangeable. Nulls sort first. An empty table gives no rows.
    """
    text = F.col(text_col)
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields
              if "map<" not in f.dataType.simpleString()]
    h1, h2 = row_digest(hashed)
    keyed = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16).alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        h1.alias("h1"), h2.alias("h2"))
    rows = keyed.groupBy("doc_id", "size", "text_crc32", "h1", "h2").agg(
        F.count(F.lit(1)).alias("copies"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")
    rows = number_rows(rows, ["doc_id", "h1", "h2", "copy"], total="n_rows", label="shard-rows")
    shard, slot = place(F.col("row_index"), F.col("n_rows"), n_shards, seed)
    return rows.select("doc_id", "size", "text_crc32", "h1", "h2", "row_index",
                       shard.alias("shard"), slot.alias("slot"))


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS, seed: int = SEED,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows of ``docs`` with ``shard`` and ``slot`` (columns of these
    names are replaced). Each distinct row is shuffled once and then
    repeated for its copies; see :func:`assign_shards` for nulls, ties and
    empty tables."""
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields
              if "map<" not in f.dataType.simpleString()]
    h1, h2 = row_digest(hashed)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    distinct = docs.select(h1.alias("h1"), h2.alias("h2"), whole.alias("doc")).groupBy(
        "h1", "h2").agg(F.first("doc").alias("doc"))
    places = assign_shards(docs, n_shards, seed, id_col, text_col).select(
        "h1", "h2", "shard", "slot")
    kept = [F.col("doc").getField(c).alias(c) for c in docs.columns if c not in ("shard", "slot")]
    return distinct.join(places, ["h1", "h2"]).select(*kept, "shard", "slot")
