"""Vector code compression: product codes by active-entry Lloyd rounds.

Vectors become integers and are cut into parts; every part position has a
codebook. A round assigns each part to its nearest entry and replaces each
entry by the mean of its parts. The assignment is *active*: a part keeps,
with its code, the exact squared distance to its entry. If that entry did
not move in the last update, no unmoved entry can have become nearer, so
the part is compared with the moved entries only; a part whose entry moved
is compared with all of them. Of equally near entries the lower index wins
either way, so the codes are those of full comparisons.

Each round reads the table of vectors with their codes and distances and
writes a new one; entry sums are formed in every task, added up by Spark,
and only the codebooks (entries x components, whatever the number of
vectors) reach the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import small_side
from ledgerlens.operators.materialize import materialize, release

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
CHUNK = 4096  # vectors compared at a time in a task


def finite(vector: Column) -> Column:
    """Whether a vector is not null and has no null or non-finite component."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
                     & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(whole, F.lit(False))


def digits(vector: Column, scale: int = SCALE) -> Column:
    """Each component as the integer floor(scale * x), x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def part_bounds(length: int, parts: int) -> list[tuple[int, int]]:
    """``parts`` consecutive parts, equal where ``length`` divides."""
    cuts = [length * i // parts for i in range(parts + 1)]
    return list(zip(cuts, cuts[1:]))


def integer_rows(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column of ``width`` longs each."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), width)


def _check_range(x: np.ndarray) -> None:
    if x.size and 4 * x.shape[1] * float(np.abs(x.astype(float)).max()) ** 2 >= 2.0 ** 63:
        raise OverflowError("components are too large for squared distances in 64 bits")


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared Euclidean distances of integer rows, as integers."""
    top = max(float(np.abs(x).max(initial=0)), float(np.abs(entries).max(initial=0)))
    if 4 * x.shape[1] * top * top < 2.0 ** 53:  # all sums are exact in doubles
        a, b = x.astype(np.float64), entries.astype(np.float64)
        out = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None]
        return out.astype(np.int64)
    out = np.zeros((len(x), len(entries)), np.int64)
    for i in range(x.shape[1]):
        gap = x[:, i, None] - entries[None, :, i]
        out += gap * gap
    return out


def assign_part(x: np.ndarray, entries: np.ndarray, moved: np.ndarray | None,
                code: np.ndarray | None, near: np.ndarray | None
                ) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of every row of ``x`` and its squared distance.

    ``code`` and ``near`` are those of the round before and ``moved`` says
    which entries changed since; without them all entries are compared."""
    if code is None:
        every = distances(x, entries)
        code = every.argmin(1)
        return code, every[np.arange(len(x)), code]
    code, near = code.copy(), near.copy()
    which = np.flatnonzero(moved)
    if not len(which):
        return code, near
    rescan = moved[code]
    still = np.flatnonzero(~rescan)
    if len(still):
        some = distances(x[still], entries[which])
        at = some.argmin(1)
        least, index = some[np.arange(len(still)), at], which[at]
        closer = (least < near[still]) | ((least == near[still]) & (index < code[still]))
        code[still[closer]], near[still[closer]] = index[closer], least[closer]
    again = np.flatnonzero(rescan)
    if len(again):
        code[again], near[again] = assign_part(x[again], entries, None, None, None)
    return code, near


def _assign(codebook: np.ndarray, moved: np.ndarray | None, parts: int):
    """(vec_id, label, v[, code, near]) -> the same with new codes."""
    bounds = part_bounds(codebook.shape[1], parts)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                rows = batch.slice(start, CHUNK)
                x = integer_rows(rows.column("v"), codebook.shape[1])
                _check_range(x)
                old = near = None
                if moved is not None:
                    old = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8)
                    old = old.reshape(len(x), parts).astype(np.int64)
                    near = integer_rows(rows.column("near"), parts)
                codes, gaps = np.empty((len(x), parts), np.uint8), np.empty((len(x), parts), np.int64)
                for p, (a, b) in enumerate(bounds):
                    codes[:, p], gaps[:, p] = assign_part(
                        x[:, a:b], codebook[:, a:b], *((moved[p], old[:, p], near[:, p])
                                                       if moved is not None else (None,) * 3))
                flat = codes.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [rows.column("vec_id"), rows.column("label"), rows.column("v"),
                     pa.array([flat[i:i + parts] for i in range(0, len(flat), parts)], pa.binary()),
                     pa.array(list(gaps), pa.list_(pa.int64()))],
                    names=["vec_id", "label", "v", "code", "near"])
    return run


def _entry_sums(entries: int, length: int, parts: int):
    """Per task: how many parts each entry has and their sums."""
    bounds = part_bounds(length, parts)

    def run(batches):
        count = np.zeros((parts, entries), np.int64)
        total = np.zeros((entries, length), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = integer_rows(batch.column("v"), length)
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8)
            code = code.reshape(len(x), parts)
            for p, (a, b) in enumerate(bounds):
                count[p] += np.bincount(code[:, p], minlength=entries)
                np.add.at(total[:, a:b], code[:, p], x[:, a:b])
        part = np.repeat(np.arange(parts), [b - a for a, b in bounds])
        entry, at = np.nonzero(count[part].T)
        yield pa.RecordBatch.from_arrays(
            [pa.array(entry, pa.int32()), pa.array(at, pa.int32()),
             pa.array(count[part[at], entry], pa.int64()), pa.array(total[entry, at], pa.int64())],
            names=["entry", "at", "n", "total"])
    return run


def _updated(state: DataFrame, codebook: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The codebooks after replacing each used entry by the mean of its parts,
    rounded down, and which entries (part, entry) changed."""
    sums = state.select("v", "code").mapInArrow(
        _entry_sums(len(codebook), codebook.shape[1], parts),
        "entry int, at int, n long, total long")
    whole = "decimal(38,0)"
    # at most entries x components rows
    sums = sums.groupBy("entry", "at").agg(F.sum("n").alias("n"),
                                           F.sum(F.col("total").cast(whole)).alias("total")).collect()
    after = codebook.copy()
    for r in sums:
        after[r["entry"], r["at"]] = int(r["total"]) // r["n"]
    moved = np.array([(after[:, a:b] != codebook[:, a:b]).any(1)
                      for a, b in part_bounds(codebook.shape[1], parts)])
    return after, moved


def books_digest(codebook: np.ndarray, parts: int) -> str:
    """SHA-256 of all entries' components by part, entry and position."""
    text = ",".join(str(c) for a, b in part_bounds(codebook.shape[1], parts)
                    for entry in codebook[:, a:b].tolist() for c in entry)
    return hashlib.sha256(text.encode()).hexdigest()


def compress_vectors(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES,
                     rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id",
                     vector_col: str = "embedding", label_col: str = "label"
                     ) -> tuple[DataFrame, np.ndarray]:
    """Codes of all vectors, and the final codebooks (entries x components).

    One row per usable vector: ``vec_id``, ``label``, ``v`` (its integers),
    ``code`` (one byte per part), ``near`` (squared distance per part). Null
    vectors and those with a null or non-finite component are dropped. The
    codebooks start as the ``entries`` smallest ids (null ids last, equal
    ids in the order of their integers); with fewer vectors there are fewer
    entries. Vectors of another length than the first of them have a null
    code and null distances and count for no codebook. A length that the
    number of parts does not divide is cut as evenly as possible. Components
    whose distances would leave 64 bits are an error. An empty table gives
    no rows and codebooks without entries.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte per part: entries must be 1 to 256")
    source = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"),
                            F.col(vector_col).alias("_x"))
    source = source.filter(finite(F.col("_x"))).select("vec_id", "label",
                                                       digits(F.col("_x"), scale).alias("v"))
    kept = materialize(source, "vector-digits")
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    layout = (f"vec_id {kinds['vec_id']}, label {kinds['label']}, v array<bigint>, "
              "code binary, near array<bigint>")
    uncoded = ["vec_id", "label", "v", F.lit(None).cast("binary").alias("code"),
               F.lit(None).cast("array<bigint>").alias("near")]
    if not first:
        return kept.select(*uncoded), np.zeros((0, 0), np.int64)
    length = len(first[0]["v"])
    codebook = np.array([r["v"] for r in first if len(r["v"]) == length], np.int64)
    codebook = codebook.reshape(len(codebook), length)
    _check_range(codebook)
    moved, state = None, kept.filter(F.size("v") == length)
    for n in range(rounds + 1):
        following = materialize(state.mapInArrow(_assign(codebook, moved, parts), layout),
                                "vector-codes")
        if n:
            release(state)
        state = following
        if n < rounds:
            codebook, moved = _updated(state, codebook, parts)
    return state.unionByName(kept.filter(F.size("v") != length).select(*uncoded)), codebook


def compression_report(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES,
                       rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id",
                       vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` per usable
    vector: the code in lowercase hex, its squared error, that error summed
    over all vectors of the label (null labels together), and the digest of
    the codebooks. Rows and cases as :func:`compress_vectors` has them; a
    vector without a code has a null error and adds nothing to its label's.
    """
    coded, codebook = compress_vectors(vectors, parts, entries, rounds, scale, id_col,
                                       vector_col, label_col)
    out = coded.select("vec_id", "label", F.lower(F.hex("code")).alias("code"),
                       F.aggregate("near", F.lit(0).cast("long"), lambda s, x: s + x).alias("error"))
    sums = materialize(out.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    sums = small_side(sums.withColumnRenamed("label", "_label"))
    return out.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", "code", "error", "label_error",
        F.lit(books_digest(codebook, parts)).alias("codebooks_sha256"))
