"""Exact top-k search with multi-resolution segment statistics.

A vector is described at several resolutions, from one segment to many, by
the mean and deviation of each segment. For a segment of n components

    |q - v|^2  >=  n (mean_q - mean_v)^2 + n (dev_q - dev_v)^2,

so with the features sqrt(n) mean and sqrt(n) dev the squared distance of
two feature rows is a lower bound of that of the vectors, and finer
segments give a higher one. Since |q|^2 and |v|^2 are known, a lower bound
of the distance is an upper bound of the inner product
(|q|^2 + |v|^2 - d^2) / 2, so one search serves both orders.

Rows are ordered by the signs of their segment means, coarse to fine, and
cut into stripes of bounded size. Each query first gets a threshold: the
k-th best exact score in its own stripe. Then blocks of queries meet
stripes: by the ranges of their features as a whole, where a pair that
cannot reach any threshold of the block is not even shipped, and then row by
row, coarse to fine. The exact distance is computed for what is left. A
task holds one block and one stripe at a time; each returns at most k rows
a query. No vector passes through the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import row_digest, small_side
from ledgerlens.llm.veccodes import digits, finite
from ledgerlens.operators.materialize import materialize
from ledgerlens.operators.numbering import number_rows

K = 5
EVERY = 50
SCALE = 256
LEVELS = (1, 4, 16)  # segments of each resolution
ORDER_SEGMENTS = (1, 2, 4, 8)  # whose signs order the rows
CELLS = 1 << 19  # components in a stripe of candidates or a block of queries
SIDE = 1024  # rows bounded at a time inside a task
DENSE = 0.02  # share of pairs left from which all products are cheaper than single ones


def _segments(length: int, count: int) -> np.ndarray:
    """Bounds of ``count`` segments (fewer in shorter vectors)."""
    count = max(1, min(count, length))
    return np.array([length * i // count for i in range(count + 1)])


def features(x: np.ndarray, count: int) -> np.ndarray:
    """sqrt(n) * mean and sqrt(n) * deviation of every segment."""
    if not x.shape[1]:
        return np.zeros((len(x), 2))
    cut = _segments(x.shape[1], count)
    size = np.diff(cut).astype(np.float64)
    y = x.astype(np.float64)
    mean = np.add.reduceat(y, cut[:-1], axis=1) / size
    # deviations from the mean itself, so that large means lose nothing
    gap = y - np.repeat(mean, np.diff(cut), axis=1)
    dev = np.sqrt(np.add.reduceat(gap * gap, cut[:-1], axis=1) / size)
    return np.concatenate([mean * np.sqrt(size), dev * np.sqrt(size)], axis=1)


def order_key(x: np.ndarray) -> np.ndarray:
    """The signs of the segment means, coarse to fine, as one number."""
    key = np.zeros(len(x), np.int64)
    for count in ORDER_SEGMENTS:
        f = features(x, count)
        for j in range(f.shape[1] // 2):
            key = 2 * key + (f[:, j] < 0)
    return key


def _squares(x: np.ndarray) -> np.ndarray:
    """Exact |x|^2 of integer rows; an error where it leaves 60 bits."""
    if x.size and x.shape[1] * float(np.abs(x.astype(np.float64)).max()) ** 2 >= 2.0 ** 60:
        raise OverflowError("components are too large for inner products in 64 bits")
    return (x * x).sum(1)


class _Best:
    """The k best (score, then smaller id, null ids last) of every query."""

    def __init__(self, k: int, thresholds: np.ndarray):
        self.k, self.floor = k, thresholds.copy()
        empty = np.zeros(0, np.int64)
        self.query = self.score = self.at = empty

    def add(self, query: np.ndarray, score: np.ndarray, at: np.ndarray, ids: np.ndarray) -> None:
        query = np.concatenate([self.query, query])
        score = np.concatenate([self.score, score])
        at = np.concatenate([self.at, at])
        order = np.lexsort((ids[at], -score, query))
        query, score, at = query[order], score[order], at[order]
        begin = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else query
        place = np.arange(len(query)) - np.repeat(begin, np.diff(np.r_[begin, len(query)]))
        last = place == self.k - 1
        self.floor[query[last]] = np.maximum(self.floor[query[last]], score[last])
        keep = place < self.k
        self.query, self.score, self.at = query[keep], score[keep], at[keep]


def search(q: np.ndarray, v: np.ndarray, v_ids: np.ndarray, k: int, thresholds: np.ndarray,
           by_distance: bool = False, levels=LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query, candidate, score)`` positions of the ``k`` best rows of ``v``
    for every row of ``q``, among those with at least the query's threshold.
    The score is the inner product, or the negated squared distance."""
    qq, vv = _squares(q), _squares(v)
    best = _Best(k, thresholds.astype(np.float64))
    resolutions = [(features(q, n), features(v, n)) for n in levels]
    # rounding of the bounds, far above what doubles lose here
    slack = 1.0 + 1e-9 * (float(qq.max(initial=0)) + float(vv.max(initial=0)))
    for start in range(0, len(v), SIDE):
        for first in range(0, len(q), SIDE):
            i, j = np.arange(first, min(first + SIDE, len(q))), np.arange(start, min(start + SIDE, len(v)))
            alive = np.ones((len(i), len(j)), bool)
            for fq, fv in resolutions:
                a, b = fq[i], fv[j]
                lower = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)
                top = -lower if by_distance else (qq[i, None] + vv[None, j] - lower) / 2
                alive &= top + slack >= best.floor[i, None]
                # queries and candidates without any pair left need no finer look
                keep, some = alive.any(1), alive.any(0)
                i, j, alive = i[keep], j[some], alive[np.ix_(keep, some)]
            if not alive.any():
                continue
            if np.count_nonzero(alive) < DENSE * alive.size:
                x, y = np.nonzero(alive)
                x, y = i[x], j[y]
                score = _scores(_products(q, v, x, y), qq[x], vv[y], by_distance)
            else:
                table = _scores(_table(q[i], v[j]), qq[i, None], vv[None, j], by_distance)
                if len(j) >= k:  # no query needs more than its k best here
                    last = np.partition(np.where(alive, table, np.iinfo(np.int64).min), len(j) - k)[:, -k]
                    best.floor[i] = np.maximum(best.floor[i], last)
                x, y = np.nonzero(alive & (table >= best.floor[i, None]))
                score = table[x, y]
                x, y = i[x], j[y]
            good = score >= best.floor[x]
            best.add(x[good], score[good], y[good], v_ids)
    return best.query, best.at, best.score


def _scores(product: np.ndarray, qq: np.ndarray, vv: np.ndarray, by_distance: bool) -> np.ndarray:
    """The exact score from |q - v|^2 = |q|^2 + |v|^2 - 2 q.v."""
    gap = qq + vv - 2 * product
    return -gap if by_distance else (qq + vv - gap) // 2


def _table(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all pairs of integer rows."""
    if float(_squares(a).max()) * float(_squares(b).max()) < 2.0 ** 104:
        # every partial sum is an integer below 2^52: exact in doubles
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return np.stack([b @ row for row in a])


def _pieces(n: int, size: int = 1 << 16):
    return (slice(start, start + size) for start in range(0, n, size))


def _products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact inner products of pairs of integer rows."""
    out = np.empty(len(i), np.int64)
    for s in _pieces(len(i)):
        out[s] = np.einsum("ij,ij->i", a[i[s]], b[j[s]])
    return out


def _rows(column) -> np.ndarray:
    """Rows of a list column whose lists are equally long."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), len(flat) // len(column)) if len(column) else np.zeros((0, 0), np.int64)


def _ids(column) -> np.ndarray:
    """Ids for ordering, null ones last."""
    return column.fill_null(np.iinfo(np.int64).max).to_numpy().astype(np.int64)


def _keyed(batches):
    """(row, vec_id, asks, v) -> the same with the order key."""
    for batch in batches:
        width = batch.column("v").value_lengths().to_numpy()
        for d in np.unique(width):
            rows = batch.filter(pa.array(width == d))
            key = order_key(_rows(rows.column("v")))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(key)], names=[*rows.schema.names, "key"])


def _ranges(x: np.ndarray) -> dict:
    """The range of every finest feature and of the squared length."""
    f, square = features(x, LEVELS[-1]), _squares(x)
    return {"low": f.min(0).tolist(), "high": f.max(0).tolist(),
            "least": int(square.min()), "most": int(square.max())}


_RANGES = "d int, low array<double>, high array<double>, least long, most long, floor double"


def _stripe_report(k: int, by_distance: bool):
    """One row with the ranges of a stripe, and one per asked vector in it with
    the ``k``-th best score that it has in the stripe (if it has so many)."""
    def run(table: pa.Table) -> pa.Table:
        x = _rows(table.column("v"))
        asked = np.flatnonzero(table.column("asked").to_numpy())
        query, _, score = search(x[asked], x, _ids(table.column("vec_id")), k,
                                 np.full(len(asked), -np.inf), by_distance)
        floor = np.full(len(asked), np.inf)
        np.minimum.at(floor, query, score.astype(np.float64))
        floor[np.bincount(query, minlength=len(asked)) < k] = -np.inf
        whole = {"stripe": table.column("stripe")[0].as_py(), "d": x.shape[1], **_ranges(x)}
        row = table.column("row").to_numpy()
        return pa.Table.from_pylist(
            [whole] + [{"row": int(row[i]), "floor": float(t)} for i, t in zip(asked, floor)],
            schema=pa.schema([("stripe", pa.int64()), ("row", pa.int64()), ("d", pa.int32()),
                              ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())),
                              ("least", pa.int64()), ("most", pa.int64()), ("floor", pa.float64())]))
    return run


def _block_report(table: pa.Table) -> pa.Table:
    """The ranges of a block of queries, and its least threshold."""
    x = _rows(table.column("v"))
    whole = {"block": table.column("block")[0].as_py(), "d": x.shape[1], **_ranges(x),
             "floor": float(table.column("floor").to_numpy().min())}
    return pa.Table.from_pylist([whole], schema=pa.schema(
        [("block", pa.int64()), ("d", pa.int32()), ("low", pa.list_(pa.float64())),
         ("high", pa.list_(pa.float64())), ("least", pa.int64()), ("most", pa.int64()),
         ("floor", pa.float64())]))


def _block_search(k: int, by_distance: bool):
    """One block of queries against one stripe of candidates."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if len(left) and len(right):
            i, j, score = search(_rows(left.column("v")), _rows(right.column("v")),
                                 _ids(right.column("vec_id")), k, left.column("floor").to_numpy(),
                                 by_distance)
        else:
            i = j = score = np.zeros(0, np.int64)
        i, j = pa.array(i, pa.int64()), pa.array(j, pa.int64())
        return pa.table({"query": left.column("row").take(i), "row": right.column("row").take(j),
                         "vec_id": right.column("vec_id").take(j), "score": pa.array(score, pa.int64())})
    return run


def _numbered_parts(placed: DataFrame, height: int, name: str) -> DataFrame:
    """``name``: numbers of parts of at most ``height`` consecutive rows (by
    ``row_index``) of one length."""
    ends = placed.groupBy("d").agg(F.min("row_index").alias("_from"), F.max("row_index").alias("_to"))
    # one row per vector length from here
    count = F.floor((F.col("_to") - F.col("_from")) / height) + 1
    before = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ends.select("d", "_from", F.coalesce(F.sum(count).over(before), F.lit(0)).alias("_off"))
    return placed.join(small_side(offsets), "d").withColumn(
        name, F.col("_off") + F.floor((F.col("row_index") - F.col("_from")) / height)).drop("_from", "_off")


def _reachable(blocks: DataFrame, stripes: DataFrame, by_distance: bool) -> DataFrame:
    """Pairs ``block, stripe`` of one vector length in which some query could
    reach its threshold, judged by the ranges of both."""
    s = stripes.select("stripe", *[F.col(c).alias(f"s_{c}") for c in ("low", "high", "least", "most")])
    spans = small_side(stripes.groupBy("d").agg(F.min("stripe").alias("lo"), F.max("stripe").alias("hi")))
    # a block lists the numbers of the stripes of its length
    pairs = blocks.join(spans, "d").withColumn("stripe", F.explode(F.sequence("lo", "hi"))).join(s, "stripe")
    above = F.zip_with("low", "s_high", lambda a, b: F.greatest(a - b, F.lit(0.0)))
    below = F.zip_with("s_low", "high", lambda a, b: F.greatest(a - b, F.lit(0.0)))
    lower = F.aggregate(F.zip_with(above, below, lambda a, b: a * a + b * b), F.lit(0.0), lambda t, x: t + x)
    squares = F.col("most").cast("double") + F.col("s_most").cast("double")
    top = -lower
    if not by_distance:
        # neither by the distance nor by the products of the ranges
        products = F.zip_with(F.arrays_zip("low", "high"), F.arrays_zip("s_low", "s_high"),
                              lambda a, b: F.greatest(a["low"] * b["s_low"], a["low"] * b["s_high"],
                                                      a["high"] * b["s_low"], a["high"] * b["s_high"]))
        top = F.least((squares - lower) / 2, F.aggregate(products, F.lit(0.0), lambda t, x: t + x))
    return pairs.filter(top + 1.0 + 1e-9 * squares >= F.col("floor")).select("block", "stripe")


def exact_top_k(vectors: DataFrame, asks: str, k: int = K, scale: int = SCALE,
                by_distance: bool = False, id_col: str = "vec_id", vector_col: str = "embedding",
                cells: int = CELLS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best rows for every row that
    fulfils the SQL condition ``asks``, itself excepted.

    Components count as floor(scale * x). The score is the inner product,
    or with ``by_distance`` the negated squared Euclidean distance; ties go
    to the smaller id, null ids last. Null vectors and those with a null or
    non-finite component take no part; vectors are compared with those of
    their own length only (empty ones score 0 with each other). Rows are
    distinct whatever their ids: repeated queries are answered each. Vectors
    whose squared length would leave 60 bits are an error. An empty table,
    or one without queries, gives no rows.

    Equal vectors are searched for once, for ``k`` + 1 rows, of which a
    query then leaves out its own; and of equal vectors only the ``k`` + 1
    with the smallest ids can be among these, so only they are candidates.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"),
                          F.coalesce(F.expr(asks), F.lit(False)).alias("asks"),
                          F.col(vector_col).alias("_x"))
    rows = rows.filter(finite(F.col("_x"))).select(
        F.monotonically_increasing_id().alias("row"), "vec_id", "asks", digits(F.col("_x"), scale).alias("v"))
    keyed = rows.mapInArrow(_keyed, "row long, vec_id long, asks boolean, v array<bigint>, key long")
    h1, h2 = row_digest([F.col("v")])
    keyed = materialize(keyed.select("*", F.size("v").alias("d"), h1.alias("h1"), h2.alias("h2")),
                        "vector-keys")
    same = ["d", "h1", "h2"]
    asked = keyed.filter("asks").select(*same).distinct().withColumn("asked", F.lit(True))
    # Spark takes the first rows of equal vectors in every task, before the shuffle
    copies = Window.partitionBy(*same).orderBy(F.col("vec_id").asc_nulls_last(), "row")
    first = keyed.drop("asks").withColumn("nth", F.row_number().over(copies)).filter(F.col("nth") <= k + 1)
    first = first.join(asked, same, "left").withColumn(
        "asked", F.col("asked").isNotNull() & (F.col("nth") == 1))
    widest = keyed.agg(F.max("d")).first()[0] or 1
    height = max(16, cells // widest)
    placed = number_rows(first, ["d", "key", "h1", "h2", "nth"], label="vector-order")
    placed = materialize(_numbered_parts(placed, height, "stripe").drop("key"), "vector-stripes")
    report = materialize(
        placed.select("stripe", "row", "vec_id", "asked", "v").groupBy("stripe").applyInArrow(
            _stripe_report(k + 1, by_distance), "stripe long, row long, " + _RANGES), "stripe-reports")
    queries = placed.filter("asked").select("row", *same, "v", F.col("row_index").alias("at")).join(
        report.filter("row is not null").select("row", "floor"), "row")
    queries = number_rows(queries, ["at"], label="vector-queries")
    queries = materialize(_numbered_parts(queries, height, "block"), "query-blocks")
    blocks = queries.select("block", "v", "floor").groupBy("block").applyInArrow(
        _block_report, "block long, " + _RANGES)
    pairs = materialize(_reachable(blocks, report.filter("row is null"), by_distance), "reachable")
    left = queries.select("block", "row", "v", "floor").join(pairs, "block")
    right = placed.select("stripe", "row", "vec_id", "v").join(pairs, "stripe")
    found = left.groupBy("block", "stripe").cogroup(right.groupBy("block", "stripe")).applyInArrow(
        _block_search(k + 1, by_distance), "query long, row long, vec_id long, score long")
    order = [F.desc("score"), F.col("vec_id").asc_nulls_last(), "row"]
    found = found.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy(*order)))
    found = materialize(found.filter(F.col("nth") <= k + 1), "vector-found")
    # every query row takes the answer of its vector, without itself
    answers = small_side(queries.select(F.col("row").alias("query"), *same).join(found, "query").groupBy(*same).agg(
        F.sort_array(F.collect_list(F.struct("nth", "row", "vec_id", "score"))).alias("best")))
    rows = keyed.filter("asks").select(F.col("vec_id").alias("query_id"), F.col("row").alias("own"), *same)
    own = rows.join(answers, same).select(
        "query_id", F.slice(F.filter("best", lambda b: b["row"] != F.col("own")), 1, k).alias("best"))
    return own.select("query_id", F.posexplode("best").alias("at", "b")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), "b.vec_id", "b.score")
