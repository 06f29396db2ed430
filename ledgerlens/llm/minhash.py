"""Near-duplicate documents by a multi-index Hamming join of signatures.

A document's signature has ``CHUNKS * WIDTH`` minimum hashes of its word
shingles, cut to 16 bits each. It is split into chunks. Two signatures that
differ in at most ``2 * CHUNKS - 1`` places differ in at most one place of
some chunk, so each chunk is indexed once for each place left out: every
such pair meets under a common key, and pairs further apart often do.
Candidates are confirmed on the full shingle sets.

Documents with equal sets form one node from the start. In a bucket
(nodes under a key) of at most ``SMALL`` nodes every pair is a candidate;
in a larger one each node is first compared with the bucket's smallest
node and with the one that shares most buckets with others (the text that
copies were made from, rather than one of the copies). Then nodes that
share a bucket but not a component are compared in full, in tiles of
``TILE`` x ``TILE`` nodes: a matrix product counts the common shingles of
all their pairs, tiles inside one component are left out, and of the links
found only a spanning forest is emitted. So no link between components is
lost, no group is handled in one task, and a large group of copies costs
about two comparisons a member.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import byte_pieces, small_side, spare
from ledgerlens.llm.components import connected_components
from ledgerlens.operators.materialize import materialize, release
from ledgerlens.operators.numbering import number_rows

SHINGLE = 4
CHUNKS, WIDTH = 8, 5
PLACES = CHUNKS * WIDTH
SMALL = 8
TILE = 128
COLUMNS = 1 << 15  # shingles in one matrix product
SIMILAR_PERCENT = 80
BLOCK = 1 << 13  # shingles put through all hash functions at a time

_ODD = np.uint64(0x9E3779B97F4A7C15)
_POWERS: tuple[np.ndarray, np.ndarray] | None = None
_random = np.random.default_rng(77)
_TIMES = _random.integers(0, 1 << 63, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64 and their inverses."""
    global _POWERS
    if _POWERS is None or len(_POWERS[0]) <= n:
        size = max(n + 1, 1 << 14)
        inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        table = np.ones((2, size), np.uint64)
        table[0, 1:], table[1, 1:] = _ODD, inverse
        _POWERS = tuple(np.multiply.accumulate(table, axis=1))
    return _POWERS


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word (A-Z lower-cased), in order."""
    out = []
    for piece in byte_pieces(text.encode("utf-8", "surrogatepass").lower()):
        data = np.frombuffer(piece, np.uint8)
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = ~_BLANK[data]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        powers, inverses = _powers(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:len(data)], out=sums[1:])
        out.append(_mix((sums[ends] - sums[starts]) * inverses[starts]
                        + (ends - starts).astype(np.uint64)))
    return np.concatenate(out) if len(out) > 1 else out[0]


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    words = word_hashes(text) if text else np.zeros(0, np.uint64)
    if not len(words):
        return words
    width = min(SHINGLE, len(words))
    rolled = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        rolled = rolled * _ODD + words[i:len(words) - width + 1 + i]
    rolled = np.sort(_mix(rolled))
    first = np.ones(len(rolled), bool)
    np.not_equal(rolled[1:], rolled[:-1], out=first[1:])
    return rolled[first]


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minimum of each hash function over a non-empty set."""
    least = np.full(PLACES, ~np.uint64(0))
    for start in range(0, len(shingles), BLOCK):
        block = shingles[start:start + BLOCK]
        np.minimum(least, (block * _TIMES[:, None]).min(axis=1), out=least)
    return least


def index_keys(minima: np.ndarray) -> np.ndarray:
    """Keys of each row of minima (documents x PLACES): the signature cut
    to 16 bits a place, one key per chunk and place of it left out."""
    places = (_mix(minima) >> np.uint64(48)).reshape(-1, CHUNKS, WIDTH)
    keys = np.empty(places.shape, np.uint64)
    tags = np.arange(CHUNKS, dtype=np.uint64) * np.uint64(WIDTH)
    for out in range(WIDTH):
        packed = np.zeros(places.shape[:2], np.uint64)
        for i in range(WIDTH):
            if i != out:
                packed = (packed << np.uint64(16)) | places[:, :, i]
        keys[:, :, out] = _mix(_mix(packed) + tags + np.uint64(out))
    return keys.reshape(len(places), PLACES)


def node_id(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sketch(batches):
    for batch in batches:
        ids, sizes, minima = [], [], np.zeros((batch.num_rows, PLACES), np.uint64)
        for i, text in enumerate(batch.column(2)):
            shingles = shingle_set(text.as_py())
            sizes.append(len(shingles))
            ids.append(node_id(shingles) if len(shingles) else None)
            if len(shingles):
                minima[i] = signature(shingles)
        keys = pa.FixedSizeListArray.from_arrays(
            pa.array(index_keys(minima).ravel().view(np.int64)), PLACES)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(ids, pa.binary()),
             pa.array(sizes, pa.int64()), keys.cast(pa.list_(pa.int64()))],
            names=["doc_id", "text_hash", "digest", "n_shingles", "keys"])


def _full_sets(batches):
    """Sets of the texts that belong to their node (an id that repeats may
    bring others)."""
    for batch in batches:
        nodes, sets = [], []
        for node, digest, text in zip(batch.column(0), batch.column(1), batch.column(2)):
            shingles = shingle_set(text.as_py())
            if len(shingles) and node_id(shingles) == digest.as_py():
                nodes.append(node.as_py())
                sets.append(shingles.view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))],
            names=["node", "shingles"])


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    return (pairs.join(two, "b").join(one, "a")
            # the smaller set can be no smaller than that share of the larger one
            .filter(100 * F.least(F.size("sa"), F.size("sb"))
                    >= percent * F.greatest(F.size("sa"), F.size("sb")))
            .filter(100 * common >= percent * (F.size("sa") + F.size("sb") - common))
            .select("a", "b"))


def near_duplicates(docs: DataFrame, percent: int = SIMILAR_PERCENT, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``n_shingles``, ``component_id``
    (the smallest id reachable by links, its own included), ``kept``
    (that id is its own) and ``text_hash`` (``xxhash64`` of the text). Documents link if their shingle sets have a
    Jaccard similarity of at least ``percent`` / 100.

    Null, empty and blank texts have no shingles and link with nothing.
    Rows with equal texts lie in one component. A null id never counts as
    smallest; a component without any id, and a null id's row without
    shingles, get a null component and are kept. An id that repeats is
    judged row by row. An empty table gives no rows.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"),
                         F.col(text_col).alias("text"))
    schema = source.select("doc_id", "text_hash").schema.add("digest", "binary").add(
        "n_shingles", "long").add("keys", T.ArrayType(T.LongType()))
    sketches = materialize(source.mapInArrow(_sketch, schema), "sketches")
    nodes = (sketches.filter("digest is not null").groupBy("digest")
             .agg(F.min("doc_id").alias("rep"), F.min(F.struct("doc_id", "text_hash")).alias("at"),
                  F.first("keys").alias("keys")))
    nodes = number_rows(nodes, ["digest"], "node", label="nodes")
    # a text is fetched by id and hash, and once where rows have both in common
    repeated = materialize(sketches.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
                           .filter("n > 1"), "repeated")
    components = connected_components(_links(source, nodes, repeated, percent))
    # smallest id over the members of all nodes of a component
    label = nodes.select("node", "digest", "rep").join(components, "node", "left").select(
        "digest", "rep", F.coalesce("component", "node").alias("component"))
    least = label.groupBy("component").agg(F.min("rep").alias("component_id"))
    label = label.join(least, "component").select("digest", "component_id")
    return sketches.drop("keys").join(label, "digest", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
        .alias("component_id"), "text_hash",
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _tile_links(percent: int):
    """Links between components among the nodes of one or two tiles, as a
    spanning forest of the components."""
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        component = table.column("component").to_numpy()
        tile = table.column("tile").to_numpy()
        sets = table.column("shingles").combine_chunks()
        sizes = np.diff(sets.offsets.to_numpy())
        owner = np.repeat(np.arange(len(sizes)), sizes)
        shingle, column, seen = np.unique(sets.flatten().to_numpy(), return_inverse=True,
                                          return_counts=True)
        common = seen[column] > 1  # the others are in one set only
        kept = np.cumsum(seen > 1) - 1
        owner, column = owner[common], kept[column[common]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        low = np.flatnonzero(tile == tile.min())
        high = np.flatnonzero(tile == tile.max())
        both = np.zeros((len(low), len(high)))
        width = int((seen > 1).sum())
        for start in range(0, width, COLUMNS):
            at = slice(*np.searchsorted(column, [start, start + COLUMNS]))
            m = np.zeros((len(sizes), min(COLUMNS, width - start)), np.float32)
            m[owner[at], column[at] - start] = 1
            both += m[low] @ m[high].T
        union = sizes[low][:, None] + sizes[high][None, :] - both
        i, j = np.nonzero((100 * both >= percent * union)
                          & (component[low][:, None] != component[high][None, :]))
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        out = []
        for x, y in np.unique(np.stack([component[low[i]], component[high[j]]], axis=1), axis=0).tolist():
            rx, ry = root(x), root(y)
            if rx != ry:
                parent[max(rx, ry)] = min(rx, ry)
                out.append((min(x, y), max(x, y)))
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()),
                         "b": pa.array([x[1] for x in out], pa.int64())})
    return run


def _texts(source: DataFrame, wanted: DataFrame, repeated: DataFrame) -> DataFrame:
    """``node, digest, text``: one text for each of the nodes in ``wanted``."""
    at = F.struct(F.col("doc_id"), F.col("text_hash"))
    many = small_side(repeated.select(at.alias("_many"), F.lit(True).alias("_often")))
    wanted = wanted.join(many, F.col("at").eqNullSafe(F.col("_many")), "left").select(
        "node", "digest", "at", F.coalesce("_often", F.lit(False)).alias("often"))
    near = small_side(materialize(wanted, "wanted"))
    found = source.join(near, source["doc_id"].eqNullSafe(near["at.doc_id"])
                        & source["text_hash"].eqNullSafe(near["at.text_hash"])).select(
        "node", "digest", "text", "often")
    return found.filter("not often").union(
        found.filter("often").dropDuplicates(["node"])).drop("often")


def _links(source: DataFrame, nodes: DataFrame, repeated: DataFrame, percent: int) -> DataFrame:
    """Confirmed links ``a, b`` between nodes that hold every component
    together."""
    members = nodes.select("node", F.explode("keys").alias("key"))
    buckets = members.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("node").alias("least")).filter("n > 1")
    members = materialize(members.join(buckets, "key"), "buckets")
    # texts are read again only for the nodes that share a bucket
    wanted = materialize(members.select("node").distinct().join(nodes, "node").select(
        "node", "digest", "at"), "candidates")
    sets = materialize(_texts(source, wanted, repeated).mapInArrow(
        _full_sets, "node long, shingles array<long>"), "shingle-sets")
    release(wanted)
    few = members.filter(F.col("n") <= SMALL).groupBy("key").agg(
        F.sort_array(F.collect_list("node")).alias("x"))
    few = few.select(F.col("x"), F.posexplode("x").alias("i", "a")).select(
        "a", F.explode(F.expr(f"slice(x, i + 2, {SMALL})")).alias("b"))
    many = members.filter(F.col("n") > SMALL)
    shared = many.groupBy("node").agg(F.sum("n").alias("shared"))
    centres = many.join(shared, "node").groupBy("key").agg(
        F.max(F.struct("shared", F.col("node").alias("centre"))).alias("c"))
    pivots = many.join(centres, "key").select("node", F.explode(F.array(
        "least", "c.centre")).alias("p"))
    pairs = few.union(pivots.filter("node <> p").select(
        F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b"))).distinct()
    found = materialize(_confirm(pairs, sets, percent), "confirmed")
    labels = connected_components(found)
    placed = materialize(many.select("key", "node").join(labels, "node", "left").select(
        "key", "node", F.coalesce("component", "node").alias("component")), "placed")
    split = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    placed = placed.join(split.filter("lo <> hi").select("key", "lo"), "key")
    late = _links_between(placed, sets, percent)
    links = late.union(labels.select(F.col("component").alias("a"), F.col("node").alias("b")))
    release(sets, members, found)
    return links


def _links_between(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between the components of nodes that share a bucket; ``placed``
    has ``key, node, component`` and the bucket's smallest component
    ``lo``. Components that meet in buckets, directly or through others,
    form a cluster, which is cut into tiles in the order of components."""
    meet = connected_components(placed.select(F.col("lo").alias("a"), F.col("component").alias("b")))
    meet = meet.select(F.col("node").alias("component"), F.col("component").alias("cluster"))
    rows = placed.select("node", "component").distinct().join(meet, "component", "left").select(
        "node", "component", F.coalesce("cluster", "component").alias("cluster"))
    rows = number_rows(rows, ["cluster", "component", "node"], label="clusters")
    first = rows.groupBy("cluster").agg(F.min("row_index").alias("first"))
    rows = materialize(rows.join(first, "cluster").select(
        "node", "component", "cluster",
        F.floor((F.col("row_index") - F.col("first")) / TILE).alias("tile")), "tiles")
    tiles = rows.groupBy("cluster", "tile").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"))
    other = tiles.select("cluster", F.col("tile").alias("tile2"), F.col("lo").alias("lo2"),
                         F.col("hi").alias("hi2"))
    pairs = tiles.join(other, "cluster").filter("tile <= tile2").filter(
        "lo <> hi or lo2 <> hi2 or lo <> lo2")
    sides = pairs.select("cluster", F.col("tile").alias("i"), F.col("tile2").alias("j"),
                         F.explode(F.array_distinct(F.array("tile", "tile2"))).alias("tile"))
    links = sides.join(rows, ["cluster", "tile"]).join(sets, "node").groupBy(
        "cluster", "i", "j").applyInArrow(_tile_links(percent), "a long, b long")
    return materialize(links, "confirmed")


def keep_one(docs: DataFrame, percent: int = SIMILAR_PERCENT, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept: of each group of near duplicates
    the row with the smallest id. Of rows with equal id and text one stays.
    Rows without shingles are kept, as are rows with a null id in a
    component without ids. All columns stay."""
    verdict = near_duplicates(docs, percent, id_col, text_col).groupBy("doc_id", "text_hash").agg(
        F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    verdict = materialize(verdict.filter("not kept or n > 1"), "verdict")
    repeated = F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text_col).alias("h"))

    def matched(rows: DataFrame, which: str, how: str) -> DataFrame:
        side = small_side(verdict.filter(which).select(
            F.struct(F.col("doc_id").alias("id"), F.col("text_hash").alias("h")).alias(name)))
        return rows.join(side, repeated.eqNullSafe(F.col(name)), how)

    name = spare("row", docs.columns)
    once = matched(docs, "kept", "left_semi").select(
        F.struct("*").alias("doc"), repeated.alias("row")).dropDuplicates(["row"]).select("doc.*")
    return matched(docs, "true", "left_anti").union(once)
