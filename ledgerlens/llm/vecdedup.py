"""Near-duplicate vectors by sorted projection passes.

In every pass the vectors get a string of random hyperplane signs and are
ordered by it; each vector is compared with the next ``NEIGHBOURS`` in that
order. Pairs whose cosine, in double precision, reaches the threshold are
united over all passes. Then vectors that share a pass's first
``prefix_bits`` signs but no component are compared in full, in tiles of
``TILE`` x ``TILE``: a matrix product each, tiles inside one component are
left out, and of the links found only a spanning forest is emitted. So a
pair that agrees in these signs in any pass ends in one component, however
crowded its surroundings are; the number of passes follows from the number
of vectors, so that a pair exactly at the threshold does so with
probability ``RECALL``. Where the crowds are so large that this would
compare more than all pairs, all pairs are compared, once.

Equal vectors are one node from the start. The links of a vector are then
counted exactly within its component, tile by tile: no group is handled in
one task, and no pairs are emitted for that.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import row_digest
from ledgerlens.llm.components import connected_components
from ledgerlens.operators.materialize import materialize
from ledgerlens.operators.numbering import number_rows

COSINE = 0.95
NEIGHBOURS = 16
RECALL = 0.999
BITS = 60  # signs in one pass's key
BLOCK = 1024  # vectors of the sorted order compared in one group
TILE = 512
SEED = 99


def prefix_bits(n: int, neighbours: int = NEIGHBOURS) -> int:
    """Leading signs that at most ``neighbours`` of ``n`` random vectors share
    on average."""
    return min(BITS, max(1, math.ceil(math.log2(max(2.0, n / neighbours)))))


def passes_needed(n: int, cosine: float = COSINE, neighbours: int = NEIGHBOURS,
                  recall: float = RECALL) -> int:
    """Passes until a pair at the threshold agrees in the first
    ``prefix_bits`` signs of one of them with probability ``recall``."""
    same = 1 - math.acos(cosine) / math.pi
    met = same ** prefix_bits(n, neighbours)
    return max(2, math.ceil(math.log(1 - recall) / math.log(1 - met)))


def usable(vector: Column) -> Column:
    """Whether a vector can link: not null, no null or non-finite component,
    not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x)
                      & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(column: pa.Array) -> np.ndarray:
    """Rows of a list column as unit vectors in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    # scaled first, so that neither very large nor very small values are lost
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _project(passes: int, bits: int, seed: int):
    """(node, vector) -> one key of ``bits`` signs per pass."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column(0)
            x = _unit(batch.column(1))
            planes = np.random.default_rng(seed).standard_normal((x.shape[1], passes * bits))
            signs = (x @ planes > 0).reshape(len(x), passes, bits)
            keys = signs @ (np.int64(1) << np.arange(bits - 1, -1, -1, dtype=np.int64))
            at = np.repeat(np.arange(len(x)), passes)
            yield pa.RecordBatch.from_arrays(
                [node.take(pa.array(at)), pa.array(np.tile(np.arange(passes, dtype=np.int32), len(x))),
                 pa.array(keys.ravel())], names=["node", "pass", "key"])
    return run


def _neighbour_pairs(cosine: float, neighbours: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("position").combine_chunks()
        x = _unit(table.column("vector").chunk(0))
        node = np.array(table.column("node").to_pylist(), dtype=object)
        first, second = [], []
        for start in range(0, len(x), 64):
            rows = x[start:start + 64]
            c = rows @ x[start:start + 64 + neighbours].T
            i, j = np.nonzero(c >= cosine)
            near = (j > i) & (j - i <= neighbours)
            first.append(i[near] + start)
            second.append(j[near] + start)
        a = node[np.concatenate(first)] if first else node[:0]
        b = node[np.concatenate(second)] if second else node[:0]
        return pa.table({"a": pa.array(np.minimum(a, b), pa.string()),
                         "b": pa.array(np.maximum(a, b), pa.string())})
    return run


def _tile_links(cosine: float):
    """Links between the nodes of two tiles (or inside one) that make the
    same components as all of their links."""
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        tile = table.column("tile").to_numpy()
        node = np.array(table.column("node").to_pylist(), dtype=object)
        x = _unit(table.column("vector").chunk(0))
        low = np.flatnonzero(tile == tile.min())
        high = np.flatnonzero(tile != tile.min())
        high = high if len(high) else low
        i, j = np.nonzero(x[low] @ x[high].T >= cosine)
        i, j = low[i], high[j]
        label, first, second = np.arange(len(x)), [], []
        while True:  # each round joins every part to the smallest one that it sees
            a, b = label[i], label[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            large, small = np.maximum(a, b), np.minimum(a, b)
            order = np.lexsort((small, large))
            part, at = np.unique(large[order], return_index=True)
            at = order[at]
            first.append(i[at])
            second.append(j[at])
            to = np.arange(len(x))
            to[part] = small[at]
            while (to[to] != to).any():
                to = to[to]
            label = to[label]
        a = node[np.concatenate(first)] if first else node[:0]
        b = node[np.concatenate(second)] if second else node[:0]
        return pa.table({"a": pa.array(np.minimum(a, b), pa.string()),
                         "b": pa.array(np.maximum(a, b), pa.string())})
    return run


def _tile_counts(cosine: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        tile = table.column("tile").to_numpy()
        weight = table.column("members").to_numpy()
        x = _unit(table.column("vector").chunk(0))
        low = tile == tile.min()
        high = ~low if (~low).any() else low
        linked = x[low] @ x[high].T >= cosine
        if low is high:
            np.fill_diagonal(linked, False)
        n = np.zeros(len(x), np.int64)
        n[low] += linked @ weight[high]
        if low is not high:
            n[high] += linked.T @ weight[low]
        return pa.table({"node": table.column("node"), "n": pa.array(n)})
    return run


def near_duplicate_vectors(vectors: DataFrame, cosine: float = COSINE,
                           neighbours: int = NEIGHBOURS, recall: float = RECALL,
                           id_col: str = "vec_id", vector_col: str = "embedding",
                           seed: int = SEED) -> DataFrame:
    """One row per input row: ``vec_id``, ``n_links`` (other rows linked
    directly), ``component_id`` (smallest id reachable, its own included)
    and ``kept`` (that id is its own).

    Null, empty and zero vectors and those with a null, NaN or infinite
    component link with nothing. Rows with equal vectors are linked with
    each other. Vectors of different lengths never link. A null id never
    counts as smallest. An empty table gives no rows.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"))
    h1, h2 = row_digest([F.col("vector")])
    node = F.when(usable(F.col("vector")), F.concat(
        F.lpad(F.hex(h1), 16, "0"), F.lpad(F.hex(h2), 16, "0")))
    rows = rows.select("vec_id", "vector", node.alias("node"))
    ids = materialize(rows.select("vec_id", "node"), "vector-ids")
    nodes = materialize(rows.filter("node is not null").groupBy("node").agg(
        F.first("vector").alias("vector"), F.min("vec_id").alias("rep"),
        F.count(F.lit(1)).alias("members")), "vector-nodes")
    lengths = [r["d"] for r in nodes.select(F.size("vector").alias("d")).distinct().collect()]
    found = None
    for d in sorted(lengths):
        links = _links(nodes.filter(F.size("vector") == d), cosine, neighbours, recall, seed)
        found = links if found is None else found.union(links)
    if found is None:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"),
                          F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    components = connected_components(found)
    members = components.union(components.select(F.col("component").alias("node"), "component")
                               .distinct())
    members = materialize(members, "vector-components")
    least = members.join(nodes.select("node", "rep"), "node").groupBy("component").agg(
        F.min("rep").alias("component_id"))
    counts = _count_links(members, nodes, cosine)
    label = nodes.select("node", "rep", "members").join(
        members.join(least, "component").select("node", "component_id"), "node", "left").join(
        counts, "node", "left").select(
        "node", (F.col("members") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
        F.coalesce("component_id", "rep").alias("component_id"))
    out = ids.join(label, "node", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
        .alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _links(nodes: DataFrame, cosine: float, neighbours: int, recall: float, seed: int) -> DataFrame:
    """Verified pairs ``a, b`` that connect all that meet in some pass, for
    vectors of one length."""
    n = nodes.count()
    passes = passes_needed(n, cosine, neighbours, recall)
    keys = nodes.select("node", "vector").mapInArrow(
        _project(passes, BITS, seed), "node string, pass int, key long")
    ordered = materialize(number_rows(keys, ["pass", "key", "node"], label="projections").select(
        "node", "pass", F.shiftright("key", BITS - prefix_bits(n, neighbours)).alias("prefix"),
        (F.col("row_index") - F.col("pass") * F.lit(n)).alias("position")), "projections")
    block = F.floor(F.col("position") / BLOCK)
    # the first rows of a block are also the end of the one before
    blocks = F.when((F.col("position") % BLOCK < neighbours) & (block > 0),
                    F.array(block, block - 1)).otherwise(F.array(block))
    grouped = ordered.join(nodes.select("node", "vector"), "node").select(
        "node", "vector", "pass", "position", F.explode(blocks).alias("block"))
    pairs = grouped.groupBy("pass", "block").applyInArrow(
        _neighbour_pairs(cosine, neighbours), "a string, b string").distinct()
    near = materialize(pairs, "vector-links")
    # a run of at most neighbours + 1 rows has been compared in full
    runs = materialize(ordered.groupBy("pass", "prefix").agg(F.count(F.lit(1)).alias("size"))
                       .filter(F.col("size") > neighbours + 1), "vector-runs")
    pairs = runs.agg(F.sum(F.col("size").cast("double") ** 2).alias("s")).first()["s"]
    if pairs is None:
        return near
    labels = materialize(connected_components(near), "vector-near")
    if pairs < float(n) * n:
        crowds = ordered.join(runs, ["pass", "prefix"]).select("node", "pass", "prefix")
    else:
        crowds = nodes.select("node", F.lit(0).alias("pass"), F.lit(0).cast("long").alias("prefix"))
    crowds = crowds.join(labels, "node", "left").select(
        "pass", "prefix", "node", F.coalesce("component", "node").alias("component"))
    late = _crowd_links(crowds, nodes, cosine)
    return near.union(late)


def _crowd_links(crowds: DataFrame, nodes: DataFrame, cosine: float) -> DataFrame:
    """Links between components inside each run ``pass, prefix`` of rows
    ``node, component``."""
    run = ["pass", "prefix"]
    placed = number_rows(crowds, [*run, "component", "node"], label="crowds")
    first = placed.groupBy(run).agg(F.min("row_index").alias("first"), F.min("component").alias("least"),
                                    F.max("component").alias("most")).filter("least <> most")
    rows = materialize(placed.join(first, run).select(
        *run, "node", "component",
        F.floor((F.col("row_index") - F.col("first")) / TILE).alias("tile")), "crowd-tiles")
    tiles = rows.groupBy(*run, "tile").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    other = tiles.select(*run, F.col("tile").alias("tile2"), F.col("lo").alias("lo2"),
                         F.col("hi").alias("hi2"))
    pairs = tiles.join(other, run).filter("tile <= tile2").filter("lo <> hi or lo2 <> hi2 or lo <> lo2")
    sides = pairs.select(*run, F.col("tile").alias("i"), F.col("tile2").alias("j"),
                         F.explode(F.array_distinct(F.array("tile", "tile2"))).alias("tile"))
    links = sides.join(rows, [*run, "tile"]).join(nodes.select("node", "vector"), "node").groupBy(
        *run, "i", "j").applyInArrow(_tile_links(cosine), "a string, b string")
    return materialize(links, "crowd-links")


def _count_links(members: DataFrame, nodes: DataFrame, cosine: float) -> DataFrame:
    """``node, n``: rows linked with each node, within its component."""
    placed = number_rows(members, ["component", "node"], label="component-order")
    first = placed.groupBy("component").agg(F.min("row_index").alias("first"),
                                            F.count(F.lit(1)).alias("size"))
    tiles = placed.join(first, "component").select(
        "node", "component", F.floor((F.col("row_index") - F.col("first")) / TILE).alias("tile"),
        F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / TILE).cast("int"))).alias("other"))
    tiles = tiles.join(nodes.select("node", "vector", "members"), "node").withColumns(
        {"low": F.least("tile", "other"), "high": F.greatest("tile", "other")})
    return tiles.groupBy("component", "low", "high").applyInArrow(
        _tile_counts(cosine), "node string, n long").groupBy("node").agg(F.sum("n").alias("n"))
