"""Approximate nearest neighbours by hierarchical navigable small-world graphs.

Rows are dealt to shards by hash. Each shard's task builds a graph of its vectors and stores it as flat
arrays, one row per shard. Every query searches the graph of every shard, and the shards' hits are merged.

Largest inner product becomes nearest neighbour by one more coordinate that lifts all vectors to the length of the
longest. Nodes of a shard are ordered by falling layer, so a layer is the first so many of them.
Searches and insertions advance whole blocks of queries at once, one hop at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterwise.session import settle

# Nodes that each query of a block expands in one hop.
HOP = 4
# Nodes that are linked by comparing all, before a layer grows by searches.
FIRST_NODES = 128
BATCH_NODES = 512
# Of candidates for links, the nearest so many are weighed against one another.
LINK_CANDIDATES = 64
# Marks of visited nodes that a block of queries may take.
SEEN_BYTES = 1 << 25


@dataclass(frozen=True)
class GraphPlan:
    neighbours: int = 20
    # Links of a new node; a node of the ground layer holds twice as many.
    links: int = 16
    build_width: int = 64
    # Wide enough for vectors of like length; lengths that differ much need more in a large shard.
    search_width: int = 128
    # At least so many shards, and more where one would hold more bytes of vectors.
    shards: int = 16
    shard_bytes: int = 32 << 20
    # Queries that meet a shard in one task.
    query_rows: int = 8192


def beam(points: np.ndarray, links: np.ndarray, wanted: np.ndarray, entries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``width`` nodes nearest to each of ``wanted`` that a best-first walk from ``entries`` over ``links`` finds, and
    their similarities, falling; -1 where fewer were reached."""
    n = len(wanted)
    rows = np.arange(n)
    seen = np.zeros((n, len(links)), bool)
    ids, sims, fresh = np.full((n, width), -1), np.full((n, width), -np.inf, np.float32), np.zeros((n, width), bool)
    ids[:, 0], fresh[:, 0] = entries, True
    sims[:, 0] = np.einsum("ij,ij->i", wanted, points[entries])
    seen[rows, entries] = True
    hop = min(HOP, width)
    active = rows
    while len(active):
        at = active[:, None]
        waiting = np.where(fresh[active], sims[active], -np.inf)
        pick = np.argpartition(-waiting, hop - 1, axis=1)[:, :hop]
        nodes = np.where(np.take_along_axis(waiting, pick, 1) > -np.inf, ids[at, pick], -1)
        fresh[at, pick] = False
        near = np.where(nodes[:, :, None] >= 0, links[nodes], -1)
        new = np.zeros(near.shape, bool)
        for i in range(hop):  # two nodes of a hop may share neighbours
            of_node = near[:, i]
            new[:, i] = (of_node >= 0) & ~seen[at, of_node]
            met, place = np.nonzero(new[:, i])
            seen[active[met], of_node[met, place]] = True
        near, new = near.reshape(len(active), -1), new.reshape(len(active), -1)
        found = np.full(near.shape, -np.inf, np.float32)
        met, place = np.nonzero(new)
        found[met, place] = np.einsum("ij,ij->i", wanted[active[met]], points[near[met, place]])
        every = np.hstack([sims[active], found])
        best = np.argpartition(-every, width - 1, axis=1)[:, :width]
        sims[active] = np.take_along_axis(every, best, 1)
        ids[active] = np.take_along_axis(np.hstack([ids[active], near]), best, 1)
        fresh[active] = np.take_along_axis(np.hstack([fresh[active], new]), best, 1)
        active = active[(fresh[active] & (sims[active] > -np.inf)).any(axis=1)]
    ids[sims == -np.inf] = -1
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def descend(points: np.ndarray, layers: list[np.ndarray], wanted: np.ndarray) -> np.ndarray:
    """A near node for each of ``wanted``, through ``layers`` from the top."""
    entries = np.zeros(len(wanted), np.int64)
    for links in layers:
        entries = beam(points, links, wanted, entries, 1)[0][:, 0]
    return entries


def diverse(points: np.ndarray, ids: np.ndarray, sims: np.ndarray, keep: int) -> np.ndarray:
    """Of each row's candidates (falling similarity; -1: none) those that are nearer to the row's node than to any
    chosen one, then the nearest of the others, ``keep`` in all."""
    vectors = points[ids]
    mutual = vectors @ vectors.transpose(0, 2, 1)
    chosen, covered = np.zeros(ids.shape, bool), np.full(ids.shape, -np.inf, np.float32)
    for j in range(ids.shape[1]):
        take = (ids[:, j] >= 0) & (sims[:, j] > covered[:, j]) & (chosen.sum(axis=1) < keep)
        chosen[:, j] = take
        covered[take] = np.maximum(covered[take], mutual[take, j])
    order = np.argsort(~chosen & (ids >= 0) + 2 * (ids < 0), axis=1, kind="stable")[:, :keep]
    return np.take_along_axis(ids, order, 1)


def nearest_first(ids: np.ndarray, sims: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-sims, axis=1, kind="stable")[:, :most]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def link_back(points: np.ndarray, links: np.ndarray, nodes: np.ndarray) -> None:
    """Give the neighbours of ``nodes`` links to them; a node with too many keeps a diverse choice."""
    width = links.shape[1]
    source, place = np.nonzero(links[nodes] >= 0)
    target, source = links[nodes][source, place], nodes[source]
    new = ~(links[target] == source[:, None]).any(axis=1)
    target, source = target[new], source[new]
    order = np.argsort(target, kind="stable")
    target, source = target[order], source[order]
    targets, starts, counts = np.unique(target, return_index=True, return_counts=True)
    for at in range(0, len(targets), BATCH_NODES):
        part, n = targets[at : at + BATCH_NODES], counts[at : at + BATCH_NODES]
        added = np.full((len(part), int(n.max())), -1)
        row = np.repeat(np.arange(len(part)), n)
        first = starts[at]
        added[row, np.arange(len(row)) - np.repeat(starts[at : at + BATCH_NODES] - first, n)] = source[first : first + len(row)]
        ids = np.hstack([links[part], added])
        sims = np.full(ids.shape, -np.inf, np.float32)
        row, place = np.nonzero(ids >= 0)
        sims[row, place] = np.einsum("ij,ij->i", points[part[row]], points[ids[row, place]])
        ids, sims = nearest_first(ids, sims, max(width, LINK_CANDIDATES))
        full = (ids >= 0).sum(axis=1) > width
        links[part[~full]] = ids[~full, :width]
        if full.any():
            links[part[full]] = diverse(points, ids[full], sims[full], width)


def grown_layer(points: np.ndarray, size: int, links: int, width: int, above: list[np.ndarray], build_width: int) -> np.ndarray:
    """The links of the layer of the first ``size`` nodes, ``width`` places each."""
    out = np.full((size, width), -1, np.int32)
    done = min(size, FIRST_NODES)
    for at in [0, *range(done, size, BATCH_NODES)]:
        stop = done if at == 0 else min(at + BATCH_NODES, size)
        nodes = np.arange(at, stop)
        ids, sims = np.tile(nodes, (len(nodes), 1)), points[nodes] @ points[nodes].T
        np.fill_diagonal(sims, -np.inf)
        ids, sims = nearest_first(np.where(sims > -np.inf, ids, -1), sims, LINK_CANDIDATES)
        if at:
            entries = descend(points, above, points[nodes])
            entries[entries >= at] = 0  # of the layer above, not yet in this one
            found, near = beam(points, out[:at], points[nodes], entries, build_width)
            ids, sims = nearest_first(np.hstack([found, ids]), np.hstack([near, sims]), LINK_CANDIDATES)
        keep = min(width if at == 0 else links, ids.shape[1])
        out[nodes, :keep] = diverse(points, ids, sims, keep)
        link_back(points, out, nodes)
    return out


def lifted(vectors: np.ndarray) -> np.ndarray:
    """Vectors scaled so that the longest has length one, with one more coordinate that makes all as long."""
    scaled = vectors / np.abs(vectors).max()
    squares = (scaled**2).sum(axis=1)
    return (np.column_stack([scaled, np.sqrt(np.maximum(squares.max() - squares, 0))]) / np.sqrt(squares.max())).astype(np.float32)


@dataclass(frozen=True)
class Graph:
    points: np.ndarray
    layers: list[np.ndarray]  # from the top; row i has the links of node i, -1 for none

    @staticmethod
    def grow(vectors: np.ndarray, sizes: list[int], plan: GraphPlan) -> Graph:
        points, layers = lifted(vectors), []
        for i, size in enumerate(sizes):
            width = plan.links * (2 if i == len(sizes) - 1 else 1)
            layers.append(grown_layer(points, size, plan.links, width, layers, plan.build_width))
        return Graph(points, layers)

    def search(self, queries: np.ndarray, width: int) -> np.ndarray:
        """The nodes found for each query, -1 for none."""
        longest = np.linalg.norm(queries / np.abs(queries).max(axis=1, keepdims=True), axis=1, keepdims=True)
        unit = queries / np.abs(queries).max(axis=1, keepdims=True) / longest
        wanted = np.column_stack([unit, np.zeros(len(unit))]).astype(np.float32)
        out = np.full((len(queries), width), -1)
        step = max(1, SEEN_BYTES // max(1, len(self.points)))
        for at in range(0, len(queries), step):
            part = wanted[at : at + step]
            out[at : at + step] = beam(self.points, self.layers[-1], part, descend(self.points, self.layers[:-1], part), width)[0]
        return out


def layer_sizes(n: int, links: int, seed: int) -> list[int]:
    """How many of ``n`` nodes each layer has, from the top: every layer thins out by ``links``."""
    height = np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(links)).astype(int)
    return [int((height >= h).sum()) for h in range(height.max(), -1, -1)]


INDEX = (
    "shard long, rows array<long>, ids array<long>, first array<int>, sizes array<int>, links array<int>, dimensions int, vectors array<{kind}>"
)


def _shard_row(table: pa.Table, plan: GraphPlan) -> pa.Table:
    """The index of one shard: distinct vectors as nodes, the rows of each (``first`` marks where they begin; least id
    first, null last), layer sizes and all layers' links one after the other."""
    shard = table["shard"][0].as_py()
    row, ids = table["row"].to_numpy(), table["vec_id"].combine_chunks()
    flat = table["vector"].combine_chunks().flatten().to_numpy()
    vectors = flat.reshape(len(row), -1) + 0  # -0.0 becomes 0.0
    places = np.lexsort([row, ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)])
    distinct, node = np.unique(vectors, axis=0, return_inverse=True)
    dealt = np.random.default_rng(shard).permutation(len(distinct))  # the order of insertion
    number = np.argsort(dealt)[node.ravel()]
    places = places[np.argsort(number[places], kind="stable")]
    first = np.searchsorted(number[places], np.arange(len(distinct) + 1))
    vectors = distinct[dealt]
    sizes = layer_sizes(len(vectors), plan.links, shard)
    graph = Graph.grow(vectors.astype(np.float64), sizes, plan)
    links = np.concatenate([layer.ravel() for layer in graph.layers])
    kind = table["vector"].type.value_type
    values = [
        ([shard], pa.int64()), ([row[places]], pa.list_(pa.int64())), ([ids.take(pa.array(places))], pa.list_(pa.int64())),
        ([first], pa.list_(pa.int32())), ([sizes], pa.list_(pa.int32())), ([links], pa.list_(pa.int32())),
        ([vectors.shape[1]], pa.int32()), ([vectors.ravel()], pa.list_(kind)),
    ]
    return pa.table([pa.array(v, t) for v, t in values], names=[f.split()[0] for f in INDEX.split(", ")])


def stored_graph(index: dict, plan: GraphPlan) -> Graph:
    """The graph of an index row (``vectors``, ``sizes`` and ``links`` as arrays)."""
    layers, at = [], 0
    for i, size in enumerate(index["sizes"]):
        width = plan.links * (2 if i == len(index["sizes"]) - 1 else 1)
        layers.append(index["links"][at : at + size * width].reshape(size, width))
        at += size * width
    return Graph(lifted(index["vectors"]), layers)


def _hits(index: pa.Table, queries: pa.Table, plan: GraphPlan) -> pa.Table:
    """The shard's nearest rows for each query, scored in double precision on the stored vectors."""
    names = ["query", "query_id", "vec_id", "row", "score"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
    if not index.num_rows or not queries.num_rows:
        return pa.table([pa.array([], k) for k in kinds], names=names)
    held = {c: index[c][0].values.to_numpy() for c in ("rows", "first", "sizes", "links")}
    vectors = index["vectors"][0].values.to_numpy().reshape(-1, index["dimensions"][0].as_py()).astype(np.float64)
    ids = index["ids"][0].values
    wanted = queries["vector"].combine_chunks().flatten().to_numpy().reshape(queries.num_rows, -1).astype(np.float64)
    own = queries["row"].to_numpy()
    nodes = stored_graph(held | {"vectors": vectors}, plan).search(wanted, plan.search_width)
    query, place = np.nonzero(nodes >= 0)
    node = nodes[query, place]
    score = np.concatenate(
        [(wanted[query[i : i + 65536]] * vectors[node[i : i + 65536]]).sum(axis=1) for i in range(0, len(query), 65536)] or [np.zeros(0)]
    )
    # Of copies, the first few can be hits; one more, as the query may be among them.
    copies = np.minimum(np.diff(held["first"])[node], plan.neighbours + 1)
    at = np.repeat(held["first"][node] - (np.cumsum(copies) - copies), copies) + np.arange(int(copies.sum()))
    query, score = np.repeat(query, copies), np.repeat(score, copies)
    other = held["rows"][at] != own[query]
    query, score, at = query[other], score[other], at[other]
    hit_ids = ids.take(pa.array(at))
    order = np.lexsort([held["rows"][at], hit_ids.fill_null(0).to_numpy(), hit_ids.is_null().to_numpy(zero_copy_only=False), -score, query])
    rank = np.arange(len(order)) - np.searchsorted(query[order], query[order])
    order = order[rank < plan.neighbours]
    columns = [own[query[order]], queries["vec_id"].combine_chunks().take(pa.array(query[order])), hit_ids.take(pa.array(order)), held["rows"][at][order], score[order]]
    return pa.table([pa.array(c, k) if isinstance(c, np.ndarray) else c for c, k in zip(columns, kinds)], names=names)


def is_searchable(vector: Column) -> Column:
    """Neither null nor zero, all components finite; an empty vector is zero."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))  # NaN is above all
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def searchable_rows(vectors: DataFrame) -> DataFrame:
    """``row``, ``vec_id``, ``vector`` (its kind of number kept) of the vectors that take part, written once."""
    kind = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"
    slim = vectors.where(is_searchable(F.col("embedding"))).select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("vector")
    )
    return settle(slim, "vectors")


def shard_count(rows: DataFrame, plan: GraphPlan) -> int:
    size = rows.agg(F.sum(8 * F.size("vector"))).first()[0] or 0
    return max(plan.shards, -(-size // plan.shard_bytes))


def build_index(rows: DataFrame, shards: int, plan: GraphPlan) -> DataFrame:
    """One row per shard, written to the shared folder. Vectors of different sizes are in different shards."""
    kind = dict(rows.dtypes)["vector"].removeprefix("array<").removesuffix(">")
    shard = F.size("vector").cast("long") * shards + F.pmod(F.xxhash64("row"), F.lit(shards))
    dealt = rows.withColumn("shard", shard)
    return settle(dealt.groupBy("shard").applyInArrow(lambda t: _shard_row(t, plan), INDEX.format(kind=kind)), "graphs")


def search_index(index: DataFrame, queries: DataFrame, shards: int, plan: GraphPlan) -> DataFrame:
    """``query`` and ``query_id`` (row and id), ``rank``, ``vec_id``, ``row`` and ``score`` of the hits of ``queries``
    (``row``, ``vec_id``, ``vector``) in all shards. Queries are cut into slices, so a task holds one shard and a bounded number of them."""
    slices = max(1, -(-queries.count() // plan.query_rows))
    every_slice = F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")
    every_shard = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    held = index.select("*", every_slice)
    asked = queries.withColumn("slice", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(slices)).cast("int")).withColumn("shard", every_shard)
    asked = asked.withColumn("shard", F.size("vector").cast("long") * shards + F.col("shard"))
    met = held.groupBy("shard", "slice").cogroup(asked.groupBy("shard", "slice"))
    hits = met.applyInArrow(lambda a, b: _hits(a, b, plan), "query long, query_id long, vec_id long, row long, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= plan.neighbours)


def nearest_neighbours(vectors: DataFrame, is_query: Column, plan: GraphPlan | None = None) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the nearest other rows found for each row of ``vectors``
    (``vec_id``, ``embedding``) for which ``is_query`` holds; nearest is the largest inner product.

    Vectors that are null or zero, or have a null, NaN or infinite component, take no part. Vectors of different sizes
    never meet. Rows of equal id, and equal rows, are rows of their own: a query does not find itself, but its copies; null ids are found
    and come last among ties. With no more candidates than hits asked for, all are found. An empty table gives no rows. Further columns are left out.
    """
    plan = plan or GraphPlan()
    rows = searchable_rows(vectors)
    shards = shard_count(rows, plan)
    index = build_index(rows, shards, plan)
    return search_index(index, rows.where(is_query), shards, plan).select("query_id", "rank", "vec_id", "score")
