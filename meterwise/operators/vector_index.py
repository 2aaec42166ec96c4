"""Inverted lists over document vectors: similarity search that reads part of a large corpus.

Every vector belongs to the list of its nearest centroid and keeps its distance to it. A search reads the lists
nearest to each query first; the k-th hit found there then rules out all lists too far away to hold a better one, and the
others are read too, so hits equal those of ``knowledge.semantic_topk``. On vectors without structure few lists are
ruled out, and the search reads as much as the plain one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwise.config import Config
from meterwise.functions.vectors import best_pairs, hit_table, id_type, keep_best, plain_ids, unit_rows
from meterwise.functions.versioning import top_per_key
from meterwise.operators.knowledge import WHOLE_NUMBERS, semantic_topk

LISTS, SAMPLE, ROUNDS = 64, 20_000, 8
PROBES = 4
# Scores are rounded to nine places, distances come from them.
SCORE_SLACK, DISTANCE_SLACK = 1e-8, 1e-6


def id_kind(vectors: DataFrame) -> str:
    return "long" if dict(vectors.dtypes)["doc_id"] in WHOLE_NUMBERS else "string"


def fit_lists(vectors: DataFrame, lists: int = LISTS, sample: int = SAMPLE) -> np.ndarray:
    """Centroids of at most ``lists`` lists by k-means on the directions of at most ``sample`` vectors, those of
    least hash: a bound on what the driver holds. Equal input gives equal centroids; no vectors give none."""
    held = vectors.where(F.col("vector").isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("vector").toArrow()
    if not held.num_rows:
        return np.zeros((0, 0))
    points = np.unique(unit_rows(held["vector"].combine_chunks()), axis=0)
    centroids = points[np.linspace(0, len(points) - 1, min(lists, len(points))).astype(int)]
    for _ in range(ROUNDS):
        nearest = distances(points, centroids).argmin(axis=1)
        members = np.bincount(nearest, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, points)
        centroids = np.where(members[:, None] > 0, sums / np.maximum(members, 1)[:, None], centroids)
    return centroids


def distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    squared = (points**2).sum(axis=1)[:, None] - 2 * points @ centroids.T + (centroids**2).sum(axis=1)
    return np.sqrt(np.maximum(squared, 0))


def in_lists(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``doc_id``, ``list``, ``distance`` and ``vector`` of every vector; null vectors are in no list."""
    kind = id_kind(vectors)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                apart = distances(unit_rows(batch.column("vector")), centroids)
                nearest = apart.argmin(axis=1)
                columns = [batch.column("doc_id"), pa.array(nearest, pa.int32()), pa.array(apart.min(axis=1)), batch.column("vector")]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "list", "distance", "vector"])

    rows = vectors.where(F.col("vector").isNotNull())
    rows = rows.select(F.col("doc_id").cast(kind).alias("doc_id"), F.col("vector").cast("array<double>").alias("vector"))
    return rows.mapInArrow(place, f"doc_id {kind}, list int, distance double, vector array<double>")


def search_lists(
    indexed: DataFrame, centroids: np.ndarray, queries: DataFrame, cfg: Config, k: int = 4, probes: int = PROBES, exact: bool = True
) -> DataFrame:
    """The hits of ``semantic_topk`` from rows of ``in_lists``: query_id, doc_id, score, rank.

    Not ``exact``, only the ``probes`` lists nearest to each query are read, and hits elsewhere are missed. More queries than
    a task holds (``query_vectors_per_task``) meet all vectors, block by block. What the driver receives is bounded by the
    queries a task holds times ``k``, and by the lists.
    """
    wanted = queries.where(F.col("vector").isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), "vector")
    held = wanted.limit(cfg.query_vectors_per_task + 1).toArrow()
    if held.num_rows > cfg.query_vectors_per_task or not held.num_rows or not len(centroids):
        return semantic_topk(indexed, queries, cfg, k)
    ids, wanted_rows = held["query_id"].to_numpy(), unit_rows(held["vector"].combine_chunks())
    apart = distances(wanted_rows, centroids)
    first = np.zeros(apart.shape, bool)
    np.put_along_axis(first, np.argsort(apart, axis=1, kind="stable")[:, :probes], True, axis=1)
    hits = _ranked(_hits(indexed, ids, wanted_rows, first, k), k)
    if not exact:
        return hits
    found = hits.toArrow()
    rest = ~first & (apart - _radii(indexed, len(centroids)) <= _reach(found, ids, k)[:, None])
    near = indexed.sparkSession.createDataFrame(found).select("query_id", "doc_id", "score")
    return _ranked(near.union(_hits(indexed, ids, wanted_rows, rest, k)), k)


def _radii(indexed: DataFrame, lists: int) -> np.ndarray:
    """The greatest distance within each list; one narrow column is read. Empty lists reach nowhere."""
    radii = np.full(lists, -np.inf)
    for row in indexed.groupBy("list").agg(F.max("distance").alias("radius")).collect():
        radii[row["list"]] = row["radius"]
    return radii


def _reach(found: pa.Table, ids: np.ndarray, k: int) -> np.ndarray:
    """How far from each query a vector can be that is as good as its k-th hit; any distance with fewer hits."""
    reach = {}
    for query, score, rank in zip(*(found[c].to_pylist() for c in ("query_id", "score", "rank"))):
        if rank == k:
            reach[query] = np.sqrt(max(0.0, 2 - 2 * (score - SCORE_SLACK))) + DISTANCE_SLACK
    return np.array([reach.get(i, np.inf) for i in ids.tolist()])


def _hits(indexed: DataFrame, ids: np.ndarray, queries: np.ndarray, visits: np.ndarray, k: int) -> DataFrame:
    """The best hits of each task among the lists that ``visits`` (queries by lists) marks; others are not read."""
    kind = id_kind(indexed)
    read = np.flatnonzero(visits.any(axis=0)).tolist()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = (np.empty(0, np.int64), plain_ids(pa.array([], id_type(kind))), np.empty(0))
        for batch in batches:
            lists = batch.column("list").to_numpy()
            for number in np.unique(lists):
                rows, asking = batch.filter(pa.array(lists == number)), visits[:, number]
                docs = plain_ids(rows.column("doc_id")), unit_rows(rows.column("vector"))
                found = best_pairs(ids[asking], queries[asking], *docs, k)
                best = keep_best(*[np.concatenate(pair) for pair in zip(best, found)], k)
        yield from hit_table(*best, id_type(kind)).to_batches()

    chosen = indexed.where(F.col("list").isin(read)).select("doc_id", "list", "vector")
    return chosen.mapInArrow(search, f"query_id long, doc_id {kind}, score double")


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    ranked = top_per_key(hits, ["query_id"], [F.desc("score"), F.asc("doc_id")], k, rank="rank")
    return ranked.select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))
