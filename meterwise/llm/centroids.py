"""Exact k-means in integers, with centroids ruled out by rotated coordinates.

Vectors are rotated onto their principal axes. The leading coordinates and the norm of the
rest are stored; for a vector and a centroid, the squared distance of the leading ones plus the squared
difference of the norms is never above the true squared distance. Centroids whose bound exceeds the distance to
the most promising one are out; the others are compared in integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterwise.session import settle

# Squared distances of larger components would not fit a long.
MOST_COMPONENT = 1 << 27
# Rounding of the bound, relative to the squared norms.
SLACK = 1e-9


@dataclass(frozen=True)
class ClusterPlan:
    clusters: int = 40
    rounds: int = 5
    dimensions: int = 64
    leading: int = 16
    scale: int = 256
    salt: str = "2:"


def is_whole(vector: Column, dimensions: int) -> Column:
    """Neither null nor of another size, all components finite."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))  # NaN is above all
    return F.coalesce((F.size(vector) == dimensions) & finite, F.lit(False))


def whole_vectors(vectors: DataFrame, plan: ClusterPlan) -> DataFrame:
    """``vec_id`` and the integer components of the vectors that take part. A component beyond 2^27 ends the
    job with an error, as distances would not fit a long."""
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * plan.scale))
    kept = vectors.where(is_whole(F.col("embedding"), plan.dimensions)).select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("ints"))
    small = F.forall("ints", lambda x: F.abs(x) <= MOST_COMPONENT)
    checked = F.when(small, F.col("ints").cast("array<int>")).otherwise(F.raise_error(F.lit("a component is too large for exact distances")))
    return kept.select("vec_id", checked.alias("ints"))


def matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dimensions)


@dataclass(frozen=True)
class Rotation:
    mean: np.ndarray
    axes: np.ndarray  # orthonormal columns, the leading principal axes

    def __call__(self, ints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading coordinates, and the norm of what is left."""
        centred = ints - self.mean
        lead = centred @ self.axes
        return lead, np.linalg.norm(centred - lead @ self.axes.T, axis=1)


def fit_rotation(whole: DataFrame, plan: ClusterPlan) -> Rotation:
    """Principal axes of all vectors. Each task adds up products of its own; the sums of the tasks meet by place
    in the matrix, so a fixed number of rows reaches the driver. Any rotation gives the same clusters."""
    d = plan.dimensions

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d + 1, d + 1))
        for batch in batches:
            rows = np.hstack([matrix(batch.column(0), d).astype(np.float64), np.ones((batch.num_rows, 1))])
            total += rows.T @ rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange((d + 1) ** 2)), pa.array(total.ravel())], names=["place", "x"])

    sums = whole.select("ints").mapInArrow(moments, "place long, x double").groupBy("place").agg(F.sum("x").alias("x"))
    total = np.zeros((d + 1) ** 2)
    for place, x in sums.collect():
        total[place] = x
    total = total.reshape(d + 1, d + 1)
    n = max(total[-1, -1], 1.0)
    mean = total[-1, :-1] / n
    _, axes = np.linalg.eigh(total[:-1, :-1] / n - np.outer(mean, mean))
    return Rotation(mean, axes[:, ::-1][:, : plan.leading].copy())


def rotated(whole: DataFrame, rotation: Rotation, plan: ClusterPlan) -> DataFrame:
    """``whole`` with ``lead`` and ``rest``, written once."""

    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead, rest = rotation(matrix(batch.column("ints"), plan.dimensions))
            places = pa.array(np.arange(0, lead.size + 1, lead.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("ints"), pa.ListArray.from_arrays(places, pa.array(lead.ravel())), pa.array(rest)],
                names=["vec_id", "ints", "lead", "rest"],
            )

    return settle(whole.mapInArrow(rotate, "vec_id long, ints array<int>, lead array<double>, rest double"), "rotated")


def nearest(ints: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray, rotation: Rotation) -> tuple[np.ndarray, np.ndarray]:
    """For each vector the nearest centroid (ties: smaller number) and the squared distance, exactly."""
    ints = ints.astype(np.int64)
    c_lead, c_rest = rotation(centroids)
    squares, c_squares = (lead**2).sum(axis=1) + rest**2, (c_lead**2).sum(axis=1) + c_rest**2
    bound = squares[:, None] + c_squares - 2 * (lead @ c_lead.T) - 2 * np.outer(rest, c_rest)
    guess = bound.argmin(axis=1)
    reach = ((ints - centroids[guess]) ** 2).sum(axis=1)
    alive = bound <= reach[:, None] + SLACK * (squares[:, None] + c_squares + 1)
    alive[np.arange(len(ints)), guess] = True
    row, centroid = np.nonzero(alive)
    distance = ((ints[row] - centroids[centroid]) ** 2).sum(axis=1)
    starts = np.searchsorted(row, np.arange(len(ints)))
    least = np.minimum.reduceat(distance, starts) if len(ints) else np.zeros(0, np.int64)
    _, at = np.unique(row[distance == least[row]], return_index=True)
    return centroid[distance == least[row]][at], least


def _blocks(batch: pa.RecordBatch, plan: ClusterPlan) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    ints, lead = (matrix(batch.column(c), d) for c, d in (("ints", plan.dimensions), ("lead", plan.leading)))
    rest = batch.column("rest").to_numpy()
    for at in range(0, batch.num_rows, 2048):
        yield at, min(at + 2048, batch.num_rows), ints[at : at + 2048], lead[at : at + 2048], rest[at : at + 2048]


def _summing(centroids: np.ndarray, rotation: Rotation, plan: ClusterPlan) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, d = centroids.shape
        sums, counts = np.zeros((k, d), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for _, _, ints, lead, rest in _blocks(batch, plan):
                cluster, _ = nearest(ints, lead, rest, centroids, rotation)
                np.add.at(sums, cluster, ints)
                counts += np.bincount(cluster, minlength=k)
        met = np.flatnonzero(counts)
        columns = [met, counts[met], *sums[met].T]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["cluster", "n", *[f"s{i}" for i in range(d)]])

    return run


def next_centroids(store: DataFrame, centroids: np.ndarray, rotation: Rotation, plan: ClusterPlan) -> np.ndarray:
    """One round: tasks add up their vectors by cluster, a row per cluster and task is shuffled."""
    columns = [f"s{i}" for i in range(plan.dimensions)]
    schema = ", ".join(f"{c} long" for c in ["cluster", "n", *columns])
    sums = store.mapInArrow(_summing(centroids, rotation, plan), schema).groupBy("cluster").agg(*[F.sum(c).alias(c) for c in ["n", *columns]])
    moved = centroids.copy()
    for cluster, n, *totals in sums.collect():  # a row per centroid
        moved[cluster] = [t // n for t in totals]
    return moved


def assigned(store: DataFrame, centroids: np.ndarray, rotation: Rotation, plan: ClusterPlan) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, stop, ints, lead, rest in _blocks(batch, plan):
                cluster, distance = nearest(ints, lead, rest, centroids, rotation)
                columns = [batch.column("vec_id")[at:stop], pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance"])

    return store.mapInArrow(run, "vec_id long, cluster int, distance long")


def first_centroids(whole: DataFrame, plan: ClusterPlan) -> np.ndarray:
    """The vectors of least salted hash of their id (ties, as of repeated ids: by components); a null id counts as empty text."""
    digest = F.sha2(F.concat(F.lit(plan.salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    chosen = whole.select("ints", digest.alias("digest")).orderBy("digest", "ints").limit(plan.clusters)
    return np.array([r["ints"] for r in chosen.collect()], np.int64).reshape(-1, plan.dimensions)


def cluster_vectors(vectors: DataFrame, plan: ClusterPlan | None = None) -> DataFrame:
    """``vec_id``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia`` and ``centroid_sha256`` of each vector of
    ``vectors`` (``vec_id``, ``embedding``) that has all its components.

    Null vectors, those of another size and those with a null, NaN or infinite component are left out. Rows of
    equal or null id are vectors of their own; equal vectors tie alike, so copies share a cluster. Fewer vectors than
    clusters: each is a centroid. An empty table gives no rows. Further columns are left out. Components beyond 2^27
    after scaling end the job with an error.
    """
    plan = plan or ClusterPlan()
    whole = whole_vectors(vectors, plan)
    rotation = fit_rotation(whole, plan)
    store = rotated(whole, rotation, plan)
    centroids = first_centroids(store, plan)
    for _ in range(plan.rounds if len(centroids) else 0):
        centroids = next_centroids(store, centroids, rotation, plan)
    found = settle(assigned(store, centroids, rotation, plan), "assigned")
    sums = dict(found.groupBy("cluster").agg(F.sum("distance")).collect())  # a row per centroid
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]

    def of_cluster(values: list, kind: str) -> Column:
        return F.element_at(F.lit(values).cast(f"array<{kind}>"), F.col("cluster") + 1) if values else F.lit(None).cast(kind)

    return found.select(
        "vec_id", "cluster", "distance", of_cluster([sums.get(i, 0) for i in range(len(centroids))], "long").alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("long").alias("inertia"), of_cluster(digests, "string").alias("centroid_sha256"),
    )
