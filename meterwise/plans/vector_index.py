"""A stored index of inverted lists, kept current by changed vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterwise.config import Config
from meterwise.operators.vector_index import LISTS, PROBES, fit_lists, id_kind, in_lists, search_lists
from meterwise.sinks.tables import create_buckets_if_missing, merge_parts, part_table, publish_version


def build_index(vectors: DataFrame, name: str, lists: int = LISTS) -> None:
    """Index ``vectors`` (doc_id, vector) under the new table ``name`` (``database.table``), a part for each list. The
    centroids are fitted once, on a bounded sample; an index whose corpus has changed much is built anew under
    another name. Of equal ids the greatest vector counts; null ids and vectors are left out."""
    spark = vectors.sparkSession
    if spark.catalog.tableExists(name):
        raise ValueError(f"{name} exists")
    vectors = _one_each(vectors)
    centroids = fit_lists(vectors, lists)
    rows = [(i, c.tolist()) for i, c in enumerate(centroids)]
    publish_version(spark.createDataFrame(rows, "list int, centroid array<double>"), f"{name}_centroids")
    placed = in_lists(vectors, centroids)
    create_buckets_if_missing(spark, name, placed.schema)
    merge_parts(placed, name, placed.schema, _part(), lambda before, rows: rows)


def refresh_index(changed: DataFrame, name: str) -> None:
    """Bring the vectors of ``changed`` (doc_id, vector) up to date: new ids are added, known ones move to their new list,
    and those with a null vector leave. Lists that neither held nor receive a changed id keep their files."""
    spark, changed = changed.sparkSession, _one_each(changed)
    placed = in_lists(changed, _centroids(spark, name))
    known = _indexed(spark, name).join(changed.select("doc_id"), "doc_id", "left_semi").select("doc_id", "list")
    nothing = {"distance": F.lit(None).cast("double"), "vector": F.lit(None).cast("array<double>")}

    def moved(before: DataFrame, rows: DataFrame) -> DataFrame:
        stays = before.join(rows.select("doc_id").distinct(), "doc_id", "left_anti")
        return stays.unionByName(rows.where(F.col("vector").isNotNull()))

    merge_parts(placed.unionByName(known.withColumns(nothing)), name, placed.schema, _part(), moved)


def search_index(spark: SparkSession, name: str, queries: DataFrame, cfg: Config, k: int = 4, probes: int = PROBES, exact: bool = True) -> DataFrame:
    """``search_lists`` over the stored index; parts that no query visits are not read."""
    return search_lists(_indexed(spark, name), _centroids(spark, name), queries, cfg, k, probes, exact)


def _part() -> Column:
    return F.col("list").cast("string")


def _one_each(vectors: DataFrame) -> DataFrame:
    kind, vector = id_kind(vectors), F.max(F.col("vector").cast("array<double>")).alias("vector")
    return vectors.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast(kind).alias("doc_id")).agg(vector)


def _indexed(spark: SparkSession, name: str) -> DataFrame:
    return part_table(spark, name).select("doc_id", F.col("bucket").cast("int").alias("list"), "distance", "vector")


def _centroids(spark: SparkSession, name: str) -> np.ndarray:
    """One row a list, as many as ``build_index`` was told."""
    rows = spark.table(f"{name}_centroids").orderBy("list").collect()
    return np.array([r["centroid"] for r in rows]) if rows else np.zeros((0, 0))
