"""Search in inverted lists against the plain search."""

from __future__ import annotations

import re
from dataclasses import replace

import numpy as np
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from meterwise.operators import vector_index as index
from meterwise.operators.knowledge import semantic_topk
from meterwise.plans import vector_index as stored
from meterwise.sinks.tables import part_table

VECTORS, QUERIES = "doc_id {}, vector array<double>", "query_id long, vector array<double>"


@pytest.fixture(scope="module")
def clustered(spark):
    """Vectors around 20 directions, a third of them copies of one, some zero; queries near them, one zero, one far."""
    draw = np.random.default_rng(3)
    middles = draw.normal(size=(20, 16))
    docs = middles[draw.integers(0, 20, 900)] + 0.1 * draw.normal(size=(900, 16))
    docs[300:600] = docs[0]
    docs[5:8] = 0
    asked = np.vstack([docs[0], middles[:8] + 0.05 * draw.normal(size=(8, 16)), np.zeros(16), -middles.sum(axis=0)])
    rows = [(i, v.tolist()) for i, v in enumerate(docs)] + [(900, None)]
    return (
        spark.createDataFrame(rows, VECTORS.format("long")),
        spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)] + [(99, None)], QUERIES),
    )


@pytest.mark.parametrize("k", [1, 4, 400])
@pytest.mark.parametrize("probes", [1, 3])
def test_hits_equal_those_of_the_plain_search(spark, cfg, clustered, k, probes):
    vectors, queries = clustered
    centroids = index.fit_lists(vectors, lists=16)
    held = index.in_lists(vectors, centroids).cache()
    assert held.count() == 900 and len(centroids) == 16
    expected = rows_of(semantic_topk(vectors, queries, cfg, k))
    assert rows_of(index.search_lists(held, centroids, queries, cfg, k, probes)) == expected
    assert rows_of(index.search_lists(held, centroids, queries, replace(cfg, query_vectors_per_task=2), k, probes)) == expected


def test_far_lists_are_ruled_out_and_recall_without_the_second_pass_is_measured(spark, cfg, clustered):
    vectors, queries = clustered
    near = queries.where("query_id BETWEEN 1 AND 8")
    centroids = index.fit_lists(vectors, lists=16)
    held = index.in_lists(vectors, centroids)
    seen = []
    plain, index._hits = index._hits, lambda *a: (seen.append(a[3].sum()), plain(*a))[1]
    try:
        index.search_lists(held, centroids, near, cfg, 4, 2).collect()
    finally:
        index._hits = plain
    assert seen[0] == 16 and seen[1] < 8 * 14 / 2  # of 8 queries and 14 lists left to each
    expected = set(rows_of(semantic_topk(vectors, near, cfg, 4), "query_id", "doc_id"))
    found = set(rows_of(index.search_lists(held, centroids, near, cfg, 4, 2, exact=False), "query_id", "doc_id"))
    assert len(found & expected) >= 0.9 * len(expected)


def test_text_ids_empty_tables_and_no_queries(spark, cfg):
    vectors = spark.createDataFrame([("b-10", [1.0, 0.0]), ("b-9", [2.0, 0.0]), ("é", [1.0, 1.0])], VECTORS.format("string"))
    queries = spark.createDataFrame([(1, [1.0, 0.0])], QUERIES)
    centroids = index.fit_lists(vectors)
    held = index.in_lists(vectors, centroids)
    assert rows_of(index.search_lists(held, centroids, queries, cfg, 2), "rank", "doc_id") == [(1, "b-10"), (2, "b-9")]
    assert index.search_lists(held, centroids, queries.where("false"), cfg).isEmpty()
    none = vectors.where("false")
    centroids = index.fit_lists(none)
    assert len(centroids) == 0
    assert index.search_lists(index.in_lists(none, centroids), centroids, queries, cfg).isEmpty()
    assert index.in_lists(vectors.withColumn("vector", F.lit(None).cast("array<double>")), np.eye(2)).isEmpty()


def test_a_stored_index_follows_changes_and_leaves_other_lists_alone(spark, cfg, clustered):
    vectors, queries = clustered
    spark.sql("CREATE DATABASE IF NOT EXISTS index_tests")
    name = "index_tests.vectors"
    stored.build_index(vectors, name, lists=16)
    with pytest.raises(ValueError, match="exists"):
        stored.build_index(vectors, name)

    def files():
        rows = part_table(spark, name).select("bucket", F.input_file_name()).distinct().collect()
        return {b: {f for x, f in rows if x == b} for b, _ in rows}

    def same(now):
        expected = rows_of(semantic_topk(now, queries, cfg, 4))
        assert rows_of(stored.search_index(spark, name, queries, cfg, 4, 2)) == expected

    same(vectors)
    before = files()
    lists_of = {r["doc_id"]: str(r["list"]) for r in stored._indexed(spark, name).collect()}
    away = spark.createDataFrame([(20, None), (21, [float(x) for x in range(16)]), (5000, [1.0] * 16), (5000, [1.0] * 16), (None, [1.0] * 16)], VECTORS.format("long"))
    stored.refresh_index(away, name)
    now = vectors.where("doc_id NOT IN (20, 21)").union(away.where("doc_id <> 20").dropDuplicates(["doc_id"]))
    same(now)
    after = files()
    moved_to = {str(r["list"]) for r in stored._indexed(spark, name).where("doc_id IN (21, 5000)").collect()}
    assert {b for b in before if after.get(b) != before[b]} <= {lists_of[20], lists_of[21]} | moved_to
    stored.refresh_index(away, name)  # again: nothing doubles
    same(now)
    one = stored._indexed(spark, name).where(F.col("list").isin([int(lists_of[0])]))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*cast\(bucket", plan)  # other parts are not read
