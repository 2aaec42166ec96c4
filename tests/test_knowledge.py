from __future__ import annotations

from dataclasses import replace

import numpy as np
import pytest
from conftest import rows_of

from meterwise.operators import knowledge

DOCS = "doc_id string, title string, content string, source string, tags string, updated_at timestamp"


def doc(doc_id, content, when="2024-01-01 00:00:00", tags="a,b"):
    return (doc_id, "t", content, "s", tags, when)


def test_upsert_updates_inserts_and_keeps(frame):
    old = frame([doc("1", "one"), doc("2", "two")], DOCS)
    batch = frame(
        [doc("2", "zwei", "2024-01-02 00:00:00"), doc("2", "deux", "2024-01-03 00:00:00"), doc("3", "three")], DOCS
    )
    merged = knowledge.upsert_documents(old, batch)
    assert rows_of(merged, "doc_id", "content") == [("1", "one"), ("2", "deux"), ("3", "three")]


def test_changed_documents_sees_text_fields_and_not_the_time(frame):
    old = frame([doc("1", "one"), doc("2", "two"), doc("3", "three"), doc("4", None)], DOCS)
    now = frame(
        [
            doc("1", "one", "2024-01-09 00:00:00"),
            doc("2", "TWO"),
            doc("3", "three", tags="a"),
            doc("4", None),
            doc("5", "new"),
        ],
        DOCS,
    )
    changed = knowledge.changed_documents(now, knowledge.index_state(old))
    assert rows_of(changed, "doc_id") == [("2",), ("3",), ("5",)]


def test_documents_by_tag_matches_whole_tags(frame):
    docs = frame([doc("1", "x", tags="cost,spark"), doc("2", "x", tags="costs"), doc("3", "x", tags=None)], DOCS)
    assert rows_of(knowledge.documents_by_tag(docs, tag="cost"), "doc_id") == [("1",)]
    assert knowledge.documents_by_tag(docs, source="other").isEmpty()


@pytest.fixture(scope="module")
def vectors():
    draw = np.random.default_rng(5)
    docs = draw.integers(-3, 4, size=(400, 6)).astype(float)
    docs[100:240] = docs[0]  # a third of all documents are copies of one
    docs[7] = 0
    return docs, np.vstack([docs[0], draw.normal(size=(9, 6)), np.zeros(6)])


def brute_force(docs, queries, k):
    def unit(m):
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    scores = np.round(unit(queries) @ unit(docs).T, 9)
    return sorted(
        (q, int(d), rank + 1)
        for q in range(len(queries))
        for rank, d in enumerate(np.lexsort((np.arange(len(docs)), -scores[q]))[:k])
    )


@pytest.mark.parametrize("per_task", [1024, 3])
@pytest.mark.parametrize("k", [1, 4, 50])
def test_topk_is_exact_for_few_and_for_many_queries(spark, cfg, vectors, per_task, k):
    docs, queries = vectors
    held = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(docs)], "doc_id long, vector array<float>")
    wanted = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id long, vector array<float>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        hits = knowledge.semantic_topk(held, wanted, replace(cfg, query_vectors_per_task=per_task), k)
        found = {(r["query_id"], r["rank"]): r for r in hits.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    expected = brute_force(docs, queries.astype(np.float32).astype(float), k)
    assert len(found) == len(expected)
    # Equal scores may differ in their last bit, so compare scores by rank, and ids where copies tie.
    assert [found[0, r + 1]["doc_id"] for r in range(k)] == [d for q, d, _ in expected if q == 0]
    for q, d, rank in expected:
        assert found[q, rank]["score"] == pytest.approx(
            float(score_of(docs[d], queries[q])), abs=1e-6
        )


def score_of(a, b):
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return a @ b / n if n else 0.0


def test_vectors_of_other_length_are_refused_and_null_ones_skipped(spark, cfg):
    query = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<float>")
    schema = "doc_id long, vector array<float>"
    mixed = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, [1.0, 2.0, 3.0])], schema).coalesce(1)
    with pytest.raises(Exception, match="differ in length"):
        knowledge.semantic_topk(mixed, query, cfg).collect()
    some = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], schema)
    assert rows_of(knowledge.semantic_topk(some, query, cfg), "doc_id") == [(1,)]


def test_no_queries_give_no_hits(spark, cfg):
    docs = spark.createDataFrame([(1, [1.0])], "doc_id long, vector array<float>")
    none = spark.createDataFrame([], "query_id long, vector array<float>")
    assert knowledge.semantic_topk(docs, none, cfg).isEmpty()


def test_search_brings_the_document_fields(spark, frame, cfg):
    docs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "doc_id long, vector array<float>")
    query = spark.createDataFrame([(9, [1.0, 0.1])], "query_id long, vector array<float>")
    hits = knowledge.semantic_search(frame([doc("1", "one")], DOCS), docs, query, cfg, k=2)
    assert rows_of(hits, "query_id", "rank", "content") == [(9, 1, "one"), (9, 2, None)]


def test_centroids(spark):
    rows = spark.createDataFrame(
        [(1, [1.0, 3.0], 7), (2, [3.0, 5.0], 7), (3, [0.0, 0.0], 8)], "doc_id long, vector array<float>, label int"
    )
    assert rows_of(knowledge.label_centroids(rows)) == [(7, [2.0, 4.0]), (8, [0.0, 0.0])]


def test_upsert_refuses_a_null_key(frame):
    old = frame([doc("1", "one")], DOCS)
    with pytest.raises(Exception, match="cannot be upserted"):
        knowledge.upsert_documents(old, frame([doc(None, "a"), doc(None, "b")], DOCS)).collect()


@pytest.mark.parametrize("per_task", [1024, 2])
def test_text_ids_are_searched_and_copies_tie_by_id(spark, cfg, per_task):
    vectors = spark.createDataFrame(
        [("bench-10", [1.0, 0.0]), ("bench-9", [2.0, 0.0]), ("7", [0.0, 1.0]), ("é", [1.0, 1.0])],
        "doc_id string, vector array<double>",
    )
    queries = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(3)], "query_id long, vector array<double>")
    docs = spark.createDataFrame([("bench-9", "t", "c", "s", "a")], "doc_id string, title string, content string, source string, tags string")
    found = knowledge.semantic_search(docs, vectors, queries, replace(cfg, query_vectors_per_task=per_task), k=3)
    assert rows_of(found, "query_id", "rank", "doc_id", "title") == [
        (q, rank, i, t) for q in range(3) for rank, i, t in ((1, "bench-10", None), (2, "bench-9", "t"), (3, "é", None))
    ]
