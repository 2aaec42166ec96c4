"""What a task does with one batch of vectors."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# Tasks get these functions by value, so executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# Sums of products differ in their last bits with the shape of the matrices.
SCORE_PLACES = 9


def unit_rows(column: pa.Array) -> np.ndarray:
    """A list column as a matrix of unit vectors; a zero vector stays zero."""
    if len(pc.unique(pc.list_value_length(column))) != 1:
        raise ValueError("vectors differ in length")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    matrix = flat.reshape(len(column), -1)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def keep_best(query: np.ndarray, doc: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k hits of each query with the greatest score, ties by lower document id."""
    order = np.lexsort((doc, -score, query))
    query, doc, score = query[order], doc[order], score[order]
    _, first, per_query = np.unique(query, return_index=True, return_counts=True)
    kept = np.arange(len(query)) - np.repeat(first, per_query) < k
    return query[kept], doc[kept], score[kept]


def best_pairs(query_ids: np.ndarray, queries: np.ndarray, doc_ids: np.ndarray, docs: np.ndarray, k: int):
    scores = np.round(queries @ docs.T, SCORE_PLACES)
    if scores.shape[1] > k:
        # Whatever reaches the k-th score is a candidate, so no tie is lost.
        kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        q, d = np.nonzero(scores >= kth)
    else:
        q, d = np.indices(scores.shape).reshape(2, -1)
    return keep_best(query_ids[q], doc_ids[d], scores[q, d], k)


def id_type(kind: str) -> pa.DataType:
    return pa.int64() if kind == "long" else pa.string()


def plain_ids(column: pa.Array) -> np.ndarray:
    """Ids that numpy can order: whole numbers, or text by code point."""
    ids = column.to_numpy(zero_copy_only=False)
    return ids.astype(np.int64) if pa.types.is_integer(column.type) else ids.astype(str)


def hit_table(query: np.ndarray, doc: np.ndarray, score: np.ndarray, doc_type: pa.DataType) -> pa.Table:
    return pa.table(
        {
            "query_id": pa.array(query, pa.int64()),
            "doc_id": pa.array(list(doc), doc_type),
            "score": pa.array(score, pa.float64()),
        }
    )
