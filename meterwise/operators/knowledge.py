"""The document corpus: upsert, changed rows, filters and exact similarity search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterwise.config import Config
from meterwise.functions.vectors import best_pairs, hit_table, id_type, keep_best, plain_ids, unit_rows
from meterwise.functions.versioning import newest_version, top_per_key
from meterwise.session import settle

CONTENT_COLUMNS = ["title", "content", "source", "tags"]
WHOLE_NUMBERS = ("tinyint", "smallint", "int", "bigint")


def _hits(kind: str) -> str:
    return f"query_id long, doc_id {kind}, score double"


def upsert_documents(documents: DataFrame, batch: DataFrame, key: str = "doc_id") -> DataFrame:
    """The corpus after the batch: its rows replace those of equal key, the rest are
    added. Within the batch the newest row of a key wins. Only keys of the batch meet
    the corpus, so a small batch does not make the corpus move. A null key in the batch is
    an error when the rows are read."""
    refused = F.raise_error(F.lit(f"a document without {key} cannot be upserted"))
    batch = batch.withColumn(key, F.coalesce(F.col(key), refused))
    kept = documents.join(batch.select(key), key, "left_anti")
    return kept.unionByName(newest_version(batch, [key], "updated_at"))


def content_hash() -> Column:
    return F.xxhash64(*[F.coalesce(F.col(c), F.lit("")) for c in CONTENT_COLUMNS])


def index_state(documents: DataFrame) -> DataFrame:
    """What the index remembers of each document."""
    return documents.select("doc_id", content_hash().alias("content_hash"))


def changed_documents(documents: DataFrame, indexed: DataFrame) -> DataFrame:
    """Documents that the index lacks or has with other content.

    The comparison moves keys and hashes only. The changed keys are written before
    texts meet them: with their true size known, a few keys are broadcast and no text
    moves, and many are joined by a shuffle.
    """
    changed = index_state(documents).join(indexed, ["doc_id", "content_hash"], "left_anti")
    return documents.join(settle(changed.select("doc_id"), "changed-documents"), "doc_id", "left_semi")


def documents_by_tag(documents: DataFrame, source: str | None = None, tag: str | None = None) -> DataFrame:
    if source is not None:
        documents = documents.where(F.col("source") == source)
    if tag is not None:
        documents = documents.where(F.array_contains(F.split("tags", ","), tag))
    return documents


def label_centroids(vectors: DataFrame) -> DataFrame:
    """The mean vector of each label, as (query_id, vector)."""
    per_dimension = (
        vectors.select("label", F.posexplode("vector").alias("i", "x"))
        .groupBy("label", "i")
        .agg(F.avg("x").alias("x"))
    )
    # As many entries per label as the vectors have dimensions.
    ordered = F.sort_array(F.collect_list(F.struct("i", "x")))
    return per_dimension.groupBy(F.col("label").cast("long").alias("query_id")).agg(
        F.transform(ordered, lambda e: e["x"]).alias("vector")
    )


def _search_held_queries(
    documents: DataFrame, query_ids: np.ndarray, queries: np.ndarray, k: int, kind: str
) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = (np.empty(0, np.int64), plain_ids(pa.array([], id_type(kind))), np.empty(0))
        for batch in batches:
            if batch.num_rows:
                ids = plain_ids(batch.column("doc_id"))
                found = best_pairs(query_ids, queries, ids, unit_rows(batch.column("vector")), k)
                best = keep_best(*[np.concatenate(pair) for pair in zip(best, found)], k)
        yield from hit_table(*best, id_type(kind)).to_batches()

    return documents.mapInArrow(search, _hits(kind))


def _search_in_blocks(documents: DataFrame, queries: DataFrame, k: int, cfg: Config, kind: str) -> DataFrame:
    """Many queries: a grid of query blocks and document slices, one cell per group.
    Both sides are cut by hash, so cells are of even, bounded size and nothing passes
    through the driver."""
    size = cfg.query_vectors_per_task
    blocks = max(1, -(-queries.count() // size))
    slices = max(1, -(-documents.count() // (16 * size)))

    def cut(key: str, parts: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(parts)).cast("long")

    def repeat(parts: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))

    left = documents.withColumn("slice", cut("doc_id", slices)).withColumn("block", repeat(blocks))
    right = queries.withColumn("block", cut("query_id", blocks)).withColumn("slice", repeat(slices))

    def cell(docs: pa.Table, wanted: pa.Table) -> pa.Table:
        if not docs.num_rows or not wanted.num_rows:
            return hit_table([], [], [], id_type(kind))
        return hit_table(
            *best_pairs(
                wanted["query_id"].to_numpy(),
                unit_rows(wanted["vector"].combine_chunks()),
                plain_ids(docs["doc_id"].combine_chunks()),
                unit_rows(docs["vector"].combine_chunks()),
                k,
            ),
            id_type(kind),
        )

    return left.groupBy("block", "slice").cogroup(right.groupBy("block", "slice")).applyInArrow(cell, _hits(kind))


def semantic_topk(vectors: DataFrame, queries: DataFrame, cfg: Config, k: int = 4) -> DataFrame:
    """The ``k`` documents with the greatest cosine similarity to each query, exactly.

    ``queries`` is (query_id, vector). Each task scores its documents against all
    queries as a matrix product and passes on ``k`` hits per query, so pairs never reach
    a shuffle. ``doc_id`` keeps its kind, number or text. Scores are rounded to nine places,
    so that copies tie by id whatever the shape of a product. Few queries, which a bounded read confirms, travel to the
    tasks; more are searched block by block.
    """
    kind = "long" if dict(vectors.dtypes)["doc_id"] in WHOLE_NUMBERS else "string"
    documents = vectors.where(F.col("vector").isNotNull()).select(F.col("doc_id").cast(kind).alias("doc_id"), "vector")
    wanted = queries.where(F.col("vector").isNotNull()).select(
        F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector")
    )
    held = wanted.limit(cfg.query_vectors_per_task + 1).toArrow()
    if held.num_rows > cfg.query_vectors_per_task:
        hits = _search_in_blocks(documents, wanted, k, cfg, kind)
    elif held.num_rows:
        ids, matrix = held["query_id"].to_numpy(), unit_rows(held["vector"].combine_chunks())
        hits = _search_held_queries(documents, ids, matrix, k, kind)
    else:
        hits = vectors.sparkSession.createDataFrame([], _hits(kind))
    ranked = top_per_key(hits, ["query_id"], [F.desc("score"), F.asc("doc_id")], k, rank="rank")
    return ranked.select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def semantic_search(
    documents: DataFrame, vectors: DataFrame, queries: DataFrame, cfg: Config, k: int = 4
) -> DataFrame:
    """The hits of ``semantic_topk`` with their document fields. Ids meet as text, so that
    numbers find documents whose ids are text."""
    hits = semantic_topk(vectors, queries, cfg, k)
    fields = documents.select(F.col("doc_id").cast("string").alias("_id"), "title", "content", "source", "tags")
    return hits.withColumn("_id", F.col("doc_id").cast("string")).join(fields, "_id", "left").drop("_id")
