"""SimHash near-duplicates, linked by BK-trees of shards.

Fingerprints that differ in at most two of 64 bits agree on one of any three parts of the
bits. So each distinct fingerprint goes to three shards, keyed by a part and its value;
every link lies within a shard. A shard that is too large is divided again in the same
way by its remaining bits. Each shard's tree is built where its members meet.

Near copies further apart are linked beside that by the similarity of their shingle sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterwise.llm.arrow import text_slices
from meterwise.llm.components import smallest_reachable
from meterwise.llm.similar import SIMILARITY, similar_roots, with_signatures
from meterwise.session import settle

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 2
# Members of a shard up to which its tree is built at once.
TREE_MEMBERS = 1024
# After so many divisions at most 13 bits are left, and so 2^13 members.
LEVELS = 4


def fingerprint(text: str) -> int:
    """SimHash of the shingles of the words, unsigned; 0 without words."""
    words = text.encode().lower().split()  # bytes: only A-Z is lowered, only ASCII white space divides
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= SHINGLE_WORDS:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        shingles = zip(starts[: n - SHINGLE_WORDS + 1].tolist(), ends[SHINGLE_WORDS - 1 :].tolist(), strict=True)
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in shingles), np.uint64, n - SHINGLE_WORDS + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


@F.arrow_udf(T.LongType())
def simhash(text: pa.Array) -> pa.Array:
    """The fingerprint of each text (null: empty) as a signed long."""
    values = [fingerprint(t) for part in text_slices(text) for t in part.to_pylist()]
    return pa.array(np.array(values, np.uint64).view(np.int64))


def parts_of(mask: int, parts: int = RADIUS + 1) -> list[int]:
    """``mask`` joined with each of three parts of the other bits."""
    rest = [b for b in range(64) if not mask >> b & 1]
    return [mask | sum(1 << b for b in rest[i * len(rest) // parts : (i + 1) * len(rest) // parts]) for i in range(parts)]


def masks(levels: int = LEVELS) -> list[list[int]]:
    """By level; the children of mask i are masks 3i, 3i + 1 and 3i + 2 of the next."""
    tree = [[0]]
    for _ in range(levels):
        tree.append([child for mask in tree[-1] for child in parts_of(mask)])
    return tree[1:]


class BKTree:
    """Children are keyed by their distance to the parent; a search follows only the edges
    within the radius of its own distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.edges: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.values.append(value)
        self.edges.append({})
        node, new = 0, len(self.values) - 1
        while node != new:
            node = self.edges[node].setdefault((self.values[node] ^ value).bit_count(), new)

    def within(self, value: int, radius: int) -> Iterator[int]:
        """The places of the members within ``radius``."""
        work = [0] if self.values else []
        while work:
            node = work.pop()
            d = (self.values[node] ^ value).bit_count()
            if d <= radius:
                yield node
            edges = self.edges[node]
            if len(edges) <= 2 * radius + 1:
                work += [child for e, child in edges.items() if -radius <= e - d <= radius]
            else:
                work += [edges[e] for e in range(d - radius, d + radius + 1) if e in edges]


def forest(members: list[int]) -> list[tuple[int, int]]:
    """(member, root) of all but the roots of the groups that links within a shard form:
    fewer rows than members, whatever the number of links."""
    tree, root = BKTree(), list(range(len(members)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i, value in enumerate(members):
        for j in tree.within(value & (1 << 64) - 1, RADIUS):
            a, b = sorted((top(i), top(j)))
            root[b] = a
        tree.add(value & (1 << 64) - 1)
    return [(v, members[top(i)]) for i, v in enumerate(members) if top(i) != i]


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (mask, key, fp) sorted by shard: the links of one shard after the other."""
    shard, members = None, []

    def links() -> pa.RecordBatch:
        pairs = forest(members) if len(members) > 1 else []
        return pa.RecordBatch.from_arrays(
            [pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"]
        )

    for batch in batches:
        for mask, key, fp in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (mask, key) != shard:
                if len(members) > 1:
                    yield links()
                shard, members = (mask, key), []
            members.append(fp)
    if len(members) > 1:
        yield links()


def near_links(fingerprints: DataFrame, tree_members: int = TREE_MEMBERS) -> DataFrame:
    """Links (``a``, ``b``) that join all distinct ``fp`` within the radius, directly or
    over others: a spanning forest of each shard."""
    frontier, found = fingerprints.select("fp", F.lit(0).alias("parent")), None
    for level, level_masks in enumerate(masks()):
        children = F.explode(F.array(*[3 * F.col("parent") + i for i in range(3)])).alias("mask")
        value = F.element_at(F.lit([m - (m >> 63 << 64) for m in level_masks]), F.col("mask") + 1)
        keyed = frontier.select("fp", children).withColumn("key", F.col("fp").bitwiseAND(value))
        sizes = keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
        shared = settle(keyed.join(sizes, ["mask", "key"]), f"shards-{level}")
        last = level == LEVELS - 1
        small = shared if last else shared.where(F.col("members") <= tree_members)
        members = small.select("mask", "key", "fp").repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
        links = members.mapInArrow(_trees, "a long, b long")
        found = links if found is None else found.union(links)
        large = shared.where(F.col("members") > tree_members)
        if last or large.isEmpty():
            break
        frontier = large.select("fp", F.col("mask").alias("parent"))
    return found.distinct()


def near_fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` of each row of ``docs`` (``doc_id``, ``text``): fingerprints within the
    radius are linked.

    The component is the smallest ``doc_id`` reachable over links; null only if all its
    ids are null. Texts without words (null, empty) have fingerprint 0 and are linked like
    others. Rows of equal ``doc_id`` get a row each. Equal fingerprints are one node, so copies
    cost nothing but their row. An empty table gives no rows. Further columns are left out.
    """
    prints = settle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), simhash("text").alias("fp")), "fingerprints")
    return prints.join(components_of(prints, lambda nodes: smallest_reachable(near_links(nodes)).withColumnRenamed("node", "fp")), "fp").select("doc_id", "fp", "component_id")


def fingerprint_links(signed: DataFrame) -> DataFrame:
    """Links (``a``, ``b``) between sets of ``signed`` (``fp``, ``simhash``) that join all whose texts have fingerprints
    within the radius, directly or over others. A fingerprint of several sets is named by the smallest one."""
    prints = settle(signed.select("simhash", "fp").distinct(), "fingerprints")
    nodes = settle(prints.groupBy("simhash").agg(F.min("fp").alias("first")), "nodes")
    equal = prints.join(nodes, "simhash").select(F.col("fp").alias("a"), F.col("first").alias("b"))
    a, b = (nodes.select(F.col("simhash").alias(k), F.col("first").alias(f"first_{k}")) for k in "ab")
    near = near_links(nodes.select(F.col("simhash").alias("fp"))).join(a, "a").join(b, "b").select("first_a", "first_b")
    return settle(equal.union(near).where("a <> b"), "near")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """As ``near_fingerprints``, but texts are linked whose sets of five-word shingles are at least as
    similar as ``similarity`` (Jaccard), and ``fp`` is a digest of the set."""
    signed = with_signatures(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    prints = signed.select("doc.doc_id", "fp")
    found = components_of(prints, lambda _: similar_roots(signed, similarity))
    return prints.join(found, "fp").select("doc_id", "fp", "component_id")


def components_of(prints: DataFrame, roots_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``fp``, ``root`` (a fingerprint that names the component) and ``component_id`` of the distinct
    fingerprints of ``prints`` (``doc_id``, ``fp``); ``roots_of`` them gives those that are not their own root."""
    nodes = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    rooted = nodes.join(roots_of(nodes.select("fp")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(firsts, "root").select("fp", "root", "component_id")


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stand for their component, with all columns: the one of smallest ``doc_id`` (null
    last), then of smallest text hash; of equal rows, one. The links are those of ``near_fingerprints`` and, for near
    copies further apart, those of ``near_duplicates``.

    Numbers and digests of the rows decide; the winners are then met with the rows,
    whose texts are not shuffled while the winners' ids fit a broadcast.
    """
    signed = with_signatures(docs, simhash=simhash("text"))
    prints = signed.select("row", F.col("doc.doc_id").cast("long").alias("doc_id"), "fp", F.xxhash64("doc.text").alias("digest"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "digest", "row")
    firsts = prints.groupBy("fp").agg(F.min(order).alias("first"))
    found = components_of(prints, lambda _: similar_roots(signed, similarity, fingerprint_links(signed)))
    winners = firsts.join(found, "fp").groupBy("root").agg(F.min("first").alias("first"))
    return signed.join(winners.select("first.row"), "row", "left_semi").select("doc.*")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
