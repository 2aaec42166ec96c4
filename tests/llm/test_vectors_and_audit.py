"""Clusters, neighbours and the filter audit against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterwise.llm import centroids, filter_audit, graphs

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


def vectors_of(spark, rows, kind="float"):
    """Rows (vec_id, components), with further columns of names that the operators use."""
    data = [(i, v if v is None else [None if x is None else float(x) for x in v], 7, "x", 0.5) for i, v in rows]
    return spark.createDataFrame(data, f"vec_id long, embedding array<{kind}>, row int, cluster string, score double")


def random_rows(n, d=64, seed=1):
    draw = np.random.default_rng(seed)
    return [(i, draw.normal(size=d).round(3).tolist()) for i in range(n)]


# --- clusters -------------------------------------------------------------------------


def brute_clusters(rows, k=40, rounds=5):
    kept = [(i, v) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    ints = np.array([np.floor(256 * np.array(v, np.float32).astype(float)) for _, v in kept]).astype(np.int64).reshape(-1, 64)
    digest = [hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest() for i, _ in kept]
    order = sorted(range(len(kept)), key=lambda j: (digest[j], ints[j].tolist()))[:k]
    means = ints[order].copy()

    def nearest():
        d = ((ints[:, None] - means[None]) ** 2).sum(axis=2)
        return d.argmin(axis=1), d.min(axis=1)

    for _ in range(rounds if len(kept) else 0):
        at, _ = nearest()
        for c in range(len(means)):
            if (at == c).any():
                means[c] = [int(s) // int((at == c).sum()) for s in ints[at == c].sum(axis=0)]
    if not kept:
        return Counter()
    at, distance = nearest()
    sha = [hashlib.sha256(",".join(map(str, m.tolist())).encode()).hexdigest() for m in means]
    inertia = np.bincount(at, distance, len(means)).astype(int)
    return Counter((i, int(c), int(d), int(inertia[c]), int(distance.sum()), sha[c]) for (i, _), c, d in zip(kept, at, distance))


ODD = [
    (1, None), (2, []), (3, [1.0] * 63), (4, [1.0] * 65), (5, [None] + [1.0] * 63), (6, [NAN] + [1.0] * 63), (7, [INF] + [1.0] * 63),
    (8, [0.0] * 64), (8, [0.0] * 64), (8, [0.5] * 64), (None, [0.5] * 64), (None, [-0.25] * 64), (9, [-0.001] * 64),
]


@pytest.mark.parametrize(
    "rows",
    [
        random_rows(300),
        ODD,
        ODD + random_rows(60, seed=2),
        [(i, [1.0, -1.0] * 32) for i in range(100)] + random_rows(50),
        [(i, [float(i % 3)] * 64) for i in range(90)],
        [],
    ],
    ids=["random", "odd", "mixed", "copies", "ties", "empty"],
)
def test_clusters_against_brute_force(spark, rows):
    found = centroids.cluster_vectors(vectors_of(spark, rows).repartition(3))
    columns = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert found.columns == columns
    assert Counter(tuple(r) for r in found.collect()) == brute_clusters(rows)


@pytest.mark.parametrize("leading", [1, 16, 64])
def test_bound_rules_out_no_nearest_centroid(leading):
    draw = np.random.default_rng(3)
    ints = draw.integers(-(1 << 20), 1 << 20, (500, 64)) // draw.integers(1, 1 << 18, (500, 1))
    means = np.vstack([ints[:30], ints[:5]])  # equal centroids: the smaller number
    _, axes = np.linalg.eigh(np.cov(ints.T))
    rotation = centroids.Rotation(ints.mean(axis=0), axes[:, ::-1][:, :leading])
    at, distance = centroids.nearest(ints, *rotation(ints), means, rotation)
    every = ((ints[:, None] - means[None]) ** 2).sum(axis=2)
    assert (at == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()


def test_components_out_of_range_end_the_job(spark):
    with pytest.raises(Exception, match="too large"):
        centroids.cluster_vectors(vectors_of(spark, [(1, [1e9] * 64)])).collect()


# --- neighbours -----------------------------------------------------------------------


def brute_hits(rows, k, is_query):
    """(query place, query id) and its ranked (id, score)."""
    usable = [(i, v) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for a, (i, v) in enumerate(usable):
        if i is None or not is_query(i):
            continue
        scored = [(-float(np.dot(np.array(v, np.float64), np.array(w, np.float64))), j is None, j or 0, j) for b, (j, w) in enumerate(usable) if b != a and len(w) == len(v)]
        out.append((i, [(j, -s) for s, _, _, j in sorted(scored, key=lambda x: x[:3])[:k]]))
    return out


def found_hits(frame):
    hits = {}
    for r in frame.collect():
        hits.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(h, key=lambda x: x[0]) for q, h in hits.items()}


def test_neighbours_of_odd_rows(spark):
    rows = [
        (0, [1.0, 2.0]), (1, [2.0, 4.0]), (2, [2.0, 4.0]), (3, None), (4, [0.0, 0.0]), (5, [NAN, 1.0]), (6, [INF, 1.0]), (7, [None, 1.0]),
        (8, []), (9, [-1.0, 0.5]), (None, [2.0, 4.0]), (20, [1.0, 0.0, 0.0]), (21, [0.5, 0.0, 0.0]), (40, [5.0]),
    ]
    want = brute_hits(rows, 20, lambda i: i % 20 == 0)
    got = found_hits(graphs.nearest_neighbours(vectors_of(spark, rows, "double"), F.col("vec_id") % 20 == 0))
    assert got == {q: [(r, j, s) for r, (j, s) in enumerate(hits, 1)] for q, hits in want if hits}
    assert got[0][0][1] == 1 and got[0][2][1] is None  # ties by id, null last


def test_repeated_query_rows_find_one_another(spark):
    rows = [(0, [1.0, 1.0]), (0, [1.0, 1.0]), (3, [3.0, 3.0])]
    found = graphs.nearest_neighbours(vectors_of(spark, rows), F.col("vec_id") == 0).collect()
    assert Counter((r["query_id"], r["rank"], r["vec_id"]) for r in found) == {(0, 1, 3): 2, (0, 2, 0): 2}


def test_no_rows_without_vectors(spark):
    assert graphs.nearest_neighbours(vectors_of(spark, [(0, None), (20, [0.0])]), F.col("vec_id") % 20 == 0).collect() == []


def test_copies_that_fill_a_third_are_ranked_by_id(spark):
    rows = random_rows(200, 8) + [(i, [3.0] * 8) for i in range(200, 300)]
    got = found_hits(graphs.nearest_neighbours(vectors_of(spark, rows, "double"), F.col("vec_id") % 100 == 0))
    for q, hits in brute_hits(rows, 20, lambda i: i % 100 == 0):
        assert [j for _, j, _ in got[q]] == [j for j, _ in hits]


@pytest.mark.parametrize(
    ("plan", "spread"),
    [
        (graphs.GraphPlan(), 4.0),
        (graphs.GraphPlan(shards=1, query_rows=50), 1.0),
        (graphs.GraphPlan(shards=1, search_width=384), 4.0),
    ],
    ids=["shards, lengths differ", "one graph, sliced queries", "one graph, lengths differ"],
)
def test_recall(spark, plan, spread):
    """Vectors without any structure: the hard case."""
    draw = np.random.default_rng(5)
    matrix = draw.normal(size=(3000, 64)) * draw.uniform(0.5, 0.5 * spread, (3000, 1))
    matrix = matrix.astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(matrix)]
    got = found_hits(graphs.nearest_neighbours(vectors_of(spark, rows), F.col("vec_id") % 20 == 0, plan))
    scores = matrix[::20].astype(float) @ matrix.T.astype(float)
    np.fill_diagonal(scores[:, ::20], -np.inf)
    best = np.argsort(-scores, axis=1, kind="stable")[:, :20]
    met = sum(len({j for _, j, _ in got[20 * q]} & set(best[q])) for q in range(len(best)))
    assert met / best.size >= 0.9
    assert all(abs(s - scores[q // 20, j]) < 1e-9 for q, hits in got.items() for _, j, s in hits)
    assert all([r for r, _, _ in hits] == list(range(1, 21)) for hits in got.values())


def test_graph_is_flat_layered_and_bounded(spark):
    plan = graphs.GraphPlan(shards=1)
    rows = graphs.searchable_rows(vectors_of(spark, random_rows(1000, 16)))
    index = graphs.build_index(rows, 1, plan).first()
    sizes = index["sizes"]
    assert sizes[-1] == 1000 and sizes == sorted(sizes) and len(sizes) > 1
    assert len(index["links"]) == sum(sizes[:-1]) * plan.links + sizes[-1] * 2 * plan.links
    ground = np.array(index["links"][-2000 * plan.links :]).reshape(1000, -1)
    reached, work = {0}, [0]
    while work:
        for j in ground[work.pop()]:
            if j >= 0 and j not in reached:
                reached.add(int(j))
                work.append(int(j))
    assert len(reached) > 980 and sorted(index["ids"]) == list(range(1000))


# --- filter audit ---------------------------------------------------------------------


def brute_mask(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    fails = [
        len(words) < 200,
        100 * len(set(words)) < 50 * len(words),
        100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
        bool(re.search("[#$%&*|]", text)),
    ]
    return sum(f << i for i, f in enumerate(fails))


def brute_audit(docs, labels):
    firsts = {}
    for i, text, _ in docs:
        if i is not None:
            firsts[text or ""] = min(i, firsts.get(text or "", i))
    good = {i for i, quality, _ in labels if quality == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    seen = [(lang or "", brute_mask(text or "") | (i is not None and i > firsts[text or ""]) << 4, i in good, i in toxic) for i, text, lang in docs]
    out, shares = {}, Counter()
    for part in {s[0] for s in seen}:
        for order in permutations("ABCDE"):
            left = [s for s in seen if s[0] == part]
            for step, letter in enumerate(order, 1):
                bit = 1 << "ABCDE".index(letter)
                gone, left = [s for s in left if s[1] & bit], [s for s in left if not s[1] & bit]
                fails = sum(bool(s[1] & bit) for s in seen if s[0] == part)
                shares[part, letter] += len(gone)
                alone = sum(s[1] == bit for s in seen if s[0] == part)
                out[part, "".join(order), step] = [len(left), len(gone), fails - len(gone), alone, sum(s[2] for s in gone), sum(s[3] for s in gone)]
    return {k: (*v, shares[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audit(spark, docs, labels):
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, lang string, mask string, digest int")
    lab = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, part string")
    rows = filter_audit.audit_filters(d.repartition(3), lab).collect()
    assert len({tuple(r)[:3] for r in rows}) == len(rows)
    return {tuple(r)[:3]: tuple(r)[3:] for r in rows}


def test_audit_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(300))
    docs = [
        (1, long, "en"), (2, long, "en"), (3, long, None), (3, long, "en"), (None, long, "en"), (None, long, "en"), (4, None, "en"), (5, "", "en"),
        (6, "A B C # d", "de"), (7, "a " * 400, "de"), (8, long + " #", "de"), (2, "other\x0btext\x85X", "de"), (9, "ÀÉ漢 AB", ""), (1, long, "en"),
    ]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, None, 1), (None, 1, 1), (99, 1, 1), (7, 0, 1), (6, 1, None)]
    assert audit(spark, docs, labels) == brute_audit(docs, labels)
    assert audit(spark, docs, []) == brute_audit(docs, [])
    assert audit(spark, [], labels) == {}


def test_audit_of_a_whole_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert audit(spark, docs, labels) == brute_audit(docs, labels)


@pytest.mark.parametrize("blocks", [1, 7])
def test_sketch_clears_unique_texts_only(spark, blocks):
    digests = spark.range(6000).select(F.xxhash64("id").alias("digest"))
    docs = digests.union(digests.limit(50))
    sketch = filter_audit.repeat_sketch(docs, blocks)
    flagged = filter_audit.with_repeat_flags(docs, sketch, blocks).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("may_repeat").alias("may"))
    assert flagged.where("n > 1 and not may").count() == 0
    cleared = flagged.where("n = 1 and not may").count()
    assert cleared > (0.85 if blocks == 1 else 0.98) * 5900
