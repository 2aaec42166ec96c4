"""Near-duplicates against brute-force Jaccard similarity."""

from __future__ import annotations

import random
import re
from collections import Counter

from meterwise.llm import similar, simhash

SF = "/root/testdata/sf0.01"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_groups(docs, least=0.8):
    """The smallest id that links of at least ``least`` reach, by id."""
    sets = {}
    for i, text in docs:
        sets.setdefault(shingles(text), []).append(i)
    distinct = list(sets)
    parent = list(range(len(distinct)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    places = {}
    for n, s in enumerate(distinct):
        for x in s:
            places.setdefault(x, []).append(n)
    links = 0
    for n, s in enumerate(distinct):
        shared = Counter(m for x in s for m in places[x] if m < n)
        for m, both in shared.items():
            if both / (len(s) + len(distinct[m]) - both) >= least:
                links += 1
                a, b = top(n), top(m)
                parent[max(a, b)] = min(a, b)
    least_id = {}
    for n, s in enumerate(distinct):
        least_id[top(n)] = min(least_id.get(top(n), min(sets[s])), min(sets[s]))
    return {i: least_id[top(n)] for n, s in enumerate(distinct) for i in sets[s]}, links


def edited(words, share, draw):
    return " ".join(w if draw.random() > share else f"x{draw.randrange(10**6)}" for w in words)


def copies(n, seed, share, start=0, length=150):
    draw = random.Random(seed)
    base = [f"w{draw.randrange(500)}" for _ in range(length)]
    return [(start + i, edited(base, share * draw.random(), draw)) for i in range(n)]


def found(spark, docs):
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    return {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(frame).collect()}


def test_groups_around_the_bound(spark):
    """Copies with up to a twentieth of their words changed: many pairs lie at 0.8, many groups share buckets."""
    docs = copies(150, 1, 0.05) + copies(100, 2, 0.03, 1000) + copies(60, 3, 0.08, 2000) + [(5000, None), (5001, ""), (5002, "one two"), (5003, "One TWO")]
    want, _ = brute_groups(docs)
    got = found(spark, docs)
    assert len(got) == len(docs) and got[5000] == got[5001] == 5000 and got[5002] == got[5003] == 5002
    assert sum(got[i] == want[i] for i in want) >= 0.99 * len(want)
    # Nothing is linked that brute force keeps apart.
    assert {(got[i], want[i]) for i in want} >= {(c, want[c]) for c in got.values()} and all(want[got[i]] == want[i] for i in want)


def test_chains_are_followed(spark):
    draw = random.Random(4)
    text = [f"w{i}" for i in range(200)]
    docs = []
    for i in range(12):  # neighbours differ in three words, the ends in thirty
        docs.append((i, " ".join(text)))
        text = [w if j // 16 != i or j % 16 > 2 else f"y{draw.randrange(10**6)}" for j, w in enumerate(text)]
    assert brute_groups(docs)[0] == {i: 0 for i in range(12)} == found(spark, docs)


def test_real_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want, links = brute_groups(docs)
    got = found(spark, docs)
    assert links > 0 and sum(got[i] == want[i] for i in want) >= 0.99 * len(want)
    assert all(want[got[i]] == want[i] for i in want)


def test_pairs_grow_with_members_only(spark, monkeypatch):
    sizes = []
    settle = similar.settle

    def counting(df, label):
        kept = settle(df, label)
        sizes.append((label, kept.count()))
        return kept

    monkeypatch.setattr(similar, "settle", counting)
    docs = [row for g in range(4) for row in copies(120, g, 0.1, 1000 * g, 80)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    similar.similar_roots(similar.with_signatures(frame)).count()
    members = max(n for label, n in sizes if label == "buckets")
    assert [n for label, n in sizes if label == "pairs"] and all(n <= (similar.DRAWN + 2) * members for label, n in sizes if label in ("pairs", "similar"))


def test_columns_of_any_name_come_back(spark):
    docs = [(i, "a b c d e f g", i * 7, f"k{i}", 0.5, "s", i) for i in range(3)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, row int, fp string, bands double, doc string, _row int")
    assert [tuple(r) for r in simhash.one_of_each(frame).collect()] == docs[:1]


def repeated(seed, words, times, tail=5):
    """A long part that is the same for all seeds, and an end that is not."""
    draw = random.Random(seed)
    return " ".join([f"c{i}" for i in range(words)] * times + [f"t{draw.randrange(10**6)}" for _ in range(tail)])


def test_near_fingerprints_are_linked_too(spark):
    """Fingerprints count repeats, sets do not: texts within two bits may be unlike as sets."""

    def bits(a, b):
        return (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count()

    def alike(a, b):
        return len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))

    base = repeated(0, 21, 6)
    near = next(t for t in (repeated(n, 21, 6) for n in range(1, 500)) if bits(base, t) in (1, 2))
    equal = [repeated(n, 5, 40, 9) for n in range(3)]
    far = " ".join(f"{w}{i // 3}" for i, w in enumerate(equal[0].split()))
    copy = " ".join([*near.split()[84:], "end"])  # like near as a set, reached from base over it only
    assert alike(base, near) < 0.8 and alike(equal[0], equal[1]) < 0.8 and bits(equal[0], equal[1]) == 0
    assert alike(near, copy) >= 0.8 and bits(base, copy) > 2 and bits(near, copy) > 2
    docs = [(1, base), (2, near), (3, copy), (4, far), *((5 + i, t) for i, t in enumerate(equal)), (9, None), (10, " ")]
    want = {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 5, 9: 9, 10: 9}
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert sorted(r["doc_id"] for r in simhash.one_of_each(frame).collect()) == sorted(set(want.values()))
    assert all(want[r["doc_id"]] == want[r["component_id"]] for r in simhash.near_fingerprints(frame).collect())
