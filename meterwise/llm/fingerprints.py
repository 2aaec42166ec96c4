"""Document fingerprints: homomorphic multiset hashes of paragraphs, in DataFrame
functions only.

A fingerprint is an array of longs, the sum of one such vector per paragraph, so it does
not depend on their order, and a paragraph is inserted or deleted by adding or taking its
vector. ``[0]`` is the number of phrases, ``[1:3]`` two sums of paragraph hashes modulo
2^62, which decide equality, and the rest sums of phrase bits: each long has three lanes
modulo 2^20, one for every component. As sums of random signs the lanes keep angles: their cosine estimates
how much two texts share.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A phrase: up to 48 characters without line break or sentence end, and the ends after it.
PHRASE = r"[^\n.!?]{1,48}[.!?]*|[.!?]+"
LANE_BITS, LANES, SHIFTS, HASHES = 21, 3, 21, 2
ONES = sum(1 << LANE_BITS * i for i in range(LANES))
LANE_MASK = sum(((1 << LANE_BITS - 1) - 1) << LANE_BITS * i for i in range(LANES))
SUM_MASK = (1 << 62) - 1


def paragraphs(text: Column) -> Column:
    return F.split(text, "\n")


def phrases(text: Column) -> Column:
    trimmed = F.transform(F.regexp_extract_all(text, F.lit(PHRASE), F.lit(0)), lambda p: F.trim(p))
    return F.filter(trimmed, lambda p: p != "")


def masked_sum(hashes: Column, part: callable, mask: int) -> Column:
    """The sum over ``hashes`` modulo the powers that ``mask`` stands for."""
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda s, h: (s + part(h)).bitwiseAND(F.lit(mask)))


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text (null: empty), an array of 45 longs."""
    text = F.coalesce(text, F.lit(""))
    sums = [
        masked_sum(F.transform(paragraphs(text), lambda p: F.xxhash64(F.lit(k), p)), lambda h: h.bitwiseAND(F.lit(SUM_MASK)), SUM_MASK)
        for k in (1, 2)
    ]

    def lanes(hashes: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(SHIFTS - 1)),
            lambda j: F.aggregate(
                hashes,
                F.lit(0).cast("long"),
                lambda s, h: (s + F.call_function("shiftrightunsigned", h, j).bitwiseAND(F.lit(ONES))).bitwiseAND(F.lit(LANE_MASK)),
            ),
        )

    def of_phrases(p: Column) -> Column:
        count = F.array(F.size(p).cast("long"))
        per_hash = [F.flatten(F.transform(F.array(F.transform(p, lambda x: F.xxhash64(F.lit(k), x))), lanes)) for k in range(3, 3 + HASHES)]
        return F.concat(count, F.array(*sums), *per_hash)

    return F.flatten(F.transform(F.array(phrases(text)), of_phrases))


def signed_lanes(print_: Column) -> Column:
    """Each lane as a sum of signs: twice its ones less the phrases."""
    low = (1 << LANE_BITS - 1) - 1
    packed = F.slice(print_, 4, SHIFTS * HASHES)
    each = F.flatten(
        F.transform(packed, lambda v: F.array(*[F.shiftrightunsigned(v, LANE_BITS * i).bitwiseAND(F.lit(low)) for i in range(LANES)]))
    )
    return F.transform(each, lambda x: (2 * x - F.get(print_, F.lit(0))).cast("double"))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the estimated cosine of two fingerprints' phrase counts (share of common phrases); 1 if equal,
    0 if only one is empty. The estimate's standard error is about 0.09."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    def cosine(x: Column) -> Column:
        norms = F.sqrt(dot(x["a"], x["a"]) * dot(x["b"], x["b"]))
        return F.when(norms > 0, F.least(F.greatest(dot(x["a"], x["b"]) / norms, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)

    pair = F.array(F.struct(signed_lanes(a).alias("a"), signed_lanes(b).alias("b")))
    return F.when(a == b, F.lit(1.0)).otherwise(F.element_at(F.transform(pair, cosine), 1))


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint ``a`` with the paragraphs of ``b`` inserted (``sign`` 1) or deleted
    (-1), lane by lane."""
    low = (1 << LANE_BITS - 1) - 1
    count = F.array(F.get(a, F.lit(0)) + sign * F.get(b, F.lit(0)))

    def lanewise(x: Column, y: Column) -> Column:
        terms = []
        for i in range(LANES):
            p, q = (F.shiftrightunsigned(v, LANE_BITS * i).bitwiseAND(F.lit(low)) for v in (x, y))
            terms.append(F.shiftleft((p + sign * q).bitwiseAND(F.lit(low)), LANE_BITS * i))
        return terms[0].bitwiseOR(terms[1]).bitwiseOR(terms[2])

    sums = F.zip_with(F.slice(a, 2, 2), F.slice(b, 2, 2), lambda x, y: (x + sign * y).bitwiseAND(F.lit(SUM_MASK)))
    return F.concat(count, sums, F.zip_with(F.slice(a, 4, SHIFTS * HASHES), F.slice(b, 4, SHIFTS * HASHES), lanewise))


def as_text(print_: Column) -> Column:
    return F.array_join(F.transform(print_, lambda v: F.lower(F.hex(v))), ":")


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last floor(n / 2) code points replaced by the first as many (or all)
    of ``following``."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))
