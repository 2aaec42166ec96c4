"""How document filters interact: what each removes at each place of each order.

Only the combination of filters that a document fails matters, so documents shrink to counts
by part and failure mask, and all orders are read off these. Repeated texts are found behind
a counting Bloom sketch: a text with a cell that nothing else fell into is unique, and only the
others are shuffled.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterwise.session import settle

# The filters, in the order of the mask's bits.
FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 200, 50, 3
ODD_SIGNS = "[#$%&*|]"
WHITE = r"[\x20\x09-\x0D]+"
REPEATED = 1 << FILTERS.index("E")

# A block's flags are one bitmap of the built-in bitmap functions: 4 KB.
BLOCK_CELLS = 1 << 15
CELLS_PER_ROW = 16
# 128 MB of flags at most are broadcast. Beyond 67 million rows there are fewer cells a row, so more
# unique texts are shuffled; results stay exact.
MOST_BLOCKS = 1 << 15


def failure_mask(text: Column) -> Column:
    """The bits of the filters A to D that a text fails."""
    words = F.array_remove(F.split(text, WHITE), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    fails = [
        n < LEAST_WORDS,
        100 * distinct < DISTINCT_PERCENT * n,
        100 * F.regexp_count(text, F.lit("[A-Z]")) > UPPER_PERCENT * F.length(text),
        text.rlike(ODD_SIGNS),
    ]
    return sum((F.when(fail, 1 << bit).otherwise(0) for bit, fail in enumerate(fails)), F.lit(0))


def block_of(digest: Column, blocks: int) -> Column:
    return F.pmod(digest, F.lit(blocks)).cast("int")


def cells_of(digest: Column) -> Column:
    """The two cells of a text in its block, from its 64-bit hash."""
    mixed = F.xxhash64(digest)
    return F.array(*[F.shiftrightunsigned(mixed, 15 * i).bitwiseAND(F.lit(BLOCK_CELLS - 1).cast("long")) for i in range(2)])


def blocks_for(rows: int) -> int:
    return min(max(1, -(-rows * CELLS_PER_ROW // BLOCK_CELLS)), MOST_BLOCKS)


def repeat_sketch(digests: DataFrame, blocks: int) -> DataFrame:
    """``block`` and ``flags``, a bitmap of its cells that were met twice or more. Each task counts
    its own cells and the counters are summed; blocks without such a cell have no row."""
    cells = digests.select(block_of(F.col("digest"), blocks).alias("block"), F.explode(cells_of(F.col("digest"))).alias("cell"))
    counters = cells.groupBy("block", "cell").agg(F.count(F.lit(1)).alias("n"))
    return counters.where("n > 1").groupBy("block").agg(F.bitmap_construct_agg("cell").alias("flags"))


def may_repeat(digest: Column, flags: Column) -> Column:
    """False only for texts that are unique for certain; ``flags`` is the block's bitmap or null."""

    def is_set(cell: Column) -> Column:
        byte = F.conv(F.hex(F.substring(flags, (F.shiftright(cell, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return F.getbit(byte, cell.bitwiseAND(F.lit(7).cast("long")).cast("int")) == 1

    first, second = (F.element_at(cells_of(digest), i) for i in (1, 2))
    return F.coalesce(flags.isNotNull() & is_set(first) & is_set(second), F.lit(False))


def with_repeat_flags(docs: DataFrame, sketch: DataFrame, blocks: int) -> DataFrame:
    """``docs`` (with ``digest``) and ``may_repeat``; the sketch has at most MOST_BLOCKS rows of 4 KB."""
    placed = docs.withColumn("block", block_of(F.col("digest"), blocks))
    met = placed.join(F.broadcast(sketch), "block", "left")
    return met.withColumn("may_repeat", may_repeat(F.col("digest"), F.col("flags"))).drop("block", "flags")


def first_copies(docs: DataFrame, sketch: DataFrame, blocks: int) -> DataFrame:
    """``doc_id`` and ``digest`` of the smallest id of each whole text that may repeat. Copies meet inside
    the tasks first, so a text that fills a third of the table sends a row per task."""
    possible = with_repeat_flags(docs, sketch, blocks).where("may_repeat and doc_id is not null")
    firsts = possible.groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    return firsts.select("doc_id", F.xxhash64("text").alias("digest"), F.lit(True).alias("is_first"))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part``, ``mask``, ``n``, ``good``, ``toxic``: documents by the filters they fail, and how many of them
    are labelled good or toxic.

    A row is a repeat unless its id is the smallest with its text. Rows without an id are no repeats
    and have no labels; rows of one id and text are alike. Of several labels of an id, one that says so is enough.
    """
    digested = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("digest", F.xxhash64("text"))
    blocks = blocks_for(docs.count())
    sketch = settle(repeat_sketch(digested.select("digest"), blocks), "repeat-sketch")
    firsts = first_copies(digested, sketch, blocks)
    judged = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    judged = judged.agg(*[F.max((F.col(c) == 1).cast("int")).alias(c) for c in ("quality", "toxic")])

    masked = digested.withColumn("mask", failure_mask(F.col("text")))
    known = with_repeat_flags(masked.where("doc_id is not null"), sketch, blocks).select("doc_id", "digest", "part", "mask", "may_repeat")
    flagged = known.join(firsts, ["doc_id", "digest"], "left").join(judged, "doc_id", "left")
    repeat = F.col("may_repeat") & F.col("is_first").isNull()
    rows = flagged.select(
        "part", (F.col("mask") + F.when(repeat, REPEATED).otherwise(0)).alias("mask"), F.coalesce("quality", F.lit(0)).alias("quality"),
        F.coalesce("toxic", F.lit(0)).alias("toxic"),
    )
    unnamed = masked.where("doc_id is null").select("part", "mask", F.lit(0).alias("quality"), F.lit(0).alias("toxic"))
    sums = [F.count(F.lit(1)).alias("n"), F.sum("quality").alias("good"), F.sum("toxic").alias("toxic")]
    return rows.unionByName(unnamed).groupBy("part", "mask").agg(*sums)


def all_steps() -> Column:
    """Every step of every order, as structs: the order, the step, the bits before it and its own."""
    steps = []
    for order in map("".join, permutations(FILTERS)):
        bits = [1 << FILTERS.index(letter) for letter in order]
        steps += [{"filter_order": order, "step": i + 1, "before": sum(bits[:i]), "bit": bits[i]} for i in range(len(bits))]
    return F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, before: int, bit: int>>")


def interactions(counts: DataFrame) -> DataFrame:
    """A row for each part, order and step from ``mask_counts``: a few rows for each part."""
    at = counts.select("*", F.inline(all_steps()))
    mask, before, bit, n = (F.col(c) for c in ("mask", "before", "bit", "n"))
    fails, seen = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(before) != 0

    def total(condition: Column, value: Column = n) -> Column:
        return F.sum(F.when(condition, value).otherwise(0)).cast("long")

    # Of all orders, one in as many as filters fail has this one first.
    orders = F.lit(len(list(permutations(FILTERS))))
    return at.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~seen).alias("kept"),
        total(fails & ~seen).alias("removed"),
        total(fails & seen).alias("redundant"),
        total(mask == bit).alias("unique_fails"),
        total(fails & ~seen, F.col("good")).alias("good_lost"),
        total(fails & ~seen, F.col("toxic")).alias("toxic_lost"),
        total(fails, n * (orders / F.greatest(F.bit_count("mask"), F.lit(1))).cast("long")).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part (``lang``; null: empty), order of the five filters and step of ``docs`` (``doc_id``, ``text``,
    ``lang``) and ``labels`` (``doc_id``, ``quality``, ``toxic``), with what the step keeps, removes and loses.

    Null text counts as empty; empty texts are equal like any others. Null ids are never repeats of a smaller id;
    rows that repeat an id with its text are all its first copy. Null labels and labels without a document
    count for nothing. An empty table has no parts and gives no rows. Further columns are left out.
    """
    return interactions(mask_counts(docs, labels))
