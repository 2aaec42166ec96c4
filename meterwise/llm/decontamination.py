"""Benchmark decontamination in DataFrame functions only.

A window is 13 words of a benchmark item. Any window in a document covers a gram of nine words at one
of every five places, so only these grams are hashed and looked up in the set of all grams of
the windows, which is broadcast while a count bounds it. Hits are verified word by word over
all windows around, and the words they cover are counted, or cut out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterwise.functions.joins import holds_at_most

WINDOW = 13
STRIDE = 5
# Grams in context up to which the set is broadcast, some 150 MB at 17 words; beyond, it is joined by shuffle.
BROADCAST_GRAMS = 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The share of hit words from which a document counts as contaminated.
HIT_SHARE = 20


def lowered(text: Column) -> Column:
    """Only A-Z is lowered. ``lower`` is faster and does the same on ASCII texts."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """Words of a text without nulls."""
    return F.filter(F.split(lowered(text), NO_WORD), lambda w: w != "")


def stride_of(length: int) -> int:
    """Documents are probed at every so many words: each window of ``length`` has a probe
    whose gram of ``length - stride + 1`` words lies inside."""
    return min(STRIDE, max(1, length // 2))


def probes(words: Column, length: int) -> Column:
    """Structs of ``n``, ``at`` (from 1) and the ``hash`` of the gram there."""
    stride = stride_of(length)
    gram = length - stride + 1
    last = F.size(words) - gram + 1
    places = F.when(last > 0, F.sequence(F.lit(1), F.greatest(last, F.lit(1)), F.lit(stride))).otherwise(F.array().cast("array<int>"))
    return F.transform(
        places, lambda i: F.struct(F.lit(length).alias("n"), i.alias("at"), F.xxhash64(F.slice(words, i, gram)).alias("hash"))
    )


def item_grams(benchmark: DataFrame, length: int = WINDOW) -> DataFrame:
    """The distinct grams of the windows of ``benchmark`` (``item_id``, ``text``) in their contexts: ``n`` (the
    window's words), ``hash``, ``context`` (the words of all windows around), ``inside`` (the gram's place in it) and
    ``item_ids`` (as text). A shorter item is one window; one without words has none."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.coalesce("text", F.lit(""))).alias("words"))
    sized = items.where(F.size("words") > 0).withColumn("n", F.least(F.size("words"), F.lit(length)))
    stride = F.element_at(F.lit([stride_of(n) for n in range(1, length + 1)]), F.col("n"))
    wide = sized.withColumn("stride", stride).withColumn("gram", F.col("n") - F.col("stride") + 1)
    at = wide.withColumn("at", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("gram") + 1)))
    first = F.greatest(F.col("at") - F.col("stride") + 1, F.lit(1))
    each = at.select(
        "item_id",
        "n",
        F.xxhash64(F.slice("words", F.col("at"), F.col("gram"))).alias("hash"),
        F.slice("words", first, F.least(F.col("at") + F.col("n"), F.size("words") + 1) - first).alias("context"),
        (F.col("at") - first + 1).alias("inside"),
    )
    return each.groupBy("n", "hash", "context", "inside").agg(F.collect_set("item_id").alias("item_ids"))


def window_starts(words: Column, at: Column, context: Column, inside: Column, n: Column, length: int) -> Column:
    """Where windows of the context begin in the document, given that the gram at ``inside``
    may be the one at ``at``: every window over both is compared word by word."""

    def same(back: Column) -> Column:
        ours, theirs = at - back, inside - back
        in_range = (ours >= 1) & (theirs >= 1) & (theirs + n - 1 <= F.size(context))
        return in_range & (F.slice(words, F.greatest(ours, F.lit(1)), n) == F.slice(context, F.greatest(theirs, F.lit(1)), n))

    backs = F.filter(F.sequence(F.lit(0), F.lit(stride_of(length) - 1)), same)
    return F.transform(backs, lambda back: F.struct((at - back).alias("at"), n.alias("n")))


def hits(docs: DataFrame, benchmark: DataFrame, length: int = WINDOW, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """For each row of ``docs`` (with ``text``): its own columns in struct ``doc``,
    ``n_words``, ``spans`` (structs ``at``, ``n``: the windows found, by place, from 1) and ``item_ids`` (sorted).

    Each row has a number of its own, so equal rows and null ids stay apart. Per row one
    marker and its verified hits leave the task; a window that many documents share adds
    a row to each, and no rows meet but those of one document.
    """
    known = item_grams(benchmark, length)
    lengths = sorted(r["n"] for r in known.select("n").distinct().collect())  # at most ``length`` values
    known = F.broadcast(known) if holds_at_most(known, broadcast_grams) else known
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("doc"), words_of(F.coalesce("text", F.lit(""))).alias("words")
    )
    marker = F.array(F.struct(F.lit(0).alias("n"), F.lit(0).alias("at"), F.lit(None).cast("long").alias("hash")))
    probed = rows.select("row", "doc", "words", F.inline(F.concat(marker, *[probes(F.col("words"), n) for n in lengths])))
    met = probed.join(known, ["n", "hash"], "left").where((F.col("n") == 0) | F.col("context").isNotNull())
    starts = window_starts(F.col("words"), F.col("at"), F.col("context"), F.col("inside"), F.col("n"), length)
    slim = met.select(
        "row",
        F.when(F.col("n") == 0, F.col("doc")).alias("doc"),
        F.when(F.col("n") == 0, F.size("words")).alias("n_words"),
        F.when(F.col("n") > 0, starts).alias("spans"),
        "item_ids",
    ).where(F.col("n_words").isNotNull() | (F.size("spans") > 0))
    return slim.groupBy("row").agg(
        F.first("doc", ignorenulls=True).alias("doc"),
        F.max("n_words").cast("long").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"),
    )


def covered(spans: Column) -> Column:
    """The number of distinct words in sorted spans."""
    start = F.struct(F.lit(0).cast("long").alias("words"), F.lit(1).alias("next"))
    total = F.aggregate(
        spans,
        start,
        lambda s, x: F.struct(
            (s["words"] + F.greatest(x["at"] + x["n"] - F.greatest(s["next"], x["at"]), F.lit(0))).cast("long").alias("words"),
            F.greatest(s["next"], x["at"] + x["n"]).alias("next"),
        ),
    )
    return total["words"]


def contamination(docs: DataFrame, benchmark: DataFrame, length: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: its columns in ``doc``, ``n_words``, ``n_hit``, ``item_ids``, ``contaminated``.

    A word inside any occurrence of a window is hit; a document is contaminated if it has hits
    and they make a 20th of its words or more. Null and empty texts have no words and are
    clean, as are all rows where ``benchmark`` is empty.
    """
    counted = hits(docs, benchmark, length).withColumn("n_hit", covered(F.col("spans")))
    share = (F.col("n_hit") > 0) & (F.lit(HIT_SHARE) * F.col("n_hit") >= F.col("n_words"))
    return counted.select("doc", "n_words", "n_hit", "item_ids", share.alias("contaminated"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns."""
    kept = contamination(docs, benchmark).where(~F.col("contaminated"))
    return kept.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def without_spans(docs: DataFrame, benchmark: DataFrame, length: int = WINDOW) -> DataFrame:
    """All rows of ``docs``; from a text with hits, the hit words go and the words left are
    joined by spaces. Other texts stay as they are."""
    found = hits(docs, benchmark, length)
    is_hit = lambda i: F.exists("spans", lambda x: (i + 1 >= x["at"]) & (i + 1 < x["at"] + x["n"]))
    text = F.col("doc.text")
    left = F.array_join(F.filter(words_of(F.coalesce(text, F.lit(""))), lambda w, i: ~is_hit(i)), " ")
    cleaned = F.when(F.size("spans") > 0, left).otherwise(text)
    return found.select(*[cleaned.alias(c) if c == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns])
