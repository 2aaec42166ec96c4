"""Toxicity by a weighted lexicon.

Texts are folded (case, look-alike letters, digits for letters) to words; an Aho-Corasick
automaton finds lexicon entries at word starts. Entries and exceptions are word beginnings with weights
learned from labels; at one place the longest counts, so an exception hides the entry in it.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterwise.llm.arrow import text_slices

# Digits and signs that stand for letters, and letters of other scripts that look Latin.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h",
    "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѵ": "v", "ԛ": "q", "ԝ": "w", "ѡ": "w", "г": "r", "п": "n",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u",
    "χ": "x", "γ": "y", "ω": "w", "ı": "i", "ɩ": "i", "ɑ": "a", "ɡ": "g", "ʟ": "l", "ո": "n", "օ": "o", "ս": "u", "ց": "g",
}
INVISIBLE = "­​‌‍⁠﻿"


def fold_table() -> dict[int, str | None]:
    """Everything ASCII that is no letter becomes a space, unless it stands for one. Wide and styled
    forms become the plain ones."""
    table: dict[int, str | None] = {c: " " for c in range(128) if not chr(c).isalpha()}
    table |= {ord(k): v for k, v in (SUBSTITUTES | LOOK_ALIKES).items()}
    table |= {ord(c): None for c in INVISIBLE}
    for c in [*range(0xFF21, 0xFF5B), *range(0x1D400, 0x1D7FF), *range(0x24B6, 0x24EA)]:
        plain = unicodedata.normalize("NFKC", chr(c)).lower()
        if len(plain) == 1 and plain.isascii() and plain.isalnum():
            table[c] = SUBSTITUTES.get(plain, plain)
    return table


FOLDS = fold_table()


def folded(text: str) -> str:
    return f" {text.lower().translate(FOLDS)} "


@dataclass(frozen=True)
class LexiconPlan:
    # Bounds of the labelled sample: the documents of least hashed id of either label.
    most_toxic: int = 20_000
    most_clean: int = 20_000
    # Lengths of word beginnings that may become entries, and bounds of the lexicon.
    shortest: int = 4
    longest: int = 12
    least_documents: int = 3
    most_candidates: int = 50_000
    least_weight: float = 2.5
    # Words added to a text's length, so that one hit in a few words is no certainty.
    extra_words: float = 10.0


@dataclass(frozen=True)
class Lexicon:
    """``weights`` of word beginnings (0: an exception), and the ``cut`` at which the score is one half."""

    weights: dict[str, float]
    cut: float
    extra_words: float

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            found.add_word(" " + entry, (len(entry), weight))
        if self.weights:
            found.make_automaton()
        return found


def density(text: str, automaton: ahocorasick.Automaton, extra_words: float) -> float:
    """The weight of the entries found, for each word of the text."""
    if not len(automaton):
        return 0.0
    plain = folded(text)
    longest = {end - n: weight for end, (n, weight) in automaton.iter(plain)}  # longer matches end later
    if not longest:
        return 0.0
    return sum(longest.values()) / (len(plain.split()) + extra_words)


def densities(lexicon: Lexicon) -> Callable[[Column], Column]:
    made: list[ahocorasick.Automaton] = []

    @F.arrow_udf("double")
    def of(text: pa.Array) -> pa.Array:
        if not made:
            made.append(lexicon.automaton())
        values = [density(t, made[0], lexicon.extra_words) for part in text_slices(text) for t in part.to_pylist()]
        return pa.array(values, pa.float64())

    return of


def toxicity_score(lexicon: Lexicon, text: Column) -> Column:
    """0 to 1, one half at the cut; 0 for null and empty texts."""
    x = densities(lexicon)(text)
    return x / (x + F.lit(lexicon.cut))


# Entries that a task holds before it passes their counts on.
HELD_ENTRIES = 100_000


def beginnings(texts: Iterable[str], plan: LexiconPlan, known: frozenset[str] | None) -> Iterator[Counter]:
    """In how many texts each word beginning occurs, in parts to be summed; only ``known``
    ones if given."""
    counts: Counter = Counter()
    for text in texts:
        found = {w[:n] for w in set(folded(text).split()) for n in range(plan.shortest, min(len(w), plan.longest) + 1)}
        counts.update(found if known is None else found & known)
        if len(counts) > HELD_ENTRIES:
            yield counts
            counts = Counter()
    yield counts


def document_frequencies(docs: DataFrame, plan: LexiconPlan, known: frozenset[str] | None = None) -> DataFrame:
    """``entry`` and ``documents``, counted per task and then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for counts in beginnings((t for part in text_slices(batch.column(0)) for t in part.to_pylist()), plan, known):
                columns = [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["entry", "n"])

    return docs.select("text").mapInArrow(run, "entry string, n long").groupBy("entry").agg(F.sum("n").alias("documents"))


def chosen(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int, plan: LexiconPlan) -> dict[str, float]:
    """Log odds less their standard error; an entry that a shorter one covers is left out,
    and longer beginnings found rather in clean texts become exceptions."""
    kept: dict[str, float] = {}
    for entry in sorted(toxic, key=lambda e: (len(e), e)):
        a, b = toxic[entry] + 0.5, clean.get(entry, 0) + 0.5
        weight = math.log(a / (n_toxic + 1)) - math.log(b / (n_clean + 1)) - math.sqrt(1 / a + 1 / b)
        shorter = max((kept.get(entry[:n], 0.0) for n in range(plan.shortest, len(entry))), default=0.0)
        if weight >= plan.least_weight and weight > shorter + 1:
            kept[entry] = weight
        elif shorter and math.log(a / (n_toxic + 1)) < math.log(b / (n_clean + 1)):
            kept[entry] = 0.0
    return kept


def best_cut(bins: list[tuple[int, int, int]]) -> int:
    """From (bin, toxic, clean), the bin at and above which calling a text toxic errs least."""
    if not bins:
        return 0
    bins = sorted(bins)
    errors = sum(clean for _, _, clean in bins)
    best, at = errors, bins[0][0]
    for i, (_, toxic, clean) in enumerate(bins):
        errors += toxic - clean
        if errors <= best and i + 1 < len(bins):
            best, at = errors, bins[i + 1][0]
    return at


BINS_PER_E = 8


def fit_lexicon(docs: DataFrame, labels: DataFrame, plan: LexiconPlan | None = None) -> Lexicon:
    """Learn from ``docs`` (``doc_id``, ``text``) and ``labels`` (``doc_id``, ``toxic`` 0 or 1).

    A document of several labels counts as toxic if one says so; null labels and labels without a document
    teach nothing. Without toxic examples the lexicon is empty and every score 0. The
    sample is bounded by the plan, so what reaches the driver is: ids and at most
    ``most_candidates`` counts.
    """
    plan = plan or LexiconPlan()
    judged = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sampled = {
        toxic: judged.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id")
        for toxic, most in ((1, plan.most_toxic), (0, plan.most_clean))
    }
    texts = {toxic: docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id") for toxic, ids in sampled.items()}
    n_toxic, n_clean = (ids.count() for ids in sampled.values())
    common = document_frequencies(texts[1], plan).where(F.col("documents") >= plan.least_documents)
    toxic = dict(common.orderBy(F.desc("documents"), "entry").limit(plan.most_candidates).collect())
    clean = dict(document_frequencies(texts[0], plan, frozenset(toxic)).collect())
    draft = Lexicon(chosen(toxic, clean, n_toxic, n_clean, plan), 1.0, plan.extra_words)
    if not draft.weights:
        return draft
    judged_texts = texts[1].select("text", F.lit(1).alias("toxic")).union(texts[0].select("text", F.lit(0).alias("toxic")))
    scored = judged_texts.select("toxic", densities(draft)(F.col("text")).alias("x")).where("x > 0")
    binned = scored.groupBy(F.floor(F.log("x") * BINS_PER_E).alias("bin")).agg(F.sum("toxic"), F.sum(1 - F.col("toxic")))
    return Lexicon(draft.weights, float(np.exp(best_cut([tuple(r) for r in binned.collect()]) / BINS_PER_E)), plan.extra_words)
