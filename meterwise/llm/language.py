"""Language identification by segmentation-marginalised unigrams.

Each language has probabilities for the pieces of one fixed public vocabulary. A word's
probability is the sum over all its segmentations into pieces, by a forward algorithm; a
text's is the product over its words. Probabilities are learned by expectation-maximisation over all
segmentations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterwise.llm.arrow import list_array, sums_by_row, text_slices
from meterwise.session import settle

UNKNOWN = "und"
MARK = "▁"  # begins a word, as in the vocabulary
LONGEST_WORD = 32  # longer runs of letters are scored in parts of this length
# Bounds of memory, without effect on results: scores (words times languages) that a worker remembers, and that one
# pass of the forward algorithm holds at each end; languages scored at once.
MEMO_SCORES = 4_000_000
PASS_SCORES = 400_000
BLOCK = 16


@dataclass(frozen=True)
class LanguagePlan:
    # Bounds of the sample, for each language: documents, and distinct words.
    most_documents: int = 1_000
    most_words: int = 20_000
    rounds: int = 3
    smoothing: float = 0.1


def vocabulary_pieces(path: str) -> list[str]:
    """The lower-cased letter pieces of a sentencepiece model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    return sorted(p for p in pieces if p == MARK or p.removeprefix(MARK).isalpha())


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Marked words of all texts, one after the other, and the number of each text."""
    letters = pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}]+", " ")
    short = pc.replace_substring_regex(letters, rf"(\p{{L}}{{{LONGEST_WORD}}})", r"\1 ")
    cut = pc.split_pattern(short, " ")
    flat = cut.flatten()
    keep = pc.not_equal(flat, "")
    counts = pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.filter(keep), sums_by_row(keep.to_numpy(zero_copy_only=False).astype(np.int64), counts)


class Segmenter:
    """The forward algorithm over a batch of words, ordered by falling length."""

    def __init__(self, pieces: list[str]):
        self.pieces = pa.array(pieces, pa.string())
        self.longest = max(map(len, pieces))

    def places(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, list[list[tuple[int, np.ndarray]]]]:
        """The order by length, the ordered lengths, and for each end the (length, piece number) of what may
        end there; the last number stands for a letter that no piece has, -1 for no piece."""
        lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False)
        order = np.argsort(-lengths, kind="stable")
        ordered, lengths = words.take(pa.array(order)), lengths[order]
        ends = []
        for end in range(1, int(lengths[0]) + 1 if len(lengths) else 1):
            active = ordered[: int(np.searchsorted(-lengths, -end, side="right"))]
            here = []
            for n in range(1, min(end, self.longest) + 1):
                found = pc.index_in(pc.utf8_slice_codeunits(active, end - n, end), value_set=self.pieces)
                number = pc.fill_null(found, len(self.pieces) if n == 1 else -1).to_numpy(zero_copy_only=False)
                if n == 1 or (number >= 0).any():
                    here.append((n, number))
            ends.append(here)
        return order, lengths, ends

    def forward(self, ends, table: np.ndarray, n_words: int) -> list[np.ndarray]:
        """By end, the summed probability of all segmentations up to it; ``table`` has a row
        for each piece, one for unknown letters, and one of zeros."""
        alpha = [np.ones((n_words, table.shape[1]))]
        for end, here in enumerate(ends, 1):
            n = len(here[0][1])
            alpha.append(sum(alpha[end - k][:n] * table[number] for k, number in here))
        return alpha

    def log_probability(self, words: pa.Array, table: np.ndarray) -> np.ndarray:
        order, lengths, ends = self.places(words)
        alpha = self.forward(ends, table, len(words))
        total = np.zeros((len(words), table.shape[1]))
        for end in range(1, len(alpha)):
            first, last = np.searchsorted(-lengths, -end, side="left"), len(alpha[end])
            total[first:last] = alpha[end][first:last]
        out = np.zeros_like(total)
        out[order] = np.log(total)
        return out

    def learn(self, words: pa.Array, counts: np.ndarray, rounds: int, smoothing: float) -> np.ndarray:
        """Piece probabilities for the words of each language: (pieces + 2) x languages."""
        order, lengths, ends = self.places(words)
        counts = counts[order]
        n_pieces, n_lang = len(self.pieces), counts.shape[1]
        table = np.full((n_pieces + 2, n_lang), 1.0 / (n_pieces + 1))
        table[-1] = 0
        for _ in range(rounds):
            alpha = self.forward(ends, table, len(words))
            beta = [np.zeros_like(a) for a in alpha]
            for end in range(1, len(alpha)):
                first, last = np.searchsorted(-lengths, -end, side="left"), len(alpha[end])
                beta[end][first:last] = counts[first:last] / np.maximum(alpha[end][first:last], 1e-300)
            expected = np.zeros_like(table)
            for end in range(len(ends), 0, -1):
                for k, number in ends[end - 1]:
                    n = len(number)
                    flow = beta[end] * table[number]
                    for lang in range(n_lang):
                        weights = alpha[end - k][:n, lang] * flow[:, lang]
                        expected[:, lang] += np.bincount(number % (n_pieces + 2), weights, n_pieces + 2)
                    beta[end - k][:n] += flow
            expected[-1] = 0
            expected[:-1] += smoothing
            table = expected / expected.sum(axis=0)
        return table


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    pieces: list[str]
    table: np.ndarray  # probability of each piece (then: unknown letter, none) by language


_LEARNED = "lang string, pieces array<int>, probabilities array<double>, rest double"


def _learner(pieces: list[str], plan: LanguagePlan) -> Callable[[pa.Table], pa.Table]:
    """Learns one language from its words (``lang``, ``word``, ``n``): the pieces that its words can
    hold, their probabilities, and the one of all others."""

    def learn(words: pa.Table) -> pa.Table:
        ordered = words.sort_by("word")
        marked = pc.binary_join_element_wise(pa.scalar(MARK), ordered["word"].combine_chunks(), "")
        counts = ordered["n"].to_numpy().astype(float)[:, None]
        column = Segmenter(pieces).learn(marked, counts, plan.rounds, plan.smoothing)[:-1, 0]
        rest = column.min()
        known = np.flatnonzero(column > rest)
        lists = [list_array(x, np.array([len(known)])) for x in (known.astype(np.int32), column[known])]
        return pa.table([ordered["lang"][:1].combine_chunks(), *lists, pa.array([rest])], ["lang", "pieces", "probabilities", "rest"])

    return learn


def fit_languages(docs: DataFrame, vocabulary: str, plan: LanguagePlan | None = None) -> LanguageModel:
    """Learn from ``docs`` (``doc_id``, ``text``, ``lang``); null ``lang`` and texts without letters teach
    nothing. The sample takes the documents of least hashed id of each language, and its most frequent
    words (long ones in the parts that scoring reads); both bounds are the plan's. Every language with an example is learned,
    each in a task of its own; the driver receives the learned probabilities, at most one a
    piece and language. Without any example, no language is learned. Rows of equal ``doc_id`` are taken together;
    further columns do not matter."""
    plan = plan or LanguagePlan()
    known = docs.where("lang is not null and text is not null")
    per_language = Window.partitionBy("lang")
    ids = known.select("lang", "doc_id").withColumn("k", F.row_number().over(per_language.orderBy(F.xxhash64("doc_id"), "doc_id")))
    # Written, so that its true size decides how texts meet it.
    sample = settle(ids.where(F.col("k") <= plan.most_documents).select("lang", "doc_id").distinct(), "language-sample")
    texts = known.select("lang", "doc_id", "text").join(sample, ["lang", "doc_id"])
    parts = F.regexp_replace(F.regexp_replace(F.lower("text"), r"[^\p{L}]+", " "), rf"(\p{{L}}{{{LONGEST_WORD}}})", "$1 ")
    words = texts.select("lang", F.explode(F.split(parts, " ")).alias("word")).where("word <> ''")
    counts = words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    top = counts.withColumn("k", F.row_number().over(per_language.orderBy(F.desc("n"), "word"))).where(F.col("k") <= plan.most_words)
    top = settle(top.select("lang", "word", "n"), "language-words")
    letters = top.select(F.explode(F.split("word", "")).alias("letter")).distinct().collect()  # at most Unicode's
    pieces = sorted({*vocabulary_pieces(vocabulary), *(r["letter"] for r in letters if r["letter"]), MARK})
    learned = top.groupBy("lang").applyInArrow(_learner(pieces, plan), _LEARNED)
    rows = sorted(learned.collect(), key=lambda r: r["lang"])
    table = np.zeros((len(pieces) + 2, len(rows)))
    for at, row in enumerate(rows):
        table[:-1, at] = row["rest"]
        table[row["pieces"], at] = row["probabilities"]
    return LanguageModel([r["lang"] for r in rows], pieces, table)


class Scorer:
    """Scores text columns; remembers the probabilities of the words it has met."""

    def __init__(self, model: LanguageModel):
        self.model, self.segmenter = model, Segmenter(model.pieces)
        n = len(model.languages)
        self.blocks = [slice(at, min(n, at + BLOCK)) for at in range(0, n, BLOCK)]
        self.forget()

    def forget(self) -> None:
        self.words = pa.array([], pa.string())
        self.scores = [np.zeros((0, b.stop - b.start)) for b in self.blocks]

    def _computed(self, words: pa.Array, block: slice) -> np.ndarray:
        """A row for each word, a column for each language of the block."""
        marked = pc.binary_join_element_wise(pa.scalar(MARK), words, "")
        table, step = self.model.table[:, block], PASS_SCORES // BLOCK
        passes = [self.segmenter.log_probability(marked[at : at + step], table) for at in range(0, len(marked), step)]
        return np.concatenate(passes) if passes else np.zeros((0, table.shape[1]))

    def _scores_of(self, distinct: pa.Array) -> Iterator[np.ndarray]:
        """The scores of the words, one block of languages after the other."""
        most = MEMO_SCORES // max(1, len(self.model.languages))
        found = pc.index_in(distinct, value_set=self.words)
        new = distinct.filter(pc.is_null(found))
        if len(self.words) + len(new) > most:
            self.forget()
            new = distinct
        if len(new) > most:
            yield from (self._computed(distinct, block) for block in self.blocks)
            return
        if len(new):
            self.scores = [np.concatenate([s, self._computed(new, b)]) for s, b in zip(self.scores, self.blocks, strict=True)]
            self.words = pa.concat_arrays([self.words, new])
            found = pc.index_in(distinct, value_set=self.words)
        at = found.to_numpy(zero_copy_only=False).astype(np.int64)
        yield from (s[at] for s in self.scores)

    def predict(self, texts: pa.Array) -> pa.Array:
        names, scores = [], []
        for part in text_slices(texts):
            flat, counts = words_of(part)
            coded = flat.dictionary_encode()
            at = coded.indices.to_numpy(zero_copy_only=False)
            known = counts > 0
            if self.model.languages:
                total = np.concatenate([sums_by_row(scores[at], counts) for scores in self._scores_of(coded.dictionary)], axis=1)
                best = total.argmax(axis=1)
                odds = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                names += [self.model.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
                scores += np.where(known, odds, 0.0).tolist()
            else:
                names += [UNKNOWN] * len(part)
                scores += [0.0] * len(part)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])


def language_of(model: LanguageModel) -> Callable[[Column], Column]:
    """A column function: struct ``lang_pred`` and ``score``, the language's posterior under equal
    priors. ``und`` and 0 for null, for texts without a letter, and if no language was learned. Equal texts
    get scores that are equal but for rounding; no rows give none."""
    made: list[Scorer] = []

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def of(text: pa.Array) -> pa.Array:
        if not made:
            made.append(Scorer(model))
        return made[0].predict(text)

    return of
