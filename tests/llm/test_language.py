"""Language models against the sum over all segmentations by hand, without bounds on languages or word lengths."""

from __future__ import annotations

import math

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meterwise.llm import language, queries

VOCABULARY = public_tokenizers.path(queries.PIECE_VOCABULARY)
SCHEMA = "doc_id long, text string, lang string, k int, n int, word string, pieces string, letter string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 1, "x", "y", "z") for r in rows], SCHEMA)


def letters_of(n: int) -> str:
    """A word of a letter that no other word has."""
    return chr(0xAC00 + n) * 2


def by_hand(model, word: str, lang: int) -> float:
    """The summed probability of all segmentations of a marked word."""
    number = {p: i for i, p in enumerate(model.pieces)}
    word = language.MARK + word
    total = [1.0] + [0.0] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(end):
            piece = number.get(word[start:end], len(model.pieces) if end - start == 1 else None)
            if piece is not None:
                total[end] += total[start] * model.table[piece, lang]
    return math.log(total[-1])


@pytest.fixture(scope="module")
def many(spark):
    """230 languages of one word each, often enough to be heard above the smoothing of 24,000 pieces, a word of 160 letters,
    and rows that teach nothing."""
    rows = [(n, f"{letters_of(n)} " * 500, f"l{n:03d}") for n in range(230)]
    long = "".join(chr(0xB000 + n) for n in range(160))
    rows += [(1000, f"{long} " * 500, "long"), (1000, f"{long} " * 500, "long"), (1001, None, "l001"), (1002, "word", None), (1003, "123 !", "none")]
    return frame(spark, rows), long


@pytest.fixture(scope="module")
def model(many):
    return language.fit_languages(many[0], VOCABULARY)


def test_every_language_is_learned_and_found(spark, many, model):
    assert model.languages == [f"l{n:03d}" for n in range(230)] + ["long"]
    assert model.table[:-1].sum(axis=0) == pytest.approx([1.0] * 231) and (model.table[:-1] > 0).all()
    docs = many[0].where("doc_id < 230")
    wrong = docs.withColumn("found", language.language_of(model)("text")).where("found.lang_pred <> lang").count()
    assert wrong == 0


def test_all_of_a_long_word_is_learned(spark, many, model):
    """The end of a run of letters speaks for its language as its beginning does."""
    tail = many[1][128:]
    found = frame(spark, [(1, tail, None)]).select(language.language_of(model)("text").alias("f")).first()["f"]
    assert found["lang_pred"] == "long" and found["score"] > 0.9


def test_scores_equal_those_by_hand_whatever_the_bounds(model, monkeypatch):
    words = [letters_of(n) for n in (0, 5, 229)] + ["ab", "ж", "zebra"]
    texts = pa.array([*words, " ".join(words), None, "", "12", words[0]])
    want = language.Scorer(model).predict(texts).to_pylist()
    for at, text in enumerate(words):
        odds = [by_hand(model, text, i) for i in range(len(model.languages))]
        assert odds[model.languages.index(want[at]["lang_pred"])] == pytest.approx(max(odds))  # ties: any
        assert want[at]["score"] == pytest.approx(1 / sum(math.exp(o - max(odds)) for o in odds), rel=1e-6)
    assert [r["lang_pred"] for r in want[-4:-1]] == ["und"] * 3
    assert want[-1] == {"lang_pred": want[0]["lang_pred"], "score": pytest.approx(want[0]["score"])}
    for memo, one_pass, block in ((231 * 2, 32, 16), (0, 16, 1), (1 << 20, 1 << 20, 500)):
        for name, value in (("MEMO_SCORES", memo), ("PASS_SCORES", max(one_pass, block)), ("BLOCK", block)):
            monkeypatch.setattr(language, name, value)
        scorer = language.Scorer(model)
        for _ in range(2):
            got = scorer.predict(texts).to_pylist()
            assert all(g["lang_pred"] == w["lang_pred"] for g, w in zip(got, want, strict=True) if w["score"] > 0.1)
            assert [g["score"] for g in got] == pytest.approx([w["score"] for w in want])


def test_bounds_of_the_sample_hold(spark):
    rows = [(n, letters_of(n), "a") for n in range(50)] + [(100, "bbbb", "b")]
    plan = language.LanguagePlan(most_documents=5, most_words=3)
    model = language.fit_languages(frame(spark, rows), VOCABULARY, plan)
    assert model.languages == ["a", "b"]
    ids = sorted(range(50), key=lambda n: spark.range(n, n + 1).select(F.xxhash64("id")).first()[0])[:5]
    words = sorted(letters_of(n) for n in ids)[:3]
    whole = language.fit_languages(frame(spark, [(n, w, "a") for n, w in enumerate(words)] + rows[-1:]), VOCABULARY)
    assert by_hand(model, words[0], 0) == pytest.approx(by_hand(whole, words[0], 0))


def test_nothing_to_learn_from(spark):
    docs = frame(spark, [(1, "some words", None)])
    for given in (docs, docs.where("false")):
        model = language.fit_languages(given, VOCABULARY)
        assert model.languages == []
        assert docs.select(language.language_of(model)("text").alias("f")).first()["f"] == ("und", 0.0)
