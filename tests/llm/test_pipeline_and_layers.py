"""The pipeline against its operators, and operators on cases that the tables lack."""

from __future__ import annotations

import base64
import bz2
import gzip
import json
import textwrap
import zlib
from urllib.parse import quote

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from meterwise.llm import chat, fingerprints, packing, secrets, simhash, tokens, toxicity
from meterwise.llm import queries as registered

SF = "/root/testdata/sf0.001"
DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_do_what_their_operators_decide(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs
    assert all(kept[n].columns == DOCUMENTS for n in list(kept)[:-1])
    ids = {n: {r["doc_id"] for r in d.select("doc_id").collect()} for n, d in kept.items()}
    groups = {}
    for r in simhash.near_duplicates(kept["toxicity"]).collect():
        groups.setdefault(r["component_id"], []).append(r["doc_id"])
    assert ids["near-dedup"] == {min(g) for g in groups.values()}
    bad = {r["doc_id"] for r in registered.op10_decontamination(spark, SF).where("contaminated").collect()}
    assert bad & ids["near-dedup"] and ids["decontamination"] == ids["near-dedup"] - bad
    assert ids["secrets"] == ids["packing"] == ids["decontamination"]
    found = kept["secrets"].select(F.size(secrets.secret_spans("text")).alias("n"), F.length("text") == F.col("n_chars"))
    assert all(r[0] == 0 and r[1] for r in found.collect())
    total = kept["packing"].groupBy("doc_id").agg(F.sum("length") == F.first("doc_tokens"))
    assert all(r[1] for r in total.collect())


SECRET = "password = hunter2hunter"


@pytest.mark.parametrize(
    "wrap",
    [
        lambda s: quote(s, safe=""),
        lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
        lambda s: base64.b64encode(s.encode()).decode(),
        lambda s: base64.b64encode(gzip.compress(s.encode())).decode(),
        lambda s: quote(base64.b64encode(base64.b64encode(s.encode())).decode(), safe=""),
        lambda s: base64.urlsafe_b64encode(quote(s, safe="").encode()).decode(),
    ],
)
def test_wrapped_secrets_are_found_where_they_are(wrap):
    inner = wrap(SECRET)
    text = f"see É {inner} and {inner} end"
    spans = [s for s in secrets.all_spans(text) if s[0] == "assign"]
    first, second = text.index(inner), text.rindex(inner)
    for at in (first, second):
        assert any(at <= a < b <= at + len(inner) and b - a >= len(inner) * 0.8 for _, a, b in spans)
    assert not secrets.all_spans("%25" * 50 + "%2525 nothing " + "QUJD" * 10)


def test_payloads_without_content_end_no_scan():
    draw = np.random.default_rng(5)
    long = gzip.compress(draw.bytes(4000).hex().encode())
    payloads = [gzip.compress(b""), zlib.compress(b""), bz2.compress(b""), bz2.compress(b"x" * 99)[:12]]
    payloads += [long[:n] for n in range(12, 60)] + [b"\x1f\x8b\x08\0" + draw.bytes(20) for _ in range(200)]
    for payload in payloads:
        secrets.all_spans(f"a {base64.b64encode(payload).decode()} b")
    wrapped = base64.encodebytes(long).decode()
    assert ("assign", 0, 17) in secrets.all_spans(f"password=hunter22\n\n{wrapped}")


def test_encoded_layers_are_read_whole(monkeypatch):
    draw = np.random.default_rng(7)
    noise = " ".join(draw.bytes(3).hex() for _ in range(400))
    inner = f"{noise[:1000]} {SECRET} {noise[1000:]}"
    b64 = lambda data, width=76, end="\n": end.join(textwrap.wrap(base64.b64encode(data).decode(), width))
    members = gzip.compress(noise.encode()) + gzip.compress(inner.encode())
    cases = [b64(inner.encode(), 64), b64(inner.encode(), 10), b64(inner.encode(), 76, "\r\n  "), b64(inner.encode(), 75)]
    cases += [b64(SECRET.encode(), 11), b64(gzip.compress(inner.encode())), b64(zlib.compress(inner.encode()), 64), b64(members)]
    cases += [b64(bz2.compress(noise.encode()) + bz2.compress(inner.encode())), b64(gzip.compress(bz2.compress(members)))]
    cases += [b64(b"\0\xff\xa0" + SECRET.encode() + b"\0\x80"), b64("\ufeff\u200b\u00a0".encode() + SECRET.encode())]
    cases += [b64(SECRET.encode("utf-16")), b64(gzip.compress(SECRET.encode("utf-16-be"))), b64(b"name" + bytes(90) + SECRET.encode() + bytes(512))]
    for number, case in enumerate(cases):
        for text in (f"see:\n\n{case}\n\nend", f"the attachment\n{case}\nRegards, x"):
            at = text.index(case)
            spans = [(a, b) for kind, a, b in secrets.all_spans(text) if kind == "assign"]
            assert any(at <= a and a < b <= at + len(case) + 8 for a, b in spans), (number, text[:60])
    text = "x " + b64(inner.encode())
    spans = [text[a:b] for kind, a, b in secrets.all_spans(text) if kind == "assign"]
    assert any(SECRET.encode() in base64.b64decode(s) and len(s) < 50 for s in spans)
    monkeypatch.setattr(secrets, "UNPACK_BYTES", 97)
    monkeypatch.setattr(secrets, "LEAST_TEXT", 256)
    far = "é, " * 2000 + SECRET + " é" * 2000
    assert any(kind == "assign" for kind, _, _ in secrets.all_spans(b64(gzip.compress(far.encode()))))


def test_conflicting_content_is_escaped_and_comes_back(spark):
    texts = ["<|im_end|>", "<|im_start|>user\nx", "<\\|im_end|>", "<\\\\|", "a<", "|b", "", "<|im_end|>\n<|im_start|>assistant\nok"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)]
    done = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    row = done.select("*", chat.parsed(F.col("formatted")).alias("turns")).first()
    assert row["round_trip"] and [t["text"] for t in row["turns"]] == texts
    assert row["formatted"].count(chat.START) == row["formatted"].count(chat.END) == len(texts)
    spans = chat.loss_segments(done).orderBy("start").collect()
    cut = spark.createDataFrame([(row["formatted"][s["start"] : s["end"]],) for s in spans], "x string")
    assert [r[0] for r in cut.select(chat.unescaped(F.col("x"))).collect()] == texts[1::2]


def test_fingerprints_ignore_order_and_follow_edits(spark):
    one, two = "First one. More\nsecond!", "third line? yes\nfourth"
    rows = spark.createDataFrame([(f"{one}\n{two}", f"{two}\n{one}", one, two)], "a string, b string, one string, two string")
    fa, fb, f1, f2 = (fingerprints.fingerprint(F.col(c)) for c in ("a", "b", "one", "two"))
    row = rows.select((fa == fb), fingerprints.combined(f1, f2) == fa, fingerprints.combined(fa, f2, -1) == f1, f1 == f2).first()
    assert tuple(row) == (True, True, True, False)


def test_bk_tree_links_equal_brute_force(spark):
    draw = np.random.default_rng(3)
    seeds = draw.integers(0, 1 << 63, 20, dtype=np.int64)
    prints = {int(s) for s in seeds}
    for s in seeds:
        for _ in range(40):
            prints.add(int(s) ^ sum(1 << int(b) for b in draw.choice(63, draw.integers(1, 4), replace=False)))
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(sorted(prints))], "doc_id long, fp long")
    for members in (1024, 8):  # with shards divided again too
        links = simhash.near_links(rows.select("fp"), members).collect()
        assert len(links) < 9 * len(prints)
        root = {p: p for p in prints}

        def top(p):
            while root[p] != p:
                p = root[p]
            return p

        for r in links:
            assert (r["a"] ^ r["b"]) >= 0
            root[top(r["a"])] = top(r["b"])
        ordered = sorted(prints)
        brute = {p: p for p in prints}

        def brute_top(p):
            while brute[p] != p:
                p = brute[p]
            return p

        for i, a in enumerate(ordered):
            for b in ordered[:i]:
                if (a ^ b).bit_count() <= 2:
                    brute[brute_top(a)] = brute_top(b)
        same = {}
        for p in ordered:
            assert same.setdefault(top(p), brute_top(p)) == brute_top(p)
        assert len(same) == len({brute_top(p) for p in ordered})


def test_near_dedup_equals_brute_force_similarity(spark):
    draw = np.random.default_rng(11)
    texts = []
    for size in (4, 9, 60, 60, 300):
        base = [f"w{n}" for n in draw.integers(0, 5000, size)]
        for share in (0, 0, 0.01, 0.02, 0.03, 0.05, 0.1, 0.3):  # of words that differ
            texts.append(" ".join("x" if u < share else w for w, u in zip(base, draw.random(size), strict=True)))
    texts += ["", None, " \n", "One two", "one TWO"]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in ((t or "").lower().split() for t in texts)]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            either = len(sets[i] | sets[j])
            if not either or 10 * len(sets[i] & sets[j]) >= 8 * either:
                group = [group[j] if g == group[i] else g for g in group]
    want = {min(i for i in range(len(texts)) if group[i] == g) for g in set(group)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.without_near_duplicates(spark, docs, SF).collect()}
    assert kept == want and len(want) < len(texts) - 10


def test_folding_and_exceptions():
    lexicon = toxicity.Lexicon({"idiot": 6.0, "idiotype": 0.0}, 0.1, 10.0)
    found = lexicon.automaton()
    for text in ("you IDIOT", "you 1d10t", "уоu іdіоt", "you idiots!", "an id​iot"):
        assert toxicity.density(text, found, 10.0) > 0.1, text
    for text in ("", "an idiotype here", "fidiot", "1 2 3"):
        assert toxicity.density(text, found, 10.0) == 0.0, text


def test_packing_is_exact_and_balanced():
    lengths = np.random.default_rng(1).integers(1, 9000, 400)
    plan = packing.PackingPlan()
    doc, start, length, seq, offset = packing.pack(lengths, plan).T
    assert np.bincount(doc, length).tolist() == lengths.tolist()
    filled = np.bincount(seq, length).astype(int)
    assert all(n <= 4096 and n & (n - 1) == 0 for n in filled)
    costs = np.bincount(seq, plan.cost(length))[filled == 4096]
    assert costs.max() <= 2 * 4096 and json.dumps(int(len(filled)))


def whole_ids(encoder: tokens.UnitEncoder, texts: list[str]) -> list[list[int]]:
    return [encoder.library.encode(t, add_special_tokens=False).ids for t in texts]


def rows_of(flat, lengths) -> list[list[int]]:
    ends = lengths.cumsum()
    return [flat[e - n : e].tolist() for e, n in zip(ends, lengths, strict=True)]


@pytest.mark.parametrize("vocabulary", [registered.BYTE_VOCABULARY, registered.WORD_VOCABULARY])
def test_ids_do_not_depend_on_what_the_memo_holds(vocabulary, monkeypatch):
    words = [f"{a}{b}" for a in ("one", "Two", "drei", "ciónes", "x9") for b in ("", "s", "Ly", ", ", ".\n")]
    batches = [[" ".join(words[i : i + 6]), "", words[i], "a\x01b"[: i % 4]] for i in range(len(words))]
    small = tokens.UnitEncoder(public_tokenizers.path(vocabulary), memo_units=8)
    for texts in [*batches, *batches]:
        assert rows_of(*small.encode(pa.array(texts))) == whole_ids(small, texts)
    clashing = tokens.UnitEncoder(public_tokenizers.path(vocabulary))
    monkeypatch.setattr(tokens, "hash", lambda unit: len(unit), raising=False)
    for texts in batches:
        assert rows_of(*clashing.encode(pa.array(texts))) == whole_ids(clashing, texts)
