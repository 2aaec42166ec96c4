"""Token ids against the library used plainly, and the layout of token files."""

from __future__ import annotations

import random

import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from meterwise.llm import packing, token_files, tokens

VOCABULARIES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
PARTS = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "|>", " ", "\n", "a", "Été", " the", "\x01", "!!", "漢", "  "]


@pytest.mark.parametrize("vocabulary", VOCABULARIES)
def test_added_tokens_in_texts(vocabulary):
    path = public_tokenizers.path(vocabulary)
    plain, ours = Tokenizer.from_file(path), tokens.UnitEncoder(path)
    draw = random.Random(1)
    texts = ["a <|endoftext|> b", "<|endoftext|><|startoftext|>", ""] + ["".join(draw.choices(PARTS, k=draw.randrange(12))) for _ in range(600)]
    flat, lengths = ours.encode(pa.array(texts))
    got, at = [], 0
    for n in lengths:
        got.append(flat[at : at + n].tolist())
        at += n
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_files_layout_and_selective_reads(spark, tmp_path):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.lit("some words")] * 20, F.col("id").cast("string")).alias("text"))
    path = f"{tmp_path}/files"
    token_files.write_token_files(docs.repartition(2), path, public_tokenizers.path(VOCABULARIES[0]), 2)
    files = sorted(tmp_path.glob("files/*.parquet"))
    assert files
    for name in files:
        meta = pq.ParquetFile(name).metadata
        for group in range(meta.num_row_groups):
            assert meta.row_group(group).total_byte_size < 32 << 20
            for c in range(meta.num_columns):
                column = meta.row_group(group).column(c)
                assert "DELTA_BINARY_PACKED" in column.encodings and column.dictionary_page_offset is None
                assert column.has_column_index and column.has_offset_index
    read = token_files.read_token_files(spark, path, F.col("doc_id").between(100, 120), ["doc_id", "n_tokens"])
    assert sorted(r["doc_id"] for r in read.collect()) == list(range(100, 121))
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,100)" in plan and "ids" not in plan.split("ReadSchema")[1]


def lowest_cost(lengths, plan):
    """Rests in descending order, each to the cheapest sequence with room, by a plain search."""
    rests = [(n % plan.capacity, i) for i, n in enumerate(lengths)]
    room = list(packing.capacities(sum(r for r, _ in rests), plan.capacity))
    cost, out = [0.0] * len(room), []
    for rest, doc in sorted(rests, key=lambda x: (-x[0], x[1])):
        start = lengths[doc] - rest
        while rest:
            fitting = [s for s in range(len(room)) if room[s] >= rest] or [s for s in range(len(room)) if room[s]]
            best = min(fitting, key=lambda s: (cost[s], s))
            n = min(rest, room[best])
            out.append((doc, start, n, best))
            room[best] -= n
            cost[best] += plan.cost(n)
            rest, start = rest - n, start + n
    return out


@pytest.mark.parametrize("seed", range(5))
def test_packing_takes_the_cheapest_sequence(seed):
    import numpy as np

    draw = np.random.default_rng(seed)
    plan = packing.PackingPlan(capacity=256)
    lengths = np.minimum(draw.lognormal(4, 1, 120).astype(np.int64) + 1, 900)
    rows = packing.pack(lengths, plan)
    whole = sum(int(n) // 256 for n in lengths)
    assert [(d, s, n, q - whole) for d, s, n, q, _ in rows.tolist()[whole:]] == lowest_cost(lengths.tolist(), plan)
