"""Cost-balanced packing of documents into training sequences.

Attention over a piece of n tokens costs ``linear * n + quadratic * n * n``. Pieces go, in
descending order, to the sequence of lowest cost that has room.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwise.llm.arrow import gather_runs, text_slices
from meterwise.llm.tokens import crc_of_runs, encoder, with_end

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "sequence_length long, sequence_cost double"
)


@dataclass(frozen=True)
class PackingPlan:
    capacity: int = 4096
    linear: float = 1.0
    quadratic: float = 1.0 / 4096
    # Documents are packed in groups of about this many tokens, so that a task's memory and
    # the search for the cheapest sequence are bounded at any input size.
    group_tokens: int = 1 << 20

    def cost(self, n):
        return self.linear * n + self.quadratic * n * n


def capacities(total: int, full: int) -> np.ndarray:
    """Sequences that ``total`` tokens fill exactly: full ones, then powers of two."""
    rest = total % full
    powers = [1 << b for b in reversed(range(full.bit_length())) if rest >> b & 1]
    return np.array([full] * (total // full) + powers, np.int64)


def pack(lengths: np.ndarray, plan: PackingPlan) -> np.ndarray:
    """Rows (document, start, length, sequence, offset) that place every token once.

    Whole multiples of the capacity fill sequences of their own. The rests go in descending
    order (ties: earlier document first) to the cheapest sequence with room; where none has
    room for the whole rest, it is cut. Sequences have exactly as much room in all as
    there are tokens, the last ones at powers of two, so nothing is padded.
    """
    full = plan.capacity
    pieces = []
    for doc in np.flatnonzero(lengths >= full):
        for start in range(0, int(lengths[doc]) // full * full, full):
            pieces.append((doc, start, full, len(pieces), 0))
    first = len(pieces)
    rests = lengths % full
    room = capacities(int(rests.sum()), full)
    size, cost = room.copy(), np.zeros(len(room))
    for doc in np.argsort(-rests, kind="stable"):
        left, start = int(rests[doc]), int(lengths[doc] - rests[doc])
        while left:
            open_to_all = room >= left
            fits = open_to_all if open_to_all.any() else room > 0
            seq = int(np.where(fits, cost, np.inf).argmin())
            n = min(left, int(room[seq]))
            pieces.append((doc, start, n, first + seq, int(size[seq] - room[seq])))
            room[seq] -= n
            cost[seq] += plan.cost(n)
            start, left = start + n, left - n
    return np.array(pieces, np.int64).reshape(-1, 5)


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int | None, plan: PackingPlan | None = None) -> DataFrame:
    """One row per piece of ``docs`` (``doc_id``, ``text``; null text: empty).

    Each task packs its own documents as it reads them: nothing is shuffled, and a repeated
    task gives the same rows. ``sequence_id`` holds the task's number above its own count.
    Rows of equal ``doc_id`` are documents of their own. A document without ids (no
    ``end_id`` and an empty text) has no piece. Further columns are left out.
    """
    plan = plan or PackingPlan()
    if plan.capacity & (plan.capacity - 1):
        raise ValueError("the capacity must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 40
        held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence
            flat = np.concatenate([h[0] for h in held])
            lengths = np.concatenate([h[1] for h in held])
            doc_ids = pa.concat_arrays([h[2] for h in held])
            doc, start, length, seq, offset = pack(lengths, plan).T
            begin = (np.cumsum(lengths) - lengths)[doc] + start
            crc = crc_of_runs(gather_runs(flat, begin, length), length)
            n_seq = int(seq.max()) + 1 if len(seq) else 0
            filled = np.bincount(seq, length, n_seq).astype(np.int64)
            costs = np.bincount(seq, plan.cost(length), n_seq)
            columns = [doc_ids.take(pa.array(doc)), start, length, crc, lengths[doc], sequence + seq, offset, filled[seq], costs[seq]]
            sequence += n_seq
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[f.split()[0] for f in PIECES.split(", ")])

        for batch in batches:
            row = 0
            for texts in text_slices(batch.column(1)):
                flat, lengths = with_end(*encoder(vocabulary).encode(texts), end_id)
                held.append((flat, lengths, batch.column(0)[row : row + len(texts)]))
                row += len(texts)
                tokens += len(flat)
                if tokens >= plan.group_tokens:
                    yield flush()
                    held, tokens = [], 0
        if held:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)
