"""Helpers for work on Arrow text columns inside tasks."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """``texts`` cut between rows into slices of about ``limit`` bytes, so that what a task
    derives from a batch stays small. A longer row is a slice of its own. Null becomes empty."""
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    row = 0
    while row < len(texts):
        done = ends[row - 1] if row else 0
        stop = max(row + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield texts[row:stop]
        row = stop
    pa.default_memory_pool().release_unused()  # a worker lives on between tasks


def worker_state() -> dict:
    """What a Python worker keeps from one task to the next. Functions that are shipped by
    value get new globals with each task; this lives in the process."""
    return vars(sys.modules.setdefault("_worker_state", types.ModuleType("_worker_state")))


def sums_by_row(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of each row's run of ``counts`` values; 0 for an empty run."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def gather_runs(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs ``flat[start : start + length]``, one after the other."""
    before = np.cumsum(lengths) - lengths
    return flat[np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()), dtype=np.int64)]


def list_array(flat: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
