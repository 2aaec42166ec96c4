"""Token ids of whole texts, with the tokenizers library.

Text is cut where every tokenizer of this kind starts a new word, and each distinct
unit is encoded once per worker: the library's time goes into words, not into text.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterwise.llm.arrow import gather_runs, list_array, sums_by_row, text_slices, worker_state

# Units that a worker remembers before it drops those not met of late: some 20 MB.
MEMO_UNITS = 300_000
CUT = "\x01"
# White space and other characters on which tokenizers disagree: nothing is cut beside them.
SPACES = r"\x00-\x20\x7f-\xa0\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{206f}\x{3000}\x{feff}"
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
SPACED_WORD = rf"^ [{LETTERS}]+$"


def byte_characters() -> dict[int, str]:
    """The characters by which byte-level vocabularies write the 256 bytes: printable
    Latin-1 as itself, the others from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(others)}


BYTE_TABLE = byte_characters()


def strings(values: pa.Array) -> list[str]:
    """As ``to_pylist``, which takes many times as long."""
    return values.to_numpy(zero_copy_only=False).tolist()


class UnitEncoder:
    """Encodes text columns; remembers the ids of the units it has met.

    A cut lies before a space and a visible character, around a single line break
    between visible characters, and between Latin letters and common punctuation. At
    all these places the pre-tokenizers of byte-level vocabularies end a word whatever
    stands around, so the ids of the units, in order, are the ids of the text.
    """

    def __init__(self, path: str, memo_units: int = MEMO_UNITS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        # Added tokens are matched in the text as such, across the places where it would be cut.
        added = [token.content for token in self.library.get_added_tokens_decoder().values() if token.content]
        self.uncut = "(?i)" + "|".join(map(re.escape, [CUT, *added]))
        self.lowers = self.library.normalizer is not None
        self.memo_units = memo_units
        self.forget()

    def forget(self) -> None:
        self.units = pa.array([], pa.string())
        self.flat = np.zeros(0, np.int32)
        self.ends = np.zeros(0, np.int64)
        self.met = np.zeros(0, np.int32)  # the slice that met a unit last
        self.slices = 0
        # The units' hashes ascending, and the unit of each.
        self.keys, self.unit_of_key = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows in one array, and each row's number of ids."""
        parts = [self._encode_slice(x) for x in text_slices(texts)]
        pa.default_memory_pool().release_unused()
        if not parts:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _encode_slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        uncut = pc.match_substring_regex(texts, self.uncut)
        if not pc.any(uncut).as_py():
            return self._in_units(texts)
        parts = [self._whole(texts.filter(uncut)), self._in_units(texts.filter(pc.invert(uncut)))]
        flat, lengths = (np.concatenate(x) for x in zip(*parts))
        apart = uncut.to_numpy(zero_copy_only=False)
        place = np.argsort(np.concatenate([np.flatnonzero(apart), np.flatnonzero(~apart)]))
        return gather_runs(flat, (np.cumsum(lengths) - lengths)[place], lengths[place]), lengths[place]

    def _in_units(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not len(texts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        cut = pc.split_pattern(self._marked(texts), CUT)
        coded = cut.flatten().dictionary_encode()
        entries = self._entries(coded.dictionary)
        if entries is None:
            return self._whole(texts)
        entry = entries[coded.indices.to_numpy(zero_copy_only=False)]
        lengths = np.diff(self.ends, prepend=0)
        unit_lengths = lengths[entry]
        flat = gather_runs(self.flat, self.ends[entry] - unit_lengths, unit_lengths)
        counts = pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)
        return flat, sums_by_row(unit_lengths, counts)

    def _whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.library.encode_batch(texts.to_pylist(), add_special_tokens=False)]
        return np.array([i for x in ids for i in x], np.int32), np.array([len(x) for x in ids], np.int64)

    def _marked(self, texts: pa.Array) -> pa.Array:
        if self.lowers:
            texts = pc.ascii_lower(texts)
        if pc.any(pc.match_substring_regex(texts, rf" [{SPACES}]")).as_py():
            texts = pc.replace_substring_regex(texts, rf" ([^{SPACES}])", CUT + r" \1")
        else:
            texts = pc.replace_substring(texts, " ", CUT + " ")
        texts = pc.replace_substring_regex(texts, rf"([^{SPACES}])\n([^{SPACES}])", f"\\1{CUT}\n{CUT}\\2")
        return pc.replace_substring_regex(texts, rf"([{LETTERS}])([.,;:!?*#$%&|]+){CUT}", rf"\1{CUT}\2{CUT}")

    def _entries(self, distinct: pa.Array) -> np.ndarray | None:
        """The place in the memo of each unit; new ones are encoded first. Units are found by
        hash and then compared: None if two of them share one."""
        keys = np.fromiter(map(hash, strings(distinct)), np.int64, len(distinct))
        self.slices += 1
        found, known = self._places(keys)
        if len(self.keys) + np.count_nonzero(~known) > self.memo_units:
            self.met[found[known]] = self.slices
            self._forget_oldest()
            found, known = self._places(keys)
        if not known.all():
            new = np.flatnonzero(~known)
            self._remember(distinct.take(pa.array(new)), keys[new])
            found, _ = self._places(keys)
        self.met[found] = self.slices
        return found if self.units.take(pa.array(found)).equals(distinct) else None

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The unit of each key, and whether there is one."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        order = np.argsort(keys)  # a search in order stays in the cache
        at = np.empty(len(keys), np.int64)
        at[order] = np.searchsorted(self.keys, keys[order])
        at = np.minimum(at, len(self.keys) - 1)
        return self.unit_of_key[at], self.keys[at] == keys

    def _forget_oldest(self) -> None:
        """Keep the units met last, at most three quarters of those there may be."""
        by_age = np.argsort(-self.met, kind="stable")
        kept = np.sort(by_age[: self.memo_units // 4 * 3])
        keys = np.empty_like(self.keys)
        keys[self.unit_of_key] = self.keys
        keys, lengths = keys[kept], np.diff(self.ends, prepend=0)[kept]
        self.flat = gather_runs(self.flat, self.ends[kept] - lengths, lengths)
        self.units, self.ends, self.met = self.units.take(pa.array(kept)), np.cumsum(lengths), self.met[kept]
        self.unit_of_key = np.argsort(keys)
        self.keys = keys[self.unit_of_key]

    def _remember(self, new: pa.Array, keys: np.ndarray) -> None:
        plain = pc.match_substring_regex(new, SPACED_WORD)
        words, others = new.filter(plain), new.filter(pc.invert(plain))
        ids = [self._word(w) for w in strings(words)]
        ids += [e.ids for e in self.library.encode_batch(strings(others), add_special_tokens=False)]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.int32, int(lengths.sum()))
        is_word = plain.to_numpy(zero_copy_only=False)
        keys = np.concatenate([keys[is_word], keys[~is_word]])
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        self.keys = np.insert(self.keys, at, keys[order])
        self.unit_of_key = np.insert(self.unit_of_key, at, len(self.units) + order)
        self.met = np.concatenate([self.met, np.full(len(keys), self.slices, np.int32)])
        self.units = pa.concat_arrays([self.units, words, others])
        self.ends = np.concatenate([self.ends, np.cumsum(lengths) + len(self.flat)])
        self.flat = np.concatenate([self.flat, flat])

    def _word(self, unit: str) -> list[int]:
        """A unit of one space and letters is one word for the library's model."""
        word = unit[1:].lower() if self.lowers else unit
        written = word if word.isascii() and self.lowers else word.encode().decode("latin-1").translate(BYTE_TABLE)
        return [token.id for token in self.library.model.tokenize(written)]


def encoder(path: str) -> UnitEncoder:
    """The worker's encoder for a vocabulary."""
    encoders = worker_state().setdefault("encoders", {})
    if path not in encoders:
        encoders[path] = UnitEncoder(path)
    return encoders[path]


def with_end(flat: np.ndarray, lengths: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    if end_id is None:
        return flat, lengths
    return np.insert(flat, np.cumsum(lengths), end_id).astype(np.int32), lengths + 1


def token_ids(path: str, end_id: int | None = None) -> Callable[[Column], Column]:
    """A column function: the ids of each text (null: empty), then ``end_id`` if given.
    ``path`` names the vocabulary file, to be found there by every executor."""

    @F.arrow_udf("array<int>")
    def ids(text: pa.Array) -> pa.Array:
        return list_array(*with_end(*encoder(path).encode(text), end_id))

    return ids


def crc_of_runs(flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The unsigned crc32 of each run of ids, as little-endian unsigned 32-bit integers."""
    data = memoryview(np.ascontiguousarray(flat, dtype="<u4").tobytes())
    ends = np.cumsum(lengths) * 4
    starts = ends - np.asarray(lengths) * 4
    return np.fromiter((zlib.crc32(data[a:b]) for a, b in zip(starts, ends, strict=True)), np.int64, len(ends))


@F.arrow_udf(T.LongType())
def ids_crc32(ids: pa.Array) -> pa.Array:
    lengths = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
    return pa.array(crc_of_runs(ids.flatten().to_numpy(zero_copy_only=False), lengths), pa.int64())
