"""Secret scans with recursive decoding.

Each text is a worklist of layers. A layer is scanned, then unwrapped: percent escapes,
Unicode escapes, base64 runs and compressed data in them each give a new layer, until no
layer is new. Findings in a layer are mapped back to code points of the text.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterwise.llm.arrow import text_slices

KINDS = ("assign", "access", "hex")
# The patterns of the three kinds, and the least length of a finding.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE, LEAST_ACCESS = 6, 20

# Whatever has a finding or an escape matches this; all other texts need no closer look.
MAY_MATTER = r"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]{16}|[0-9a-f]{24}|%[0-9A-Fa-f]{2}|\\[uUx][0-9A-Fa-f{]|&#"
# The shortest finding (token=123456) has 12 characters, and so 16 in base64, which may be wrapped: a
# full line, a first or last line of at least half of them, or a line between others.
DIGIT = r"[A-Za-z0-9+/_-]"
BREAK = r"\r?\n[ \t]*"
LEAST_RUN = 16
BASE64_RUN = rf"{DIGIT}{{16}}|{DIGIT}{{8}}{BREAK}{DIGIT}|{DIGIT}{BREAK}{DIGIT}{{8}}|\n[ \t]*{DIGIT}+{BREAK}{DIGIT}"
RUN = re.compile(rf"(?<!{DIGIT})(?:{DIGIT}{{16,}}+(?:{BREAK}{DIGIT}++)*+|{DIGIT}++(?:{BREAK}{DIGIT}++)++)={{0,2}}")
LINE = re.compile(rf"{DIGIT}+={{0,2}}")
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
# Bytes that are unpacked at a time, and characters from which unpacked text is handed on at the next place that
# no finding or encoding crosses; without such a place, in parts of MOST_TEXT that overlap by OVERLAP.
UNPACK_BYTES, LEAST_TEXT, MOST_TEXT, OVERLAP = 1 << 20, 4 << 20, 32 << 20, 1 << 20
APART = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])|[(),!?<>|*~^`@$\[\]]|\x00{4}")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


@dataclass
class Layer:
    """Decoded text and where it came from: block i starts at ``at[i]`` here and covers
    ``source[i]`` to ``source[i] + width[i]`` in the parent; a block that is not ``same``
    stands for its whole source."""

    text: str
    parent: Layer | None = None
    at: list[int] = field(default_factory=list)
    source: list[int] = field(default_factory=list)
    width: list[int] = field(default_factory=list)
    same: list[bool] = field(default_factory=list)

    def up(self, start: int, end: int) -> tuple[int, int]:
        """The place in the parent."""
        i, j = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        first = self.source[i] + (start - self.at[i] if self.same[i] else 0)
        return first, self.source[j] + (end - self.at[j] if self.same[j] else self.width[j])

    def to_root(self, start: int, end: int) -> tuple[int, int]:
        layer = self
        while layer.parent is not None:
            start, end = layer.up(start, end)
            layer = layer.parent
        return start, end


class Builder:
    """Puts a child layer together from copied and decoded blocks."""

    def __init__(self, parent: Layer):
        self.layer, self.texts, self.length = Layer("", parent), [], 0

    def add(self, text: str, source: int, width: int, same: bool) -> None:
        if text:
            x = self.layer
            for where, value in ((x.at, self.length), (x.source, source), (x.width, width), (x.same, same)):
                where.append(value)
            self.texts.append(text)
            self.length += len(text)

    def done(self) -> Layer:
        self.layer.text = "".join(self.texts)
        return self.layer


def _percent(m: re.Match) -> Iterator[tuple[str, int, int]]:
    """Characters of a run of percent escapes; bytes that are no UTF-8 stay as they are."""
    data, at = bytes.fromhex(m[0].replace("%", "")), 0
    while at < len(data):
        first = data[at]
        n = 1 if first < 0x80 else 2 if first >> 5 == 6 else 3 if first >> 4 == 14 else 4 if first >> 3 == 30 else 1
        try:
            char = data[at : at + n].decode()
        except UnicodeDecodeError:
            n, char = 1, m[0][3 * at : 3 * at + 3]
        yield char, m.start() + 3 * at, 3 * n
        at += n


def _code_point(m: re.Match) -> Iterator[tuple[str, int, int]]:
    digits = next(x for x in m.groups() if x is not None)
    value = int(digits, 10 if m[6] is not None else 16)
    valid = value < 0x110000 and not 0xD800 <= value < 0xE000
    yield chr(value) if valid else m[0], m.start(), m.end() - m.start()


def replaced(layer: Layer, pattern: re.Pattern, decode: Callable) -> Layer | None:
    """The layer with each match decoded; None if nothing changes."""
    out, last = Builder(layer), 0
    for m in pattern.finditer(layer.text):
        out.add(layer.text[last : m.start()], last, m.start() - last, True)
        for char, start, width in decode(m):
            out.add(char, start, width, False)
        last = m.end()
    if not last:
        return None
    out.add(layer.text[last:], last, len(layer.text) - last, True)
    child = out.done()
    return child if child.text != layer.text else None


class Base64Layer(Layer):
    """The bytes of base64 as text; positions follow from those of its digits. Bytes that are no UTF-8 are U+FFFD."""

    def __init__(self, parent: Layer, data: bytes, digits: list[tuple[int, int]]):
        raw = data.decode(errors="surrogateescape")
        super().__init__(re.sub("[\udc80-\udcff]", "\ufffd", raw), parent)
        self.clean = self.text == raw and all(c.isprintable() or c in "\t\r\n" for c in raw)
        if len(raw) == len(data):
            self.ends = None  # a character is a byte
        else:
            codes = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), np.uint32)
            escaped = (codes >= 0xDC80) & (codes <= 0xDCFF)
            self.ends = np.cumsum(np.where(escaped, 1, 1 + (codes > 0x7F) + (codes > 0x7FF).astype(np.int64) + (codes > 0xFFFF)))
        # Where the lines begin among the digits, and in the parent.
        self.places = [place for place, _ in digits]
        self.firsts = [0, *np.cumsum([n for _, n in digits])[:-1].tolist()]
        self.n_digits = sum(n for _, n in digits)

    def _place(self, digit: int) -> int:
        i = bisect_right(self.firsts, digit) - 1
        return self.places[i] + digit - self.firsts[i]

    def up(self, start: int, end: int) -> tuple[int, int]:
        if self.ends is None:
            first, last = start, end - 1
        else:
            first, last = int(self.ends[start - 1]) if start else 0, int(self.ends[end - 1]) - 1
        return self._place(first // 3 * 4), self._place(min(last // 3 * 4 + 4, self.n_digits) - 1) + 1


class WholeLayer(Layer):
    """Text whose every part stands for the same place of the parent."""

    def __init__(self, text: str, parent: Layer, place: tuple[int, int]):
        super().__init__(text, parent)
        self.place = place

    def up(self, start: int, end: int) -> tuple[int, int]:
        return self.place


class NarrowedLayer(Layer):
    """A layer without the single or triple NUL bytes of UTF-16 and UTF-32 text."""

    def __init__(self, parent: Layer):
        pieces = [(m.start(), m[0]) for m in WIDE_TEXT.finditer(parent.text)]
        super().__init__("".join(p for _, p in pieces), parent)
        self.places = [place for place, _ in pieces]
        self.firsts = [0, *np.cumsum([len(p) for _, p in pieces])[:-1].tolist()]

    def up(self, start: int, end: int) -> tuple[int, int]:
        i, j = bisect_right(self.firsts, start) - 1, bisect_right(self.firsts, end - 1) - 1
        return self.places[i] + start - self.firsts[i], self.places[j] + end - self.firsts[j]


# What stays of text with NULs between its characters: runs of other lengths stay.
WIDE_TEXT = re.compile(r"[^\x00]+|\x00{4,}|(?<!\x00)\x00{2}(?!\x00)")


def decompressor(data: bytes):
    """What may unpack gzip, zlib or bzip2 data, by its first bytes; else None."""
    if data[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if len(data) > 2 and data[0] & 15 == 8 and int.from_bytes(data[:2], "big") % 31 == 0:
        return zlib.decompressobj()
    return None


class Unpacked:
    """Iterates over the content of packed data of ``parts``, all members of it, in bounded pieces. ``whole`` tells, at the
    end, whether all of the data was a complete stream; content before damage is given."""

    def __init__(self, parts: Iterator[bytes]):
        self.parts, self.whole = parts, False

    def __iter__(self) -> Iterator[bytes]:
        data, tool = next(self.parts, b""), None
        while True:
            while len(data) < 4 and (more := next(self.parts, b"")):
                data += more
            if not data:
                self.whole = True
                return
            tool = decompressor(data)
            if tool is None:
                return
            bzip = isinstance(tool, bz2.BZ2Decompressor)
            try:
                while not tool.eof:
                    out = tool.decompress(data, UNPACK_BYTES)
                    data = b"" if bzip else tool.unconsumed_tail
                    if out:
                        yield out
                    if tool.eof or (not tool.needs_input if bzip else data or len(out) == UNPACK_BYTES):
                        continue
                    data = next(self.parts, b"")
                    if not data:
                        if not bzip and (out := tool.flush()):
                            yield out
                        return
            except (zlib.error, OSError, EOFError, ValueError):
                return
            data = tool.unused_data


def unpacked_all(parts: Iterator[bytes]) -> Iterator[bytes]:
    """The content of packed data; where that is packed again, the innermost content."""
    while True:
        inner = iter(Unpacked(parts))
        head = b""
        while len(head) < 4 and (more := next(inner, b"")):
            head += more
        parts = chain([head] if head else [], inner)
        tool = decompressor(head)
        if tool is None:
            yield from parts
            return
        try:  # the first bytes of a text may look packed
            tool.decompress(head, 1)
        except (zlib.error, OSError, EOFError, ValueError):
            yield from parts
            return


def texts_of(parts: Iterator[bytes]) -> Iterator[str]:
    """Text of ``parts``, cut where no finding or encoding is cut."""
    decoder, text = codecs.getincrementaldecoder("utf-8")("replace"), ""
    for part in parts:
        text += decoder.decode(part)
        if len(text) < LEAST_TEXT:
            continue
        last = None
        for size in (1 << 12, 1 << 16, len(text)):
            for m in APART.finditer(text, max(0, len(text) - size)):
                last = m.start()
            if last:
                break
        if last:
            yield text[:last]
            text = text[last:]
        elif len(text) >= MOST_TEXT:
            yield text
            text = text[-OVERLAP:]
    if text := text + decoder.decode(b"", True):
        yield text


def base64_bytes(digits: str) -> bytes | None:
    body = digits[: len(digits) - (len(digits) % 4 == 1)].replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def from_base64(layer: Layer, start: int, block: str) -> Iterator[Layer]:
    """What a run of one or more lines stands for; returns whether all of it is text, or a
    complete packed stream. Decoded characters map to their groups of four; unpacked text maps to the whole run."""
    lines = [(start + m.start(), m[0].rstrip("=")) for m in LINE.finditer(block)]
    digits = "".join(line for _, line in lines)
    data = base64_bytes(digits) if len(digits) >= LEAST_RUN else None
    if not data:
        return False
    if decompressor(data):
        outer, any_text = Unpacked(iter([data])), False
        for text in texts_of(unpacked_all(iter([data]))):
            any_text = True
            yield from narrowed(WholeLayer(text, layer, (start, start + len(block))))
        if any_text:
            for _ in outer:
                pass
            if outer.whole:
                return True
    child = Base64Layer(layer, data, [(place, len(line)) for place, line in lines])
    yield from narrowed(child)
    if child.clean:
        return True
    for skipped in (1, 2, 3):  # a word before it may be joined to the run and shift its groups of four
        if len(digits) - skipped >= LEAST_RUN and (data := base64_bytes(digits[skipped:])):
            rest = lines
            for _ in range(skipped):
                rest = [(rest[0][0] + 1, rest[0][1][1:]), *rest[1:]] if len(rest[0][1]) > 1 else rest[1:]
            yield from narrowed(Base64Layer(layer, data, [(place, len(line)) for place, line in rest]))
    return False


def narrowed(layer: Layer) -> Iterator[Layer]:
    yield layer
    if "\0" in layer.text and (narrow := NarrowedLayer(layer)).text not in ("", layer.text):
        yield narrow


def from_block(layer: Layer, start: int, block: str) -> Iterator[Layer]:
    """The layers of a run that may span lines: of all of it; unless that is clean, of all but the first
    line and of lines of equal width (and a shorter last one), as words beside it may be joined to it; and of single lines."""
    if (yield from from_base64(layer, start, block)):
        return
    lines = [(m.start(), m.end()) for m in LINE.finditer(block)]
    if len(lines) > 1 and (yield from from_base64(layer, start + lines[1][0], block[lines[1][0] :])):
        return
    groups: list[list[tuple[int, int]]] = []
    open_ = False
    for a, b in lines:
        width = groups[-1][0][1] - groups[-1][0][0] if groups else 0
        if open_ and b - a <= width:
            groups[-1].append((a, b))
            open_ = b - a == width
        else:
            groups.append([(a, b)])
            open_ = True
    for group in groups:
        a, b = group[0][0], group[-1][1]
        if 1 < len(group) and len(groups) > 1 and (yield from from_base64(layer, start + a, block[a:b])):
            continue
        full = [x for x in group if x[1] - x[0] == group[0][1] - group[0][0]]
        if 1 < len(full) < len(group) and (yield from from_base64(layer, start + a, block[a : full[-1][1]])):
            continue
        for c, d in group:
            line = block[c:d]
            if len(lines) > 1 and (yield from from_base64(layer, start + c, line)):
                continue
            for part in re.finditer(r"[A-Za-z0-9]{16,}={0,2}", line):  # a path or a word may be joined to it
                if len(part[0]) < len(line):
                    yield from from_base64(layer, start + c + part.start(), part[0])


def children(layer: Layer) -> Iterator[Layer]:
    for pattern, decode in ((PERCENT, _percent), (UNICODE, _code_point)):
        if child := replaced(layer, pattern, decode):
            yield child
    for m in RUN.finditer(layer.text):
        if len(m[0]) >= LEAST_RUN:
            yield from from_block(layer, m.start(), m[0])


def all_spans(text: str) -> list[tuple[str, int, int]]:
    """Distinct spans of all layers, by start, kind as listed, and end."""
    found, seen, work = set(base_spans(text)), {(_digest(text), 0, len(text))}, [children(Layer(text))]
    while work:  # depth first: few layers are held at a time
        child = next(work[-1], None)
        if child is None:
            work.pop()
            continue
        if not child.text:
            continue
        layer = (_digest(child.text), *child.to_root(0, len(child.text)))
        if layer in seen:  # a layer that comes back at its place, by whatever way, ends there
            continue
        seen.add(layer)
        work.append(children(child))
        found |= {(kind, *child.to_root(a, b)) for kind, a, b in base_spans(child.text)}
    return in_order(found)


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode(errors="surrogatepass"), digest_size=16).digest()


def in_order(spans) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPANS = T.ArrayType(T.StructType().add("kind", "string").add("start", "integer").add("end", "integer").add("decoded", "boolean"))
SPAN_TYPE = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("decoded", pa.bool_())])
)


def suspects(texts: pa.Array) -> Iterator[tuple[int, str]]:
    """The place and text of what may have a finding or an encoding; the others are not looked at in Python."""
    matters = pc.or_(pc.match_substring_regex(texts, MAY_MATTER), pc.match_substring_regex(texts, BASE64_RUN))
    for i in np.flatnonzero(matters.to_numpy(zero_copy_only=False)):
        yield int(i), texts[int(i)].as_py()


@F.arrow_udf(SPANS)
def secret_spans(text: pa.Array) -> pa.Array:
    """The spans of each text (null: none), code points, end exclusive, ordered by start,
    kind and end. ``decoded`` marks those that only a decoded layer shows."""
    out: list[list[dict]] = []
    for texts in text_slices(text):
        rows: list[list[dict]] = [[] for _ in range(len(texts))]
        for i, whole in suspects(texts):
            base = set(base_spans(whole))
            rows[i] = [dict(kind=k, start=a, end=b, decoded=(k, a, b) not in base) for k, a, b in all_spans(whole)]
        out += rows
    return pa.array(out, SPAN_TYPE)


def without_spans(text: str, spans: Iterable[tuple[str, int, int]]) -> str:
    """``text`` with ordered spans replaced by ``[kind]``; overlapping ones become one, named by the first."""
    parts, last = [], 0
    for kind, start, end in spans:
        if start >= last:
            parts += [text[last:start], f"[{kind}]"]
        last = max(last, end)
    return "".join(parts) + text[last:]


@F.arrow_udf(T.StringType())
def redacted(text: pa.Array) -> pa.Array:
    """Each text with the spans of all its secrets replaced by ``[kind]``. Null stays null."""
    out = []
    for texts in text_slices(text):
        rows = texts.to_pylist()
        for i, whole in suspects(texts):
            rows[i] = without_spans(whole, all_spans(whole))
        out += rows
    return pc.if_else(pc.is_valid(text), pa.array(out, pa.string()), pa.scalar(None, pa.string()))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
