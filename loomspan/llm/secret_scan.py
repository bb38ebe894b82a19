"""Operator 9: secret scans by a recursive decoding worklist.

The text itself is scanned with the base patterns. Then every encoded stretch (percent escapes,
\\u and \\x escapes, base64, compressed bytes inside any of these, UTF-16 inside bytes) is unwrapped into a new layer, which is
scanned and unwrapped in turn until nothing new appears. Base64 may be wrapped: consecutive lines of it, indented
or not, are also read as one stretch; what is decoded from it maps to the lines that hold it. A stretch that isn't
text from its first character on is tried at all four alignments, as other characters may touch it; bytes that aren't UTF-8 are read as Latin-1. A layer whose content was already seen for
the same stretch ends that branch (cycle detection). Each layer carries, for each of its characters,
the start and end in the original text, so that a secret found deep inside maps to the span that holds it.

Null and empty texts have no spans. Offsets are code points, end exclusive. Whole texts are scanned, however long. Repeated rows repeat in the result, each with its spans; where
several layers show a secret of one kind at one span it is given once. An empty table gives an empty table; columns other than doc_id and text are ignored, whatever their names.
A stretch that would inflate beyond `inflate_limit` bytes is itself reported, as kind `oversize`, and is inflated and scanned
in overlapping chunks. A chunk ends before a word or a base64 stretch that goes on, unless that alone is longer than `inflate_limit`.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, batch_of, slices

# The base patterns and the least length of what they must hold.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "decoded_assign", "decoded_access", "decoded_hex", "oversize")

PERCENT = re.compile(r"%[0-9A-Fa-f]{2}")
ESCAPE = re.compile(r"\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}")
#: One byte of a line under percent escapes, and of one under escapes of JSON, C or Python.
PERCENT_BYTE = re.compile(r"%([0-9A-Fa-f]{2})|([\s\S])")
ESCAPE_BYTE = re.compile(r"\\(?:u00|x)([0-9A-Fa-f]{2})|\\([abfnrtv0\\'\"/])|([\s\S])")
SHORT = dict(zip("abfnrtv0", b"\a\b\f\n\r\t\v\0", strict=True))
#: Starts of gzip, bzip2, xz and zlib data (without a preset dictionary).
MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9]|\xfd7zXZ\0|" + b"|".join(re.escape(bytes([a, b])) for a in range(0x08, 0x80, 0x10) for b in range(256) if (a << 8 | b) % 31 == 0 and not b & 32))
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{19,}={0,2}")  # 14 bytes, the shortest secret, take 19
BREAK = re.compile(r"[ \t]*+(?:\r?\n|(?:\\r)?\\n)[ \t]*+")  # also the escaped line ends of JSON
WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:{BREAK.pattern}[A-Za-z0-9+/_-]++)++={{0,2}}")
#: ASCII in 16 bits, either byte first.
WIDE = re.compile(r"(?:[\t\n\r\x20-\x7e]\0){8,}|(?:\0[\t\n\r\x20-\x7e]){8,}")
INFLATE_LIMIT = 64 << 20
CHUNK = 4 << 20  #: bytes of an oversize stretch that are inflated at once
OVERLAP = 64 << 10  #: bytes of a chunk that the next one repeats
#: The last word of reversed bytes, with the lines of one word before it.
LAST_WORD = re.compile(rb"\S*+(?:[ \t]*+\n\r?[ \t]*+\S++)*+")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


class Layer:
    """Text with the original span of each character; lo is None for the original text itself. Neither lo nor hi ever falls."""

    __slots__ = ("hi", "lo", "text")

    def __init__(self, text: str, lo: Sequence[int] | np.ndarray | None = None, hi: Sequence[int] | np.ndarray | None = None):
        self.text, self.lo, self.hi = text, lo, hi

    def span(self, start: int, end: int) -> tuple[int, int]:
        return (start, end) if self.lo is None else (int(self.lo[start]), int(self.hi[end - 1]))


def _lines_with(pattern: re.Pattern, text: str) -> Iterator[tuple[int, int]]:
    """Line spans that hold a match."""
    end = -1
    for m in pattern.finditer(text):
        if m.start() >= end:
            start = text.rfind("\n", 0, m.start()) + 1
            end = text.find("\n", m.start())
            end = len(text) if end < 0 else end
            yield start, end


def _unescape(layer: Layer, start: int, end: int, pattern: re.Pattern) -> Layer:
    """One line with its escapes decoded; runs of percent escapes are decoded as UTF-8 together."""
    out, lo, hi = [], [], []

    def add(s: str, a: int, b: int, each: bool) -> None:
        for k, ch in enumerate(s):
            x, y = layer.span(a + k, a + k + 1) if each else layer.span(a, b)
            out.append(ch)
            lo.append(x)
            hi.append(y)

    at, runs = start, []
    for m in pattern.finditer(layer.text, start, end):
        if pattern is PERCENT and runs and runs[-1][1] == m.start():
            runs[-1][1] = m.end()
        else:
            runs.append([m.start(), m.end()])
    for a, b in runs:
        add(layer.text[at:a], at, a, True)
        piece = layer.text[a:b]
        if pattern is PERCENT:
            add(bytes.fromhex(piece.replace("%", "")).decode("utf-8", "replace"), a, b, False)
        else:
            add(chr(int(piece[2:], 16)), a, b, False)
        at = b
    add(layer.text[at:end], at, end, True)
    return Layer("".join(out), lo, hi)


def _makers(raw: bytes | memoryview, limit: int) -> list[Callable[[], object]]:
    """Decompressors for what raw starts with."""
    makers: list[Callable[[], object]] = []
    if raw[:2] == b"\x1f\x8b" or (len(raw) > 2 and raw[0] & 15 == 8 and (raw[0] << 8 | raw[1]) % 31 == 0):
        makers.append(lambda: zlib.decompressobj(47))
    if raw[:3] == b"BZh":
        makers.append(bz2.BZ2Decompressor)
    if raw[:6] == b"\xfd7zXZ\0":
        makers.append(lambda: lzma.LZMADecompressor(memlimit=max(limit, INFLATE_LIMIT) * 4))
    return makers


BROKEN = (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError)


def _inflate(raw: bytes | memoryview, limit: int) -> tuple[bytes | memoryview | None, int]:
    """Decompressed bytes, raw itself if it isn't compressed, None if it would exceed the limit; and how many bytes of raw hold them."""
    for make in _makers(raw, limit):
        try:
            d = make()
            got = d.decompress(raw, limit + 1)
        except BROKEN:
            continue
        if len(got) > limit:
            return None, len(raw)
        if d.eof:
            return got, len(raw) - len(d.unused_data)
    return raw, len(raw)


def _inflate_parts(source: Iterator[bytes], d: object, size: int) -> Iterator[bytes]:
    """What source inflates to, in parts of at most `size` bytes. Where it breaks off, what came before stands."""
    for data in source:
        more = True
        while more and not d.eof:
            try:
                got = d.decompress(data, size)
            except BROKEN:
                return
            if got:
                yield got
            if hasattr(d, "unconsumed_tail"):
                data = d.unconsumed_tail
                more = bool(data) or len(got) == size
            else:
                data, more = b"", not d.needs_input
        if d.eof:
            return


def _all_layers(source: Iterator[bytes], size: int, limit: int, seen: frozenset[bytes] = frozenset()) -> Iterator[bytes]:
    """Parts of source after all compressed layers at its start. A layer that starts like one above it, over a whole part, ends the branch."""
    first = b""
    for part in source:
        first += part
        if len(first) >= size:
            break
    h = hashlib.sha256(first).digest()
    if h in seen:
        return
    for make in _makers(first, limit):
        try:
            make().decompress(first, size)
        except BROKEN:
            continue
        yield from _all_layers(_inflate_parts((x[i : i + OVERLAP] for x in chain([first], source) for i in range(0, len(x), OVERLAP)), make(), size), size, limit, seen | {h})
        return
    if first:
        yield first
    yield from source


def _chunks(raw: bytes | memoryview, limit: int) -> Iterator[bytes]:
    """What oversize raw holds, in overlapping chunks; memory is bounded by the limit and a part."""
    size = max(1, min(CHUNK, limit))
    overlap = min(OVERLAP, size // 4)
    held, new = b"", 0
    for part in _all_layers(iter([bytes(raw)]), size, limit):
        held += part
        new += len(part)
        cut = len(held) - LAST_WORD.match(held[::-1]).end()
        if len(held) >= max(limit, 2 * size) or len(held) - new < cut:
            whole = cut if len(held) - new < cut else len(held)
            yield held[:whole]
            new = len(held) - whole
            held = held[max(0, whole - overlap) :]
    if new:
        yield held


def _text(raw: bytes) -> tuple[str, bool]:
    """Bytes as text (Latin-1 if they aren't UTF-8), and whether they look like text."""
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1"), False
    return text, bool(text) and sum(map(str.isprintable, text)) + sum(map(text.count, "\t\r\n")) >= 0.95 * len(text)


def _unpack(raw: bytes | memoryview, limit: int) -> tuple[bytes | memoryview | None, int]:
    """raw after all compressed layers at its start (None: one would exceed the limit), and how many bytes of raw they take; 0 if there are none."""
    got, packed = _inflate(raw, limit)
    if got is raw:
        return raw, 0
    seen = {hashlib.sha256(raw[:packed]).digest()}
    while got is not None and (h := hashlib.sha256(got).digest()) not in seen:  # some hold themselves
        seen.add(h)
        got, _ = _inflate(got, limit)
    return got, packed


def _at(text: str, lo: int, hi: int) -> Layer:
    """Text all of which maps to one span."""
    return Layer(text, np.broadcast_to(lo, len(text)), np.broadcast_to(hi, len(text)))


def _streams(raw: bytes, limit: int) -> Iterator[tuple[int, int, bytes | None]]:
    """Compressed data anywhere in raw: start, end, and what it holds. Where that is too much, None comes first and then each chunk."""
    at, view = 0, memoryview(raw)
    while m := MAGIC.search(raw, at):
        got, packed = _unpack(view[m.start() :], limit)
        at = m.start() + max(packed, 1)
        if packed:
            yield m.start(), at, got
        if got is None:
            for chunk in _chunks(view[m.start() :], limit):
                yield m.start(), at, chunk


def _from_base64(piece: str, limit: int) -> Iterator[tuple[int, int, int, bytes | None, bool]]:
    """What a base64 stretch holds: alignment, start and end within the bytes at that alignment, content (None: too much, chunks follow), and whether it was compressed."""
    core = piece.rstrip("=").replace("-", "+").replace("_", "/")
    for shift in range(4):
        part = core[shift : len(core) - ((len(core) - shift) % 4 == 1)]
        raw = base64.b64decode(part + "=" * (-len(part) % 4))
        done, rest = _text(raw)[1], bytearray(raw)
        for a, b, got in _streams(raw, limit):
            yield shift, a, b, got, True
            rest[a:b] = bytes(b - a)  # compressed bytes themselves aren't text
            done = done or (a == 0 and b == len(raw))
        if any(rest):
            yield shift, 0, len(raw), bytes(rest), False
        if done:
            break


def _unwrap_bytes(layer: Layer, start: int, end: int, pattern: re.Pattern, limit: int) -> Iterator[Layer | tuple[int, int]]:
    """Compressed data among the bytes of one line under escapes."""
    raw, at = bytearray(), []
    for m in (PERCENT_BYTE if pattern is PERCENT else ESCAPE_BYTE).finditer(layer.text, start, end):
        at.append(m.start())
        if m.group(1):
            raw.append(int(m.group(1), 16))
        elif pattern is ESCAPE and m.group(2):
            raw.append(SHORT.get(m.group(2), ord(m.group(2))))
        else:
            raw.append(min(ord(m.group()), 0xFF))
    at.append(end)
    for data in {bytes(raw), bytes(raw).replace(b"+", b" ")} if pattern is PERCENT else (bytes(raw),):  # forms write a space as a plus sign
        for a, b, got in _streams(data, limit):
            lo, hi = layer.span(at[a], at[b])
            if got is None:
                yield lo, hi
            else:
                yield _at(_text(bytes(got))[0], lo, hi)


def _unwrap_lines(layer: Layer, start: int, end: int, limit: int) -> Iterator[Layer | tuple[int, int]]:
    """A base64 stretch over several lines: each character maps to the line or lines that its bytes stand in."""
    edges = [start, *(x for m in BREAK.finditer(layer.text, start, end) for x in m.span()), end]
    lines = list(zip(edges[::2], edges[1::2], strict=True))
    piece = "".join([layer.text[a:b] for a, b in lines])
    if len(piece) < 19:
        return
    spans = np.array([layer.span(a, b) for a, b in lines], np.int64)
    line = np.repeat(np.arange(len(lines)), [b - a for a, b in lines])
    for shift, a, b, got, packed in _from_base64(piece, limit):
        if packed:
            lo, hi = int(spans[line[shift + a * 8 // 6], 0]), int(spans[line[shift + (b * 8 - 1) // 6], 1])
            yield (lo, hi) if got is None else _at(_text(bytes(got))[0], lo, hi)
            continue
        text, _ = _text(got)
        data = np.frombuffer(got, np.uint8)
        starts = np.arange(len(data)) if len(text) == len(data) else np.flatnonzero((data & 0xC0) != 0x80)
        ends = np.append(starts[1:], len(data))
        yield Layer(text, spans[line[shift + starts * 8 // 6], 0], spans[line[shift + (ends * 8 - 1) // 6], 1])


def unwrap(layer: Layer, limit: int) -> Iterator[Layer | tuple[int, int]]:
    """Layers one step below; a bare span stands for an oversize one."""
    text = layer.text
    if "%" in text:
        for a, b in _lines_with(PERCENT, text):
            yield _unescape(layer, a, b, PERCENT)
            yield from _unwrap_bytes(layer, a, b, PERCENT, limit)
    if "\\" in text:
        for a, b in _lines_with(ESCAPE, text):
            yield _unescape(layer, a, b, ESCAPE)
            yield from _unwrap_bytes(layer, a, b, ESCAPE, limit)
    if "\0" in text:
        for m in WIDE.finditer(text):
            at = np.arange(m.start() + (text[m.start()] == "\0"), m.end(), 2)
            yield Layer(m.group().replace("\0", ""), at if layer.lo is None else np.asarray(layer.lo)[at], at + 1 if layer.hi is None else np.asarray(layer.hi)[at])
    for m in BASE64.finditer(text):
        lo, hi = layer.span(m.start(), m.end())
        for _, _, _, got, _ in _from_base64(m.group(), limit):
            yield (lo, hi) if got is None else _at(_text(bytes(got))[0], lo, hi)
    for m in WRAPPED.finditer(text):
        yield from _unwrap_lines(layer, m.start(), m.end(), limit)


def _key(layer: Layer) -> tuple[int, int, bytes]:
    return *layer.span(0, len(layer.text)), hashlib.sha256(layer.text.encode("utf-8", "surrogatepass")).digest()


def scan(text: str | None, inflate_limit: int = INFLATE_LIMIT) -> tuple[list[Span], list[Span]]:
    """Base spans of the text, and the spans that only decoding shows."""
    base = base_spans(text or "")
    if not text:
        return base, []
    extra: set[Span] = set()
    work, seen = [unwrap(Layer(text), inflate_limit)], {_key(Layer(text))}
    while work:  # depth first, so that one layer of each depth is held
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
        elif isinstance(layer, tuple):
            extra.add(("oversize", *layer))
        elif layer.text and (key := _key(layer)) not in seen:
            seen.add(key)
            for kind, a, b in base_spans(layer.text):
                lo, hi = layer.span(a, b)
                if not any(k == kind and s <= lo and hi <= e for k, s, e in base):
                    extra.add((f"decoded_{kind}", lo, hi))
            work.append(unwrap(layer, inflate_limit))
    return base, list(extra)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


SCHEMA = "doc_id long, base array<struct<kind:string,start:int,end:int>>, decoded array<struct<kind:string,start:int,end:int>>, base_joined string, spans string"


def scan_documents(docs: DataFrame, inflate_limit: int = INFLATE_LIMIT) -> DataFrame:
    """Spans of each row of docs (doc_id, text; other columns are ignored)."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [scan(t, inflate_limit) for t in batch.column("text").to_pylist()]
            as_rows = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
            yield batch_of(doc_id=batch.column("doc_id"), base=pa.array([as_rows(b) for b, _ in found], kind), decoded=pa.array([as_rows(x) for _, x in found], kind), base_joined=pa.array([joined(b) for b, _ in found], pa.string()), spans=pa.array([joined(b + x) for b, x in found], pa.string()))

    return arrow_map(docs.select("doc_id", "text"), run, SCHEMA)


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns from scan_documents()."""
    from pyspark.sql import functions as F

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2("base_joined", 256).alias("base_sha256"), "spans")
