"""Operator 7: media columns as baseline JPEG.

A payload becomes the DC coefficients of a grey baseline JPEG: one byte is one 8 x 8 block whose
quantised DC value is byte - 128 under a DC quantiser of 8, so the DC-only luminance thumbnail *is*
the payload and the storage is lossless. Frames are 64 blocks wide; a restart interval is one block
row, so that rows decode independently of each other. Payloads of more than MAX_ROWS rows take
several frames, one after another in the same stored value.

The reader parses markers of any baseline JPEG (several components, subsampling, AC coefficients,
with or without restart intervals), Huffman-decodes the scan and rebuilds the luminance thumbnail
from DC values only. All restart segments of all frames with the same tables advance in lockstep,
one numpy step for each block, instead of one Python step for each symbol.

Defined results: null and empty texts give a payload of 64 zero bytes. Equal texts (ties) give equal values in all columns but doc_id, which may be null. Rows repeat as they do
in docs. Very long texts are stored whole, in several frames, about 1 MB of text or one longest text at a time. An empty table gives an empty table. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, batch_of, slices, text_buffer

WIDTH = 64  #: blocks in a row, bytes in a unit of payload
MAX_ROWS = 8191  #: block rows in a frame: 65,528 pixels

# Huffman code lengths of DC categories 0 to 8, as suits differences of text bytes;
# the only AC symbol is end-of-block with a one-bit code.
DC_LENGTHS = {0: 5, 1: 5, 2: 4, 3: 3, 4: 2, 5: 3, 6: 6, 7: 2, 8: 7}
AC_LENGTHS = {0x00: 1}


def canonical(lengths: dict[int, int]) -> tuple[list[int], list[int], dict[int, tuple[int, int]]]:
    """BITS and HUFFVAL of a DHT segment, and symbol -> (code, length)."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    bits = [sum(1 for s in order if lengths[s] == n) for n in range(1, 17)]
    codes, code, last = {}, 0, 0
    for s in order:
        code <<= lengths[s] - last
        last = lengths[s]
        codes[s] = (code, last)
        code += 1
    return bits, order, codes


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _dht(kind: int, lengths: dict[int, int]) -> bytes:
    bits, values, _ = canonical(lengths)
    return bytes([kind << 4, *bits, *values])


_PREFIX = b"\xff\xd8" + _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + _segment(0xDB, b"\0" + bytes([8] * 64))
_SUFFIX = _segment(0xC4, _dht(0, DC_LENGTHS)) + _segment(0xC4, _dht(1, AC_LENGTHS)) + _segment(0xDD, struct.pack(">H", WIDTH)) + _segment(0xDA, b"\1\1\0\0\x3f\0")


def header(rows: int) -> bytes:
    return _PREFIX + _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, WIDTH * 8, 1) + b"\1\x11\0") + _SUFFIX


def _code_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each DC difference -255..255: the code word (DC code, extra bits, end of block) left-aligned in 16 bits, its length."""
    _, _, dc = canonical(DC_LENGTHS)
    _, _, ac = canonical(AC_LENGTHS)
    words, sizes = np.zeros(511, np.uint16), np.zeros(511, np.int64)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        extra = d if d >= 0 else d + (1 << s) - 1
        code, n = dc[s]
        word, n = (code << s) | extra, n + s
        word, n = (word << ac[0][1]) | ac[0][0], n + ac[0][1]
        words[d + 255], sizes[d + 255] = word << (16 - n), n
    return words, sizes


_WORDS, _SIZES = _code_tables()
_TAKE = np.arange(16)[None, :] < np.arange(17)[:, None]


def encode(payloads: np.ndarray, rows_of: np.ndarray) -> list[bytes]:
    """Stored values of payloads that stand one after another in uint8 `payloads`, each rows_of[i] * 64 bytes long."""
    grid = payloads.reshape(-1, WIDTH).astype(np.int16) - 128
    n_rows = len(grid)
    diff = grid.copy()
    diff[:, 1:] -= grid[:, :-1]
    at = diff.astype(np.int64) + 255
    words, sizes = np.zeros((n_rows, WIDTH + 1), ">u2"), np.zeros((n_rows, WIDTH + 1), np.int64)
    words[:, :-1], sizes[:, :-1] = _WORDS[at], _SIZES[at]
    used = sizes.sum(1)
    words[:, -1], sizes[:, -1] = 0xFFFF, -used % 8
    bits = np.unpackbits(words.view(np.uint8).reshape(-1, 2), axis=1)
    stream = np.packbits(bits[_TAKE[sizes.reshape(-1)]])
    row_bytes = (used + 7) // 8

    first_row = np.cumsum(rows_of) - rows_of
    row_doc = np.repeat(np.arange(len(rows_of)), rows_of)
    in_doc = np.arange(n_rows) - first_row[row_doc]
    in_frame = in_doc % MAX_ROWS
    is_last = (in_frame == MAX_ROWS - 1) | (in_doc == rows_of[row_doc] - 1)

    full = stream == 0xFF
    row_of = np.repeat(np.arange(n_rows), row_bytes)
    before = np.cumsum(full) - full
    out = np.zeros(len(stream) + int(full.sum()) + 2 * n_rows, np.uint8)
    out[np.arange(len(stream)) + before + 2 * row_of] = stream
    row_full = np.bincount(row_of[full], minlength=n_rows)
    row_end = np.cumsum(row_bytes + row_full + 2)
    out[row_end - 2] = 0xFF
    out[row_end - 1] = np.where(is_last, 0xD9, 0xD0 + (in_frame & 7))

    stored, cut = [], np.concatenate([[0], row_end])
    for r0, n in zip(first_row.tolist(), rows_of.tolist(), strict=True):
        parts = []
        for f in range(0, n, MAX_ROWS):
            take = min(MAX_ROWS, n - f)
            parts += [header(take), out[cut[r0 + f] : cut[r0 + f + take]].tobytes()]
        stored.append(b"".join(parts))
    return stored


@dataclass
class Frame:
    """One parsed frame: size in pixels, sampling of its components, tables, and the bytes of its scan."""

    height: int = 0
    width: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantiser
    tables: dict[tuple[int, int], bytes] = field(default_factory=dict)
    quant: dict[int, tuple[int, ...]] = field(default_factory=dict)
    scan: list[tuple[int, int, int]] = field(default_factory=list)  # id, DC table, AC table
    interval: int = 0
    start: int = 0
    end: int = 0

    def key(self) -> tuple:
        return (tuple(self.components), tuple(sorted(self.tables.items())), tuple(self.scan), self.quant[self.components[0][3]][0])


def parse(data: bytes) -> list[Frame]:
    """Frames of a stored value. Raises ValueError for what is not baseline JPEG."""
    frames, at = [], 0
    while at < len(data):
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError(f"no start of image at byte {at}")
        f, at = Frame(), at + 2
        while True:
            if data[at] != 0xFF:
                raise ValueError(f"no marker at byte {at}")
            while data[at + 1] == 0xFF:
                at += 1
            marker = data[at + 1]
            at += 2
            if marker == 0xD9:
                break
            (size,) = struct.unpack_from(">H", data, at)
            body = data[at + 2 : at + size]
            at += size
            if marker == 0xDB:
                while body:
                    wide, k = body[0] >> 4, body[0] & 15
                    f.quant[k] = struct.unpack(">64H" if wide else ">64B", body[1 : 129 if wide else 65])
                    body = body[129 if wide else 65 :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    f.tables[body[0] >> 4, body[0] & 15] = body[1 : 17 + n]
                    body = body[17 + n :]
            elif marker == 0xC0:
                bits, f.height, f.width, n = struct.unpack_from(">BHHB", body)
                if bits != 8:
                    raise ValueError(f"{bits} bits a sample")
                f.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                raise ValueError(f"frame type {marker:02x} is not baseline")
            elif marker == 0xDD:
                (f.interval,) = struct.unpack(">H", body)
            elif marker == 0xDA:
                f.scan = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
                f.start = at
                while True:
                    at = data.index(b"\xff", at)
                    if data[at + 1] == 0 or 0xD0 <= data[at + 1] <= 0xD7:
                        at += 2
                    else:
                        break
                f.end = at
        if not f.scan or len(f.scan) != len(f.components):
            raise ValueError("the scan must hold all components")
        frames.append(f)
    return frames


def _lookup(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each 16-bit window: code length (0: no code) and symbol."""
    size, symbol = np.zeros(65536, np.int64), np.zeros(65536, np.int64)
    code, at = 0, 16
    for n in range(1, 17):
        for _ in range(table[n - 1]):
            lo, hi = code << (16 - n), (code + 1) << (16 - n)
            size[lo:hi], symbol[lo:hi] = n, table[at]
            code, at = code + 1, at + 1
        code <<= 1
    return size, symbol


def _decode_group(frames: list[Frame], scans: list[bytes]) -> list[np.ndarray]:
    """Luminance DC thumbnails of frames that share tables and sampling."""
    f0 = frames[0]
    hmax, vmax = max(c[1] for c in f0.components), max(c[2] for c in f0.components)
    by_id = {c[0]: k for k, c in enumerate(f0.components)}
    alone = len(f0.components) == 1
    order = [(by_id[i], dc, ac) for i, dc, ac in f0.scan for _ in range(1 if alone else f0.components[by_id[i]][1] * f0.components[by_id[i]][2])]
    luma = [k for k, (c, _, _) in enumerate(order) if c == 0]
    lut = {k: _lookup(t) for k, t in f0.tables.items()}

    unit_w, unit_h = (8, 8) if alone else (8 * hmax, 8 * vmax)
    mcus = [-(-f.width // unit_w) * -(-f.height // unit_h) for f in frames]
    buf = np.frombuffer(b"".join(scans), np.uint8)
    begin = np.cumsum([0, *map(len, scans)])
    nxt = np.append(buf[1:], 0)
    full = buf == 0xFF
    rst = np.flatnonzero(full & (nxt >= 0xD0) & (nxt <= 0xD7))
    keep = np.ones(len(buf), bool)
    keep[np.flatnonzero(full & (nxt == 0)) + 1] = False
    keep[rst] = keep[rst + 1] = False
    clean = np.concatenate([buf[keep], np.full(8, 0xFF, np.uint8)])
    kept = np.concatenate([[0], np.cumsum(keep)])

    lane_start = np.sort(np.concatenate([begin[:-1], rst + 2]))
    lane_frame = np.searchsorted(begin, lane_start, side="right") - 1
    lane_index = np.arange(len(lane_start)) - np.searchsorted(lane_start, begin[:-1])[lane_frame]
    total, step = np.array(mcus)[lane_frame], np.array([f.interval or m for f, m in zip(frames, mcus, strict=True)])[lane_frame]
    lane_mcus = np.minimum(step, total - lane_index * step)
    if (lane_mcus < 0).any() or (np.bincount(lane_frame, lane_mcus, len(frames)) != mcus).any():
        raise ValueError("restart markers do not fit the size of the image")

    wide = clean.astype(np.uint64)
    n = len(wide) - 4
    window = (wide[:n] << np.uint64(32)) | (wide[1 : n + 1] << np.uint64(24)) | (wide[2 : n + 2] << np.uint64(16)) | (wide[3 : n + 3] << np.uint64(8)) | wide[4 : n + 4]
    window = window.view(np.int64)

    by_length = np.argsort(-lane_mcus, kind="stable")
    bit = kept[lane_start][by_length] * 8
    left = lane_mcus[by_length]
    pred = np.zeros((len(f0.components), len(bit)), np.int64)
    out = np.zeros((len(bit), int(left[0]) if len(left) else 0, len(luma)), np.int64)

    def take(pos: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        bits27 = (window[np.minimum(pos >> 3, n - 1)] >> (13 - (pos & 7))) & 0x7FFFFFF
        size, symbol = table[0][bits27 >> 11], table[1][bits27 >> 11]
        if not size.all():
            raise ValueError("no such Huffman code")
        return bits27, size, symbol

    for m in range(out.shape[1]):
        live = int(np.searchsorted(-left, -m, side="left"))  # lanes with more than m units
        for k, (c, dc, ac) in enumerate(order):
            pos = bit[:live]
            bits27, size, s = take(pos, lut[0, dc])
            extra = (bits27 >> (27 - size - s)) & ((1 << s) - 1)
            pred[c, :live] += np.where(extra < (1 << s >> 1), extra - (1 << s) + 1, extra)
            pos = pos + size + s
            if c == 0:
                out[:live, m, luma.index(k)] = pred[c, :live]
            at, coef = np.arange(live), np.ones(live, np.int64)
            while len(at):
                _, size, rs = take(pos[at], lut[1, ac])
                pos[at] += size + (rs & 15)
                coef = np.where(rs == 0, 64, coef + (rs >> 4) + 1)
                if (coef >= 64).all():
                    break
                at, coef = at[coef < 64], coef[coef < 64]
            bit[:live] = pos

    back = np.empty_like(by_length)
    back[by_length] = np.arange(len(by_length))
    thumbs, q = [], f0.quant[f0.components[0][3]][0]
    lanes_of = np.searchsorted(lane_frame, np.arange(len(frames) + 1))
    h, v = (1, 1) if alone else f0.components[0][1:3]
    for i, f in enumerate(frames):
        lanes = back[lanes_of[i] : lanes_of[i + 1]]
        counts = lane_mcus[lanes_of[i] : lanes_of[i + 1]]
        flat = out[lanes, : counts[0]].reshape(-1, len(luma)) if (counts == counts[0]).all() else np.concatenate([out[x, :c] for x, c in zip(lanes, counts, strict=True)])
        across, down = -(-f.width // unit_w), -(-f.height // unit_h)
        grid = flat.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
        need_h, need_w = -(-f.height * (v if not alone else 1) // unit_h), -(-f.width * (h if not alone else 1) // unit_w)
        thumbs.append(np.clip(np.rint(grid[:need_h, :need_w] * q / 8).astype(np.int64) + 128, 0, 255).astype(np.uint8))
    return thumbs


def thumbnails(stored: list[bytes]) -> list[list[tuple[Frame, np.ndarray]]]:
    """For each stored value its frames with their DC-only luminance thumbnails."""
    parsed = [parse(x) for x in stored]
    groups: dict[tuple, list[tuple[int, int]]] = {}
    for i, frames in enumerate(parsed):
        for k, f in enumerate(frames):
            groups.setdefault(f.key(), []).append((i, k))
    found: dict[tuple[int, int], np.ndarray] = {}
    for where in groups.values():
        fs = [parsed[i][k] for i, k in where]
        found.update(zip(where, _decode_group(fs, [stored[i][f.start : f.end] for (i, _), f in zip(where, fs, strict=True)]), strict=True))
    return [[(f, found[i, k]) for k, f in enumerate(frames)] for i, frames in enumerate(parsed)]


def average_hash(thumb: np.ndarray) -> str:
    """64 bits: which cells of an 8 x 8 reduction are brighter than their mean."""
    rows, cols = (np.arange(9) * n // 8 for n in thumb.shape)
    sums = np.zeros((thumb.shape[0] + 1, thumb.shape[1] + 1), np.int64)
    sums[1:, 1:] = thumb.astype(np.int64).cumsum(0).cumsum(1)
    lo_r, lo_c = np.minimum(rows[:-1], thumb.shape[0] - 1), np.minimum(cols[:-1], thumb.shape[1] - 1)
    hi_r, hi_c = np.maximum(rows[1:], lo_r + 1), np.maximum(cols[1:], lo_c + 1)
    area = (hi_r - lo_r)[:, None] * (hi_c - lo_c)[None, :]
    cells = (sums[np.ix_(hi_r, hi_c)] - sums[np.ix_(lo_r, hi_c)] - sums[np.ix_(hi_r, lo_c)] + sums[np.ix_(lo_r, lo_c)]) / area
    return np.packbits((cells > cells.mean()).reshape(-1)).tobytes().hex()


SCHEMA = "doc_id long, n_bytes long, media binary, frames int, width int, height int, thumb_hash string, payload binary"


def store_texts(docs: DataFrame) -> DataFrame:
    """Texts as media: doc_id, n_bytes, media (stored JPEG), frames, width, height (pixels, all frames), thumb_hash,
    payload (as read back from the stored bytes). Nulls count as empty; other columns of docs are ignored; rows repeat as they do in docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=1 << 20):
            data, offsets = text_buffer(batch.column("text"))
            size = np.diff(offsets)
            rows = np.maximum(-(-size // WIDTH), 1)
            start = np.cumsum(rows * WIDTH) - rows * WIDTH
            payload = np.zeros(int(rows.sum()) * WIDTH, np.uint8)
            payload[np.arange(len(data)) + np.repeat(start - offsets[:-1], size)] = data
            stored = encode(payload, rows)
            cols: list[list] = [[], [], [], [], []]
            for frames in thumbnails(stored):
                whole = frames[0][1] if len(frames) == 1 else np.concatenate([t for _, t in frames])
                for c, x in zip(cols, (len(frames), frames[0][0].width, sum(f.height for f, _ in frames), average_hash(whole), whole.tobytes()), strict=True):
                    c.append(x)
            yield batch_of(doc_id=batch.column("doc_id"), n_bytes=pa.array(size, pa.int64()), media=pa.array(stored, pa.binary()), frames=pa.array(cols[0], pa.int32()), width=pa.array(cols[1], pa.int32()), height=pa.array(cols[2], pa.int32()), thumb_hash=cols[3], payload=pa.array(cols[4], pa.binary()))

    return arrow_map(docs.select("doc_id", "text"), run, SCHEMA)


def digests(media: DataFrame) -> DataFrame:
    """The contract's columns from store_texts()."""
    from pyspark.sql import functions as F

    return media.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.concat_ws("x", "width", "height"), F.col("thumb_hash")).alias("feature"),
    )


def media_digest(text: str | None) -> tuple:
    """Brute-force twin of the query for one text, by the library routines alone; used by tests."""
    raw = (text or "").encode()
    payload = raw + b"\0" * ((-len(raw)) % WIDTH if raw else WIDTH)
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])
