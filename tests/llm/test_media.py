import hashlib

import numpy as np
import pytest
from helpers import frame, odd_rows

from loomspan.llm import media_jpeg as m


def test_payload_survives(spark):
    rows = odd_rows(spark)
    got = m.digests(m.store_texts(frame(spark, rows))).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == sorted((str(i), *m.media_digest(t)) for i, t in rows)
    same = [r for r in got if r["doc_id"] == 1005]
    assert len(same) == 2 and len({r["media_sha256"] for r in same}) == 1
    assert m.store_texts(frame(spark, rows).limit(0)).count() == 0


def test_stored_form_is_a_jpeg_of_that_size():
    payload = np.arange(64 * 3, dtype=np.uint8)
    stored = m.encode(payload, np.array([3]))[0]
    (frame_,) = m.parse(stored)
    assert (frame_.height, frame_.width, frame_.interval) == (24, 512, 64) and stored[:2] == b"\xff\xd8" and stored[-2:] == b"\xff\xd9"
    assert m.thumbnails([stored])[0][0][1].tobytes() == payload.tobytes()


def test_every_byte_pair_and_stuffing():
    rng = np.random.default_rng(0)
    payload = np.concatenate([np.repeat(np.array([0, 255], np.uint8), 32), rng.integers(0, 256, 64 * 200, dtype=np.uint8), np.tile(np.array([0, 255], np.uint8), 64)])
    rows = np.array([1, 150, 50, 2])
    assert b"".join(t.tobytes() for f in m.thumbnails(m.encode(payload, rows)) for _, t in f) == payload.tobytes()


def test_long_payload_takes_several_frames():
    rows = m.MAX_ROWS + 5
    payload = np.random.default_rng(1).integers(97, 123, rows * 64, dtype=np.uint8)
    stored = m.encode(payload, np.array([rows]))
    (frames,) = m.thumbnails(stored)
    assert [f.height // 8 for f, _ in frames] == [m.MAX_ROWS, 5]
    assert b"".join(t.tobytes() for _, t in frames) == payload.tobytes()


# A colour image with subsampled chroma, written here bit by bit: the reader must skip AC symbols and chroma.
def colour_image(luma, interval=0):
    dc = {i: 4 for i in range(12)}
    ac = {0x00: 2, 0x01: 2, 0x21: 3, 0xF0: 4}
    _, _, dcode = m.canonical(dc)
    _, _, acode = m.canonical(ac)
    pad = "1"
    out, bits, pred = b"", "", [0, 0, 0]

    def put(code):
        return format(code[0], f"0{code[1]}b")

    def block(c, value, coefficients):
        nonlocal bits
        d = value - pred[c]
        pred[c] = value
        s = abs(d).bit_length()
        bits += put(dcode[s]) + (format(d if d > 0 else d + (1 << s) - 1, f"0{s}b") if s else "")
        for symbol in coefficients:
            bits += put(acode[symbol]) + ("1" if symbol & 15 else "")
        bits += put(acode[0])

    def flush():
        nonlocal bits, out
        bits += pad * (-len(bits) % 8)
        out += int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0") if bits else b""
        bits = ""

    h, w = luma.shape
    units = [(y, x) for y in range(0, h, 2) for x in range(0, w, 2)]
    for k, (y, x) in enumerate(units):
        if interval and k and k % interval == 0:
            flush()
            out += bytes([0xFF, 0xD0 + (k // interval - 1) % 8])
            pred = [0, 0, 0]
        for j, (dy, dx) in enumerate(((0, 0), (0, 1), (1, 0), (1, 1))):
            block(0, int(luma[y + dy, x + dx]), [[], [0x01], [0x21, 0x01], [0xF0, 0x01]][j])
        block(1, k % 7, [0x01])
        block(2, -k % 5, [])
    flush()
    seg = m._segment
    body = b"\xff\xd8" + seg(0xDB, b"\0" + bytes([16] * 64)) + seg(0xC0, (8).to_bytes(1, "big") + (h * 8).to_bytes(2, "big") + (w * 8).to_bytes(2, "big") + b"\3\1\x22\0\2\x11\0\3\x11\0")
    body += seg(0xC4, m._dht(0, dc)) + seg(0xC4, m._dht(1, ac)) + (seg(0xDD, interval.to_bytes(2, "big")) if interval else b"")
    return body + seg(0xDA, b"\3\1\0\2\0\3\0\0\x3f\0") + out + b"\xff\xd9"


@pytest.mark.parametrize("interval", [0, 1, 3])
def test_colour_image(interval):
    luma = np.random.default_rng(2).integers(-60, 60, (4, 6))
    ((_, thumb),) = m.thumbnails([colour_image(luma, interval)])[0]
    assert (thumb == np.clip(luma * 2 + 128, 0, 255)).all()


@pytest.mark.parametrize("bad", [b"", b"\xff\xd8\xff\xd9", b"GIF89a"])
def test_not_a_jpeg(bad):
    if bad == b"":
        assert m.parse(bad) == []
    else:
        with pytest.raises(ValueError):
            m.parse(bad)


def test_hash_tells_thumbnails_apart():
    a = np.tile(np.arange(64, dtype=np.uint8), (8, 1))
    assert m.average_hash(a) != m.average_hash(a[:, ::-1]) and len(m.average_hash(a[:1])) == 16
    assert hashlib.sha256(a).digest()
