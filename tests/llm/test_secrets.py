import base64
import bz2
import gzip
import hashlib
import json
import lzma
import random
import re
import urllib.parse
import zlib

from helpers import documents, frame, odd_rows

from loomspan.llm import secret_scan as s

KEY = "AKIA" + "ABCD1234EFGH5678"


def plain(text):
    """The base rules, written directly."""
    out = []
    word = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "password")
    assert re.match(word, "PassWord")
    keys = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k) for k in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
    for m in re.finditer(rf"""({keys})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m.group(2)) >= 8:
            out.append(("assign", m.start(), m.end()))
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32]
    return sorted(out, key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))


def test_base_spans(spark):
    rows = odd_rows(spark) + documents(spark)[40:] + [(1, "é token: 'abcdefgh12' SECRET = short API_KEY=\"0123456789\" paſſword=abcdefghij"), (2, f"{KEY} " + "deadbeef" * 5)]
    got = s.digests(s.scan_documents(frame(spark, rows))).collect()
    want = []
    for i, t in rows:
        p = plain(t or "")
        want.append((str(i), *[sum(k == kind for k, _, _ in p) for kind in ("assign", "access", "hex")], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in p).encode()).hexdigest()))
    assert sorted((str(r[0]), *tuple(r)[1:5]) for r in got) == sorted(want)
    assert s.scan_documents(frame(spark, rows).limit(0)).count() == 0


def found(text):
    return {(k, text[a:b]) for k, a, b in s.scan(text)[1]}


def test_nested_layers():
    secret = "password=hunter2hunter2"
    b64 = base64.b64encode(secret.encode()).decode()
    assert ("decoded_assign", b64) in found(f"see {b64} there")
    packed = base64.b64encode(gzip.compress(zlib.compress(f"x {KEY}".encode()))).decode()
    assert ("decoded_access", packed) in found(packed)
    twice = base64.b64encode(base64.b64encode(secret.encode())).decode()
    assert ("decoded_assign", twice) in found(twice)
    quoted = urllib.parse.quote(urllib.parse.quote("password = hunter2hunter2", safe=""), safe="")
    assert ("decoded_assign", quoted) in found(f"a {quoted} b")
    escaped = "".join(f"\\u{ord(c):04x}" for c in KEY)
    assert ("decoded_access", escaped) in found(f"é {escaped}")
    assert found("of%%% the%%% plain text") == set()


def test_spans_map_to_the_original():
    text = "line one\nü password%3D" + "abcdefgh" + " tail"
    ((kind, a, b),) = s.scan(text)[1]
    assert kind == "decoded_assign" and text[a:b] == "password%3Dabcdefgh"


def test_cycles_and_bombs_end():
    bomb = base64.b64encode(zlib.compress(b"a" * 1_000_000)).decode()
    assert ("oversize", bomb) in {(k, bomb[a:b]) for k, a, b in s.scan(bomb, inflate_limit=10_000)[1]}
    loop = "%25" * 50 + "41"
    assert s.scan(loop) == ([], [])


def test_wrapped_base64():
    noise = base64.b85encode(b"".join(hashlib.sha512(bytes([k])).digest() for k in range(3)))
    for pack in (gzip.compress, zlib.compress):
        wrapped = base64.encodebytes(pack(b" password=hunter2hunter2 " + noise)).decode().rstrip()
        assert wrapped.count("\n") >= 2
        for text in (wrapped, wrapped.replace("\n", "\n    "), wrapped.replace("\n", "\r\n"), wrapped.replace("\n", "\\n")):
            assert ("decoded_assign", text) in found(f"see below\n{text}\nthe end")
    lines = base64.encodebytes(b"x" * 45 + b" password=hunter2hunter2 " + b"y" * 71 + "é secret=abcdefgh".encode()).decode().rstrip().split("\n")
    assert len(lines) == 3
    text = "\n\t".join(lines)
    assert {x for x in found(f"head:\n{text}\n") if x[0] == "decoded_assign"} >= {("decoded_assign", "\n\t".join(lines[:2])), ("decoded_assign", lines[2])}
    assert found("a list\nof words\nand-more\n" * 50) == set()


def test_compressed_under_escapes():
    for pack in (gzip.compress, zlib.compress, bz2.compress, lzma.compress):
        raw = pack(b"a note: password=hunter2hunter2, and " + b"more of it " * 3)
        forms = [urllib.parse.quote(raw), urllib.parse.quote_plus(raw), "".join(f"%{c:02X}" for c in raw), "".join(f"\\x{c:02x}" for c in raw), repr(raw)[2:-1], json.dumps(raw.decode("latin-1"))[1:-1]]
        for form in forms:
            assert ("decoded_assign", form) in found(f"data={form} end"), (pack, form)
        twice = urllib.parse.quote(base64.b64encode(urllib.parse.quote(raw).encode()))
        assert {k for k, _ in found(twice)} == {"decoded_assign"}


def test_base64_at_any_alignment():
    least = base64.b64encode(b"token=abcdefgh").decode()
    assert least == least[:19] + "=" and ("decoded_assign", least) in found(f"see {least} there") and ("decoded_assign", least[:19]) in found(least[:19])
    for secret in (b"password=hunter2hunter2", gzip.compress(b"password=hunter2hunter2")):
        b64 = base64.b64encode(secret).decode().rstrip("=")
        for head in ("", "a", "ab", "abc", "/v1/img-", "x_"):
            for tail in ("", "Z", "YZ", "/end"):
                assert ("decoded_assign", head + b64 + tail) in found(f"see {head}{b64}{tail} there"), (head, tail)
    for around in (b"caf\xe9 ", bytes(range(128, 256)), b"\0" * 50):
        held = around + b" secret: abcdefgh1234 " + around
        for raw in (held, zlib.compress(held)):
            b64 = base64.b64encode(raw).decode()
            assert ("decoded_assign", b64) in found(b64)
    assert found("https://example.org/a_long/path-with/many-parts/of_words/index " * 20 + "Donaudampfschifffahrtsgesellschaft") == set()


def test_oversize_layers_are_scanned():
    inner = base64.encodebytes(gzip.compress(b"secret=inside-a-packed-layer " + bytes(range(256)) * 9)).decode()
    held = ("some words\n" * 3000 + "password=hunter2hunter2 " + "other words " * 3000 + KEY + "\n" + inner + "end of it " * 3000).encode()
    for pack in (gzip.compress, bz2.compress, lzma.compress, lambda x: zlib.compress(gzip.compress(x, 0))):
        b64 = base64.b64encode(pack(held)).decode()
        got = {k for k, a, b in s.scan(b64, inflate_limit=9_000)[1] if b64[a:b] == b64}
        assert got == {"oversize", "decoded_assign", "decoded_access"}, pack
    for at in range(8_900, 9_100, 7):
        b64 = base64.b64encode(zlib.compress(b"x" * at + b" token:abcdefgh " + b"y" * 20_000)).decode()
        assert ("decoded_assign", 0, len(b64)) in s.scan(b64, inflate_limit=9_000)[1]
    packed = gzip.compress(held)
    for limit in (9_000, 20_000):
        chunks = [bytes(c) for c in s._chunks(packed, limit)]
        assert len(chunks) > 1 and max(map(len, chunks)) <= 3 * limit and any(inner.encode() in c for c in chunks)


def _wrap(kind, raw, rnd):
    """One layer around bytes."""
    if kind == "percent":
        return "".join("%%%02X" % b for b in raw).encode()
    if kind == "escape":
        return "".join("\\x%02x" % b for b in raw).encode()
    if kind == "unicode":
        return "".join("\\u%04x" % ord(c) for c in raw.decode("latin-1")).encode()
    if kind == "base64":
        return base64.b64encode(raw)
    if kind == "lines":
        return base64.encodebytes(raw).rstrip()
    if kind == "url64":
        return base64.urlsafe_b64encode(raw)
    if kind == "wide":
        return base64.b64encode(raw.decode("latin-1").encode(rnd.choice(["utf-16-le", "utf-16-be"])))
    packed = {"gzip": gzip.compress, "zlib": zlib.compress, "bz2": bz2.compress, "xz": lzma.compress}[kind](raw)
    return base64.b64encode(packed)


def test_added_spans_are_what_was_nested():
    """Secrets under random nests of layers are found, at a span within the place where the nest was put, and nothing else is."""
    rnd = random.Random(12)
    kinds = ["percent", "escape", "unicode", "base64", "lines", "url64", "wide", "gzip", "zlib", "bz2", "xz"]
    for _ in range(150):
        secret = rnd.choice(["password=hunter2hunter2", "AKIA" + "QWERTYUIOPAS12", "0123456789abcdef" * 2])
        nest, raw = [rnd.choice(kinds) for _ in range(rnd.randint(1, 3))], ("said: " + secret + " so").encode()
        for kind in nest:
            raw = _wrap(kind, raw, rnd)
        before = "words of no note " * rnd.randint(0, 3)
        text = before + raw.decode() + " and the end."
        base, extra = s.scan(text)
        found = [x for x in extra if x[0] == "decoded_" + ("assign" if "=h" in secret else "access" if secret[0] == "A" else "hex")]
        assert found, nest
        assert all(len(before) <= a < b <= len(text) - 13 for _, a, b in found), nest
        assert not base or set(nest) & {"percent", "escape", "unicode"}
