"""Operator 2: packing token sequences by non-negative least squares over a length histogram.

Documents become token ids (and one end id). Full windows of 4096 stand alone. The rests (1 to 4095 ids) are counted
in bins of UNIT ids; the combinations of at most DEPTH bins that fill a window are enumerated, and non-negative least
squares finds how often each is to be used so that the histogram is used up. Counts are rounded down and kept within what
there is. What remains is packed greedily: the residual rests, laid end to end, are cut to the gaps
that the planned sequences leave and then to new sequences, so that only the last sequence of a lane has padding.

The driver sees the histogram (at most 64 bins), the combinations, and counts of bins by salt (at most 64 * SALTS);
everything else is distributed. Equal lengths, however many, spread over salts. Token ids are written once to the shared
folder; the last join reads those of the rests again, also of rests that the plan has placed.

Defined results: null and empty texts are the end id alone. A very long text is as many full windows as it fills, and one rest if ids are left. Ties: which of several rests of one length
goes where is open, but each id is in one piece. Rows repeat as they do in docs, each occurrence with its own
pieces; doc_id may be null. An empty table gives no pieces. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, batch_of, durable, ranges, slices

WINDOW = 4096
UNIT = 64
DEPTH = 3
SALTS = 1024  #: parts into which the rests of one bin are ranked, at most
SALT_ROWS = 2_000  #: rests for each salt, so few tables have all
LANE_ROWS = 50_000  #: rests and gaps that one task packs
CACHED_WORDS = 400_000  #: words, and pieces of words, whose ids a task keeps
CACHED_PIECES = 300_000


#: Words of these characters need no normalising but lower case, so their pieces can be found and looked up without the library's full path.
PLAIN = re.compile("[!-~\u00a1-\u012f\u0131-\u0148\u014a-\u017e]*")
#: Anything else in a text: other characters, white space but blanks and line ends, the start of a special token.
STRANGE = re.compile("[^ \n!-~\u00a1-\u012f\u0131-\u0148\u014a-\u017e]|<\\|")
# Fixed value: the split pattern of the vocabulary file.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class _Codes(dict):
    """word -> number; a word met first gets the next number and is noted as new."""

    def __init__(self, words: list[str]):
        super().__init__(zip(words, range(len(words)), strict=True))
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        n = self[word] = len(self)
        return n


class _Table:
    """Strings and their ids, ragged: code gives a string's number, under which start and size say where its ids are."""

    def __init__(self) -> None:
        self.code = _Codes([])
        self.flat, self.start, self.size, self.uses = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, ids: np.ndarray, size: np.ndarray) -> None:
        """Ids of the strings noted as new."""
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, ids])
        self.uses = np.concatenate([self.uses, np.zeros(len(size), np.int64)])
        self.code.new = []

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.size[numbers]
        return self.flat[ranges(self.start[numbers], size)], size

    def shrink(self) -> None:
        """Keep what was met more than once since the last time."""
        keep = np.flatnonzero(self.uses > 1)
        names = list(self.code)
        self.code = _Codes([names[k] for k in keep.tolist()])
        self.flat, self.size = self.of(keep)
        self.start, self.uses = np.cumsum(self.size) - self.size, np.zeros(len(keep), np.int64)


def _drops_space(spec: dict) -> bool:
    """Whether a tokenizer file removes white space before pieces are made: by splitting on it, or by a pattern that keeps matches, none of which holds any."""
    found = spec.get("pre_tokenizer") or {}
    for x in found.get("pretokenizers") or [found]:
        if x.get("type") in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer"):
            return True
        if x.get("type") == "Split" and x.get("behavior") == "Removed" and x.get("invert") and (pattern := (x.get("pattern") or {}).get("Regex")):
            split = regex.compile(pattern)
            return not any(split.search(c) or split.search("a" + c) and len(split.search("a" + c).group()) > 1 or split.search(c + "a") and c in split.search(c + "a").group() for c in " \t\n\r\u00a0\u2003")
    return False


class WordTokenizer:
    """A tokenizer of the `tokenizers` library with tables of words and pieces met before.

    Words between blanks and line ends are cut on their own, which is exact where no piece crosses white space; a file for which that is not known is refused. If the file splits as PIECE
    says and lower-cases, plain words are cut to pieces here and only new pieces meet the model; all other words take the library's path.
    When a table is full, the words met only once since the last time are dropped."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.inner = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if not _drops_space(spec):
            raise ValueError(f"{path}: pieces may cross white space, so words cannot be cut one by one")
        steps = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.pieces_apply = steps == ["NFC", "Replace", "Lowercase"] and (first.get("pattern") or {}).get("Regex") == PIECE.pattern
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec.get("added_tokens") or []) or "(?!)")
        self.letters = _byte_letters()
        # The model alone, on pieces between line ends; a token that ends a piece is known by the suffix.
        self.bare = Tokenizer(self.inner.model)
        self.bare.pre_tokenizer = pre_tokenizers.Split("\n", "removed")
        suffix = spec["model"].get("end_of_word_suffix")
        vocabulary = self.inner.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[n for t, n in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self.clear()

    def clear(self) -> None:
        self.pieces, self.words = _Table(), _Table()

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new pieces, one after another, and their numbers."""
        letters = [p if p.isascii() else "".join(map(self.letters.__getitem__, p.encode())) for p in pieces]
        ids = np.array(self.bare.encode_batch_fast(["\n".join(letters)], add_special_tokens=False)[0].ids, np.uint32)
        size = np.diff(np.flatnonzero(np.append(True, self.ends[ids])))
        if len(size) != len(pieces):  # no such suffix
            found = [[t.id for t in self.inner.model.tokenize(x)] for x in letters]
            ids, size = np.array(list(itertools.chain.from_iterable(found)), np.uint32), np.array(list(map(len, found)), np.int64)
        return ids, size

    def _words(self, words: list[str], simple: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new words, one after another, and their numbers; simple: all are plain and lower-cased already."""
        if len(self.pieces.code) > CACHED_PIECES:
            self.pieces = _Table()
        code, cut, plain = self.pieces.code, PIECE.findall, PLAIN.fullmatch
        used: list[int] = []
        many: list[int] = []
        late = []
        for k, w in enumerate(words):
            if simple or (self.pieces_apply and plain(w) and not ("<" in w and self.special.search(w))):
                low = w if simple else w.lower()
                if low.isalpha():
                    used.append(code[low])
                    many.append(1)
                elif low[-1:] in ",.!?;:" and low[:-1].isalpha():
                    used += (code[low[:-1]], code[low[-1]])
                    many.append(2)
                else:
                    own = cut(low)
                    used += map(code.__getitem__, own)
                    many.append(len(own))
            else:
                late.append(k)
                many.append(0)
        if code.new:
            self.pieces.add(*self._pieces(code.new))
        ids, size = self.pieces.of(np.array(used, np.int64))
        total = np.concatenate([[0], np.cumsum(size)])
        ends = np.cumsum(many)
        size = total[ends] - total[ends - many]
        if late:
            own = [e.ids for e in self.inner.encode_batch([words[k] for k in late], add_special_tokens=False)]
            parts = np.split(ids, np.cumsum(size)[np.array(late)])
            size[late] = list(map(len, own))
            ids = np.concatenate([x for p, o in zip(parts, own, strict=False) for x in (p, np.array(o, np.uint32))] + [parts[-1]])
        return ids, size

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the number of ids of each."""
        words, counts, simple = [], [], self.pieces_apply
        for t in texts:
            if self.pieces_apply and not STRANGE.search(t):
                t = t.lower()  # noqa: PLW2901  the same words at the start of sentences are met once
            else:
                simple = False
            own = t.replace("\n", " ").split(" ")
            words += own
            counts.append(len(own))
        if len(self.words.code) > CACHED_WORDS:
            self.words.shrink()
        at = np.fromiter(map(self.words.code.__getitem__, words), np.int64, len(words))
        if self.words.code.new:
            self.words.add(*self._words(self.words.code.new, simple))
        self.words.uses += np.bincount(at, minlength=len(self.words.uses))
        ids, size = self.words.of(at)
        per_text = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)] if texts else np.zeros(1, np.int64)
        return ids, np.diff(per_text)


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One for each worker process and path."""
    if path not in _TOKENIZERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


PIECES = "row_id long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bin int, ids binary"


def tokenise(docs: DataFrame, path: str, end_id: int, window: int = WINDOW) -> DataFrame:
    """Full windows (bin 0, no ids kept) and rests (bin 1 to window / UNIT, ids as little-endian 32-bit) of docs, as a stored table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        tok = tokenizer(path)
        for batch in slices(batches, limit=2 << 20):
            ids, counts = tok.encode([t or "" for t in batch.column("text").to_pylist()])
            cols: list[list] = [[] for _ in range(8)]
            at = 0
            for doc_id, n in zip(batch.column("doc_id").to_pylist(), counts.tolist(), strict=True):
                own = np.append(ids[at : at + n], end_id).astype("<u4")
                at += n
                for s in range(0, n + 1, window):
                    piece = own[s : s + window].tobytes()
                    size = len(piece) // 4
                    full = size == window
                    for c, x in zip(cols, (row, doc_id, s, size, zlib.crc32(piece), n + 1, 0 if full else -(-size // UNIT), None if full else piece), strict=True):
                        c.append(x)
                    row += 1
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])
        tok.clear()

    return durable(arrow_map(docs.select("doc_id", "text"), run, PIECES), "tokens")


def nnls(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-8) -> np.ndarray:
    """min |ax - b| for x >= 0, by the active-set method of Lawson and Hanson."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(6 * a.shape[0] + 10):
        w = a.T @ (b - a @ x)
        w[active] = -np.inf
        j = int(np.argmax(w))
        if w[j] <= tolerance * max(1.0, np.abs(b).max()):
            break
        active[j] = True
        while True:
            z = np.zeros_like(x)
            z[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            bad = active & (z <= 0)
            if not bad.any():
                break
            step = np.min(x[bad] / np.maximum(x[bad] - z[bad], 1e-300))
            x += step * (z - x)
            active &= x > 1e-12
            x[~active] = 0
            if not active.any():
                break
        x = z if active.any() else x
    return np.maximum(x, 0)


def combinations(bins: list[int], units: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Multisets of at most `depth` of these bins whose units sum to a window, or to one unit less."""
    return [c for n in range(1, depth + 1) for c in itertools.combinations_with_replacement(bins, n) if units - 1 <= sum(c) <= units]


def plan(histogram: dict[int, tuple[int, int]], window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """Combination -> how many sequences of it, from bin -> (rests, their ids). The counts never use more rests than there are, and leave enough ids to fill the gaps."""
    bins = sorted(b for b, (n, _) in histogram.items() if n)
    combos = combinations(bins, window // UNIT)
    if not combos:
        return []
    a = np.array([[c.count(b) for c in combos] for b in bins], float)
    have = np.array([histogram[b][0] for b in bins], float)
    mean = np.array([histogram[b][1] / histogram[b][0] for b in bins])
    weight = np.array(bins, float)[:, None]
    counts = np.floor(nnls(a * weight, have * weight[:, 0]) + 1e-9)
    left = have.copy()
    for j in np.argsort(-counts):
        if counts[j]:
            need = a[:, j] > 0
            counts[j] = min(counts[j], np.floor((left[need] / a[need, j]).min()))
            left -= counts[j] * a[:, j]
    filled = mean @ a
    while counts.any() and (have @ mean) - counts @ filled < 1.05 * (counts @ (window - filled)):
        counts = np.floor(counts * 0.97)
    return [(c, int(n)) for c, n in zip(combos, counts, strict=True) if n]


def slots(planned: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each bin: ends of runs of ranks, first sequence of each run, and its slot in the sequence."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    base = 0
    for combo, n in planned:
        for slot, b in enumerate(combo):
            runs.setdefault(b, []).append((n, base, slot))
        base += n
    return {b: (np.cumsum([n for n, _, _ in r]), np.array([s for _, s, _ in r]), np.array([k for _, _, k in r])) for b, r in runs.items()}


def fill(sizes: np.ndarray, gaps: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lay residual rests end to end over the gaps and then over new windows: for each piece its rest, start in it, length, place (gaps, then new windows), and offset in the place."""
    total = int(sizes.sum())
    fresh = max(0, -(-(total - int(gaps.sum())) // window))
    places = np.concatenate([gaps, np.full(fresh, window, np.int64)])
    r, p = np.cumsum(sizes), np.cumsum(places)
    ends = np.unique(np.concatenate([r, p[p < total]]))
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    rest, place = np.searchsorted(r, starts, side="right"), np.searchsorted(p, starts, side="right")
    return rest, starts - (r - sizes)[rest], ends - starts, place, starts - (p - places)[place]


def pack(docs: DataFrame, path: str, end_id: int, window: int = WINDOW) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row for each piece."""
    spark = docs.sparkSession
    table = tokenise(docs, path, end_id, window)
    meta = ["row_id", "doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    alone = table.where("bin = 0").select(*meta[1:], (F.col("row_id") * 4).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    rests = table.where("bin > 0").select(*meta, "bin")
    histogram = {r["bin"]: (r["n"], r["ids"]) for r in rests.groupBy("bin").agg(F.count("*").alias("n"), F.sum("length").alias("ids")).collect()}
    n_rests = sum(n for n, _ in histogram.values())
    salts = max(1, min(SALTS, n_rests // SALT_ROWS))
    planned = plan(histogram, window)

    salted = rests.withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(salts)).cast("int"))
    counts = sorted((r["bin"], r["salt"], r["n"]) for r in salted.groupBy("bin", "salt").agg(F.count("*").alias("n")).collect())
    before, offsets = {}, []
    for b, s, n in counts:
        offsets.append((b, s, before.get(b, 0)))
        before[b] = before.get(b, 0) + n
    offsets = spark.createDataFrame(offsets, "bin int, salt int, before long")
    rank = F.row_number().over(Window.partitionBy("bin", "salt").orderBy("row_id")) - 1
    ranked = salted.withColumn("rank", rank).join(F.broadcast(offsets), ["bin", "salt"]).withColumn("rank", F.col("rank") + F.col("before")).select(*meta, "bin", "rank")
    table_of = slots(planned)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, rank = batch.column("bin").to_numpy(), batch.column("rank").to_numpy()
            seq, slot = np.full(len(b), -1, np.int64), np.zeros(len(b), np.int32)
            for k, (ends, base, own) in table_of.items():
                at = np.flatnonzero((b == k) & (rank < ends[-1]))
                run = np.searchsorted(ends, rank[at], side="right")
                seq[at] = base[run] + rank[at] - np.concatenate([[0], ends[:-1]])[run]
                slot[at] = own[run]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in meta], pa.array(seq), pa.array(slot)], names=[*meta, "seq", "slot"])

    placed = durable(arrow_map(ranked, place, "row_id long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, seq long, slot int"), "placed")
    inside = placed.where("seq >= 0")
    before_it = F.coalesce(F.sum("length").over(Window.partitionBy("seq").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    fitted = inside.select(*meta[1:], (F.col("seq") * 4 + 1).alias("sequence_id"), before_it.alias("offset"))

    residual = placed.where("seq < 0")
    lanes = max(1, -(-n_rests // LANE_ROWS))
    lane = lambda c: F.pmod(F.xxhash64(c), F.lit(lanes)).cast("int").alias("lane")
    gaps = inside.groupBy("seq").agg(F.sum("length").alias("used")).where(F.col("used") < window)
    both = residual.select(lane("row_id"), F.col("row_id").alias("id"), F.col("length").alias("size"), F.lit(-1).cast("long").alias("used")).unionByName(gaps.select(lane("seq"), F.col("seq").alias("id"), (F.lit(window) - F.col("used")).alias("size"), "used"))

    def run(t: pa.Table) -> pa.Table:
        ids, size, used, own = (t[c].to_numpy() for c in ("id", "size", "used", "lane"))
        order = np.argsort(ids, kind="stable")
        a, g = order[used[order] < 0], order[used[order] >= 0]
        rest, start, length, place_at, offset = fill(size[a], size[g], window)
        old = place_at < len(g)
        seq = np.where(old, np.append(ids[g], 0)[np.minimum(place_at, len(g))] * 4 + 1, ((int(own[0]) << 32) + place_at - len(g)) * 4 + 2)
        offset = offset + np.where(old, np.append(used[g], 0)[np.minimum(place_at, len(g))], 0)
        return pa.table({"row_id": ids[a][rest], "cut": start, "length": length, "sequence_id": seq, "offset": offset})

    cuts = both.groupBy("lane").applyInArrow(run, "row_id long, cut long, length long, sequence_id long, offset long")
    with_ids = cuts.join(table.where("bin > 0").select("row_id", "doc_id", "start", "doc_tokens", "ids"), "row_id").select("doc_id", "start", "cut", "length", "doc_tokens", "sequence_id", "offset", "ids")

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut, length = batch.column("cut").to_numpy(), batch.column("length").to_numpy()
            found = [zlib.crc32(memoryview(x.as_buffer())[c * 4 : (c + n) * 4]) for x, c, n in zip(batch.column("ids"), cut.tolist(), length.tolist(), strict=True)]
            start = pa.array(batch.column("start").to_numpy() + cut)
            yield batch_of(doc_id=batch.column("doc_id"), start=start, length=batch.column("length"), ids_crc32=pa.array(found, pa.int64()), doc_tokens=batch.column("doc_tokens"), sequence_id=batch.column("sequence_id"), offset=batch.column("offset"))

    filled = arrow_map(with_ids, crc, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return alone.unionByName(fitted).unionByName(filled)
