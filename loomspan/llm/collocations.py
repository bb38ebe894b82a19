"""Operator 11: phrase collocation mining through merged count-min sketches.

Phrases of two and three words, counted by language within pieces of text. Steps:

1. Sketch. A task hashes its phrases and counts them in DEPTH rows of cells; what it has seen travels packed, by ranges of cells, and the ranges of all tasks are added up. A cell never
   counts less than a phrase of it has. The number of cells follows the bytes of text, so a cell gathers about two occurrences of rare phrases.
2. What remains of a cell is one bit: LEAST or more. The bits go to all tasks. They are folded to at most 2**28 a row (32 MB each), so the broadcast is bounded whatever the
   corpus; folded bits let more phrases through, and none frequent is lost.
3. Exact counts. A second pass keeps the phrases all of whose bits are set, counts their texts (not their hashes) in the task and adds them up by shuffle; those
   under LEAST go. Single words are all counted exactly in the first pass.
4. Score of each cut by decimal arithmetic of 38 digits, lowest cut, and subsumption of pairs by the triples that hold them.
5. The first TOP of each language, from the first TOP of each of several parts of it, so no task orders a language.

Defined results: a null text is empty, a null language is `und`. Repeated rows count each time, whatever their ids; ties go by phrase. Very long texts are taken whole. Without phrases of LEAST occurrences a
language has no rows; an empty table gives an empty table. Columns other than text and lang are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, batch_of, discard, durable, mix64, ranges, slices, text_buffer
from .components import spread_join
from .wordhash import LOWER, split

if TYPE_CHECKING:
    from pyspark import Broadcast

LEAST = 10  #: occurrences of a candidate
MOST_WORDS = 3
TOP = 2000
SHARE = 50  #: a longer candidate with so many hundredths of the occurrences hides what it holds
DEPTH = 2  #: rows of the sketch
SLICE = 4 << 20
PARTS = 16  #: parts of a language whose first rows are found apart


@dataclass(frozen=True)
class Sketch:
    """Sizes of the sketch; none changes the result."""

    ranges: int = 1  #: ranges of cells in a row
    width: int = 1 << 22  #: cells of a range, which one task adds up; a power of two
    bits: int = 1 << 28  #: bits of a row that are broadcast, at most
    flush: int = 3_000_000  #: phrases whose hashes a task holds before it sends their cells
    cell_bytes: int = 6  #: bytes of text for each cell of a row

    def fold(self) -> int:
        """Neighbouring cells that share one bit of the broadcast, a power of two."""
        fold = 1
        while fold < self.width and self.ranges * self.width // fold > self.bits:
            fold *= 2
        return fold

    def step(self) -> int:
        """Bytes of the bits of a range."""
        return -(-self.width // self.fold() // 8)

    def cells(self, h: np.ndarray, row: int) -> tuple[np.ndarray, np.ndarray]:
        """Range and cell within it, in a row."""
        x = mix64(h ^ _ROW[row]) if row else h
        return (((x >> np.uint64(32)) * np.uint64(self.ranges)) >> np.uint64(32)).astype(np.int64), (x & np.uint64(self.width - 1)).astype(np.int64)


#: Bytes that end a piece, and those of words: neither blank, tab nor the end of a piece.
ENDS = np.zeros(256, bool)
ENDS[list(b".,;:!?\n\x0b\x0c\r")] = True
INSIDE = ~ENDS
INSIDE[[32, 9]] = False

_PLACE = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_ROW = [np.uint64(x) for x in (0, 0x5851F42D4C957F2D)]


class Pieces:
    """Words of some texts of one language, with their phrases."""

    def __init__(self, column: pa.Array, lang: str):
        data, offsets = text_buffer(column)
        words = split(data, offsets, INSIDE)
        self.count = len(words.hashes)
        piece = np.cumsum(ENDS[data], dtype=np.int32)[words.start] if self.count else np.empty(0, np.int32)
        self.whole = {k: (piece[: self.count - k + 1] == piece[k - 1 :]) & (words.owner[: self.count - k + 1] == words.owner[k - 1 :]) if self.count >= k else np.zeros(0, bool) for k in (2, 3)}
        self.hashes, self.seed = words.hashes, np.uint64(xxhash.xxh64_intdigest(lang.encode()))
        size = words.end - words.start
        at = ranges(words.start, size + 1)
        text = LOWER[data[np.minimum(at, len(data) - 1)]] if len(data) else np.empty(0, np.uint8)
        self.ends = np.cumsum(size + 1)
        self.starts = self.ends - size - 1
        text[self.ends - 1] = 32
        self.text = text

    def phrases(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of each phrase of k words."""
        first = np.flatnonzero(self.whole[k])
        with np.errstate(over="ignore"):
            h = self.hashes[first] * _PLACE[0] + self.seed + np.uint64(k)
            for j in range(1, k):
                h += self.hashes[first + j] * _PLACE[j]
        return first, mix64(h)

    def texts(self, first: np.ndarray, k: int) -> pa.Array:
        """The phrases of k words that begin at these words, one blank between words."""
        a = self.starts[first]
        n = self.ends[first + k - 1] - 1 - a
        return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(np.append(0, np.cumsum(n)).astype(np.int64)), pa.py_buffer(self.text[ranges(a, n)]))


def by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Pieces]]:
    for batch in slices(batches, limit=SLICE):
        lang = pc.fill_null(batch.column("lang"), "und")
        for one in pc.unique(lang).to_pylist():
            yield one, Pieces(batch.column("text").filter(pc.equal(lang, one)), one)


def _zip(x: np.ndarray) -> bytes:
    return pa.compress(x.tobytes(), codec="zstd", asbytes=True)


def _unzip(raw: bytes, count: int, kind: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, decompressed_size=count * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


SENT = "kind int, lang string, word string, n long, cell int, held int, low binary, high binary, counts binary"


def _sent(**given: object) -> pa.RecordBatch:
    n = len(next(iter(given.values())))
    kinds = {"kind": pa.int32(), "lang": pa.string(), "word": pa.string(), "n": pa.int64(), "cell": pa.int32(), "held": pa.int32(), "low": pa.binary(), "high": pa.binary(), "counts": pa.binary()}
    return batch_of(**{c: (x if isinstance(x := given.get(c), pa.Array) else pa.array(x, t) if x is not None else pa.nulls(n, t)) for c, t in kinds.items()})


def _pack(held: list[np.ndarray], sketch: Sketch) -> Iterator[pa.RecordBatch]:
    """Cells of the phrases with these hashes, a row for each range: distances between the cells in use (two planes of bytes) and the counts."""
    h, n = np.unique(np.concatenate(held), return_counts=True)
    for row in range(DEPTH):
        part, cell = sketch.cells(h, row)
        at = part * sketch.width + cell
        order = np.argsort(at)
        at, count = at[order], np.minimum(n[order], 255).astype(np.uint8)  # no less than LEAST stays no less
        used, head = np.unique(at // sketch.width, return_index=True)
        bounds = np.append(head, len(at))
        gaps = np.diff(at, prepend=0)
        gaps[head] = at[head] % sketch.width
        out: dict[str, list] = {"cell": [], "held": [], "low": [], "high": [], "counts": []}
        for r, a, b in zip(used.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            g = gaps[a:b]
            for name, x in (("cell", row * sketch.ranges + r), ("held", b - a), ("low", _zip((g & 255).astype(np.uint8))), ("high", _zip((g >> 8).astype("<u2"))), ("counts", _zip(count[a:b]))):
                out[name].append(x)
        yield _sent(kind=[1] * len(used), **out)


def _first_pass(docs: DataFrame, sketch: Sketch) -> DataFrame:
    """Single words with their counts in a task's slices (kind 0), and the sketch of its phrases (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for lang, p in by_language(batches):
            if p.count:
                found = pc.value_counts(p.texts(np.arange(p.count), 1))
                for at in range(0, len(found), 20_000):
                    some = found.slice(at, 20_000)
                    yield _sent(kind=[0] * len(some), lang=[lang] * len(some), word=some.field("values").cast(pa.string()), n=some.field("counts"))
            held += [p.phrases(k)[1] for k in (2, 3)]
            if sum(map(len, held)) >= sketch.flush:
                yield from _pack(held, sketch)
                held = []
        if any(map(len, held)):
            yield from _pack(held, sketch)

    return arrow_map(docs, run, SENT)


def _heavy(first: DataFrame, sketch: Sketch) -> Broadcast:
    """Bits of the cells with LEAST or more, for each row of the sketch. A task adds up one range; the driver gets the bits alone."""
    width, step, fold = sketch.width, sketch.step(), sketch.fold()

    def add(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, key = np.zeros(width, np.uint8), None
        for batch in tables:
            for r in batch.to_pylist():
                key = r["cell"]
                cell = np.cumsum(_unzip(r["low"], r["held"], "u1").astype(np.int64) + (_unzip(r["high"], r["held"], "<u2").astype(np.int64) << 8))
                head = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
                more = np.add.reduceat(_unzip(r["counts"], r["held"], "u1").astype(np.int64), head)
                total[cell[head]] = np.minimum(total[cell[head]] + more, LEAST)
        heavy = (total >= LEAST).reshape(-1, fold).any(axis=1)
        yield batch_of(cell=pa.array([key], pa.int32()), bits=pa.array([_zip(np.packbits(heavy, bitorder="little"))], pa.binary()))

    rows = first.where("kind = 1").select("cell", "held", "low", "high", "counts").groupBy("cell").applyInArrow(add, "cell int, bits binary")
    bits = np.zeros(DEPTH * sketch.ranges * step, np.uint8)
    for r in rows.toLocalIterator():
        bits[r["cell"] * step : (r["cell"] + 1) * step] = _unzip(r["bits"], step, "u1")
    return first.sparkSession.sparkContext.broadcast(bits)


def _second_pass(docs: DataFrame, bits: Broadcast, sketch: Sketch) -> DataFrame:
    """lang, phrase, k, a: counts of a task's slices, of the phrases all of whose bits are set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bits.value
        step, fold = sketch.step(), sketch.fold()
        for lang, p in by_language(batches):
            for k in (2, 3):
                at, h = p.phrases(k)
                for row in range(DEPTH):
                    part, cell = sketch.cells(h, row)
                    cell //= fold
                    kept = (held[(row * sketch.ranges + part) * step + (cell >> 3)] >> (cell & 7).astype(np.uint8)) & 1 == 1
                    at, h = at[kept], h[kept]
                found = pc.value_counts(p.texts(at, k))
                for i in range(0, len(found), 20_000):
                    some = found.slice(i, 20_000)
                    yield batch_of(lang=[lang] * len(some), phrase=some.field("values").cast(pa.string()), k=pa.array([k] * len(some), pa.int32()), a=some.field("counts"))

    return arrow_map(docs, run, "lang string, phrase string, k int, a long")


def _key(*columns: str) -> Column:
    """Language and phrase as one text; a phrase holds no line feed."""
    return F.concat_ws("\n", *columns)


def scores(candidates: DataFrame, words: DataFrame) -> DataFrame:
    """candidates (lang, phrase, k, a) with l, r and score of the lowest-scoring cut. Parts of a candidate are words or candidates themselves, so all their counts are there."""
    known = candidates.select(_key("lang", "phrase").alias("part"), F.col("a").alias("f")).unionByName(words.select(_key("lang", "word").alias("part"), "f"))
    word = F.split("phrase", " ")
    cut = F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")
    cuts = candidates.select("*", cut).withColumn("first", _key("lang", F.array_join(F.slice(word, F.lit(1), F.col("cut")), " "))).withColumn("rest", _key("lang", F.array_join(F.slice(word, F.col("cut") + 1, F.col("k")), " ")))
    cuts = spread_join(cuts.withColumnRenamed("first", "part"), known.withColumnRenamed("f", "l"), "part", "phrase").drop("part")
    cuts = spread_join(cuts.withColumnRenamed("rest", "part"), known.withColumnRenamed("f", "r"), "part", "phrase").drop("part")
    big = lambda c: F.col(c).cast("decimal(18,0)")
    scored = cuts.withColumn("a_", big("a")).withColumn("l_", big("l")).withColumn("r_", big("r")).withColumn("score", F.expr("(cast(1000000 as decimal(7,0)) * cast(a_ * a_ as decimal(31,0))) div (l_ * r_)"))
    least = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "k", "a", "l", "r")).alias("x"))
    return least.select("lang", "phrase", "x.k", "x.a", "x.l", "x.r", "x.score")


def subsumed(candidates: DataFrame) -> DataFrame:
    """lang, phrase, over: for each pair of words in a candidate triple the most occurrences of such a triple."""
    word = F.split("phrase", " ")
    inner = F.explode(F.array(*[F.array_join(F.slice(word, i, MOST_WORDS - 1), " ") for i in (1, 2)])).alias("phrase")
    return candidates.where(f"k = {MOST_WORDS}").select("lang", "a", inner).groupBy("lang", "phrase").agg(F.max("a").alias("over"))


def mine(docs: DataFrame, sketch: Sketch = Sketch(), top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first `top` phrases."""
    own = docs.select("lang", "text")
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sketch = replace(sketch, ranges=1 + size // sketch.cell_bytes // sketch.width)
    first = durable(_first_pass(own, sketch), "sketch")
    bits = _heavy(first, sketch)
    words = durable(first.where("kind = 0").groupBy("lang", "word").agg(F.sum("n").alias("f")), "words")
    discard(first)
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    counted = _second_pass(own, bits, sketch).groupBy("lang", "phrase", "k").agg(F.sum("a").alias("a"))
    candidates = durable(counted.where(F.col("a") >= LEAST), "candidates")
    bits.unpersist()
    kept = scores(candidates, words.where(F.col("f") >= LEAST)).join(subsumed(candidates), ["lang", "phrase"], "left").where(f"over is null or 100 * over < {SHARE} * a")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    some = kept.withColumn("part", part).withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(total) if total.count() <= 10_000 else total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""WITH t AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT doc, lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
w AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM p),
one AS (SELECT lang, unnest(w) AS phrase FROM w),
f1 AS (SELECT lang, phrase, count(*) AS f FROM one GROUP BY ALL),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f1 GROUP BY lang),
two AS (SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS phrase FROM w WHERE len(w) >= 2),
three AS (SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS phrase FROM w WHERE len(w) >= 3),
c AS (SELECT lang, phrase, 2 AS k, count(*) AS a FROM two GROUP BY ALL HAVING count(*) >= 10 UNION ALL SELECT lang, phrase, 3, count(*) FROM three GROUP BY ALL HAVING count(*) >= 10),
f AS (SELECT lang, phrase, f FROM f1 UNION ALL SELECT lang, phrase, a FROM c),
s AS (SELECT *, string_split(phrase, ' ') AS v FROM c),
cuts AS (SELECT *, 1 AS cut, v[1] AS first, array_to_string(v[2:], ' ') AS rest FROM s UNION ALL SELECT *, 2, v[1] || ' ' || v[2], v[3] FROM s WHERE k = 3),
sc AS (SELECT c.lang, c.phrase, c.k, c.a, c.cut, l.f AS l, r.f AS r, CAST(1000000::HUGEINT * c.a * c.a // (l.f::HUGEINT * r.f) AS BIGINT) AS score FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.first JOIN f r ON r.lang = c.lang AND r.phrase = c.rest),
low AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT lang, phrase, max(a) AS over FROM (SELECT lang, a, v[1] || ' ' || v[2] AS phrase FROM s WHERE k = 3 UNION ALL SELECT lang, a, v[2] || ' ' || v[3] FROM s WHERE k = 3) GROUP BY ALL),
kept AS (SELECT low.* FROM low LEFT JOIN o USING (lang, phrase) WHERE o.over IS NULL OR 100 * o.over < 50 * low.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000"""
