import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from helpers import frame, odd_rows
from tokenizers import Tokenizer

from loomspan.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, got, window=4096):
    """Every document's ids lie in its pieces once, and pieces fill their sequences without gaps. Gives the share of padding."""
    plain = Tokenizer.from_file(PATH)
    want = defaultdict(list)
    for i, t in rows:
        want[i].append(np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(want) == set(pieces)
    for i, docs in want.items():
        assert sum(map(len, docs)) == sum(r["length"] for r in pieces[i])
        for r in pieces[i]:
            assert any(len(d) == r["doc_tokens"] and zlib.crc32(d[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for d in docs)
        if len(docs) == 1:
            at = 0
            for r in sorted(pieces[i], key=lambda r: r["start"]):
                assert r["start"] == at and r["length"] > 0
                at += r["length"]
    used = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
        used += at
    return 1 - used / (len(sequences) * window)


def test_pieces_are_the_documents(spark):
    rows = odd_rows(spark)
    check(rows, packing.pack(frame(spark, rows), PATH, 2).collect())


def test_little_padding_with_planned_sequences(spark):
    random.seed(3)
    rows = [(i, " ".join(random.choice(["one", "two", "three"]) for _ in range(random.choice([300, 900, 1500, 2047, 2048, 4095, 5000])))) for i in range(900)]
    assert check(rows, packing.pack(frame(spark, rows), PATH, 2).collect()) < 0.01


def test_one_length_that_fits_badly(spark):
    rows = [(i, "word " * 2100) for i in range(60)]
    assert check(rows, packing.pack(frame(spark, rows), PATH, 2).collect()) < 0.05


def test_empty_table(spark):
    assert packing.pack(frame(spark, [(1, "x")]).limit(0), PATH, 2).count() == 0


def test_tokens_equal_the_library():
    random.seed(5)
    letters = "abcXYZ  \n\t'sSdtTrReEvVlL0129!?.,<|>ſ×÷ßİıŁΣσςéÉñüǗ \u0085漢字😀ǅﬁK½²٣́"
    texts = ["".join(random.choice(letters) for _ in range(random.randrange(60))) for _ in range(5000)] + ["it's we'll I'D <|endoftext|> a<|startoftext|>b", "ΑΣ. ΑΣ", "", "<|ENDOFTEXT|> X"]
    own, plain = packing.WordTokenizer(PATH), Tokenizer.from_file(PATH)
    for _ in range(2):
        ids, counts = own.encode(texts)
        at = 0
        for e, n in zip(plain.encode_batch(texts, add_special_tokens=False), counts, strict=True):
            assert list(ids[at : at + n]) == e.ids
            at += n
        own.words.shrink()


def test_nnls_meets_its_conditions():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = rng.random((12, 20)), rng.normal(size=12)
        x = packing.nnls(a, b)
        g = a.T @ (b - a @ x)
        assert (x >= 0).all() and (g <= 1e-6).all() and np.abs(g[x > 1e-9]).max(initial=0) < 1e-6


def test_plan_uses_no_more_than_there_is():
    random.seed(1)
    for _ in range(10):
        h = {b: (n := random.randrange(1, 400), n * (b * 64 - random.randrange(64))) for b in random.sample(range(1, 65), 20)}
        used = defaultdict(int)
        for combo, n in packing.plan(h):
            assert len(combo) <= packing.DEPTH and sum(combo) <= 64
            for b in combo:
                used[b] += n
        assert all(used[b] <= h[b][0] for b in used)


def test_vocabularies_that_keep_blanks_are_refused():
    with pytest.raises(ValueError, match="white space"):
        packing.WordTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
