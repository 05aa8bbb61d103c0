"""Encoding and decoding against the tokenizers library, and the segment trees against a plain search for the next merge."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from quireflow.llm import bpe, queries
from quireflow.llm.packing import default_tokenizer

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_tokenizer())


@pytest.fixture(scope="module")
def coder():
    return bpe.Coder(default_tokenizer())


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


def next_merge(symbols, ranks):
    """Merges by looking through all pairs each time."""
    symbols = list(symbols)
    while True:
        found = min(((ranks[p][0], k) for k, p in enumerate(zip(symbols, symbols[1:])) if p in ranks), default=None)
        if found is None:
            return symbols
        k = found[1]
        symbols[k : k + 2] = [ranks[symbols[k], symbols[k + 1]][1]]


def test_trees_make_the_leftmost_lowest_merge():
    letters = bpe._byte_letters()
    vocab = {c: k for k, c in enumerate(letters.values())}
    rng = random.Random(5)
    merges = []
    for _ in range(300):
        a, b = rng.choice([*"abc", *[x + y for x, y in merges]]), rng.choice([*"abc", *[x + y for x, y in merges]])
        if len(a + b) < 12 and a + b not in vocab:
            merges.append((a, b))
            vocab[a + b] = len(vocab)
    trees = bpe.SegmentTrees(vocab, merges)
    ranks = {(vocab[a], vocab[b]): (k, vocab[a + b]) for k, (a, b) in enumerate(merges)}
    words = ["".join(rng.choice("abc") for _ in range(rng.choice([1, 2, 3, 5, 8, 9, 40, 300]))).encode() for _ in range(400)]
    for word, found in zip(words, trees.words(words)):
        assert ids(found) == next_merge([vocab[letters[b]] for b in word], ranks)


TEXTS = [
    "", " ", "\n\t ", "It's DON'T x'LL a1b22, we'Ve", "<|endoftext|>Hello<|startoftext|> <|endoftext", "<|endoftext|><|endoftext|>",
    "ΣΑΣ İstanbul ² ½ Ⅷ áé _x_ __ ẞ ǅ ﬁ", "\x1c\x1d a\x85b   ​ ﻿\x00\x01 中文字 한국어 🙂👍 \U00010400", "'" * 50, "a" * 3000, "ab" * 500 + "é" * 300,
]


def test_same_as_library(library, coder):
    rng = random.Random(7)
    spans = [(32, 127), (0xA0, 0x250), (0x250, 0x3000), (0x3000, 0xD800), (0xE000, 0x20000)]
    strange = ["".join(chr(rng.randrange(*rng.choice(spans))) for _ in range(25)) for _ in range(500)]
    for text in TEXTS + strange:
        want = library.encode(text, add_special_tokens=False).ids
        found = coder.encode([text])[0]
        assert ids(found) == want
        assert coder.decode(found) == library.decode(want, skip_special_tokens=False)


def test_pieces_and_memory_do_not_matter(library, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE", 50)
    monkeypatch.setattr(bpe, "REMEMBERED", 30)
    coder = bpe.Coder(default_tokenizer())
    text = " ".join(TEXTS * 3)
    assert ids(coder.encode([text, None, text])[2]) == library.encode(text, add_special_tokens=False).ids
    assert len(coder.met) <= 30 + 2 + 60


def test_tokenizer_of_another_kind():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, coder = Tokenizer.from_file(path), bpe.Coder(path)
    for text in TEXTS:
        want = library.encode(text, add_special_tokens=False).ids
        assert ids(coder.encode([text])[0]) == want
        assert coder.decode(coder.encode([text])[0]) == library.decode(want, skip_special_tokens=False)


def test_query_same_as_library(spark, library):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").collect()
    found = {r["doc_id"]: r for r in queries.op13_bpe_coding(spark, DIR).collect()}
    assert len(found) == len(docs)
    for d in docs:
        want = library.encode(d["text"] or "", add_special_tokens=False).ids
        r = found[d["doc_id"]]
        assert r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_odd_rows(spark):
    rows = [(1, None, "x", "c"), (None, "It's here", "y", "c"), (2, "", "z", None), (2, "a b " * 400_000, "z", "c"), (2, "", "z", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens string")
    found = bpe.digest(bpe.decoded(bpe.encoded(docs))).collect()
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"]) for r in found)) == [(False, 1, 0), (False, 2, 0), (False, 2, 0), (False, 2, 800_000), (True, 0, 3)]
    assert {r["decoded_sha256"] for r in found if not r["n_tokens"]} == {hashlib.sha256(b"").hexdigest()}
    assert bpe.digest(bpe.decoded(bpe.encoded(docs.limit(0)))).count() == 0
