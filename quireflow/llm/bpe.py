"""Byte-pair encoding and decoding of whole texts, merged by segment trees over the ranks of adjacent pairs.

A word's symbols stand in a row; leaf k of its segment tree holds the rank of the pair at symbol k together with k, and
each node the least of its two children, so the root is the leftmost pair of lowest rank. A merge changes three leaves
(the pair itself, the one before it, and the one whose left symbol is gone), each mended along its path to the root, and
the word is done when the root holds no rank. All new words of one length in a batch go through their trees in step, as
rows of one array. Words met before come from a memory of bounded size that a worker keeps.

Texts are cut where the tokenizer cuts them: special tokens first, then, after normalisation, its words. Characters are
tested one by one against the tokenizer's own normaliser and word pattern when first met, and a text that holds one
which the rules here treat otherwise is normalised and cut by the tokenizer itself.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, in_batches, text_or_empty
from .packing import default_tokenizer

#: Words that a worker remembers, characters handled at once, and cells of one array of trees.
REMEMBERED, PIECE, CELLS = 400_000, 1 << 19, 1 << 16
_NONE = np.int64(1) << np.int64(62)
_PLACE = np.int64(32)
#: Fixed value: the word pattern that the rules of this module stand for.
KNOWN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _of_kind(kind: str) -> str:
    """The characters below 65,536 of a general category, as ranges of a character class."""
    found = [c for c in range(1 << 16) if unicodedata.category(chr(c))[0] == kind]
    edges = np.flatnonzero(np.diff(found) != 1)
    return "".join(f"\\u{found[a]:04x}-\\u{found[b]:04x}" for a, b in zip([0, *(edges + 1)], [*edges, len(found) - 1]))


#: What the pattern takes for white space.
_SPACES = "\t-\r \x85\xa0  -     　"
_LETTERS, _NUMBERS = _of_kind("L"), _of_kind("N")
#: The same pattern as plain character classes, which are faster.
_WORDS = re.compile(f"[{_LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}{_SPACES}]+")
_ASCII = re.compile(r"[a-z]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^a-z0-9\t-\r ]+")
_SPACE = re.compile(r"\s")


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte: itself where it is printable, else the next from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class SegmentTrees:
    """The merges of a vocabulary, applied to many words in step."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str = ""):
        letters = _byte_letters()
        try:
            self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int64)
            self.last = np.array([vocab[letters[b] + suffix] for b in range(256)], np.int64)
        except KeyError as e:
            raise ValueError(f"the vocabulary has no token for the byte {e}") from None
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        order = order[np.append(np.diff(keys[order]) != 0, True)] if len(order) else order  # of equal pairs the last counts
        self.keys, self.ranks = keys[order], order

    def leaf(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Rank of the pairs in the upper bits and their place below, or _NONE for pairs that do not merge."""
        if not len(self.keys):
            return np.full(np.broadcast(left, place).shape, _NONE)
        key = left << np.int64(32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at] << _PLACE | place, _NONE)

    def merged(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """symbols: words of one length as rows. Their tokens one after the other, and how many each word has."""
        n_words, n = symbols.shape
        symbols = symbols.copy()
        gone = np.zeros(symbols.shape, bool)
        if n > 1:
            leaves = 1 << (n - 1).bit_length()
            tree = np.full((n_words, 2 * leaves), _NONE)
            tree[:, leaves : leaves + n - 1] = self.leaf(symbols[:, :-1], symbols[:, 1:], np.arange(n - 1))
            level = leaves
            while level > 1:
                np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2], out=tree[:, level // 2 : level])
                level //= 2
            after = np.tile(np.arange(1, n + 1), (n_words, 1))
            before = np.tile(np.arange(-1, n), (n_words, 1))
            word = np.arange(n_words)
            while True:
                root = tree[word, 1]
                word, root = word[root < _NONE], root[root < _NONE]
                if not len(word):
                    break
                here = root & np.int64((1 << 32) - 1)
                right = after[word, here]
                behind = after[word, right]
                ahead = before[word, here]
                new = self.made[root >> _PLACE]
                symbols[word, here] = new
                gone[word, right] = True
                after[word, here] = behind
                before[word, behind] = here
                one = self.leaf(new, symbols[word, np.minimum(behind, n - 1)], here)
                one[behind == n] = _NONE
                two = self.leaf(symbols[word, np.maximum(ahead, 0)], new, ahead)
                two[ahead < 0] = _NONE
                at = np.stack([right, here, np.where(ahead < 0, right, ahead)]) + leaves
                tree[word, at[0]] = _NONE
                tree[word, at[1]] = one
                tree[word, at[2]] = two
                for _ in range(leaves.bit_length() - 1):
                    at >>= 1
                    tree[word, at] = np.minimum(tree[word, 2 * at], tree[word, 2 * at + 1])
        return symbols[~gone], n - gone.sum(axis=1)

    def words(self, raw: list[bytes]) -> list[bytes]:
        """The tokens of each word, given as its bytes (none empty), as little-endian unsigned 32-bit integers."""
        found: list[bytes] = [b""] * len(raw)
        lengths = np.array([len(w) for w in raw], np.int64)
        order = np.argsort(lengths, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
            n = int(lengths[group[0]]) if len(group) else 0
            step = max(1, CELLS // max(1, n))
            for k in range(0, len(group) if n else 0, step):
                part = group[k : k + step]
                data = np.frombuffer(b"".join([raw[w] for w in part]), np.uint8).reshape(len(part), n)
                symbols = self.inner[data]
                symbols[:, -1] = self.last[data[:, -1]]
                ids, counts = self.merged(symbols)
                tokens, end = ids.astype("<u4").tobytes(), np.cumsum(counts * 4).tolist()
                for w, start, stop in zip(part.tolist(), [0, *end], end):
                    found[w] = tokens[start:stop]
        return found


class Coder:
    """Encodes and decodes with one tokenizer file; keeps the words it has met."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError(f"{path} is not a plain BPE model")
        self.trees = SegmentTrees(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
        self.tokenizer = Tokenizer.from_file(path)
        added = spec.get("added_tokens") or []
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError(f"{path} has added tokens that take more than their own characters")
        self.added = {t["content"]: int(t["id"]) for t in added}
        self.special = re.compile("|".join(sorted(map(re.escape, self.added), key=len, reverse=True))) if added else None
        kinds = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.known = kinds == ["NFC", "Replace", "Lowercase"] and cuts[0].get("pattern") == {"Regex": KNOWN_PATTERN} and len(cuts) == 2
        self.letters = {c: b for b, c in _byte_letters().items()}
        self.tokens = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.plain, self.odd = set(map(chr, range(128))), set()
        self._forget()

    def _forget(self) -> None:
        self.met: dict = {n: np.array([n], "<u4").tobytes() for n in self.added.values()}

    @staticmethod
    def _normal(text: str) -> str:
        """NFC, then each character in lower case by itself (a capital sigma has one small form here)."""
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    @staticmethod
    def _bytes(word) -> bytes:
        return word if isinstance(word, bytes) else word.encode("utf-8", "surrogatepass")

    def _own(self, text: str) -> list[bytes]:
        """The words of text by the tokenizer's own normaliser and pattern."""
        t = self.tokenizer
        text = t.normalizer.normalize_str(text) if t.normalizer else text
        parts = [w for w, _ in t.pre_tokenizer.pre_tokenize_str(text)] if t.pre_tokenizer else [text]
        return [bytes(self.letters[c] for c in w) for w in parts if w]

    def _is_odd(self, c: str) -> bool:
        """Whether the rules here differ from the tokenizer's for a character."""
        probe = f"a{c}1{c}!{c} {c}x"
        return [w.encode("utf-8", "surrogatepass") for w in _WORDS.findall(self._normal(probe))] != self._own(probe)

    def split(self, text: str) -> list:
        """The words of a text without special tokens, as str or, where the tokenizer itself has cut it, bytes."""
        if not self.known:
            return self._own(text)
        if text.isascii():
            return _ASCII.findall(text.lower())
        chars = set(text)
        for c in chars - self.plain - self.odd:
            (self.odd if self._is_odd(c) else self.plain).add(c)
        if not chars.isdisjoint(self.odd):
            return self._own(text)
        return _WORDS.findall(self._normal(text))

    def _pieces(self, text: str):
        """text in pieces of about PIECE characters, cut at white space only, special tokens as their numbers."""
        if not self.known:
            yield from self._specials(text)
            return
        start = 0
        while len(text) - start > PIECE:
            m = _SPACE.search(text, start + PIECE)
            if not m:
                break
            yield from self._specials(text[start : m.start()])
            start = m.start()
        yield from self._specials(text[start:])

    def _specials(self, text: str):
        if self.special is None:
            yield text
            return
        start = 0
        for m in self.special.finditer(text):
            yield text[start : m.start()]
            yield self.added[m[0]]
            start = m.end()
        yield text[start:]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        found: list[list[bytes]] = [[] for _ in texts]
        waiting, size = [], 0
        for k, text in enumerate(texts):
            for piece in self._pieces(text or ""):
                waiting.append((k, [piece] if isinstance(piece, int) else self.split(piece)))
                size += 1 if isinstance(piece, int) else len(piece)
                if size > PIECE:
                    self._coded(waiting, found)
                    waiting, size = [], 0
        self._coded(waiting, found)
        return [b"".join(parts) for parts in found]

    def _coded(self, waiting: list, found: list) -> None:
        """Puts the ids of each piece's words behind what found has of its text."""
        met = self.met
        near = {x: met.get(x) for x in set().union(*[w for _, w in waiting])}  # small enough for a processor's cache
        new = [x for x, ids in near.items() if ids is None]
        if new:
            if len(met) + len(new) > REMEMBERED:
                self._forget()
            learnt = dict(zip(new, self.trees.words([self._bytes(x) for x in new])))
            near.update(learnt)
            self.met.update(learnt)
        for k, w in waiting:
            found[k].append(b"".join(map(near.__getitem__, w)))

    def decode(self, ids: bytes | None) -> str:
        """The text of ids, special tokens included; ids outside the vocabulary stand for nothing."""
        numbers = np.frombuffer(ids or b"", "<u4")
        tokens = [self.tokens[i] for i in numbers[numbers < len(self.tokens)].tolist()]
        return self.tokenizer.decoder.decode(tokens) if self.tokenizer.decoder else " ".join(tokens)


def _worker(path: str) -> Coder:
    return held(f"coder of {path}", lambda: Coder(path))


def encoded(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """doc_id, ids: the ids of each row's whole text, as little-endian unsigned 32-bit integers in one binary value.

    Row by row, without a shuffle. A null or empty text has no ids; rows that repeat and null ids are rows like others;
    other columns are left out. tokenizer is a path that every executor can read.
    """
    path = tokenizer or default_tokenizer()
    rows = in_batches(docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_worker(path).encode(b.column(1).to_pylist()), pa.binary())], ["doc_id", "ids"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary")


def decoded(coded: DataFrame, *, tokenizer: str | None = None) -> DataFrame:
    """doc_id, ids, text: what the ids of encoded() stand for; null ids stand for an empty text."""
    path = tokenizer or default_tokenizer()
    rows = in_batches(coded.select("doc_id", "ids"))

    def run(batches):
        for b in batches:
            text = pa.array([_worker(path).decode(x) for x in b.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), text], ["doc_id", "ids", "text"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary, text string")


def digest(coded: DataFrame) -> DataFrame:
    """Per document the number of ids, the SHA-256 of the ids and of the text that they decode to."""
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
