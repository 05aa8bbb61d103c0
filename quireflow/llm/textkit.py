"""Hashes of words, shingles and n-grams of many texts at once, as numpy arrays.

Bytes of a batch of texts stand in one array. A token's 64-bit hash is its polynomial in an odd base modulo 2**64,
taken from prefix sums, so no text is walked in Python.
"""

from __future__ import annotations

import numpy as np

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Bytes handled at once; a longer text is a batch of its own.
BATCH_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    if len(_powers.get(name, ())) < n:
        steps = np.full(max(n, BATCH_BYTES + 4096), base, np.uint64)
        steps[0] = 1
        _powers[name] = np.multiply.accumulate(steps)
    return _powers[name][:n]


def encode(text: str | None, lower: bool = False) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.translate(_LOWER) if lower else raw


def batches(raw: list[bytes]):
    """(first, last) of consecutive texts that hold about BATCH_BYTES together."""
    first = size = 0
    for k, b in enumerate(raw):
        if size and size + len(b) > BATCH_BYTES:
            yield first, k
            first, size = k, 0
        size += len(b) + 1
    if first < len(raw):
        yield first, len(raw)


def _classes(split_punctuation: bool) -> np.ndarray:
    """0 for white space, 1 for what makes words, 2 for punctuation where that stands apart."""
    kinds = np.ones(256, np.uint8)
    if split_punctuation:
        kinds[:128] = 2
        for lo, hi in ((48, 58), (65, 91), (97, 123)):
            kinds[lo:hi] = 1
    kinds[list(SPACES)] = 0
    return kinds


_KINDS = {flag: _classes(flag) for flag in (False, True)}


def tokens(raw: list[bytes], split_punctuation: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens in order, and where each text's tokens begin (one more entry than texts)."""
    return spelled_tokens(raw, split_punctuation)[:2]


def spelled_tokens(raw: list[bytes], split_punctuation: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same with the bytes of all texts, and where in them each token begins and ends."""
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    kinds = _KINDS[split_punctuation][data]
    edge = np.empty(len(kinds), bool)
    edge[0] = True
    np.not_equal(kinds[1:], kinds[:-1], out=edge[1:])
    marks = np.flatnonzero(edge)
    full = kinds[marks] != 0
    starts = marks[full]
    ends = np.append(marks[1:], len(kinds))[full]
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, len(data)), out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * _power("down", _INVERSE, len(data))[starts])
    ends_of_text = np.cumsum([len(b) + 1 for b in raw])
    return hashes, np.concatenate([[0], np.searchsorted(starts, ends_of_text)]), data, starts, ends


_PLACES = mix(np.arange(1, 33, dtype=np.uint64)) | np.uint64(1)


def shingles(raw: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles, and where each text's begin.

    A text with fewer words has the whole sequence as its one shingle; a text without words has none.
    """
    words, first = tokens(raw)
    n = np.diff(first)
    texts = np.repeat(np.arange(len(raw)), n)
    total = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for j in range(k):
        total += words[j : j + len(total)] * _PLACES[j]
    whole = texts[: len(total)] == texts[k - 1 :] if len(total) else np.zeros(0, bool)
    hashes, owner = [mix(total[whole])], [texts[: len(total)][whole]]
    for t in np.flatnonzero((n > 0) & (n < k)):
        few = words[first[t] : first[t + 1]]
        hashes.append(mix(np.array([(few * _PLACES[: len(few)]).sum() + np.uint64(len(few))], np.uint64)))
        owner.append(np.array([t]))
    hashes, owner = np.concatenate(hashes), np.concatenate(owner)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    if len(hashes):
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(len(raw) + 1))


_AGAIN = mix(np.array([0x5EED], np.uint64))[0]


def ngrams(raw: list[bytes], n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each text's token 1-grams and 2-grams, in turn, and where each text's begin.

    Words and runs of punctuation are tokens of their own; a token like the one before it counts as a repeat.
    """
    words, first = tokens(raw, split_punctuation=True)
    if not len(words):
        return np.zeros(0, np.int64), first
    texts = np.repeat(np.arange(len(raw)), np.diff(first))
    same_text = np.zeros(len(words), bool)
    same_text[1:] = texts[1:] == texts[:-1]
    before = np.roll(words, 1)
    words = np.where(same_text & (words == before), _AGAIN, words)
    before = np.where(same_text, np.roll(words, 1), np.uint64(0))
    pairs = np.empty(2 * len(words), np.uint64)
    pairs[0::2] = words
    pairs[1::2] = mix(before * _PLACES[0] + words * _PLACES[1])
    return (pairs % np.uint64(n_buckets)).astype(np.int64), 2 * first
