"""Bound-certified best-fit packing of token pieces into sequences.

Documents are tokenised once and cut into pieces; pieces as long as a sequence are sequences already. The others are
dealt at random into pools of bounded size, and each pool is packed by best-fit decreasing. Dual feasible functions
give each pool a lower bound on its number of sequences: a pool that meets it is certified. Pools with a gap give up
all sequences that are not full, certified pools those that are far from it (another pool may have what fits), and what
was given up is dealt out anew and packed again, until one pool is left or the rounds are used up. Nothing is dropped:
the last round keeps all.
"""

from __future__ import annotations

import re
import unicodedata
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, held, in_batches, text_or_empty
from .textkit import batches, encode, spelled_tokens

SEQUENCE = 2048
POOL = 20_000
ROUNDS = 4
#: A certified pool's sequence is given up when more than one part in SPARE of it is free.
SPARE = 64
END_ID = 0
#: Words that a worker remembers.
REMEMBERED = 2_000_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: A word's letters and the ASCII punctuation behind them, which are tokenised apart; an apostrophe is not among it.
_PARTS = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]*)\Z")


class _WordIds:
    """ids of words, remembered by the words' hashes in sorted arrays of some 40 bytes a word."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = suffix and np.array([(self.tokenizer.id_to_token(i) or "").endswith(suffix) for i in range(self.tokenizer.get_vocab_size())])
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.starts, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, "<u4")

    def texts(self, raw: list[bytes]) -> list[np.ndarray]:
        """ids of each text, its words put together."""
        hashes, first, data, starts, ends = spelled_tokens(raw)
        words, one, which = np.unique(hashes, return_index=True, return_inverse=True)
        at, counts = self._places(words, lambda k: data[starts[one[k]] : ends[one[k]]].tobytes().decode("utf-8", "surrogatepass"))
        n = counts[which]
        upto = np.concatenate([[0], np.cumsum(n)])
        flat = self.ids[np.repeat(at[which] - upto[:-1], n) + np.arange(upto[-1])]
        return np.split(flat, upto[first[1:-1]])

    def _places(self, words: np.ndarray, spelled) -> tuple[np.ndarray, np.ndarray]:
        """Where in self.ids the ids of words (sorted hashes) begin, and how many they are; new words are learnt."""
        at = np.searchsorted(self.hashes, words)
        known = np.zeros(len(words), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == words[inside]
        new = np.flatnonzero(~known)
        if len(new):
            if len(self.hashes) and len(self.hashes) + len(new) > REMEMBERED:
                self._forget()
                return self._places(words, spelled)
            coded = self.encoded([spelled(k) for k in new])
            counts = np.array([len(b) // 4 for b in coded], np.int64)
            begin = len(self.ids) + np.concatenate([[0], np.cumsum(counts)[:-1]])
            self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(coded), "<u4")])
            self.hashes = np.insert(self.hashes, at[new], words[new])
            self.starts, self.counts = np.insert(self.starts, at[new], begin), np.insert(self.counts, at[new], counts)
            at = np.searchsorted(self.hashes, words)
        return self.starts[at], self.counts[at]

    def encoded(self, words: list[str]) -> list[bytes]:
        """ids of words as little-endian unsigned 32-bit bytes; letters and the punctuation behind them apart."""
        found: dict[str, bytes] = {"": b""}
        if self.ends is None:
            self._encode(list(dict.fromkeys(words)), found)
            return [found[w] for w in words]
        whole, cores, split, match = {}, {}, [], _PARTS.match
        for w in words:
            m = match(w)
            if m and (w.isascii() or _all_letters(m[1])):
                core = m[1].lower()
                cores[core] = None
                split.append((core, m[2]))
            else:
                whole[w] = None
                split.append((w, ""))
        whole.update(dict.fromkeys(rest for _, rest in split if rest))
        apart: dict[str, bytes] = {}
        self._encode(list(cores), found, single=True)
        self._encode(list(whole), apart)
        return [(found[w] if w in cores else apart[w]) + (apart[rest] if rest else b"") for w, rest in split]

    def _encode(self, words: list, found: dict, single: bool = False) -> None:
        """single: each word is one pre-token, so many are encoded as one text and parted at the ends of words."""
        for k in range(0, len(words), 2048):
            part = words[k : k + 2048]
            if single:
                ids = np.asarray(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, dtype="<u4")
                stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
                if len(stops) == len(part):
                    data, start = ids.tobytes(), 0
                    for w, stop in zip(part, stops, strict=True):
                        found[w] = data[start:stop]
                        start = stop
                    continue
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                found[w] = np.asarray(e.ids, dtype="<u4").tobytes()


def _all_letters(word: str) -> bool:
    """Whether the word stays letters when it is normalised and lower-cased."""
    return word.isalpha() and "Σ" not in word and unicodedata.normalize("NFC", word).lower().isalpha()


def _worker_ids(path: str) -> _WordIds:
    """The words that this worker process has met so far, kept from task to task."""
    return held(f"words of {path}", lambda: _WordIds(path))


def _splits_on_space(path: str) -> bool:
    """Whether the tokenizer drops white space, so that words can be encoded one by one."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    probe = "it's a1b2 don't  x\n\ty 'll Été, 3.5%"
    return t.encode(probe, add_special_tokens=False).ids == [i for w in probe.split() for i in t.encode(w, add_special_tokens=False).ids]


def token_pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """row, doc_id, piece, start, length, ids_crc32: each document's ids and end_id, cut at `sequence` ids.

    A null or empty text has the end id alone. Null ids and repeated ids are kept as they come; row tells rows apart.
    """
    path = tokenizer or default_tokenizer()
    by_word = _splits_on_space(path)
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def pieces(parts):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ids = _worker_ids(path)
        for pdf in parts:
            out = []
            rows, docs_, raw = pdf["row"].tolist(), pdf["doc_id"].tolist(), [encode(t) for t in pdf["text"]]
            for lo, hi in batches(raw):
                if by_word:
                    coded = ids.texts(raw[lo:hi])
                else:
                    coded = [e.ids for e in ids.tokenizer.encode_batch_fast(pdf["text"].tolist()[lo:hi], add_special_tokens=False)]
                for row, doc, c in zip(rows[lo:hi], docs_[lo:hi], coded, strict=True):
                    b = np.asarray(c, dtype="<u4").tobytes() + end
                    for n, at in enumerate(range(0, len(b), 4 * sequence)):
                        p = b[at : at + 4 * sequence]
                        out.append((row, doc, n, at // 4, len(p) // 4, zlib.crc32(p)))
            yield pd.DataFrame(out, columns=["row", "doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    narrow = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return in_batches(narrow).mapInPandas(pieces, "row long, doc_id long, piece int, start long, length long, ids_crc32 long")


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """The most that dual feasible functions prove; counts[s] items have size s.

    Martello and Toth's threshold functions for every k up to half the capacity, and the rounding functions
    x -> floor((m + 1) x / C) / m (x where (m + 1) x / C is whole) for small m.
    """
    sizes = np.arange(len(counts))
    mass = np.concatenate([[0], np.cumsum(counts * sizes)])
    number = np.concatenate([[0], np.cumsum(counts)])
    k = np.arange(0, capacity // 2 + 1)
    big = number[-1] - number[np.minimum(capacity - k + 1, len(counts))]
    middle = mass[np.minimum(capacity - k + 1, len(counts))] - mass[np.minimum(k, len(counts))]
    best = int(np.max(big + -(-middle // capacity)))
    for m in range(1, 51):
        steps = (m + 1) * sizes
        whole = steps % capacity == 0
        value = np.where(whole, sizes * m, (steps // capacity) * capacity)  # in units of 1 / (m * capacity)
        best = max(best, int(-(-int((value * counts).sum()) // (m * capacity))))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """bin and offset of each size, and the number of bins. Residuals in use are bits of one integer."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    used, n = 0, 0
    for i in order.tolist():
        s = int(sizes[i])
        fits = used >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                used ^= 1 << room
        else:
            room, b = capacity, n
            n += 1
        bins[i], offsets[i] = b, capacity - room
        if left := room - s:
            open_bins[left].append(b)
            used |= 1 << left
    return bins, offsets, n


def _pack_pool(last: bool, capacity: int, round_no: int):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "row", "piece"], ascending=[False, True, True, True], ignore_index=True)
        sizes = pdf["length"].to_numpy()
        bins, offsets, n = best_fit_decreasing(sizes, capacity)
        bound = lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity)
        fill = np.bincount(bins, weights=sizes, minlength=n)
        give = np.zeros(n, bool)
        if not last:
            give = fill < (capacity if n > bound else capacity - capacity // SPARE)
            give[np.argmin(fill)] = True
        pool = int(pdf["pool"].iloc[0])
        return pdf.assign(sequence_id=(round_no + 1 << 56) + (pool << 24) + bins, offset=offsets, certified=n == bound, given=give[bins])

    return pack


def pack(pieces: DataFrame, *, sequence: int = SEQUENCE, pool: int = POOL, rounds: int = ROUNDS) -> DataFrame:
    """pieces with sequence_id, offset and certified (whether the pool that placed the piece met its lower bound)."""
    full = pieces.filter(F.col("length") == sequence)
    full = full.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    done = [full.withColumn("certified", F.lit(True))]
    schema = "row long, doc_id long, piece int, start long, length long, ids_crc32 long, pool long, sequence_id long, offset long, certified boolean, given boolean"
    rest = pieces.filter(F.col("length") < sequence)
    for k in range(rounds):
        n_pools = max(1, -(-rest.count() // pool))
        last = n_pools == 1 or k == rounds - 1
        dealt = rest.withColumn("pool", F.pmod(F.xxhash64(F.lit(k), "row", "piece"), F.lit(n_pools)))
        packed = cut(dealt.groupBy("pool").applyInPandas(_pack_pool(last, sequence, k), schema)).drop("pool")
        done.append(packed.filter("NOT given").drop("given"))
        if last:
            break
        rest = packed.filter("given").drop("given", "sequence_id", "offset", "certified")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def pack_documents(docs: DataFrame, **how) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, certified for all pieces of all documents."""
    sequence = how.get("sequence", SEQUENCE)
    cutting = {k: how[k] for k in ("id_col", "text_col", "tokenizer", "end_id") if k in how}
    packing = {k: how[k] for k in ("pool", "rounds") if k in how}
    return pack(cut(token_pieces(docs, sequence=sequence, **cutting)), sequence=sequence, **packing).drop("row")
