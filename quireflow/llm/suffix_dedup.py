"""Removal of long strings that occur more than once, by a distributed merge sort of suffixes.

Every byte that a repeated string of `length` bytes covers goes. Positions are not all sorted. In each window of
`length` start positions' worth of text an anchor is chosen by content (the smallest hash of 16 bytes among the first
half, rightmost where there are ties), so equal strings have their anchors in equal places; each start position
belongs to one anchor, a contiguous range of them to each.

1. Anchors whose next `length` / 2 bytes occur nowhere else are out; all their starts are unique.
2. Anchors whose whole range of strings occurs elsewhere, anchor in the same place, are in with all their starts.
3. The others, and one of each class found in 2, are sorted twice: by what follows the anchor, then what precedes it,
   and the other way round. Tasks sort runs of suffixes and exchange them front-coded, each suffix without the prefix
   it shares with the one before; loser trees merge the runs and compare on from the prefix already known to be
   shared. Neighbours in the two orders show how far the longest match reaches to either side, which bounds the
   starts in question, and which starts are certainly repeated.
4. Starts between the bounds that no neighbour decides are compared one by one, by hashes of their strings.

A suffix begins with the hash of its half string, so a task's share of the sort is a range of hashes; the share of a
half string that very many documents hold is cut at sampled suffixes with their places. A text is known by its hash
throughout, whichever task has read it: exact copies are one text, and a table that is read twice need not be split
alike.

Beside the bytes, each row tells whether it holds a passage of more than 50 words that another text holds too, however
few bytes that has. The same way serves, with words in place of bytes: anchors chosen by content, whole ranges first,
single passages where those do not decide.
"""

from __future__ import annotations

import bisect
import hashlib
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh_dir, in_batches, text_or_empty
from .textkit import batches, encode, mix, tokens

LENGTH = 400
GRAM = 16
#: Words of a passage, and of the part of it by which passages are found.
PASSAGE, PART = 51, 12
#: Suffixes in a task's share of the sort, and suffixes sampled for each cut through a half string that fills several.
SHARE, SAMPLED = 20_000, 16
RUN = 20_000
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2**64."""
    if which not in _tables or len(_tables[which][0]) < n:
        size = max(n, 1 << 21)
        up, down = np.full(size, _BASES[which]), np.full(size, np.uint64(pow(int(_BASES[which]), -1, 1 << 64)))
        up[0] = down[0] = 1
        _tables[which] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _tables[which][0][:n], _tables[which][1][:n]


class _Strings:
    """Hashes of any substrings of some bytes, or of any runs of some word hashes.

    The second hash is over mixed grams of 8 bytes, so regular texts on which a polynomial of single bytes fails do not
    fail both; it takes strings of 8 bytes and more.
    """

    def __init__(self, data: np.ndarray):
        self.data = data
        self.sums: dict[int, np.ndarray] = {}

    def _values(self, which: int) -> np.ndarray:
        if which == 0 or self.data.dtype != np.uint8:
            return mix(self.data) if which else self.data.astype(np.uint64) + np.uint64(1)
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        return mix(np.ndarray(len(self.data), "<u8", padded, strides=(1,)))

    def hash(self, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
        up, down = _powers(which, len(self.data) + 1)
        if which not in self.sums:
            sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(self._values(which) * up[:-1], out=sums[1:])
            self.sums[which] = sums
        if which and self.data.dtype == np.uint8:
            ends = ends - 7
        return mix((self.sums[which][ends] - self.sums[which][starts]) * down[starts])


def _sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchors(raw: list[bytes], length: int = LENGTH) -> tuple[_Strings, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end: their strings, and of each anchor its text, place, first and last start."""
    data = np.frombuffer(b"".join(raw), np.uint8)
    strings, half = _Strings(data), length // 2
    ends = np.cumsum([len(b) for b in raw])
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return strings, none, none, none, none
    at = np.arange(len(data) - GRAM + 1)
    value = (strings.hash(at, at + GRAM) & ~np.uint64(0xFFFFFFFF)) | (np.uint64(0xFFFFFFFF) - at.astype(np.uint64))
    chosen = (np.uint64(0xFFFFFFFF) - (_sliding_least(value, half + 1) & np.uint64(0xFFFFFFFF))).astype(np.int64)
    text_of = np.repeat(np.arange(len(raw)), [len(b) for b in raw])
    starts = np.arange(len(data) - length + 1)
    starts = starts[ends[text_of[starts]] - starts >= length]
    if not len(starts):
        return strings, none, none, none, none
    text, place = text_of[starts], chosen[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(starts)) - 1
    return strings, text[lo], place[lo], starts[lo], starts[hi]


def word_anchors(raw: list[bytes], passage: int = PASSAGE) -> tuple[_Strings, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts' words laid end to end: their runs, where each text's begin, and of each anchor its text, place, first
    and last start. An anchor is the run of half a passage with the smallest hash in one passage or several, rightmost
    where there are ties."""
    words, first = tokens(raw)
    runs, half, none = _Strings(words), (passage + 1) // 2, np.zeros(0, np.int64)
    if len(words) < passage:
        return runs, first, none, none, none, none
    at = np.arange(len(words) - PART + 1)
    value = (runs.hash(at, at + PART) & ~np.uint64(0xFFFFFFFF)) | (np.uint64(0xFFFFFFFF) - at.astype(np.uint64))
    chosen = (np.uint64(0xFFFFFFFF) - (_sliding_least(value, passage - PART + 1) & np.uint64(0xFFFFFFFF))).astype(np.int64)
    starts = np.arange(len(words) - passage + 1)
    text = np.searchsorted(first, starts, "right") - 1
    inside = starts + passage <= first[text + 1]
    starts, text, place = starts[inside], text[inside], chosen[inside]
    if not len(starts):
        return runs, first, none, none, none, none
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(starts)) - 1
    return runs, first, text[lo], place[lo], starts[lo], starts[hi]


def _long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _survey(texts: DataFrame, length: int, passage: int) -> DataFrame:
    """row, doc_id, rank, key, sha256, n_bytes, n_words, and the hashes of the anchors' half strings (keys) and parts of passages (cores)."""

    def read(parts):
        for pdf in parts:
            raw = [encode(t) for t in pdf.pop("text")]
            keys, cores, n_words = [], [], []
            for lo, hi in batches(raw):
                strings, text, place, _, _ = anchors(raw[lo:hi], length)
                found = _long(strings.hash(place, place + length // 2)) if len(place) else np.zeros(0, np.int64)
                keys += np.split(found, np.searchsorted(text, np.arange(1, hi - lo)))
                runs, first, text, place, _, _ = word_anchors(raw[lo:hi], passage)
                found = _long(runs.hash(place, place + PART)) if len(place) else np.zeros(0, np.int64)
                cores += [np.unique(x) for x in np.split(found, np.searchsorted(text, np.arange(1, hi - lo)))]
                n_words += np.diff(first).tolist()
            pdf["n_bytes"], pdf["n_words"] = [len(b) for b in raw], n_words
            pdf["keys"], pdf["cores"] = keys, cores
            yield pdf.astype({"doc_id": "Int64"})

    schema = "row long, doc_id long, rank long, key binary, sha256 string, n_bytes long, n_words long, keys array<long>, cores array<long>"
    numbered = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "rank", "key", "sha256", "text")
    return in_batches(numbered).mapInPandas(read, schema)


def _of_document(text: str, wanted: list, length: int):
    """A text's bytes, its strings, and the wanted ones of its anchors with their places and starts."""
    raw = encode(text)
    strings, _, place, lo, hi = anchors([raw], length)
    i = np.array(sorted(wanted), np.int64)
    return raw, strings, i, place[i], lo[i], hi[i]


def _names(schema: str) -> list[str]:
    return [c.split(" ")[0] for c in schema.split(", ")]


_CLASS = "row long, i int, core long, e1 long, e2 long, lo long, hi long"


def _classes(candidates: DataFrame, length: int) -> DataFrame:
    """Each candidate anchor's half-string hash, and a hash pair of its whole range of strings with its place in it."""

    def read(parts):
        for pdf in parts:
            out = []
            for row, text, wanted in zip(pdf["row"], pdf["text"], pdf["wanted"], strict=True):
                _, s, i, a, lo, hi = _of_document(text, wanted, length)
                place = mix((a - lo).astype(np.uint64) * np.uint64(length) + (hi - lo).astype(np.uint64))
                pair = [_long(mix(s.hash(lo, hi + length, k) + place)) for k in (0, 1)]
                out.append(pd.DataFrame({"row": [row] * len(i), "i": i, "core": _long(s.hash(a, a + length // 2)), "e1": pair[0], "e2": pair[1], "lo": lo, "hi": hi}))
            yield pd.concat(out) if out else pd.DataFrame(columns=_names(_CLASS))

    return candidates.select("row", "text", "wanted").mapInPandas(read, _CLASS)


_CONTEXT = "row long, i int, core long, alone boolean, behind binary, before binary, at long, lo long, hi long"


def _contexts(chosen: DataFrame, length: int) -> DataFrame:
    """What follows each chosen anchor's half string and what precedes it (reversed), with 16 hash bytes of the half string.

    Both are padded to length / 2 with 0xFF, which no UTF-8 text holds, so a text's end matches nothing else.
    """
    half = length // 2

    def read(parts):
        for pdf in parts:
            out = []
            for row, text, wanted, alone in zip(pdf["row"], pdf["text"], pdf["wanted"], pdf["alone"], strict=True):
                order = np.argsort(wanted)
                raw, s, i, a, lo, hi = _of_document(text, wanted, length)
                c1, c2 = (s.hash(a, a + half, k) for k in (0, 1))
                for k, p in enumerate(a.tolist()):
                    core = struct.pack(">QQ", int(c1[k]), int(c2[k]))
                    behind = raw[p + half : p + length].ljust(half, b"\xff")
                    before = raw[max(0, p - half) : p][::-1].ljust(half, b"\xff")
                    out.append((row, i[k], int(_long(c1[k : k + 1])[0]), bool(alone[order[k]]), core + behind, before, p, lo[k], hi[k]))
                if len(out) >= 2000:
                    yield pd.DataFrame(out, columns=_names(_CONTEXT))
                    out = []
            yield pd.DataFrame(out, columns=_names(_CONTEXT))

    return chosen.mapInPandas(read, _CONTEXT)


def shared_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of two strings of one length that share `known` bytes for sure."""
    x, y = a[known:], b[known:]
    if x == y:
        return len(a)
    n = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
    return known + len(x) - (n.bit_length() + 7) // 8


#: How a suffix is headed in a run: its text's row, its place, the length of the shared prefix and that of the rest.
_HEAD = struct.Struct("<qiHH")


def front_code(run: list[tuple[bytes, int, int]]) -> bytes:
    """A sorted run: of each suffix its place, the length of the prefix shared with the one before, and the rest."""
    out, last = [], b""
    for s, row, i in run:
        h = shared_prefix(last, s) if last else 0
        out.append(_HEAD.pack(row, i, h, len(s) - h) + s[h:])
        last = s
    return b"".join(out)


def front_decode(data: bytes):
    """(suffix, row, i, shared with the one before) of a front-coded run."""
    at, last = 0, b""
    while at < len(data):
        row, i, h, n = _HEAD.unpack_from(data, at)
        at += _HEAD.size
        last = last[:h] + data[at : at + n]
        at += n
        yield last, row, i, h


class LoserTree:
    """Merges sorted runs of (suffix, row, i, shared with the one before in the run).

    Each run's head carries the length of the prefix it shares with the suffix last put out. The head with the longer
    one is the smaller, without a look at the strings; only heads with equal lengths are compared, and only beyond it.
    """

    def __init__(self, runs: list):
        self.runs = [iter(r) for r in runs]
        self.k = max(1, len(self.runs))
        self.heads: list = [next(r, None) for r in self.runs]
        self.shared = [0] * len(self.runs)
        self.losers = [-1] * self.k
        self.winner = -1
        for r in range(len(self.runs)):
            self._play(r, building=True)

    def _beats(self, a: int, b: int) -> bool:
        """Whether head a goes before head b; the loser learns what it shares with the winner."""
        x, y = self.heads[a], self.heads[b]
        if y is None:
            return True
        if x is None:
            return False
        if self.shared[a] != self.shared[b]:
            return self.shared[a] > self.shared[b]
        h = shared_prefix(x[0], y[0], self.shared[a])
        first = x[1:3] < y[1:3] if h == len(x[0]) else x[0][h] < y[0][h]
        self.shared[b if first else a] = h
        return first

    def _play(self, r: int, building: bool = False) -> None:
        node = (r + self.k) // 2
        while node:
            if building and self.losers[node] < 0:
                self.losers[node] = r
                return
            if not self._beats(r, self.losers[node]):
                r, self.losers[node] = self.losers[node], r
            node //= 2
        self.winner = r

    def __iter__(self):
        """(suffix, row, i, shared with the one before)."""
        while self.winner >= 0 and self.heads[self.winner] is not None:
            w = self.winner
            s, row, i, _ = self.heads[w]
            yield s, row, i, self.shared[w]
            self.heads[w] = next(self.runs[w], None)
            if self.heads[w] is not None:
                self.shared[w] = self.heads[w][3]
            self._play(w)


def _oriented(pdf: pd.DataFrame, kind: int):
    """(suffix, row, i): kind 0 by what follows the anchor, kind 1 by what precedes it."""
    for behind, before, row, i in zip(pdf["behind"], pdf["before"], pdf["row"], pdf["i"], strict=True):
        yield (behind + before if kind == 0 else behind[:16] + before + behind[16:]), row, i


def _runs(contexts: DataFrame, shares: int, cuts: dict[bytes, tuple[int, list[list]]]) -> DataFrame:
    """share, run, data: each task's suffixes in sorted runs, cut into shares and front-coded.

    cuts has for the first bytes of each half string that fills several shares the number of its first one and, of each
    kind, the suffixes at which another begins. Those exist; the share before also gets them as its end.
    """

    def pieces(run, kind):
        at = 0
        while at < len(run):
            head = run[at][0][:8]
            share = int.from_bytes(head, "big") * shares >> 64
            if head in cuts:
                stop = bisect.bisect_left(run, True, at, key=lambda x: x[0][:8] > head)
                number, splits = cuts[head]
                edges = [at, *(bisect.bisect_left(run, c, at, stop) for c in splits[kind]), stop]
                for k in range(len(edges) - 1):
                    piece = run[edges[k] : edges[k + 1]]
                    if k < len(splits[kind]) and edges[k + 1] < stop and run[edges[k + 1]] == splits[kind][k]:
                        piece = [*piece, run[edges[k + 1]]]
                    yield shares + number + k, piece
            else:  # up to the next such half string, or the end of the share
                stop = at
                while stop < len(run) and int.from_bytes(run[stop][0][:8], "big") * shares >> 64 == share and run[stop][0][:8] not in cuts:
                    stop += 1
                yield share, run[at:stop]
            at = stop

    def sort(parts):
        from pyspark import TaskContext

        task, n = TaskContext.get().partitionId(), 0

        def put(run, kind):
            run.sort()
            for share, piece in pieces(run, kind):
                if piece:
                    yield 2 * share + kind, (task << 24) + n, front_code(piece)

        held: tuple[list, list] = ([], [])
        for pdf in parts:
            for kind in (0, 1):
                held[kind].extend(_oriented(pdf, kind))
            if len(held[0]) >= RUN:
                for kind in (0, 1):
                    yield pd.DataFrame(list(put(held[kind], kind)), columns=["share", "run", "data"])
                    held[kind].clear()
                n += 1
        for kind in (0, 1):
            yield pd.DataFrame(list(put(held[kind], kind)), columns=["share", "run", "data"])

    return contexts.select("row", "i", "behind", "before").mapInPandas(sort, "share long, run long, data binary")


_MATCH = "row long, i int, before int, behind int, both array<int>"


def _merge_share(half: int):
    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        kind = int(pdf["share"].iloc[0]) % 2
        tree = LoserTree([front_decode(d) for d in pdf.sort_values("run")["data"]])
        out, last = [], None
        for s, row, i, h in tree:
            if last and h >= 16:  # the half strings are the same
                x, y = last[0], s
                one = min(h - 16, half)
                two = h - 16 - half if h >= 16 + half else shared_prefix(x[16 + half :], y[16 + half :])
                behind, before = (one, two) if kind == 0 else (two, one)
                for e in (last, (s, row, i)):
                    out.append((e[1], e[2], before, behind))
            last = s, row, i
        found = pd.DataFrame(out, columns=["row", "i", "before", "behind"])
        found["both"] = [[b, r] for b, r in zip(found["before"], found["behind"], strict=True)]
        return found

    return merge


def _cuts(contexts: DataFrame) -> dict[bytes, tuple[int, list[list]]]:
    """Where to cut half strings that fill more than one share; the driver gets SAMPLED suffixes for each of their shares."""
    many = contexts.groupBy("core").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SHARE)
    many = cut(many)
    cuts: dict = {}
    if many.isEmpty():
        return cuts
    sample = contexts.join(many.drop("n"), "core").select("row", "i", "behind", "before").sample(fraction=min(1.0, SAMPLED / SHARE), seed=1).toPandas()
    number = 0
    for core, n in many.orderBy("core").collect():
        head = struct.pack(">q", core)
        part = sample[[b[:8] == head for b in sample["behind"]]]
        shares, splits = -(-n // SHARE), []
        for kind in (0, 1):
            some = sorted(_oriented(part, kind))
            splits.append(sorted({some[k * len(some) // shares] for k in range(1, shares)}) if some else [])
        cuts[head] = number, splits
        number += max(map(len, splits)) + 1
    return cuts


def _sorted_matches(contexts: DataFrame, half: int) -> DataFrame:
    """row, i, before, behind (the most that any other shares on either side) and pairs (what one other shares)."""
    shares = max(1, -(-contexts.count() // SHARE))
    runs = _runs(contexts, shares, _cuts(contexts))
    pairs = runs.groupBy("share").applyInPandas(_merge_share(half), _MATCH)
    return pairs.groupBy("row", "i").agg(F.max("before").alias("before"), F.max("behind").alias("behind"), F.collect_set("both").alias("pairs"))


def _candidates(texts: DataFrame, survey: DataFrame, others: DataFrame) -> DataFrame:
    """row, text, wanted (anchors) and cores (of words) of every text that shares a half string or a part of a passage.

    The survey's rows fix their numbers; a text is found again by its hash and id.
    """
    one = cut(survey.select("row", "keys", "cores").join(others, "row", "left_anti"))

    def shared(hashes: DataFrame, name: str):
        repeated = hashes.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash")
        return hashes.join(cut(repeated), "hash").groupBy("row").agg(F.collect_set(name).alias(name))

    wanted = shared(one.select("row", F.posexplode("keys").alias("i", "hash")), "i").withColumnRenamed("i", "wanted")
    cores = shared(one.select("row", F.explode("cores").alias("hash")), "hash").withColumnRenamed("hash", "cores")
    named = wanted.join(cores, "row", "full").join(survey.select("row", "key", "rank"), "row")
    path = fresh_dir(texts.sparkSession, "candidates")
    texts.select("key", "rank", "text").join(named, ["key", "rank"]).drop("key", "rank").write.parquet(path)
    return texts.sparkSession.read.parquet(path)


def _repeated_starts(candidates: DataFrame, length: int) -> DataFrame:
    """row, starts: of each candidate the first and last starts of repeated strings, as pairs."""
    half = length // 2
    candidates = candidates.filter("wanted IS NOT NULL")
    found = cut(_classes(candidates, length))
    classes = found.groupBy("core", "e1", "e2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "i")).alias("one"))
    classes = cut(classes.select("core", "e1", "e2", "n", "one.row", "one.i"))
    whole = found.join(classes.filter("n > 1").select("core", "e1", "e2"), ["core", "e1", "e2"]).select("row", F.col("lo").alias("first"), F.col("hi").alias("last"))

    several = cut(classes.groupBy("core").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("core"))
    chosen = classes.join(several, "core").groupBy("row").agg(F.collect_list(F.struct("i", (F.col("n") == 1).alias("alone"))).alias("c"))
    chosen = candidates.select("row", "text").join(chosen.select("row", F.col("c.i").alias("wanted"), F.col("c.alone").alias("alone")), "row")
    kept = fresh_dir(candidates.sparkSession, "contexts")
    _contexts(chosen, length).write.parquet(kept)
    contexts = candidates.sparkSession.read.parquet(kept)
    matches = cut(_sorted_matches(contexts, half))
    decided = cut(_decided(contexts.select("row", "i", "core", "alone", "at", "lo", "hi").join(matches, ["row", "i"]), length))
    sure = decided.select("row", F.explode("sure").alias("s")).select("row", F.col("s")[0].alias("first"), F.col("s")[1].alias("last"))
    spans = whole.union(sure)

    open_cores = decided.filter("open").select("core").distinct()
    asked = cut(decided.join(open_cores, "core", "left_semi").filter("from_ <= to_").select("row", "i", "from_", "to_"))
    if not asked.isEmpty():
        windows = cut(_windows(contexts.join(asked, ["row", "i"]), length))
        twice = windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("w1", "w2")
        spans = spans.union(windows.join(cut(twice), ["w1", "w2"]).select("row", F.col("start").alias("first"), F.col("start").alias("last")))
    return spans.groupBy("row").agg(F.collect_set(F.array("first", "last")).alias("starts"))


def _wanted_runs(text: str, wanted: list, passage: int, by_place: bool):
    """A text's runs of words and, of its anchors with a wanted core or place, the core, place and starts."""
    runs, _, _, place, lo, hi = word_anchors([encode(text)], passage)
    core = _long(runs.hash(place, place + PART)) if len(place) else place
    mine = np.isin(place if by_place else core, np.array(wanted, np.int64))
    return runs, core[mine], place[mine], lo[mine], hi[mine]


def _holding_passages(candidates: DataFrame, passage: int) -> DataFrame:
    """row of every candidate that shares a run of `passage` words with another.

    First those that share all passages around an anchor. Of the others, passages are compared one by one with those
    around the same part, one of each kind of them; a text is decided by its first hit, so few are left.
    """
    candidates = candidates.filter("cores IS NOT NULL")

    def ranges(parts):
        for pdf in parts:
            out = []
            for row, text, wanted in zip(pdf["row"], pdf["text"], pdf["cores"], strict=True):
                runs, core, place, lo, hi = _wanted_runs(text, wanted, passage, False)
                at = mix((place - lo).astype(np.uint64) * np.uint64(passage) + (hi - lo).astype(np.uint64))
                out.append(pd.DataFrame({"row": [row] * len(core), "core": core, "e": _long(mix(runs.hash(lo, hi + passage, 1) + at)), "place": place}))
            yield pd.concat(out) if out else pd.DataFrame(columns=["row", "core", "e", "place"])

    def windows(parts):
        for pdf in parts:
            for row, text, wanted in zip(pdf["row"], pdf["text"], pdf["places"], strict=True):
                runs, _, _, lo, hi = _wanted_runs(text, wanted, passage, True)
                at = np.concatenate([np.arange(a, b + 1) for a, b in zip(lo, hi, strict=True)]) if len(lo) else lo
                w1, w2 = (np.unique(np.stack([_long(runs.hash(at, at + passage, k)) for k in (0, 1)]), axis=1)) if len(at) else (at, at)
                yield pd.DataFrame({"row": [row] * len(w1), "w1": w1, "w2": w2})

    found = cut(candidates.select("row", "text", "cores").mapInPandas(ranges, "row long, core long, e long, place long"))
    kinds = cut(found.groupBy("core", "e").agg(F.min(F.struct("row", "place")).alias("one"), F.max("row").alias("other")))
    same = kinds.filter("one.row <> other").select("core", "e")
    holding = cut(found.join(same, ["core", "e"], "left_semi").select("row").distinct())
    open_ = found.join(holding, "row", "left_anti").select("core").distinct()
    open_ = kinds.join(open_, "core", "left_semi").groupBy("core").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("core")
    places = kinds.join(open_, "core", "left_semi").groupBy(F.col("one.row").alias("row")).agg(F.collect_set("one.place").alias("places"))
    single = cut(candidates.select("row", "text").join(places, "row").mapInPandas(windows, "row long, w1 long, w2 long"))
    twice = single.groupBy("w1", "w2").agg(F.min("row").alias("one"), F.max("row").alias("other")).filter("one <> other").select("w1", "w2")
    return holding.union(single.join(twice, ["w1", "w2"], "left_semi").select("row")).distinct()


def _decided(matched: DataFrame, length: int) -> DataFrame:
    """Bounds from_..to_ of the starts in question, `sure` ranges of repeated starts, and whether any start is open."""
    half = length // 2

    def decide(parts):
        for pdf in parts:
            sure, open_, first, last = [], [], [], []
            for at, lo, hi, before, behind, pairs, alone in zip(pdf["at"], pdf["lo"], pdf["hi"], pdf["before"], pdf["behind"], pdf["pairs"], pdf["alone"], strict=True):
                a, b = max(lo, at - before), min(hi, at + half + behind - length)
                ranges = sorted((max(a, at - x), min(b, at + half + y - length)) for x, y in pairs)
                ranges = [r for r in ranges if r[0] <= r[1]]
                reached = a
                for x, y in ranges:
                    if x > reached:
                        break
                    reached = max(reached, y + 1)
                sure.append([[int(x), int(y)] for x, y in ranges] if alone else [])
                open_.append(bool(alone and reached <= b))
                first.append(a)
                last.append(b)
            yield pdf[["row", "i", "core"]].assign(sure=sure, open=open_, from_=first, to_=last)

    return matched.mapInPandas(decide, "row long, i int, core long, sure array<array<long>>, open boolean, from_ long, to_ long")


def _windows(asked: DataFrame, length: int) -> DataFrame:
    """row, start and a hash pair of the string, for every start in question."""
    half = length // 2

    def read(parts):
        for pdf in parts:
            for row, at, behind, before, first, last in zip(pdf["row"], pdf["at"], pdf["behind"], pdf["before"], pdf["from_"], pdf["to_"], strict=True):
                # the half string itself is the same wherever its hashes are: its 16 hash bytes stand for it
                data = np.frombuffer(before[::-1] + behind, np.uint8)
                s, starts = _Strings(data), np.arange(first, last + 1)
                lo = starts - at + half
                hi = lo + length - half + 16
                place = mix((at - starts).astype(np.uint64))
                yield pd.DataFrame({"row": [row] * len(starts), "start": starts, **{f"w{k + 1}": _long(mix(s.hash(lo, hi, k) + place)) for k in (0, 1)}})

    return asked.select("row", "at", "behind", "before", "from_", "to_").mapInPandas(read, "row long, start long, w1 long, w2 long")


def _merged(starts: list, length: int) -> list[list[int]]:
    """Maximal runs of covered bytes, as first byte and the one behind the last."""
    merged: list[list[int]] = []
    for first, last in sorted(map(tuple, starts)):
        if merged and first <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], int(last) + length)
        else:
            merged.append([int(first), int(last) + length])
    return merged


def _without(raw: bytes, spans: list[list[int]]) -> bytes:
    left, at = [], 0
    for a, b in spans:
        left.append(raw[at:a])
        at = b
    left.append(raw[at:])
    return b"".join(left)


def find_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, passage: int = PASSAGE) -> DataFrame:
    """One row per row of docs: id_col, n_bytes, removed, left_sha256, has_passage.

    removed has the maximal runs of bytes that strings of `length` bytes cover which also start elsewhere, each as its
    first byte and the one behind its last; left_sha256 is the digest of the other bytes, put together. has_passage
    tells whether the text holds a run of at least `passage` words that another row's text has too. Texts are their
    UTF-8 bytes, null is empty; matches never cross texts. Texts shorter than `length` stay whole, and rows that repeat
    a longer text lose it entirely, also where they repeat the id or have none.
    """
    text = text_or_empty(text_col)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(text.cast("binary"), 256).alias("sha256"), text.alias("text"))
    texts = texts.withColumn("key", F.unhex(F.substring("sha256", 1, 32))).withColumn("rank", F.coalesce("doc_id", F.lit(-(1 << 63))))
    survey = cut(_survey(texts, length, passage))
    copied = survey.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("rank", "row")).alias("one")).filter("copies > 1")
    copied = cut(copied.select("key", "one.row"))
    copies = cut(survey.select("key", "row").join(copied.select("key", F.col("row").alias("first")), "key").select("row", "first"))
    candidates = _candidates(texts, survey, copies.filter("row <> first").select("row"))

    def rest(parts):
        for pdf in parts:
            out = []
            for row, t, starts in zip(pdf["row"], pdf["text"], pdf["starts"], strict=True):
                spans = _merged(starts, length)
                out.append((row, spans, hashlib.sha256(_without(encode(t), spans)).hexdigest()))
            yield pd.DataFrame(out, columns=["row", "spans", "left_sha"])

    partly = candidates.select("row", "text").join(_repeated_starts(candidates, length), "row")
    partly = partly.mapInPandas(rest, "row long, spans array<array<long>>, left_sha string").withColumn("kind", F.lit("p"))
    holding = _holding_passages(candidates, passage).withColumn("kind", F.lit("w"))
    known = partly.unionByName(holding, allowMissingColumns=True).unionByName(copies.select("row", F.lit("c").alias("kind")), allowMissingColumns=True)
    known = cut(known.groupBy("row").agg(F.collect_set("kind").alias("kinds"), F.first("spans", True).alias("spans"), F.first("left_sha", True).alias("left_sha")))
    joined = survey.select("row", "doc_id", "sha256", "n_bytes", "n_words").join(known, "row", "left")
    copy = F.coalesce(F.array_contains("kinds", "c"), F.lit(False))
    whole = copy & (F.col("n_bytes") >= length)
    no_spans = F.array().cast("array<array<bigint>>")
    return joined.select(
        F.col("doc_id").alias(id_col),
        "n_bytes",
        F.when(whole, F.array(F.array(F.lit(0).cast("long"), F.col("n_bytes")))).otherwise(F.coalesce("spans", no_spans)).alias("removed"),
        F.when(whole, hashlib.sha256(b"").hexdigest()).otherwise(F.coalesce("left_sha", "sha256")).alias("left_sha256"),
        (F.coalesce(F.array_contains("kinds", "w"), F.lit(False)) | (copy & (F.col("n_words") >= passage))).alias("has_passage"),
    )


def digest(found: DataFrame) -> DataFrame:
    """found (by find_repeats) with n_removed, n_spans and kept_sha256 in place of left_sha256."""
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    rest = [c for c in found.columns if c not in ("n_bytes", "removed", "left_sha256", "has_passage")]
    return found.select(*rest, "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.col("left_sha256").alias("kept_sha256"), "removed", "has_passage")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per row of docs: id_col, n_bytes, n_removed, n_spans, kept_sha256."""
    return digest(find_repeats(docs, id_col=id_col, text_col=text_col, length=length)).drop("removed", "has_passage")
