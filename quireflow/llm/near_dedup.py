"""Near-duplicate detection: b-bit MinHash signatures, a multi-index Hamming join, and exact confirmation.

A document is the set of its distinct 5-word shingles. Its signature has 80 symbols of 16 bits, in 16 chunks of 5. Two
signatures that differ in at most 31 symbols have a chunk with at most one error (pigeonhole), so every chunk is
entered under each choice of one symbol left out, and all pairs under that distance meet under some key; of pairs
at the similarity threshold itself, one in ten million meets under none. Two sketches sort out chance meetings inside
the join. A map of 2048 bits, one set for each shingle: its bits that differ are never more than the shingles that
differ, so it rules out no linked pair, and for a document of some hundred words it is nearly the set itself. And, for
longer ones, four bits of the smallest hash in each of 512 ranges of the hash space. What is left is confirmed on the
full sets.

Not every pair within a key is compared. Documents with equal sets are one from the start. A key's centre is
the one of its documents that meets most others under all its keys, as the original of many copies does, and each
document is first compared with the centres of its keys. Only those that are not then in the component
of a key's centre are compared with the others in that key, so a large group of copies costs a few comparisons per
document, and no link that joins two components is lost.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, held, in_batches, release, shielded, text_or_empty
from .graph import components
from .textkit import batches, encode, mix, shingles

SHINGLE = 5
#: Link where LINK[1] * intersection >= LINK[0] * union.
LINK = (75, 100)
CHUNKS, CHUNK_SYMBOLS = 16, 5
MINIMA = CHUNKS * CHUNK_SYMBOLS
#: Ranges of the sketch, bits kept of each, and the 64-bit words of one bit of all.
RANGES, RANGE_BITS = 512, 4
WORDS = RANGES // 64
#: Bits of the map of shingles.
MAP = 2048
#: Standard deviations by which the sketch of a linked pair may be off.
DEVIATIONS = 5
PAIR_BATCH = 200
SKETCH = [f"{kind}{w}" for kind in ("used", *(f"bit{k}_" for k in range(RANGE_BITS))) for w in range(WORDS)] + [f"map{w}" for w in range(MAP // 64)]

_MULTIPLIERS = (mix(np.arange(1, MINIMA + 1, dtype=np.uint64) * np.uint64(0x51ED27)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def _sketches(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each set which ranges are in use, each of RANGE_BITS bits of the smallest hash in every range, and the map.

    A set's hashes are sorted and a range is given by their leading bits, so the first of a range is its smallest.
    """
    n = len(first) - 1
    owner = np.repeat(np.arange(n), np.diff(first))
    place = owner * RANGES + (hashes >> np.uint64(64 - RANGES.bit_length() + 1)).astype(np.int64)
    new = np.ones(len(place), bool)
    new[1:] = place[1:] != place[:-1]
    bits = np.zeros((1 + RANGE_BITS, n * RANGES), np.uint8)
    bits[0, place[new]] = 1
    least = mix(hashes[new])
    for k in range(RANGE_BITS):
        bits[1 + k, place[new]] = (least >> np.uint64(k)) & np.uint64(1)
    packed = np.packbits(bits.reshape(1 + RANGE_BITS, n, RANGES), axis=2).view(np.int64)
    shingle_map = np.zeros(n * MAP, np.uint8)
    shingle_map[owner * MAP + (hashes & np.uint64(MAP - 1)).astype(np.int64)] = 1
    return np.hstack([packed.transpose(1, 0, 2).reshape(n, -1), np.packbits(shingle_map.reshape(n, MAP), axis=1).view(np.int64)])


def _minima(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of MINIMA 32-bit minima for each set; sets must not be empty."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(first) - 1, MINIMA), np.uint32)
    y = np.empty_like(x)
    for k, a in enumerate(_MULTIPLIERS):
        np.multiply(x, a, out=y)
        out[:, k] = np.minimum.reduceat(y, first[:-1])
    return mix(out.astype(np.uint64)).astype(np.uint32)


def _sets(texts: list, k: int):
    """(first text, hashes, starts) for consecutive texts."""
    raw = [encode(t, lower=True) for t in texts]
    for lo, hi in batches(raw):
        yield lo, *shingles(raw[lo:hi], k)


def signatures(docs: DataFrame, *, shingle: int = SHINGLE) -> DataFrame:
    """docs (row, doc_id, text) -> row, doc_id, n_shingles, set_a, set_b (equal for equal sets), symbols and SKETCH."""

    def sign(parts):
        held("near")
        for pdf in parts:
            for lo, h, first in _sets(pdf["text"].tolist(), shingle):
                n = np.diff(first)
                out = pdf.iloc[lo : lo + len(n)][["row", "doc_id"]].copy()
                full = np.flatnonzero(n)
                sets, symbols = np.zeros((2, len(n)), np.int64), [None] * len(n)
                sketch = _sketches(h, first)
                if len(full):
                    at = first[:-1][full]
                    minima = _minima(h, np.append(at, len(h)))
                    sets[0, full] = np.add.reduceat(h, at).view(np.int64)
                    sets[1, full] = np.add.reduceat(mix(h + np.uint64(1)), at).view(np.int64)
                    for i, s in zip(full, (minima & 0xFFFF).astype("<u2"), strict=True):
                        symbols[i] = s.tobytes()
                out["n_shingles"], out["set_a"], out["set_b"], out["symbols"] = n, sets[0], sets[1], symbols
                out = pd.concat([out, pd.DataFrame(sketch, columns=SKETCH, index=out.index)], axis=1)
                yield out.astype({"doc_id": "Int64"})

    return in_batches(docs).mapInPandas(sign, "row long, doc_id long, n_shingles long, set_a long, set_b long, symbols binary, " + ", ".join(f"{c} long" for c in SKETCH))


def index_keys(signed: DataFrame) -> DataFrame:
    """id, key: every chunk of every signature under each choice of one symbol left out."""

    def enumerate_(parts):
        for pdf in parts:
            if not len(pdf):
                continue
            s = np.frombuffer(b"".join(pdf["symbols"]), "<u2").reshape(len(pdf), CHUNKS, CHUNK_SYMBOLS).astype(np.uint64)
            keys = np.empty((len(pdf), CHUNKS, CHUNK_SYMBOLS), np.uint64)
            for out in range(CHUNK_SYMBOLS):
                packed = np.zeros((len(pdf), CHUNKS), np.uint64)
                for j in range(CHUNK_SYMBOLS):
                    if j != out:
                        packed = (packed << np.uint64(16)) | s[:, :, j]
                place = np.arange(CHUNKS, dtype=np.uint64) * np.uint64(CHUNK_SYMBOLS) + np.uint64(out + 1)
                keys[:, :, out] = mix(packed + place * np.uint64(0x9E3779B97F4A7C15))
            yield pd.DataFrame({"id": np.repeat(pdf["id"].to_numpy(), CHUNKS * CHUNK_SYMBOLS), "key": keys.reshape(-1).view(np.int64)})

    return signed.select("id", "symbols").mapInPandas(enumerate_, "id long, key long")


def _close(a: str, b: str):
    """Sizes and sketches allow the pair to be linked.

    Sets of n and m shingles that are linked differ in at most (n + m) (1 - J) / (1 + J) of them. The share of used ranges in which two sketches differ estimates 1 - J. Its deviation is that of drawing as many
    shingles as ranges are in use from the union, which at the threshold has (n + m) / (1 + J) members.
    """
    n, m = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    differ, used = [], []
    for w in range(WORDS):
        pairs = [(F.col(f"{a}.{c}{w}"), F.col(f"{b}.{c}{w}")) for c in ("used", *(f"bit{k}_" for k in range(RANGE_BITS)))]
        odd = pairs[0][0].bitwiseXOR(pairs[0][1])
        for x, y in pairs[1:]:
            odd = odd.bitwiseOR(x.bitwiseXOR(y))
        differ.append(F.bit_count(odd))
        used.append(F.bit_count(pairs[0][0].bitwiseOR(pairs[0][1])))
    differ, used = sum(differ[1:], differ[0]), sum(used[1:], used[0])
    j = LINK[0] / LINK[1]
    undrawn = F.greatest(F.lit(0.05), 1 - used * (1 + j) / (n + m))
    most = (1 - j) * used + DEVIATIONS * F.sqrt(j * (1 - j) * used * undrawn) + 2
    odd = [F.bit_count(F.col(f"{a}.map{w}").bitwiseXOR(F.col(f"{b}.map{w}"))) for w in range(MAP // 64)]
    apart = sum(odd[1:], odd[0]) * (LINK[1] + LINK[0]) <= (n + m) * (LINK[1] - LINK[0])
    return (n * LINK[1] >= m * LINK[0]) & (m * LINK[1] >= n * LINK[0]) & apart & (differ <= most)


def _confirmed(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """The pairs (a, b) that are linked on their full sets. Texts of paired documents travel, in place of larger sets."""
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    needed = texts.join(ends, "id", "left_semi")
    both = pairs.join(needed.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(needed.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")

    def linked(parts):
        held("near")
        for pdf in parts:
            for at in range(0, len(pdf), PAIR_BATCH):
                part = pdf.iloc[at : at + PAIR_BATCH]
                known, texts = {}, list(set(part["text_a"]) | set(part["text_b"]))
                for lo, h, first in _sets(texts, shingle):
                    known |= {texts[lo + k]: h[first[k] : first[k + 1]] for k in range(len(first) - 1)}
                keep = []
                for a, b in zip(part["text_a"], part["text_b"], strict=True):
                    x, y = known[a], known[b]
                    same = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(LINK[1] * same >= LINK[0] * (len(x) + len(y) - same))
                yield part[["a", "b"]][keep]

    return in_batches(both.select("a", "b", "text_a", "text_b")).mapInPandas(linked, "a long, b long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id, kept.

    A-Z are lower-cased; a text with fewer words than a shingle is one shingle, one without words (or null) is linked
    with nothing. component_id is the smallest id reachable over links. Rows that repeat an id have the same decision,
    made on all of their texts; a row without an id forms no link and is kept.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    signed = cut(signatures(rows, shingle=shingle))
    usable = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")

    # documents with equal sets are one; its smallest id stands for it
    same = usable.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"))
    many = cut(same.filter("copies > 1").drop("copies"))
    of_copy = cut(usable.join(many, ["set_a", "set_b", "n_shingles"]).filter("id <> doc_id").select("id", "doc_id", "set_a", "set_b", "n_shingles"))
    copies = of_copy.select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
    # an id that comes again with another text stays with that; sets are chosen by their numbers, then sketches are fetched once
    names = ["doc_id", "set_a", "set_b", "n_shingles"]
    chosen = usable.select("row", *names).join(of_copy.drop("id").distinct(), names, "left_anti")
    chosen = chosen.groupBy("doc_id", "set_a", "set_b").agg(F.min("row").alias("row")).select("row")
    ids = cut(usable.join(chosen, "row", "left_semi").select(F.col("doc_id").alias("id"), "n_shingles", "symbols", *SKETCH))
    sketch = ids.drop("symbols")
    release(docs.sparkSession)
    texts = rows.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), "text")

    # first the centres of all keys
    keys = index_keys(ids)
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = cut(keys.join(shared, "key"))
    release(docs.sparkSession)
    degree = shared.groupBy("id").agg(F.sum("n").alias("degree"))
    centres = shared.join(degree, "id").groupBy("key").agg(F.max(F.struct("degree", (-F.col("id")).alias("late"))).alias("c"))
    met = cut(shared.drop("n").join(centres.select("key", (-F.col("c.late")).alias("centre")), "key"))
    star = met.filter("id <> centre").select(F.least("centre", "id").alias("a"), F.greatest("centre", "id").alias("b")).distinct()
    star = star.join(sketch.alias("x"), F.col("a") == F.col("x.id")).join(sketch.alias("y"), F.col("b") == F.col("y.id"))
    star = cut(star.filter(_close("x", "y")).select("a", "b"))
    links = cut(_confirmed(star, texts, shingle))
    release(docs.sparkSession)
    found = components(links)

    # then, in keys that still hold several components, whoever is not in the centre's
    label = found.withColumnRenamed("id", "of")
    centre = met.select("key", "centre").distinct().join(label, F.col("of") == F.col("centre"), "left").select("key", F.coalesce("component", "centre").alias("main"))
    own = met.join(label, F.col("of") == F.col("id"), "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    own = own.join(centre, "key").join(sketch, "id")
    left = cut(own.filter("component <> main"))
    rest = own.join(left.select("key").distinct(), "key", "left_semi")
    x, y = left.alias("x"), rest.alias("y")
    apart = (F.col("x.component") != F.col("y.component")) & ((F.col("y.component") == F.col("y.main")) | (F.col("x.id") < F.col("y.id")))
    more = x.join(y, (F.col("x.key") == F.col("y.key")) & apart & _close("x", "y"))
    more = more.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
    more = cut(more.join(star, ["a", "b"], "left_anti"))
    release(docs.sparkSession)
    if not more.isEmpty():
        late = cut(_confirmed(more, texts, shingle))
        if not late.isEmpty():
            links = links.union(late)
            found = components(links.union(copies))
            copies = None
    if copies is not None:
        found = components(links.union(copies)) if not copies.isEmpty() else found

    out = signed.select("doc_id", "n_shingles").join(found.withColumnRenamed("id", "of"), F.col("of") == F.col("doc_id"), "left")
    out = out.withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs that are kept: of each component the document with its smallest id."""
    gone = near_duplicates(docs, **how).filter("NOT kept").select("doc_id").distinct()
    plain, restored = shielded(docs, "doc_id")
    return restored(plain.join(gone, "doc_id", "left_anti"))
