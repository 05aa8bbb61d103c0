"""Ranked lexical search: every document scored for every item, by sort-based accumulation.

A scan of the texts keeps each document's matches with the items' terms, so document frequencies and lengths come from
the same scan. Each task then joins the matches of a stretch of documents with the items that hold the term, lays the
(item, document, impact) entries one after the other, sorts them by a packed key with a radix sort of 16-bit digits,
adds equal keys up in one pass and keeps each item's best documents in a heap. The tasks' candidates, at most k for an
item and task, are range-partitioned by item and score, thinned there and ranked at the end.

Items go in blocks of bounded size, so what a task knows of them does not grow with their table; each block is a scan of
its own. A block has at least one item, whose terms a row holds anyway.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from heapq import heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_dir, in_batches, text_or_empty

#: Documents kept for an item, and bytes of items' texts in a block.
BEST, BLOCK_BYTES = 50, 2_000_000
#: Entries accumulated at once.
ENTRIES = 1 << 21
#: Bytes of a text that are cut into terms at once.
PIECE = 1 << 20
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Runs of ASCII letters, digits and the bytes of all other characters.
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")


def _pieces(raw: bytes):
    """raw, lower-cased, in pieces that no term reaches across."""
    raw = raw.translate(_LOWER)
    start = 0
    while len(raw) - start > PIECE:
        m = _GAP.search(raw, start + PIECE)
        if not m:
            break
        yield raw[start : m.start()]
        start = m.start()
    yield raw[start:]


def terms_of(text: str | None) -> Counter:
    """How often each term stands in a text."""
    found: Counter = Counter()
    for piece in _pieces((text or "").encode("utf-8", "surrogatepass")):
        found.update(_TERM.findall(piece))
    return found


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int):
    """Blocks of items, (item_id, terms) each: cut by tasks, brought to the driver one at a time."""
    rows = in_batches(items.select(F.col(id_col).alias("item_id"), text_or_empty(text_col).alias("text")))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = rows.coalesce(max(1, math.ceil(size / block_bytes)))

    def cut(batches):
        ids, terms, held = [], [], 0
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = sorted(terms_of(text))
                more = sum(map(len, found))
                if ids and held + more > block_bytes:
                    yield pa.RecordBatch.from_pylist([{"ids": ids, "terms": terms}], schema=form)
                    ids, terms, held = [], [], 0
                ids.append(item)
                terms.append(found)
                held += more
        if ids:
            yield pa.RecordBatch.from_pylist([{"ids": ids, "terms": terms}], schema=form)

    kind = rows.schema["item_id"].dataType
    form = pa.schema([("ids", pa.list_(_arrow(kind))), ("terms", pa.list_(pa.list_(pa.binary())))])
    return rows.mapInArrow(cut, T.StructType([T.StructField("ids", T.ArrayType(kind)), T.StructField("terms", T.ArrayType(T.ArrayType(T.BinaryType())))])).toLocalIterator()


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def matches(docs: DataFrame, lexicon: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """doc_id, n: terms of the whole text, terms, tfs: numbers of those in the lexicon and how often each stands there."""
    rows = in_batches(docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")))
    form = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]

    def scan(batches):
        number = lexicon.get
        for b in batches:
            n, terms, tfs = [], [], []
            for text in b.column(1).to_pylist():
                size, found = 0, Counter()
                for piece in _pieces(text.encode("utf-8", "surrogatepass")):
                    words = _TERM.findall(piece)
                    size += len(words)
                    found.update(map(number, words))
                del found[None]
                n.append(size)
                terms.append(list(found))
                tfs.append(list(found.values()))
            columns = [pa.array(x, kind) for x, kind in zip((n, terms, tfs), form)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", "n", "terms", "tfs"])

    return rows.mapInArrow(scan, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n long, terms array<int>, tfs array<int>")


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The stable order of non-negative keys: a counting sort for each 16 bits, from the lowest up."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    shift = 16
    while len(keys) and int(keys.max()) >> shift:
        order = order[np.argsort((keys[order] >> shift & 0xFFFF).astype(np.uint16), kind="stable")]
        shift += 16
    return order


def accumulated(keys: np.ndarray, impacts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each one's impacts."""
    if not len(keys):
        return keys, impacts
    order = radix_order(keys)
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(impacts[order], first)


class Scorer:
    """One block of items: which of them hold a term, the terms' weights, and each item's best documents so far."""

    def __init__(self, holders: list[list[int]], weights: list[int], n_items: int, n_docs: int, n_terms: int, best: int):
        self.first = np.concatenate([[0], np.cumsum([len(h) for h in holders])]).astype(np.int64)
        self.items = np.array([i for h in holders for i in h], np.int64)
        self.weights = np.array(weights, np.int64)
        self.n_docs, self.n_terms, self.best = n_docs, n_terms, best
        self.heaps: list[list] = [[] for _ in range(n_items)]
        self.least = np.zeros(n_items, np.int64)

    def add(self, ids: list, lengths: list[int], counts: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> None:
        """Documents with their lengths, how many matches each has, and those matches one after the other."""
        m = np.array([50 + 50 * n * self.n_docs // self.n_terms for n in lengths], np.int64)
        doc = np.repeat(np.arange(len(ids)), counts)
        tf = tfs.astype(np.int64)
        impact = self.weights[terms] * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc]))
        spread = self.first[terms + 1] - self.first[terms]
        upto = np.cumsum(spread)
        per_doc = np.append(0, np.cumsum(np.bincount(doc, spread, len(ids)).astype(np.int64)))
        begin = 0
        while begin < len(ids):
            end = max(begin + 1, int(np.searchsorted(per_doc, per_doc[begin] + ENTRIES, "right")) - 1)
            a, b = np.searchsorted(doc, [begin, end])
            if a < b:
                n = spread[a:b]
                at = np.repeat(self.first[terms[a:b]] - (upto[a:b] - n - (upto[a - 1] if a else 0)), n) + np.arange(n.sum())
                keys = self.items[at] * np.int64(end - begin) + np.repeat(doc[a:b] - begin, n)
                found, sums = accumulated(keys, np.repeat(impact[a:b], n))
                self._keep(found // (end - begin), found % (end - begin) + begin, sums, ids)
            begin = end

    def _keep(self, items: np.ndarray, docs: np.ndarray, sums: np.ndarray, ids: list) -> None:
        near = np.flatnonzero((sums > 0) & (sums >= self.least[items]))
        for item, doc, score in zip(items[near].tolist(), docs[near].tolist(), sums[near].tolist()):
            heap, x = self.heaps[item], ids[doc]
            entry = (score, x is not None, 0 if x is None else -x)
            if len(heap) < self.best:
                heappush(heap, entry)
            elif entry > heap[0]:
                heapreplace(heap, entry)
            if len(heap) == self.best:
                self.least[item] = heap[0][0]

    def rows(self):
        for item, heap in enumerate(self.heaps):
            for score, there, x in heap:
                yield item, -x if there else None, score


def _block_ranks(docs: DataFrame, ids: list, item_terms: list[list[bytes]], id_col: str, text_col: str, best: int) -> DataFrame:
    """item (its number in the block), doc_id, score: the best documents of each task for each item of one block."""
    spark = docs.sparkSession
    lexicon: dict[bytes, int] = {}
    holders: list[list[int]] = []
    for item, terms in enumerate(item_terms):
        for t in terms:
            if lexicon.setdefault(t, len(holders)) == len(holders):
                holders.append([])
            holders[lexicon[t]].append(item)
    path = fresh_dir(spark, "matches")
    matches(docs, lexicon, id_col, text_col).write.parquet(path)
    found = spark.read.parquet(path)
    n_docs, n_terms = found.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    dfs = {r["term"]: r["df"] for r in found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toLocalIterator()}
    weights = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * dfs.get(k, 0) + 1))) for k in range(len(holders))]
    kind = found.schema["doc_id"].dataType
    arrow_kind = _arrow(kind)

    def score(batches):
        scorer = Scorer(holders, weights, len(ids), n_docs, n_terms or 1, best)
        for b in batches:
            terms, tfs = b.column(2), b.column(3)
            counts = np.asarray(terms.value_lengths().fill_null(0))
            scorer.add(b.column(0).to_pylist(), b.column(1).to_pylist(), counts, np.asarray(terms.flatten()), np.asarray(tfs.flatten()))
        rows = list(scorer.rows())
        columns = list(zip(*rows)) if rows else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], arrow_kind), pa.array(columns[2], pa.int64())], ["item", "doc_id", "score"])

    return in_batches(found.filter(F.size("terms") > 0)).mapInArrow(score, f"item int, doc_id {kind.simpleString()}, score long")


def ranked(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", best: int = BEST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: each item's best documents with a score above 0, equal scores by ascending doc_id.

    Terms are maximal runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. Null texts
    have no terms; a document or an item without terms takes part in nothing. Each row of docs is a document and each row
    of items an item, rows with the same id or text included (their order among themselves is by nothing); null ids come
    last among equals. Other columns are left out. doc_id must be a number.
    """
    results = []
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    spark = docs.sparkSession
    item_kind = items.schema[item_col].dataType
    for ids, terms in item_blocks(items, item_col, item_text_col, block_bytes):
        near = _block_ranks(docs, ids, terms, id_col, text_col, best)
        path = fresh_dir(spark, "candidates")
        near.write.parquet(path)
        # an item's candidates lie in stretches of score, each thinned where it lies before the item's best meet
        last = spark.read.parquet(path).repartitionByRange("item", *order).withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= best)
        names = spark.createDataFrame(list(enumerate(ids)), T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", item_kind)]))
        results.append(last.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    if not results:
        return spark.createDataFrame([], T.StructType([T.StructField("item_id", item_kind), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("score", T.LongType())]))
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out
