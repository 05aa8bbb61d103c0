"""Grids of positioned words: channels, cells, rows, headers, regions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import batches as BT

# Bin width and least channel in points, share of rows that may cross one, least share of filled cells
BIN, CHANNEL, CROSSING, FILL = 2.0, 4.0, 0.12, 0.35
STACK_GAP, STITCH_GAP, STITCH_SHIFT = 1.8, 40, 4
SYMBOLS = ("$", "€", "£", "¥")
NUMERIC = r"^[($-]*[0-9][0-9,]*\.?[0-9]*[)%]*$"
YEAR = r"^(?:19|20)[0-9]{2}$"


def _cuts(of: np.ndarray, line: np.ndarray, x0: np.ndarray, x1: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and place of each cut, in order, for the words of n_docs documents: one sweep over the bins of them all.

    A word opens its bins where no word before it in its row covers them and closes them at its end; where few rows are
    open is quiet.
    """
    a, b = np.floor(x0 / BIN).astype(np.int64), np.ceil(x1 / BIN).astype(np.int64)
    order = np.lexsort((a, line, of))
    of, line, a, b = of[order], line[order], a[order], b[order]
    first = np.ones(len(of), bool)
    first[1:] = (of[1:] != of[:-1]) | (line[1:] != line[:-1])
    rows = np.bincount(of[first], minlength=n_docs)
    least = b.min(initial=0)
    apart = np.cumsum(first) * (b.max(initial=0) - least + 1)
    reach = np.maximum.accumulate(apart + b - least) - apart + least  # of the words up to this one, row by row
    a[1:] = np.where(first[1:], a[1:], np.maximum(a[1:], reach[:-1]))
    new = a < b
    docs, at = np.concatenate((of[new], of[new])), np.concatenate((a[new], b[new]))
    turn = np.repeat((1, -1), new.sum())
    order = np.lexsort((at, docs))
    docs, at, level = docs[order], at[order], np.cumsum(turn[order])
    last = np.ones(len(docs), bool)
    last[:-1] = (docs[1:] != docs[:-1]) | (at[1:] != at[:-1])
    docs, at, level = docs[last], at[last], level[last]
    quiet = (docs[:-1] == docs[1:]) & (level[:-1] <= CROSSING * rows[docs[:-1]])  # from each place to the next
    edge = np.diff(np.concatenate(([0], quiet, [0])).astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    wide = (at[end] - at[begin]) * BIN >= CHANNEL
    begin, end = begin[wide], end[wide]
    return docs[begin], (at[begin] + at[end]) * BIN / 2


def _swept(batch: pa.RecordBatch) -> tuple:
    of, x = BT.flat(batch)
    x0, x1 = (x[c].to_numpy(zero_copy_only=False) for c in ("x0", "x1"))
    return of, x, x0, x1, *_cuts(of, x["line_no"].to_numpy(zero_copy_only=False), x0, x1, batch.num_rows)


def _typed(words: DataFrame, columns: list) -> str:
    return ", ".join(f"{c} {words.schema[c].dataType.simpleString()}" for c in columns)


def cut_lists(words: DataFrame, keys=("doc_id",)) -> DataFrame:
    """keys, cuts: the cuts of each document that has some, in order."""
    keys = list(keys)

    def lists(parts):
        for batch in parts:
            *_, docs, cuts = _swept(batch)
            having = np.unique(docs)
            offsets = np.append(np.searchsorted(docs, having), len(docs)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(having)) for k in range(len(keys))), pa.ListArray.from_arrays(offsets, pa.array(cuts, pa.float64()))], [*keys, "cuts"])

    return BT.collected(words, ["line_no", "x0", "x1"], keys).mapInArrow(lists, f"{_typed(words, keys)}, cuts array<double>")


def channel_cuts(words: DataFrame, keys=("doc_id",)) -> DataFrame:
    """keys, cut: middles of the vertical channels that at most 12 % of the rows cross, inside the words' extent."""
    return cut_lists(words, keys).select(*keys, F.explode("cuts").alias("cut"))


def words_in_cells(words: DataFrame, ids: list, keys=("doc_id",)) -> DataFrame:
    """keys, ids, col: the number of cuts left of each word's middle. ids (line_no among them) are whole numbers."""
    keys = list(keys)

    def placed(parts):
        for batch in parts:
            of, x, x0, x1, docs, cuts = _swept(batch)
            middle = (x0 + x1) / 2
            order = np.lexsort((np.concatenate((np.ones(len(of), bool), np.zeros(len(docs), bool))), np.concatenate((middle, cuts)), np.concatenate((of, docs))))
            is_cut = order >= len(of)
            col = np.empty(len(of), np.int64)
            col[order[~is_cut]] = np.cumsum(is_cut)[~is_cut]
            col -= np.searchsorted(docs, of)
            for k in range(len(keys)):
                col[batch.column(k).is_null().to_numpy(zero_copy_only=False)[of]] = 0  # no key, no cuts, as in a join
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(of)) for k in range(len(keys))), *(x[c] for c in ids), pa.array(col)], [*keys, *ids, "col"])

    return BT.collected(words, [*ids, "x0", "x1"], keys).mapInArrow(placed, f"{_typed(words, [*keys, *ids])}, col long")


def assigned_cells(words: DataFrame, cuts: DataFrame, keys=("doc_id",)) -> DataFrame:
    """words with col: the number of cuts left of the word's middle."""
    keys = list(keys)
    lists = cuts.groupBy(*keys).agg(F.collect_list("cut").alias("cuts"))
    placed = words.join(lists, keys, "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<double>")))
    middle = (F.col("x0") + F.col("x1")) / 2
    return placed.withColumn("col", F.size(F.filter("cuts", lambda c: c <= middle)).cast("long")).drop("cuts")


def is_numericish(text: Column) -> Column:
    """A number, an amount or a share; a year is none."""
    return text.rlike(NUMERIC) & ~text.rlike(YEAR)


def islands_by_gap(rows: DataFrame, gap: Column, by: list, order: list, name: str) -> DataFrame:
    """rows with `name`: how many gaps there are up to the row."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_g", F.coalesce(gap, F.lit(False)).cast("int")).withColumn(name, F.sum("_g").over(w).cast("long")).drop("_g")


def escaped(text: Column) -> Column:
    t = text
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        t = F.replace(t, F.lit(char), F.lit(entity))
    return t


def html_row(cells: Column, tag: Column) -> Column:
    inner = F.transform(cells, lambda c: F.concat(F.lit("<"), tag, F.lit(">"), escaped(c), F.lit("</"), tag, F.lit(">")))
    return F.concat(F.lit("<tr>"), F.array_join(inner, ""), F.lit("</tr>"))
