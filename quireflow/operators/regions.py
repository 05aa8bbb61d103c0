"""Several table regions a page: bands of lines that share white-space channels, and words claimed by priority.

A band goes on while the channels common to its lines do; the running intersection is a fold, cut where two lines
without gaps follow each other, since no band reaches across them. Bands close below each other are bridged. Candidates
of all kinds then claim words in the order of their priority. Spark brings a document's words together; many documents
at once are arrays, and a fold takes its next step in all of them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import batches as BT
from .rulings import _new, _numbered, _pairs
from .tables import NUMERIC, YEAR

# Least channel in points and letters, lines of a band, bridged gap, share of a full line, words of a table
CHANNEL, LETTERS, LINES, BRIDGE, FULL, LEAST_WORDS = 4.0, 1.2, 3, 48.0, 0.7, 4

#: Lists of channels, one list a line or band: how many each has, and the edges of all.
Channels = tuple[np.ndarray, np.ndarray, np.ndarray]
#: Words as columns: of (their document's place in the batch), line, word, letters, x0, x1, top, bottom.
Words = dict[str, np.ndarray | pa.Array]


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """n numbers from each first on."""
    return np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)


def _some(c: Channels, which: np.ndarray) -> Channels:
    """The lists at these places."""
    n, lo, hi = c
    at = _ranges((np.cumsum(n) - n)[which], n[which])
    return n[which], lo[at], hi[at]


def _either(choice: np.ndarray, *lists: Channels) -> Channels:
    """For each place its list out of the chosen ones; an empty one, where the choice is behind the last."""
    m = len(choice)
    every = [np.concatenate(c) for c in zip(*lists, (np.zeros(m, np.int64), np.empty(0), np.empty(0)), strict=True)]
    return _some((every[0], every[1], every[2]), choice * m + np.arange(m))


def _common(a: Channels, b: Channels, least: np.ndarray) -> Channels:
    """The parts that channels of both lists share, where wide enough."""
    n = a[0] * b[0]
    u = np.repeat(np.arange(len(n)), n)
    k = _ranges(np.zeros(len(n), np.int64), n)
    i, j = (np.cumsum(a[0]) - a[0])[u] + k // b[0][u], (np.cumsum(b[0]) - b[0])[u] + k % b[0][u]
    lo, hi = np.maximum(a[1][i], b[1][j]), np.minimum(a[2][i], b[2][j])
    wide = hi - lo >= least[u]
    return np.bincount(u[wide], minlength=len(n)), lo[wide], hi[wide]


def _sorted(w: Words) -> Words:
    """Words in order of document, line, x0 and x1; only lines that are out of order are sorted."""
    of, line, x0, x1 = (w[c] for c in ("of", "line", "x0", "x1"))
    same = ~_new(of, line)
    behind = (of[1:] < of[:-1]) | ((of[1:] == of[:-1]) & (line[1:] < line[:-1]))
    if behind.any():
        order = np.lexsort((x1, x0, line, of))
    else:
        wrong = np.flatnonzero(same[1:] & ((x0[1:] < x0[:-1]) | ((x0[1:] == x0[:-1]) & (x1[1:] < x1[:-1]))))
        if not len(wrong):
            return w
        no = np.cumsum(~same)
        some = np.flatnonzero(np.isin(no, no[wrong]))
        order = np.arange(len(of))
        order[some] = some[np.lexsort((x1[some], x0[some], no[some]))]
    return {k: c.take(pa.array(order)) if isinstance(c, pa.Array) else c[order] for k, c in w.items()}


def _least(of: np.ndarray, letter: np.ndarray) -> np.ndarray:
    """For each document with words, in order, the least width of a channel, by the median of its words' letters."""
    starts = np.flatnonzero(_new(of))
    median, most = np.minimum.reduceat(letter, starts), np.maximum.reduceat(letter, starts)
    n = np.diff(np.append(starts, len(of)))
    for d in np.flatnonzero(median < most):
        some = np.sort(letter[starts[d] : starts[d] + n[d]])
        median[d] = 0.5 * some[(n[d] - 1) // 2] + 0.5 * some[n[d] // 2]
    return np.maximum(CHANNEL, LETTERS * median)


def _bands(first: np.ndarray, n: np.ndarray, gaps: Channels, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, Channels]:
    """Each line's band (the place of its first line, or -1), the bands in order, and their channels at their last lines.

    A fold over stretches of n lines from the first on: a line goes on with the band, is carried along as a caption, ends
    the band or begins one.
    """
    order = np.argsort(-n, kind="stable")
    first, n = first[order], n[order]
    band_of = np.full(len(gaps[0]), -1)
    band, channels = np.full(len(n), -1), (np.zeros(len(n), np.int64), np.empty(0), np.empty(0))
    ended, k = [], 0
    while len(band):
        m = np.searchsorted(-n[: len(band)], -k)
        over = m + np.flatnonzero(band[m:] >= 0)
        ended.append((band[over], *_some(channels, over)))
        band, channels, line = band[:m], _some(channels, np.arange(m)), first[:m] + k
        now = _some(gaps, line)
        common = _common(channels, now, least[line])
        has, inside = now[0] > 0, band >= 0
        goes_on, carried = has & inside & (common[0] > 0), np.zeros(m, bool)
        caption = np.flatnonzero(~has & inside & (n[:m] > k + 1))
        carried[caption] = _common(_some(channels, caption), _some(gaps, line[caption] + 1), least[line[caption]])[0] > 0
        left = np.flatnonzero(inside & ~goes_on & ~carried)
        ended.append((band[left], *_some(channels, left)))
        band = np.where(goes_on | carried, band, np.where(has, line, -1))
        channels = _either(np.select([goes_on, carried, has], [0, 1, 2], 3), common, channels, now)
        band_of[line] = band
        k += 1
    bands, *lists = (np.concatenate(c) for c in zip((np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0)), *ended, strict=True))
    order = np.argsort(bands)
    return band_of, bands[order], _some((lists[0], lists[1], lists[2]), order)


def _numeric_bands(w: Words, line_of: np.ndarray, lines: np.ndarray, band: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """For each of the bands with one channel, whether one side of its middle is numbers in half of the lines or more.

    lines are the bands' lines with gaps, band the number of each one's band.
    """
    at = np.full(line_of[-1] + 1, -1)
    at[lines] = np.arange(len(lines))
    some = np.flatnonzero(at[line_of] >= 0)
    line = at[line_of[some]]
    left, right = w["x1"][some] <= middle[band[line]], w["x0"][some] >= middle[band[line]]
    some, side = some[left | right], (2 * line + ~left)[left | right]
    word = w["word"].take(pa.array(some))
    number = pc.and_(pc.match_substring_regex(word, NUMERIC), pc.invert(pc.match_substring_regex(word, YEAR)))
    count = lambda which: np.bincount(side[which.to_numpy(zero_copy_only=False)], minlength=2 * len(lines))
    # a text of several words has a blank and is no number
    one = (count(pc.is_valid(word)) == 1) & (count(pc.fill_null(number, False)) == 1)
    sides = np.flatnonzero(np.bincount(side, minlength=2 * len(lines)))
    of = 2 * band[sides // 2] + sides % 2
    n, numbers = np.bincount(of, minlength=2 * len(middle)), np.bincount(of[one[sides]], minlength=2 * len(middle))
    return ((n >= LINES) & (2 * numbers >= n)).reshape(-1, 2).any(axis=1)


def _bridged(first: np.ndarray, n: np.ndarray, box: np.ndarray, channels: Channels, between: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Regions of documents with n bands from the first on: the first band of each, and its box (x0, top, x1, bottom)."""
    order = np.argsort(-n, kind="stable")
    first, n = first[order], n[order]
    start, now, common, done, k = first, box[:, first], _some(channels, first), [], 1
    while len(start):
        m = np.searchsorted(-n[: len(start)], -k)
        done.append((start[m:], now[:, m:]))
        start, now, b = start[:m], now[:, :m], first[:m] + k
        new, own = box[:, b], _some(channels, b)
        shared = _common(_some(common, np.arange(m)), own, least[b])
        gap, width = new[1] - now[3], np.maximum(now[2] - now[0], new[2] - new[0])
        near = (shared[0] > 0) & (gap >= 0) & (gap <= BRIDGE) & (between[b] <= FULL * width)
        done.append((start[~near], now[:, ~near]))
        both = np.stack((np.minimum(now[0], new[0]), now[1], np.maximum(now[2], new[2]), np.maximum(now[3], new[3])))
        start, now, common = np.where(near, start, b), np.where(near, both, new), _either(1 - near.astype(np.int64), shared, own)
        k += 1
    return np.concatenate([s for s, _ in done] or [first]), np.concatenate([x for _, x in done] or [now], axis=1)


def found(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, region (the number of its first line) and box (x0, top, x1, bottom) of the table regions among words.

    Gaps of a line are channels if wide enough. A band has three lines with gaps and a channel at its end; one with a
    single channel is kept when one side of it is numbers in half of the lines or more. A gap of more than 48 points, no
    common channel, or a line of more than 0.7 of the width between two bands keeps them apart.
    """
    if not len(w["of"]):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty((4, 0))
    w = _sorted(w)
    of, line, x0, x1 = (w[c] for c in ("of", "line", "x0", "x1"))
    new_doc, new = _new(of), _new(of, line)
    starts, line_of = np.flatnonzero(new), np.cumsum(new) - 1
    least = _least(of, (x1 - x0) / np.maximum(w["letters"], 1))[np.cumsum(new_doc)[starts] - 1]
    l_of, l_box = of[starts], (x0[starts], np.minimum.reduceat(w["top"], starts), np.maximum.reduceat(x1, starts), np.maximum.reduceat(w["bottom"], starts))
    # gaps, and stretches of lines that no band leaves
    gap = np.flatnonzero(~new[1:] & (x0[1:] - x1[:-1] >= least[line_of[1:]])) + 1
    gaps = np.bincount(line_of[gap], minlength=len(starts)), x1[gap - 1], x0[gap]
    has, opens = gaps[0] > 0, new_doc[starts]
    opens[1:] |= ~has[:-1] & ~has[1:]
    first = np.flatnonzero(opens)
    n = np.diff(np.append(first, len(starts)))
    filled = np.add.reduceat(gaps[0], first) > 0
    band_of, bands, channels = _bands(first[filled], n[filled], gaps, least)
    held = np.flatnonzero(band_of >= 0)
    begin = np.flatnonzero(_new(band_of[held])) if len(held) else held
    last = held[np.append(begin[1:], len(held)) - 1] if len(held) else held
    box = np.stack([f.reduceat(c[held], begin) for f, c in zip((np.minimum, np.minimum, np.maximum, np.maximum), l_box, strict=True)]) if len(held) else np.empty((4, 0))
    kept = (np.add.reduceat(has[held].astype(np.int64), begin) >= LINES) & (channels[0] > 0) if len(held) else np.empty(0, bool)
    # one channel: both sides of its middle, line by line
    single = np.flatnonzero(kept & (channels[0] == 1))
    if len(single):
        no = np.full(len(starts), -1)
        no[bands[single]] = np.arange(len(single))
        lines = held[has[held] & (no[band_of[held]] >= 0)]
        _, lo, hi = _some(channels, single)
        kept[single] = _numeric_bands(w, line_of, lines, no[band_of[lines]], (lo + hi) / 2)
    kept = np.flatnonzero(kept)
    bands, last, box, channels = bands[kept], last[kept], box[:, kept], _some(channels, kept)
    # the widest line between a band and the one before it
    between = np.zeros(len(bands))
    b_of = l_of[bands]
    b_new = _new(b_of) if len(bands) else np.empty(0, bool)
    apart = np.flatnonzero(~b_new[1:] & (bands[1:] > last[:-1] + 1)) + 1
    if len(apart):
        edges = np.stack((last[apart - 1] + 1, bands[apart]), axis=1).ravel()
        between[apart] = np.maximum.reduceat(l_box[2] - l_box[0], edges)[::2]
    b_first = np.flatnonzero(b_new)
    region, box = _bridged(b_first, np.diff(np.append(b_first, len(bands))), box, channels, between, least[bands])
    return b_of[region], line[starts][bands[region]], box


def claims(w: Words, same: np.ndarray, of: np.ndarray, priority: np.ndarray, box: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word and candidate of each word that is claimed; words with one number in same are one.

    Each round decides the next candidate of all documents.
    """
    order = np.lexsort((priority, of))
    rank = np.arange(len(order)) - np.searchsorted(of[order], of[order])
    by_rank = np.argsort(rank, kind="stable")
    order, rank = order[by_rank], rank[by_rank]
    x, y = (w["x0"] + w["x1"]) / 2, (w["top"] + w["bottom"]) / 2
    x0, top, x1, bottom = box[:, order]
    c, j = _pairs(of[order], top, bottom, w["of"], y)
    inside = (x0[c] <= x[j]) & (x[j] <= x1[c])
    c, j = c[inside], j[inside]
    taken, won_by, won = np.zeros(same.max(initial=-1) + 1, bool), [order[:0]], [order[:0]]
    edges = np.searchsorted(rank, np.arange(rank.max(initial=-1) + 2))
    for a, b in zip(np.searchsorted(c, edges[:-1]), np.searchsorted(c, edges[1:]), strict=True):
        free = ~taken[same[j[a:b]]]
        cs, js = c[a:b][free], j[a:b][free]
        if len(cs):
            enough = np.bincount(cs - cs[0])[cs - cs[0]] >= LEAST_WORDS
            taken[same[js[enough]]] = True
            won_by.append(order[cs[enough]])
            won.append(js[enough])
    return np.concatenate(won), np.concatenate(won_by)


def mapped(docs: DataFrame, made: Callable[[pa.RecordBatch], tuple], schema: str, n_keys: int = 1, n_rows: str | None = None) -> DataFrame:
    """The documents' keys with what made() gives for a batch: document (its place in the batch) and the schema's other columns.

    docs are collected() ones; or, with n_rows, rows as stacked() takes them.
    """

    def placed(batches):
        for part in BT.stacked(batches, n_rows) if n_rows else (p for b in batches for p in BT.pieces(b)):
            of, *columns = made(part)
            arrays = [part.column(k).take(pa.array(of)) for k in range(n_keys)] + [c if isinstance(c, pa.Array) else pa.array(c) for c in columns]
            yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in schema.split(", ")])

    return docs.mapInArrow(placed, schema)


def _collected(words: DataFrame, fields: list, keys: list) -> tuple[DataFrame, str]:
    """Documents with their words, and their keys with types."""
    typed = ", ".join(f"{k} {words.schema[k].dataType.simpleString()}" for k in keys)
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    doubles = [F.col(c).cast("double").alias(c) for c in ("x0", "x1", "top", "bottom")]
    return BT.collected(words.filter(known), [*fields, *doubles], keys), typed


def _words(of: np.ndarray, xs: dict[str, pa.Array]) -> Words:
    return {"of": of} | {c: xs[c].to_numpy(zero_copy_only=False) for c in ("x0", "x1", "top", "bottom")}


def regions(words: DataFrame, keys=("doc_id",)) -> DataFrame:
    """keys, region, x0, top, x1, bottom: the table regions found() among words (line_no, word, x0, x1, top, bottom)."""
    keys = list(keys)
    docs, typed = _collected(words.filter("line_no IS NOT NULL"), [F.col("line_no").cast("long").alias("line_no"), "word"], keys)

    def made(batch):
        of, xs = BT.flat(batch)
        letters = pc.fill_null(pc.utf8_length(xs["word"]), 1).to_numpy(zero_copy_only=False)
        doc, region, box = found(_words(of, xs) | {"line": xs["line_no"].to_numpy(zero_copy_only=False), "word": xs["word"], "letters": letters})
        return doc, region, *box

    return mapped(docs, made, f"{typed}, region long, x0 double, top double, x1 double, bottom double", len(keys))


def claimed(words: DataFrame, candidates: DataFrame, keys=("doc_id",), word_id: str = "word_id") -> DataFrame:
    """keys, word_id, candidate: which candidate (x0, top, x1, bottom, priority, distinct on a page) each word belongs to; words of none are left out.

    In the order of priority a candidate takes the words with their middle inside it that no accepted one has, and is
    accepted with at least four of them.
    """
    keys = list(keys)
    docs, typed = _collected(words, [word_id], keys)
    boxes, _ = _collected(candidates, ["candidate", F.col("priority").cast("double").alias("priority")], keys)

    def made(batch):
        of, xs = BT.flat(batch)
        c_of, cs = BT.flat(batch, "candidates")
        same = _numbered(of, pc.fill_null(xs[word_id].dictionary_encode().indices, -1).to_numpy(zero_copy_only=False))
        number = lambda c: cs[c].to_numpy(zero_copy_only=False)
        word, candidate = claims(_words(of, xs), same, c_of, number("priority"), np.stack([number(c) for c in ("x0", "top", "x1", "bottom")]))
        return of[word], xs[word_id].take(pa.array(word)), cs["candidate"].take(pa.array(candidate))

    types = [f"{n} {df.schema[n].dataType.simpleString()}" for n, df in ((word_id, words), ("candidate", candidates))]
    return mapped(docs.join(boxes.withColumnRenamed("xs", "candidates"), keys), made, ", ".join([typed, *types]), len(keys))
