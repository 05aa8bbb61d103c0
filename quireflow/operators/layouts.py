"""Blocks of many documents at once, and the words in their boxes, as arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quireflow.functions import features as FT

from .blocks import SHIFT, STEP
from .spatial import SLACK

LETTER = 6.0
#: Pairs of a word and a block that are compared at once.
PAIRS = 4_000_000


def blocks(of: np.ndarray, lines: dict, text: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The block of each line, and the blocks' documents, block_idx, boxes and numbers of words.

    Lines (top, left, size, weight) are in order of document and line, and each has a token: as blocks.with_blocks() and
    blocks.blocks().
    """
    f = FT.of_texts(text, ("numbered", "list_item", "table_row"))
    top, left, size, weight = (lines[c] for c in ("top", "left", "size", "weight"))
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (size[1:] != size[:-1]) | (weight[1:] != weight[:-1]) | f["table_row"][:-1]
    new[1:] |= (np.diff(top) > STEP * size[1:]) | (np.abs(np.diff(left)) > SHIFT)
    new |= f["numbered"] | f["list_item"] | f["table_row"]
    block, starts = np.cumsum(new) - 1, np.flatnonzero(new)
    letters = pc.utf8_length(text).to_numpy(zero_copy_only=False)
    doc = of[starts]
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.empty(0, int)
    idx = np.arange(len(doc)) - np.repeat(first, np.diff(np.append(first, len(doc))))
    n_words = pc.count_substring(text, " ").to_numpy(zero_copy_only=False) + 1
    out = {"of": doc, "idx": idx, "left": np.minimum.reduceat(left, starts), "top": np.minimum.reduceat(top, starts)}
    out |= {"right": np.maximum.reduceat(left + LETTER * letters, starts), "bottom": np.maximum.reduceat(top + size, starts)}
    return block, out | {"n_words": np.add.reduceat(n_words.astype(np.int64), starts)}


def holders(of: np.ndarray, x: np.ndarray, y: np.ndarray, b: dict[str, np.ndarray]) -> np.ndarray:
    """For each point the smallest block of its document that holds it, the first of equals, or -1; points and blocks are in order of document."""
    found = np.full(len(of), -1)
    area = (b["right"] - b["left"]) * (b["bottom"] - b["top"])
    begin, end = np.searchsorted(b["of"], of, "left"), np.searchsorted(b["of"], of, "right")
    done = np.append(0, np.cumsum(end - begin))
    start = 0
    while start < len(of):
        stop = max(start + 1, int(np.searchsorted(done, done[start] + PAIRS, "right")) - 1)
        n = (end - begin)[start:stop]
        point = np.repeat(np.arange(start, stop), n)
        block = np.arange(n.sum()) - np.repeat(done[start:stop] - done[start], n) + np.repeat(begin[start:stop], n)
        inside = (x[point] >= b["left"][block] - SLACK) & (x[point] <= b["right"][block] + SLACK) & (y[point] >= b["top"][block] - SLACK) & (y[point] <= b["bottom"][block] + SLACK)
        point, block = point[inside], block[inside]
        order = np.lexsort((b["idx"][block], area[block], point))
        point, at = np.unique(point[order], return_index=True)
        found[point] = block[order][at]
        start = stop
    return found


def of_words(w: dict, block: np.ndarray, b: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words that a block holds, one of those with the same place, the block that each goes to, and whether a word or one of its place is held."""
    held = holders(w["of"], (w["x0"] + w["x1"]) / 2, (w["top"] + w["bottom"]) / 2, b)
    word = np.flatnonzero(held >= 0)
    if not _repeated(w["of"], w["line"], w["cell_no"], w["word_no"]):
        return word, held[word], held >= 0
    same = np.unique(np.stack([w[c].astype(np.int64) for c in ("of", "line", "cell_no", "word_no")]), axis=1, return_inverse=True)[1].ravel()
    area = (b["right"] - b["left"]) * (b["bottom"] - b["top"])
    word = word[np.lexsort((b["idx"][held[word]], area[held[word]], same[word]))]
    word = word[np.unique(same[word], return_index=True)[1]]
    return word, held[word], np.isin(same, same[word])


def _repeated(*ids: np.ndarray) -> bool:
    """Whether rows in order of the first of their ids do not rise from each to the next."""
    rises, equal = np.zeros(max(len(ids[0]) - 1, 0), bool), np.ones(max(len(ids[0]) - 1, 0), bool)
    for x in ids:
        rises |= equal & (x[1:] > x[:-1])
        equal &= x[1:] == x[:-1]
    return not rises.all()


def covered(w: dict, of: np.ndarray, line_no: np.ndarray, block: np.ndarray, n_blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The area of each block's words, and how many it has; words go to all lines of their number."""
    first = np.append(True, (of[1:] != of[:-1]) | (line_no[1:] != line_no[:-1])) if len(of) else np.empty(0, bool)
    starts = np.flatnonzero(first)
    n = np.diff(np.append(starts, len(of)))
    # the number of each word's line: words and lines are in the same order
    new = np.append(True, (w["of"][1:] != w["of"][:-1]) | (w["line"][1:] != w["line"][:-1])) if len(w["of"]) else np.empty(0, bool)
    heads = np.flatnonzero(new)
    places = {k: i for i, k in enumerate(zip(of[starts].tolist(), line_no[starts].tolist(), strict=True))}
    group = np.array([places[k] for k in zip(w["of"][heads].tolist(), w["line"][heads].tolist(), strict=True)], int)[np.cumsum(new) - 1]
    word = np.repeat(np.arange(len(group)), n[group])
    line = np.arange(len(word)) - np.repeat(np.cumsum(n[group]) - n[group], n[group]) + starts[group][word]
    area = (w["x1"] - w["x0"]) * (w["bottom"] - w["top"])
    return np.bincount(block[line], area[word], n_blocks), np.bincount(block[line], minlength=n_blocks)
