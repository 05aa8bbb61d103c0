"""Where tables begin and end: an automaton over a document's blocks, put together from stretches.

A block is a letter of a small alphabet: what it is beside the block and the row before it. A letter maps each of seven
states to another, and maps compose, so each stretch of a document is one map, found by itself; the maps of a
document's stretches give each stretch its first state; the stretches are then walked from there. No task has to hold
or walk a whole document's blocks, however long it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How near cells align, a tight gap in heights, words of a long line, rows of a table
ALIGN, TIGHT, LONG, LEAST_ROWS = 5.0, 1.5, 10, 2
#: Blocks of a stretch.
STRETCH = 64
#: State 0 is outside tables. States 1 to 6: one row or more rows so far, and none, one or two other blocks since the last row.
_OUT = 0
ROW, BREAK, ALIGNED, NEAR, FAR, LONG_TEXT, END = range(7)


def _state(rows: int, others: int) -> int:
    return 1 + 3 * (rows - 1) + others


def _moves(letter: int) -> list[int]:
    """The state that each state goes to."""
    moves = []
    for state in range(7):
        rows, others = (state - 1) // 3 + 1, (state - 1) % 3
        if letter == BREAK or (state == _OUT and letter == ROW):
            moves.append(_state(1, 0))
        elif state == _OUT or letter == END:
            moves.append(_OUT)
        elif letter == ROW:
            moves.append(_state(2, 0))
        elif letter == ALIGNED:
            moves.append(_state(rows, 0))
        else:
            others += 1
            over = others > 2 or (letter in (FAR, LONG_TEXT) and rows == 1 and others == 2) or (letter == LONG_TEXT and rows == 2)
            moves.append(_OUT if over else _state(rows, others))
    return moves


TABLE = [_moves(letter) for letter in range(7)]


def _moved(state: Column, letter: Column) -> Column:
    flat = F.array(*[F.lit(s) for moves in TABLE for s in moves])
    return F.get(flat, letter * 7 + state)


def with_letters(blocks: DataFrame) -> DataFrame:
    """blocks (block_idx, page_idx, top, height, left, size, weight, is_row, cells, n_words, centred_italic) with `letter`.

    A row breaks with the row before when fewer than two of its cells, or only a leading part of less than half of
    them, align with it, when it has more cells than two equal rows before it, or when it is on another page and has more
    than two cells. Other blocks end a table on another page, or as a centred line in italics; they belong to it when
    they stand close below and begin where a cell of the row does.
    """
    w = Window.partitionBy("doc_id").orderBy("block_idx")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    row = F.struct("cells", "page_idx", "size", "weight")
    last = F.last(F.when(F.col("is_row"), row), ignorenulls=True).over(past)
    bottom = F.lag(F.col("top") + F.col("height")).over(w)
    same_page = F.lag("page_idx").over(w) == F.col("page_idx")
    rows = blocks.withColumn("_p", last).withColumn("_gap", F.when(same_page, F.col("top") - bottom))
    before = F.last(F.when(F.col("is_row"), F.size("_p.cells")), ignorenulls=True).over(past)
    rows = rows.withColumn("_pp", before)
    n, n_before = F.size("cells"), F.size("_p.cells")
    near = lambda x: F.exists("_p.cells", lambda c: F.abs(c - x) <= ALIGN)
    hits = F.transform("cells", near)
    n_hits = F.size(F.filter(hits, lambda h: h))
    leading = F.size(F.filter(F.slice(hits, F.lit(1), n_hits), lambda h: h)) == n_hits
    broken = (n_hits < 2) | ((2 * n_hits < n) & leading)
    wider = (n > n_before) & (F.col("_pp") == n_before)
    other_page = F.col("page_idx") != F.col("_p.page_idx")
    breaks = F.col("_p").isNotNull() & ((F.greatest(n, n_before) >= 2) & broken | wider | (other_page & (n > 2)))
    ends = (other_page & (n_before >= 2)) | F.col("centred_italic")
    close = F.coalesce(F.col("_gap") <= TIGHT * F.col("height"), F.lit(False))
    other_style = (F.col("size") != F.col("_p.size")) | (F.col("weight") != F.col("_p.weight"))
    letter = (
        F.when(F.col("is_row"), F.when(breaks, BREAK).otherwise(ROW))
        .when(F.col("_p").isNull() | F.coalesce(ends, F.lit(False)), END)
        .when((F.col("n_words") > LONG) & other_style, LONG_TEXT)
        .when(close & near(F.col("left")), ALIGNED)
        .when(close, NEAR)
        .otherwise(FAR)
    )
    return rows.withColumn("letter", letter).drop("_p", "_pp", "_gap")


def with_states(rows: DataFrame, stretch: int = STRETCH, others=()) -> DataFrame:
    """doc_id, block_idx, is_row, letter, before, state and others: each block's letter and the states before and behind it.

    A document's stretches meet their first states by document, where they are; nothing is written in between.
    """
    order = F.array_sort(F.collect_list(F.struct("block_idx", "letter", "is_row", *others)))
    parts = rows.withColumn("part", F.expr(f"block_idx DIV {stretch}")).groupBy("doc_id", "part").agg(order.alias("bs"))
    one_by_one = F.array(*map(F.lit, range(7)))
    maps = parts.select("doc_id", "part", F.aggregate("bs", one_by_one, lambda m, b: F.transform(m, lambda s: _moved(s, b["letter"]))).alias("moves"))
    docs = maps.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("part", "moves"))).alias("ps"))
    starts = docs.select("doc_id", F.aggregate("ps", F.array(F.lit(_OUT)), lambda s, p: F.array_append(s, F.get(p["moves"], F.element_at(s, -1)))).alias("starts"))
    walked = F.aggregate("bs", F.array(F.get("starts", F.col("part").cast("int"))), lambda s, b: F.array_append(s, _moved(F.element_at(s, -1), b["letter"])))
    steps = parts.join(starts, "doc_id").withColumn("s", walked)
    steps = steps.select("doc_id", "s", F.posexplode("bs").alias("k", "b"))
    return steps.select("doc_id", "b.*", F.get("s", F.col("k")).alias("before"), F.get("s", F.col("k") + 1).alias("state"))


def _in_spans(blocks: DataFrame, stretch: int, others=()) -> DataFrame:
    """The blocks that are in a table's reach, with the number of its span in the document."""
    states = with_states(with_letters(blocks), stretch, others)
    opens = (F.col("letter") == BREAK) | ((F.col("letter") == ROW) & (F.col("before") == _OUT))
    past = Window.partitionBy("doc_id").orderBy("block_idx").rowsBetween(Window.unboundedPreceding, 0)
    return states.withColumn("span", F.sum(opens.cast("int")).over(past)).filter((F.col("state") != _OUT) & (F.col("span") > 0))


_END = lambda: F.max(F.when(F.col("is_row") | (F.col("letter") == ALIGNED), F.col("block_idx")))


def table_spans(blocks: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """doc_id, first_block, last_block, n_rows, n_others: tables of at least two rows, up to their last row or aligned block.

    Blocks need doc_id and block_idx from 0 without gaps; rows without cells count as rows of no cell.
    """
    found = _in_spans(blocks, stretch).groupBy("doc_id", "span").agg(F.min("block_idx").alias("first_block"), _END().alias("last_block"), F.count_if("is_row").alias("n_rows"))
    others = F.col("last_block") - F.col("first_block") + 1 - F.col("n_rows")
    return found.filter(F.col("n_rows") >= LEAST_ROWS).select("doc_id", "first_block", "last_block", "n_rows", others.alias("n_others"))


def with_spans(blocks: DataFrame, others: list, stretch: int = STRETCH) -> DataFrame:
    """doc_id, first_block, block_idx, is_row and others of the blocks of the tables that table_spans() finds."""
    w = Window.partitionBy("doc_id", "span")
    rows = _in_spans(blocks, stretch, others)
    rows = rows.withColumns({"first_block": F.min("block_idx").over(w), "last_block": _END().over(w), "n_rows": F.count_if("is_row").over(w)})
    return rows.filter((F.col("n_rows") >= LEAST_ROWS) & (F.col("block_idx") <= F.col("last_block"))).select("doc_id", "first_block", "block_idx", "is_row", *others)
