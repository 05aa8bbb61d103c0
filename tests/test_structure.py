"""Levels, chains, table spans, groups of lines and table regions on literal rows."""

import random

import pytest

from quireflow.operators import levels, spans
from quireflow.plans.catalogue import QUERIES, SQL

from .compare import spark_rows, sql_rows

DIR = "/root/testdata/sf0.001"
BLOCK = "doc_id long, block_idx long, block_type string, block_text string, left double, right double, top double, size double, weight int"


def blocks(spark, rows, doc=1):
    """rows: type, text and, where they are not the usual, left, size, weight."""
    full = []
    for k, (kind, text, *rest) in enumerate(rows):
        left, size, weight = [*rest, *(72.0, 10.0, 400)[len(rest) :]]
        full.append((doc, k, kind, text, left, left + 6.0 * len(text), 72.0 + 14 * k, size, weight))
    return spark.createDataFrame(full, BLOCK)


def levels_of(spark, rows):
    return [r["level"] for r in levels.stack_levels(blocks(spark, rows)).orderBy("block_idx").collect()]


H = (72.0, 12.0, 700)
CASES = {
    "children of headings": ([("header", "One", *H), ("para", "x"), ("header", "Two", *H), ("para", "y")], [0, 1, 0, 1]),
    "ordinals go on after a paragraph": ([("header", "One", *H), ("list_item", "(b) first"), ("para", "text between"), ("list_item", "(c) second"), ("header", "Two", *H), ("para", "y")], [0, 1, 1, 1, 0, 1]),
    "a gap of two goes on, of three does not": ([("header", "One", *H), ("list_item", "2. a"), ("list_item", "4. b"), ("list_item", "9. c"), ("header", "Two", *H)], [0, 1, 1, 1, 0]),
    "another list type goes below": ([("header", "One", *H), ("list_item", "1. a"), ("list_item", "(b) c"), ("list_item", "(c) d"), ("list_item", "2. e"), ("header", "Two", *H)], [0, 1, 2, 2, 1, 0]),
    "capitals go back to the top": ([("header", "FIRST PART", *H), ("header", "Sub", 72.0, 11.0, 700), ("para", "x"), ("header", "SECOND PART", *H), ("para", "y")], [0, 1, 2, 0, 1]),
    "a lighter heading goes below": ([("header", "Big", 72.0, 14.0, 700), ("header", "Light", 72.0, 14.0, 400), ("para", "x", 72.0, 10.0, 400), ("header", "Big too", 72.0, 14.0, 700)], [0, 1, 2, 0]),
    "indented by less than 30 is the same level": ([("header", "A", *H), ("para", "x"), ("para", "y", 95.0), ("header", "B", *H)], [0, 1, 1, 0]),
    "one block at the top is no level": ([("header", "Title", 72.0, 18.0, 700), ("header", "A", *H), ("para", "x"), ("header", "B", *H)], [0, 0, 1, 0]),
}


@pytest.mark.parametrize("name", CASES)
def test_levels(spark, name):
    rows, want = CASES[name]
    assert levels_of(spark, rows) == want


def test_a_lone_heading_is_a_paragraph(spark):
    rows = [("header", "A", *H), ("header", "Lone", 72.0, 11.0, 700), ("header", "B", *H), ("para", "x")]
    found = levels.stack_levels(blocks(spark, rows)).orderBy("block_idx").collect()
    assert [(r["level"], r["block_type"]) for r in found] == [(0, "header"), (1, "para"), (0, "header"), (1, "para")]


def test_chains(spark):
    rows = [(1, 0, "header", 0), (1, 1, "header", 2), (1, 2, "para", 3), (1, 3, "header", 1), (1, 4, "para", 2), (1, 5, "header", 1), (1, 6, "header", 0), (1, 7, "para", 1), (2, 0, "para", 0)]
    df = spark.createDataFrame(rows, "doc_id long, block_idx long, block_type string, level int")
    found = levels.heading_chains(df, 4).orderBy("doc_id", "block_idx").collect()
    assert [r["chain"] for r in found] == [[], [0], [1, 0], [0], [3, 0], [0], [], [6], []]


ROWS = "doc_id long, block_idx long, page_idx long, top double, height double, left double, size double, weight int, is_row boolean, cells array<double>, n_words long, centred_italic boolean"


def span_rows(spark, items, doc=1):
    """items: a list of cells for a row, (words, left, gap) for other blocks, 'page' for a page's end."""
    out, page, top, k = [], 0, 72.0, 0
    for x in items:
        if x == "page":
            page, top = page + 1, 72.0
            continue
        row = isinstance(x, list)
        words, left, gap, *more = (len(x), x[0] if x else 72.0, 4.0) if row else x
        top += 10.0 + gap
        weight, italic = [*more, *(400, False)[len(more) :]]
        out.append((doc, k, page, top, 10.0, float(left), 10.0, weight, row, [float(c) for c in x] if row else [float(left)], words, italic))
        k += 1
    return spark.createDataFrame(out, ROWS)


R, TEXT = [72, 200, 300], (8, 90, 4.0)
SPAN_CASES = {
    "rows in a row": ([TEXT, R, R, R, TEXT, TEXT, TEXT], [(1, 3, 3, 0)]),
    "one row is no table": ([R, TEXT, TEXT, TEXT], []),
    "two others between rows belong to it": ([R, R, TEXT, TEXT, R, TEXT, TEXT, TEXT, R], [(0, 4, 3, 2)]),
    "three others end it": ([R, R, TEXT, TEXT, TEXT, R, R], [(0, 1, 2, 0), (5, 6, 2, 0)]),
    "aligned text counts as a row's": ([R, R, (3, 72, 4.0), TEXT, TEXT, R], [(0, 5, 3, 3)]),
    "a long line in another style ends it": ([R, R, (15, 90, 4.0, 700), R, R], [(0, 1, 2, 0), (3, 4, 2, 0)]),
    "far text behind one row": ([R, (3, 90, 30.0), (3, 90, 30.0), R, R], [(3, 4, 2, 0)]),
    "columns that do not align": ([R, R, [100, 250, 400], [100, 250, 400]], [(0, 1, 2, 0), (2, 3, 2, 0)]),
    "more columns than before": ([R, R, [72, 200, 300, 400], [72, 200, 300, 400]], [(0, 1, 2, 0), (2, 3, 2, 0)]),
    "three columns end with the page": ([R, R, "page", R, R], [(0, 1, 2, 0), (2, 3, 2, 0)]),
    "two columns go on over the page": ([[72, 200], [72, 200], "page", [72, 200]], [(0, 2, 3, 0)]),
    "two columns end at text on the next page": ([[72, 200], [72, 200], "page", TEXT, [72, 200]], [(0, 1, 2, 0)]),
    "a centred line in italics ends it": ([R, R, (3, 90, 4.0, 400, True), R, R], [(0, 1, 2, 0), (3, 4, 2, 0)]),
}


@pytest.mark.parametrize("name", SPAN_CASES)
def test_table_spans(spark, name):
    items, want = SPAN_CASES[name]
    assert sorted(tuple(r)[1:] for r in spans.table_spans(span_rows(spark, items)).collect()) == want


def test_stretches_do_not_matter(spark):
    rng = random.Random(4)
    letters = [[rng.randrange(7) for _ in range(n)] for n in (1, 7, 200)]
    rows = [(d, k, x, x < 2) for d, doc in enumerate(letters) for k, x in enumerate(doc)]
    df = spark.createDataFrame(rows, "doc_id long, block_idx long, letter int, is_row boolean")
    want = []
    for d, doc in enumerate(letters):
        state = 0
        for k, x in enumerate(doc):
            before, state = state, spans.TABLE[x][state]
            want.append((d, k, before, state))
    for stretch in (1, 3, 64, 1000):
        found = spans.with_states(df, stretch).select("doc_id", "block_idx", "before", "state").collect()
        assert sorted(map(tuple, found)) == want


@pytest.mark.parametrize("name", ["stack_levels", "level_chain", "statement_table_spans"])
def test_same_as_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, DIR)) == sql_rows(SQL[name], DIR)
