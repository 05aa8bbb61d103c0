"""Tables from literal lines: columns, spans, wrapped lines, groups, headers and tables of two columns."""

import pytest

from quireflow.operators import table_build
from quireflow.plans.catalogue import QUERIES, SQL

from .compare import spark_rows, sql_rows

DIR = "/root/testdata/sf0.001"
LINES = "doc_id long, table_no long, line_no long, is_row boolean, top double, bottom double, cells array<struct<x0:double,x1:double,text:string>>"


def cell(x0, text, x1=None):
    return (float(x0), float(x1 if x1 is not None else x0 + 6 * len(text)), text)


def lines(spark, items, table=0):
    """items: cells of a row, or (cells, gap) for other text, gap points below the line before."""
    out, top = [], 100.0
    for k, item in enumerate(items):
        row = isinstance(item, list)
        cells, gap = (item, 4.0) if row else item
        top += gap
        out.append((1, table, k, row, top, top + 10.0, cells))
        top += 10.0
    return spark.createDataFrame(out, LINES)


def grid(spark, items):
    out = {}
    for r in table_build.built(lines(spark, items)).orderBy("table_no", "row_no", "col_no").collect():
        out.setdefault(r["row_no"], []).append((r["kind"], r["col_no"], r["colspan"], r["text"]))
    return [row for _, row in sorted(out.items())]


HEAD = [cell(72, "item"), cell(200, "qty"), cell(300, "price")]
ONE, TWO = [cell(72, "bolt"), cell(200, "12"), cell(300, "3.10")], [cell(72, "nut"), cell(200, "7"), cell(300, "0.20")]


def row(kind, *texts):
    return [(kind, k, 1, t) for k, t in enumerate(texts)]


H, A, B = row("header", "item", "qty", "price"), row("row", "bolt", "12", "3.10"), row("row", "nut", "7", "0.20")
CASES = {
    "clean columns with a header": ([HEAD, ONE, TWO], [H, A, B]),
    "numbers in the first row are no header": ([ONE, TWO], [A, B]),
    "a cell over two columns": ([HEAD, ONE, [cell(72, "over both of them now yes", 240), cell(300, "1")], TWO], [H, A, [("row", 0, 2, "over both of them now yes"), ("row", 2, 1, "1")], B]),
    "a missing cell leaves its column empty": ([HEAD, ONE, [cell(72, "x"), cell(300, "9")], TWO], [H, A, [("row", 0, 1, "x"), ("row", 2, 1, "9")], B]),
    "text near the row above belongs to it": ([HEAD, ONE, ([cell(72, "long")], 2.0), TWO], [H, row("row", "bolt long", "12", "3.10"), B]),
    "text near the row below belongs to it": ([HEAD, ONE, ([cell(72, "a")], 5.0), [*TWO]], [H, A, row("row", "a nut", "7", "0.20")]),
    "text far from the row below is a group": ([HEAD, ONE, ([cell(72, "parts")], 14.0), TWO], [H, A, [("group", 0, 3, "parts")], B]),
    "text with a colon is a group": ([HEAD, ONE, ([cell(72, "all:")], 2.0), TWO], [H, A, [("group", 0, 3, "all:")], B]),
    "text over several columns is a group": ([HEAD, ONE, ([cell(72, "text that goes on and on over the columns")], 2.0), TWO], [H, A, [("group", 0, 3, "text that goes on and on over the columns")], B]),
    "one row has no columns": ([HEAD], []),
    "one column is no table": ([[cell(72, "a")], [cell(72, "b")]], []),
    "two columns: text behind a row": ([[cell(72, "name"), cell(200, "first")], ([cell(205, "goes on")], 2.0), [cell(72, "other"), cell(200, "second")]], [row("header", "name", "first goes on"), row("row", "other", "second")]),
    "two columns: text before a row": ([[cell(72, "a"), cell(200, "b")], ([cell(75, "begins")], 2.0), [cell(72, "here"), cell(200, "c")]], [row("header", "a", "b"), row("row", "begins here", "c")]),
    "two columns: texts beside each other": ([[cell(72, "a"), cell(200, "b")], ([cell(50, "far")], 30.0), ([cell(330, "right")], -8.0), [cell(72, "c"), cell(200, "d")]], None),
}


@pytest.mark.parametrize("name", CASES)
def test_built(spark, name):
    items, want = CASES[name]
    if want is not None:
        assert grid(spark, items) == want


def test_two_column_tables_are_drawn_together(spark):
    items, _ = CASES["two columns: texts beside each other"]
    drawn = table_build.compacted(lines(spark, items)).orderBy("line_no").collect()
    assert [(r["is_row"], [c["text"] for c in r["cells"]]) for r in drawn] == [(True, ["a", "b"]), (True, ["far", "right"]), (True, ["c", "d"])]


def test_several_tables_of_a_document(spark):
    both = lines(spark, [HEAD, ONE]).unionByName(lines(spark, [ONE, TWO], table=1))
    found = table_build.built(both).select("table_no", "row_no").distinct().collect()
    assert sorted(map(tuple, found)) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert sorted(tuple(r)[1:] for r in table_build.evaluated(both).collect()) == [(0, 3, 2), (1, 3, 2)]


def test_columns_that_overlap_part_at_their_middle(spark):
    rows = [[cell(72, "a", 100), cell(200, "b", 240)]] * 4 + [[cell(72, "wide", 150), cell(180, "c", 240)], [cell(72, "wider", 190)]]
    cols = table_build.column_spans(lines(spark, rows)).collect()[0]["cols"]
    assert [(c["l"], c["r"]) for c in cols] == [(72.0, 185.0), (185.0, 240.0)]


def test_no_lines(spark):
    assert table_build.built(lines(spark, [HEAD]).limit(0)).count() == 0


@pytest.mark.parametrize("name", ["built_tables", "evaluated_tables"])
def test_same_as_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, DIR)) == sql_rows(SQL[name], DIR)
