"""The decision table of groups: each row is a pair or run of lines and where groups begin."""

from pyspark.sql import functions as F

from quireflow.operators import grouping
from quireflow.plans.catalogue import QUERIES, SQL

from .compare import spark_rows, sql_rows

DIR = "/root/testdata/sf0.001"

COLUMNS = (
    "doc_id long, line_no long, page_idx long, top double, left double, right double, height double, size double, weight int, style string, classes array<string>, text string, "
    "numbered boolean, list_item boolean, ended boolean, caps boolean, nouns boolean, n_words int, blank double, mode double"
)
PLAIN = dict(page_idx=0, left=72.0, right=400.0, height=10.0, size=10.0, weight=400, style="a", classes=None, text="plain words here", numbered=False, list_item=False, ended=False, caps=False, nouns=False, n_words=8, blank=6.0, mode=12.0)


def lines(doc, items):
    """items: what differs from a plain line 12 points below the line before."""
    out, top = [], 60.0
    for k, item in enumerate(items):
        row = PLAIN | item
        top = item.get("top", top + 12.0)
        row |= {"top": top, "classes": row["classes"] or [row["style"]]}
        out.append((doc, k, *[row[c.split()[0]] for c in COLUMNS.split(", ")[2:]]))
    return out


L, END, NUM = {}, {"ended": True}, {"numbered": True, "text": "1. item"}
MID = {"left": 256.0, "right": 356.0}
#: name: lines, and the numbers of those that begin a group.
CASES = {
    # new paragraph
    "lines of one paragraph": ([L, L, L], [0]),
    "more space than the style's mode": ([L, {"top": 87.0}, L], [0, 1]),
    "space within a tenth of the mode": ([L, {"top": 85.0}], [0]),
    "upward": ([{"top": 300.0}, {"top": 270.0, "left": 72.0}], [0, 1]),
    "far upward while the sentence goes on": ([{"top": 700.0}, {"top": 80.0}], [0]),
    "far upward behind a sentence": ([{"top": 700.0} | END, {"top": 80.0}], [0, 1]),
    "no mode here, one before": ([L, {"mode": None, "top": 85.0}], [0]),
    "no modes, a tight gap": ([L | {"mode": None}, {"mode": None}], [0]),
    "no modes, a wide gap": ([L | {"mode": None}, {"mode": None, "top": 99.0}], [0, 1]),
    "a shift of more than 200 to the left": ([{"left": 290.0, "right": 400.0}, {"left": 72.0}], [0, 1]),
    "a shift of less to the left": ([{"left": 150.0}, L], [0]),
    "a shift of 80 in the right half": ([{"left": 420.0, "right": 560.0}, {"left": 330.0, "right": 560.0}], [0, 1]),
    "a numbered first line may shift back while its sentence goes on": ([NUM | {"left": 290.0}, {"left": 72.0}], [0]),
    "a high step": ([L | {"mode": 40.0}, {"top": 99.0, "mode": 40.0, "left": 90.0}], [0, 1]),
    "a high step at the same left while the sentence goes on": ([{"mode": 40.0, "height": 20.0}, {"top": 99.0, "mode": 40.0}], [0]),
    "a step just above twice the size": ([{"mode": 40.0}, {"top": 92.2, "mode": 40.0, "left": 90.0}], [0]),
    "a sentence's end lowers the step to 1.8": ([END | {"mode": 40.0}, {"top": 91.0, "mode": 40.0, "left": 90.0}], [0, 1]),
    "a numbered line behind a sentence at 1.5": ([END | {"mode": 40.0}, NUM | {"top": 88.0, "mode": 40.0}], [0, 1]),
    "centred, then not": ([MID, {"left": 72.0, "right": 300.0}], [0, 1]),
    "numbered lines of one style": ([NUM, NUM | {"text": "2. item"}, NUM | {"text": "3. item"}], [0, 1, 2]),
    "far to the right on the next line": ([L, {"left": 290.0, "right": 500.0}], [0, 1]),
    "capitals, then none": ([{"caps": True}, {"top": 83.0}, L], [0, 1]),
    "capitals of nouns, then none": ([{"caps": True, "nouns": True}, {"top": 83.0}], [0]),
    # change of class
    "another style": ([L, {"style": "b", "weight": 700}], [0, 1]),
    "another style that is hardly another": ([L, {"style": "b", "size": 10.5}], [0]),
    "hardly another behind a sentence": ([END, {"style": "b", "size": 10.5}], [0, 1]),
    "the last class is among the first three": ([L | {"classes": ["a", "b"]}, {"style": "b", "classes": ["c", "b"]}], [0]),
    "the last class comes fourth": ([L, {"style": "b", "weight": 700, "classes": ["b", "c", "d", "a"]}], [0, 1]),
    # superscripts
    "a raised mark in another style": ([L, {"style": "s", "size": 6.0, "weight": 300, "left": 402.0, "right": 406.0, "top": 68.0}], [0]),
    "what follows a raised mark": ([L, {"style": "s", "weight": 300, "left": 402.0, "right": 406.0, "top": 68.0, "height": 6.0}, {"top": 72.0, "left": 408.0, "right": 500.0}], [0, 2]),
    # pages
    "a paragraph goes on over the page": ([L, {"page_idx": 1, "top": 72.0}], [0]),
    "a sentence ends with the page": ([END, {"page_idx": 1, "top": 72.0}], [0, 1]),
    "a numbered line on the next page": ([L, NUM | {"page_idx": 1, "top": 72.0}], [0, 1]),
    "a short line before the page's end": ([{"right": 200.0}, {"page_idx": 1, "top": 72.0}], [0, 1]),
    "a centred line on the next page": ([L, MID | {"page_idx": 1, "top": 72.0}], [0, 1]),
    "another style on the next page": ([L, {"page_idx": 1, "top": 72.0, "weight": 700, "style": "b"}], [0, 1]),
    # rows of tables
    "cells of a row are one group": ([{"right": 120.0}, {"top": 72.0, "left": 200.0, "right": 250.0}, {"top": 72.0, "left": 300.0, "right": 350.0}], [0]),
    "each row is a group": ([{"right": 120.0}, {"top": 72.0, "left": 200.0, "right": 250.0}, {"top": 84.0, "right": 120.0}, {"top": 84.0, "left": 200.0, "right": 250.0}], [0, 2]),
    "a cell's second line belongs to its row": ([{"right": 120.0}, {"top": 72.0, "left": 200.0, "right": 300.0}, {"top": 84.0, "left": 200.0, "right": 280.0}], [0]),
    "a word further on is no cell": ([{"right": 120.0}, {"top": 72.0, "left": 130.0, "right": 250.0}], [0]),
    "back to the left on the same line": ([{"left": 300.0, "mode": 5.0}, {"top": 74.0, "left": 72.0, "right": 200.0, "mode": 1.0}], [0, 1]),
    # lists
    "list items": ([L, {"list_item": True, "text": "• one two three"}, {"list_item": True, "text": "• four"}], [0, 1, 2]),
    "an item's second line": ([{"list_item": True, "text": "• one"}, {"left": 80.0}], [0]),
    "a wide step behind an item": ([{"list_item": True, "text": "• one"}, {"top": 100.0}], [0, 1]),
    "an item out of order": ([{"list_item": True, "text": "•", "top": 90.0}, {"top": 86.0, "left": 420.0, "right": 560.0}], [0, 1]),
    "an item on the line of another word": ([L, L | {"right": 120.0}, {"top": 84.0, "left": 130.0, "list_item": True}], [0]),
}


def test_decision_table(spark):
    rows = [r for k, (items, _) in enumerate(CASES.values()) for r in lines(k, items)]
    found = {}
    for r in grouping.grouped(spark.createDataFrame(rows, COLUMNS)).collect():
        found.setdefault(r["doc_id"], set()).add(r["group"])
    wrong = {name: (sorted(found[k]), want) for k, (name, (_, want)) in enumerate(CASES.items()) if sorted(found[k]) != want}
    assert not wrong


def test_query_same_as_sql(spark):
    assert spark_rows(QUERIES["line_groups"](spark, DIR)) == sql_rows(SQL["line_groups"], DIR)


def test_stretches_are_what_a_whole_fold_gives(spark):
    """Cutting a document where a group surely begins changes nothing."""
    pages = [[L, END, L], [NUM, L, {"right": 120.0}], [{"left": 300.0}, MID, {"style": "b", "weight": 700}], [L, {"list_item": True, "text": "• a"}, L]]
    items = [x | ({"top": 72.0} if k == 0 else {}) | {"page_idx": n} for n, page in enumerate(pages * 3) for k, x in enumerate(page)]
    pairs = grouping.with_pairs(spark.createDataFrame(lines(1, items), COLUMNS))
    assert pairs.select("stretch").distinct().count() > 3
    whole = grouping.group_starts(pairs.withColumn("stretch", F.lit(1))).collect()
    assert sorted(whole) == sorted(grouping.group_starts(pairs).collect())
