"""Table regions, claims on words and ruled grids on literal pages, and the queries against SQL."""

import pytest

from quireflow.operators import regions, rulings
from quireflow.plans.catalogue import QUERIES, SQL

from .compare import spark_rows, sql_rows

DIR = "/root/testdata/sf0.001"
WORDS = "doc_id long, line_no long, word_id long, word string, x0 double, x1 double, top double, bottom double"


def page(spark, lines, doc=1):
    """lines: (top, [(left, text), ...]); a text is one word for each of its parts."""
    rows = []
    for no, (top, cells) in enumerate(lines):
        for left, text in cells:
            for word in text.split():
                rows.append((doc, no, len(rows), word, float(left), left + 6.0 * len(word), float(top), top + 10.0))
                left += 6 * len(word) + 3
    return spark.createDataFrame(rows, WORDS)


def row(top, *cells):
    return (top, list(zip((72, 200, 300, 400), cells)))


PROSE = "this line of prose goes on over the whole width of the page without any gap"


def found(spark, lines):
    return [(r["region"], r["top"], r["bottom"]) for r in regions.regions(page(spark, lines)).orderBy("region").collect()]


GRID = [row(100, "name", "qty", "price"), row(112, "bolt", "12", "3.10"), row(124, "nut", "7", "0.20")]
REGIONS = {
    "a grid": (GRID, [(0, 100.0, 134.0)]),
    "two lines are too few": (GRID[:2], []),
    "two tables parted by prose": ([*GRID, (136, [(72, PROSE)]), (148, [(72, PROSE)]), *[(t + 70, c) for t, c in GRID]], [(0, 100.0, 134.0), (5, 170.0, 204.0)]),
    "a caption between rows belongs to them": ([*GRID, (136, [(72, "totals:")]), *[(t + 48, c) for t, c in GRID]], [(0, 100.0, 182.0)]),
    "two labels between rows are bridged": ([*GRID, (136, [(72, "part")]), (148, [(72, "two:")]), *[(t + 60, c) for t, c in GRID]], [(0, 100.0, 194.0)]),
    "a gap of more than 48 points is not": ([*GRID, (136, [(72, "part")]), (160, [(72, "two:")]), *[(t + 90, c) for t, c in GRID]], [(0, 100.0, 134.0), (5, 190.0, 224.0)]),
    "labels and numbers in two columns": ([row(100, "name", "12"), row(112, "more", "3.10"), row(124, "less", "1,000")], [(0, 100.0, 134.0)]),
    "prose in two columns is none": ([row(100, "name and", "of them"), row(112, "more of", "which are"), row(124, "less than", "most")], []),
    "channels that do not meet": ([*GRID, (136, [(72, "wide " * 14), (500, "x")]), (148, [(72, "wide " * 14), (500, "x")])], [(0, 100.0, 134.0)]),
}


@pytest.mark.parametrize("name", REGIONS)
def test_regions(spark, name):
    lines, want = REGIONS[name]
    assert found(spark, lines) == want


def test_no_words_no_regions(spark):
    assert regions.regions(page(spark, GRID).limit(0)).count() == 0


CANDIDATE = "doc_id long, candidate string, priority long, x0 double, top double, x1 double, bottom double"


def claims(spark, candidates):
    words = page(spark, [row(100 + 12 * k, "a", "b", "c", "d") for k in range(5)])
    rows = [(1, name, k, 0.0, float(top), 600.0, float(bottom)) for k, (name, top, bottom) in enumerate(candidates)]
    out = {}
    for r in regions.claimed(words, spark.createDataFrame(rows, CANDIDATE)).collect():
        out.setdefault(r["candidate"], []).append(r["word_id"])
    return {k: sorted(v) for k, v in out.items()}


def test_first_candidates_claim_first(spark):
    assert claims(spark, [("one", 95, 125), ("two", 110, 150)]) == {"one": list(range(8)), "two": list(range(8, 16))}


def test_what_is_left_with_too_few_words_claims_none(spark):
    half = {"one": list(range(8)), "three": list(range(8, 20))}
    assert claims(spark, [("one", 95, 125), ("two", 110, 124), ("three", 95, 170)]) == half


def test_a_refused_candidate_does_not_keep_others_waiting(spark):
    words = page(spark, [(100, [(72, "a"), (200, "b")]), (112, [(72, "c"), (200, "d"), (300, "e")])])
    rows = [(1, "small", 0, 0.0, 95.0, 600.0, 111.0), (1, "all", 1, 0.0, 95.0, 600.0, 170.0)]
    found = regions.claimed(words, spark.createDataFrame(rows, CANDIDATE)).collect()
    assert sorted((r["word_id"], r["candidate"]) for r in found) == [(k, "all") for k in range(5)]


def test_no_word_in_two_tables(spark):
    rows = QUERIES["claimed_words"](spark, DIR)
    assert rows.count() == rows.select("doc_id", "word_id").distinct().count() > 0


RULE = "doc_id long, orientation string, x0 double, top double, x1 double, bottom double"


def rules(spark, xs, ys, doc=1, without=()):
    """Rules from the first to the last of the other places, in pieces; without: pieces (orientation, place, k) that are left out."""
    rows = [(doc, "h", float(a), float(y), float(b), float(y)) for y in ys for k, (a, b) in enumerate(zip(xs, xs[1:])) if ("h", y, k) not in without]
    rows += [(doc, "v", float(x), float(a), float(x), float(b)) for x in xs for k, (a, b) in enumerate(zip(ys, ys[1:])) if ("v", x, k) not in without]
    return spark.createDataFrame(rows, RULE)


def grid(spark, rules_, words):
    out = {}
    for r in rulings.ruled_grids(rules_, words).orderBy("table_no", "row_no", "col_no").collect():
        out.setdefault(r["table_no"], {}).setdefault(r["row_no"], []).append((r["text"], r["colspan"]))
    return [[cells for _, cells in sorted(rows.items())] for _, rows in sorted(out.items())]


XS, YS = (60, 190, 290, 390), (640, 654, 668)


def test_a_stroked_grid(spark):
    words = page(spark, [row(642, "a", "b", "c"), row(656, "d e", "", "f")])
    assert grid(spark, rules(spark, XS, YS), words) == [[[("a", 1), ("b", 1), ("c", 1)], [("d e", 1), ("", 1), ("f", 1)]]]


def test_spans_are_repeated(spark):
    words = page(spark, [row(642, "both", "", "c"), row(656, "d", "e", "f")])
    assert grid(spark, rules(spark, XS, YS, without={("v", 190, 0)}), words) == [[[("both", 2), ("both", 2), ("c", 1)], [("d", 1), ("e", 1), ("f", 1)]]]


def test_captions_and_spacers(spark):
    xs = (60, 190, 198, 290)
    words = page(spark, [(642, [(72, "title of it")]), (656, [(72, "a"), (200, "b")])])
    cut = {("v", 190, 0), ("v", 198, 0)}
    rows = rulings.ruled_grids(rules(spark, xs, YS, without=cut), words).orderBy("row_no", "col_no").collect()
    assert [(r["row_no"], r["col_no"], r["is_caption"], r["text"]) for r in rows] == [(0, 0, True, "title of it"), (0, 1, True, "title of it"), (1, 0, False, "a"), (1, 1, False, "b")]


def test_two_tables_on_a_page_and_broken_rules(spark):
    words = page(spark, [row(642, "a", "b"), row(656, "c", "d"), row(742, "e", "f"), row(756, "g", "h")])
    shaky = rules(spark, (60, 190, 290), YS).unionByName(rules(spark, (61, 191, 291), (740, 755, 768)))
    assert grid(spark, shaky, words) == [[[("a", 1), ("b", 1)], [("c", 1), ("d", 1)]], [[("e", 1), ("f", 1)], [("g", 1), ("h", 1)]]]


def test_one_row_or_no_text_is_no_table(spark):
    assert grid(spark, rules(spark, XS, YS[:2]), page(spark, [row(642, "a")])) == []
    assert grid(spark, rules(spark, XS, YS), page(spark, [row(100, "a")])) == []


def test_rules_that_nearly_meet_are_one(spark):
    df = spark.createDataFrame([(1, "h", 0.0, 100.0, 50.0, 100.0), (1, "h", 52.0, 101.0, 90.0, 101.0), (1, "h", 95.0, 100.0, 99.0, 100.0), (1, "v", 10.0, 0.0, 10.0, 9.0)], RULE)
    assert sorted((r["orientation"], r["at"], r["lo"], r["hi"]) for r in rulings.snapped(df).collect()) == [("h", 100.0, 0.0, 90.0), ("h", 100.0, 95.0, 99.0), ("v", 10.0, 0.0, 9.0)]


@pytest.mark.parametrize("name", ["page_regions", "claimed_words", "ruled_tables"])
def test_same_as_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, DIR)) == sql_rows(SQL[name], DIR)
