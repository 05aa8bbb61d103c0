"""Operators on small made-up rows."""

from pyspark.sql import functions as F

from quireflow.operators import filters, formation, hierarchy, metrics, spatial, strict, tables
from quireflow.sources import files


def test_fragments_are_joined(spark):
    rows = [(1, 0, 0, "A", 10.0, 16.0, 10.0), (1, 0, 1, "bou", 16.2, 30.0, 10.0), (1, 0, 2, "t", 30.5, 34.0, 10.0), (1, 0, 3, "it", 37.0, 44.0, 10.0)]
    df = spark.createDataFrame(rows, "doc_id long, line_no long, piece_no long, piece string, x0 double, x1 double, size double")
    assert [r["word"] for r in formation.merged_fragments(df).orderBy("word_no").collect()] == ["About", "it"]


def test_two_columns_have_one_gutter_and_column_order(spark):
    rows = []
    for k in range(12):
        for n in range(6):
            rows += [(1, 0, float(100 + 16 * k), n, 40.0 + 35 * n, 70.0 + 35 * n), (1, 0, float(100 + 16 * k), 6 + n, 320.0 + 35 * n, 350.0 + 35 * n)]
    words = spark.createDataFrame(rows, "doc_id long, page_idx long, top double, word_no long, x0 double, x1 double")
    gutters = formation.gutter_runs(words, 600.0).filter("left > 240 AND right < 330").collect()
    assert len(gutters) == 1
    middle = spark.createDataFrame([tuple(gutters[0])], "doc_id long, page_idx long, left double, right double")
    ordered = formation.column_major(words, middle).orderBy("reading_no").collect()
    assert [r["col"] for r in ordered] == [0] * 72 + [1] * 72


def test_single_column_has_no_gutter(spark):
    rows = [(1, 0, float(100 + 16 * k), n, 40.0 + 28 * n, 66.0 + 28 * n + (k % 3)) for k in range(12) for n in range(16)]
    words = spark.createDataFrame(rows, "doc_id long, page_idx long, top double, word_no long, x0 double, x1 double")
    assert formation.gutter_runs(words, 600.0).count() == 0


def test_channels_cut_a_grid(spark):
    rows = [(1, r, 0, x, x + 30.0) for r in range(5) for x in (50.0, 150.0, 250.0)]
    words = spark.createDataFrame(rows, "doc_id long, line_no long, word_no long, x0 double, x1 double")
    cuts = tables.channel_cuts(words)
    assert cuts.count() == 2
    assert {r["col"] for r in tables.assigned_cells(words, cuts).collect()} == {0, 1, 2}


def test_smallest_box_holds_a_point(spark):
    points = spark.createDataFrame([(1, 0, 5.0, 5.0), (1, 1, 50.0, 50.0)], "doc_id long, id long, x double, y double")
    boxes = spark.createDataFrame([(1, 0, 0.0, 0.0, 100.0, 100.0), (1, 1, 0.0, 0.0, 10.0, 10.0)], "doc_id long, block_idx long, left double, top double, right double, bottom double")
    assert {r["id"]: r["block_idx"] for r in spatial.smallest_around(points, boxes, ["doc_id", "id"]).collect()} == {0: 1, 1: 0}


def test_tree_walk_ends_at_a_cycle_and_a_missing_parent(spark):
    rows = [(1, 0, None), (1, 1, 0), (1, 2, 1), (1, 5, 9), (1, 7, 8), (1, 8, 7)]
    nodes = spark.createDataFrame(rows, "doc_id long, id long, parent long")
    found = {r["id"]: (r["depth"], r["root"]) for r in hierarchy.with_depth_and_root(nodes).collect()}
    assert found[2] == (2, 0) and found[5] == (0, 5) and found[7] == found[8] == (None, None)


def test_trees_of_any_depth_and_rows_behind_a_cycle(spark):
    rows = [(1, k, k - 1 if k else None) for k in range(41)] + [(2, 0, 1), (2, 1, 0), (2, 2, 1), (2, 3, 2), (3, 4, 4)]
    nodes = spark.createDataFrame(rows, "doc_id long, id long, parent long")
    found = {(r["doc_id"], r["id"]): (r["depth"], r["root"]) for r in hierarchy.with_depth_and_root(nodes).collect()}
    assert [found[1, k] for k in range(41)] == [(k, 0) for k in range(41)]
    assert {v for k, v in found.items() if k[0] != 1} == {(None, None)}


def test_parents_at_many_levels(spark):
    rows = [(1, k, k) for k in range(9)] + [(1, 9, 3), (1, 10, 12)]
    found = hierarchy.with_parents(spark.createDataFrame(rows, "doc_id long, line_no long, level int")).orderBy("line_no").collect()
    assert [r["parent"] for r in found] == [None, *range(8), 2, 9]


def test_words_behind_a_heading_go_to_the_next_block(spark):
    blocks = [(0, True, "6.6 Taxes."), (1, False, "Each Party shall pay its taxes"), (2, True, "Term"), (3, False, "It ends"), (4, False, "soon")]
    words = [("6.6", 0), ("Taxes.", 0), ("Each", 0), ("party", 0), ("shall", 1), ("pay", 1), ("its", 1), ("taxes", 1), ("Term", 2), ("x", 2), ("It", 3), ("ends", 3), ("soon", 3), ("y", None)]
    known = spark.createDataFrame([(1, *b) for b in blocks], "doc_id long, block_idx long, is_header boolean, text string")
    held = spark.createDataFrame([(1, k, *w) for k, w in enumerate(words)] + [(2, 0, "z", None)], "doc_id long, token_no long, word string, block_idx long")
    found = strict.runin_restored(held, known).orderBy("doc_id", "token_no").collect()
    assert [r["block_idx"] for r in found] == [0, 0, 1, 1, 1, 1, 1, 1, 2, 2, 3, 3, 3, None, None]


def test_running_heads_are_one_within_twenty_points(spark):
    rows = [(1, p, 39.0 if p % 2 else 41.0, 72.0, "Report %d" % p) for p in range(6)] + [(1, p, 100.0 + 30 * p, 72.0, "Moving") for p in range(1, 3)] + [(1, 0, 75.0, 300.0, "once"), (1, 5, 75.0, 319.0, "once")]
    rows += [(2, p, 750.0, 300.0, str(p)) for p in (0, 1, 2)] + [(2, p, 400.0, 72.0, "body") for p in range(20)]
    lines = spark.createDataFrame(rows, "doc_id long, page_idx long, top double, left double, text string")
    found = {(r["doc_id"], r["zone"], r["text_key"], r["top"], r["n_pages"]) for r in filters.repeated_edges(lines, 792.0).collect()}
    assert found == {(1, "header", "Report", 39.0, 6), (1, "header", "Report", 41.0, 6), (2, "footer", "", 750.0, 3)}


def test_segmentation_scores(spark):
    rows = [(1, k, r, r) for k, r in enumerate([0, 1, 0, 0, 1, 0, 0, 0])] + [(2, k, r, h) for k, (r, h) in enumerate(zip([0, 1, 0, 0], [0, 0, 1, 0], strict=True))]
    masks = spark.createDataFrame(rows, "doc_id long, i long, ref long, hyp long")
    found = {r["doc_id"]: r for r in metrics.window_scores(masks, "doc_id", "i").collect()}
    assert found[1]["pk"] == 0 and found[1]["windowdiff"] == 0
    assert found[2]["k"] == 2 and found[2]["pk"] > 0


def test_furniture(spark):
    rows = spark.createDataFrame([("105",), ("F-18",), ("iii",), ("ARTICLE 9",), ("a@b.org",), ("www.x.org",), ("",), ("Definitions",)], "t string")
    assert [r[0] for r in rows.select(filters.is_furniture(F.col("t"))).collect()] == [True, True, True, False, True, True, False, False]


def test_cheapest_words():
    cost = {"the": 1.0, "cat": 2.0, "sat": 2.0, "at": 3.0}
    assert strict._cheapest("thecatsat", cost, 3) == ["the", "cat", "sat"]


def test_all_words_of_a_line_come_apart(spark):
    text = "The cat sat on the mat, and 12 été cats sat under it on 3 mats."
    lines = spark.createDataFrame([(1, 0, text), (1, 1, "the  cat"), (1, 2, " ")], "doc_id long, line_no long, text string")
    found = strict.split_run_together(lines).orderBy("line_no", "run_no").collect()
    assert [(r["line_no"], r["run_no"]) for r in found] == [(0, 0), (0, 1), (0, 2), (1, 0)]
    assert "".join(r["run"] for r in found[:3]) == text.lower().replace(" ", "")
    assert " ".join(r["words"] for r in found[:3]) == "the cat sat on the mat , and 12 été cats sat under it on 3 mats ."
    assert found[3]["words"] == "the cat"


def test_all_wide_gaps_of_a_level_part_a_page(spark):
    words = spark.createDataFrame([(1, 0, 100.0 * k + 12 * n) for k in range(10) for n in range(3)], "doc_id long, page_idx long, top double")
    found = strict.xy_cut(words).orderBy("region").collect()
    assert [(r["n_rows"], r["top"], r["bottom"]) for r in found] == [(3, 100.0 * k, 100.0 * k + 24) for k in range(10)]


def test_failing_pages_do_not_end_the_job(spark):
    rows = spark.createDataFrame([("a", b"x"), ("b", b"bad"), ("c", b"")], "path string, content binary")

    def decode(content):
        if content == b"bad":
            raise ValueError("broken file")
        yield content.decode()
        yield RuntimeError("page 2")

    found = files.decoded_pages(rows, decode).orderBy("path", "page_idx").collect()
    assert [(r["path"], r["text"], r["error"]) for r in found] == [("a", "x", None), ("a", "", "page 2"), ("b", "", "broken file"), ("c", "", None), ("c", "", "page 2")]


def test_word_source(spark, tmp_path):
    (tmp_path / "one.txt").write_text("ab cde\nf\n")
    files.register(spark)
    rows = spark.read.format("layout_words").option("path", str(tmp_path)).load().orderBy("line_no", "word_no").collect()
    assert [(r["word"], r["x0"], r["x1"], r["top"]) for r in rows] == [("ab", 72.0, 84.0, 72.0), ("cde", 90.0, 108.0, 72.0), ("f", 72.0, 78.0, 84.0)]
