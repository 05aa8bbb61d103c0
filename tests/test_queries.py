"""Queries against their SQL, on the smallest tables. All of them with QUIREFLOW_ALL=1."""

import os

import pytest

import __spark_entry__ as entry
from quireflow.plans.catalogue import QUERIES, SQL

from .compare import spark_rows, sql_rows

DIR = "/root/testdata/sf0.001"
SOME = (
    "line_type_counts statement_line_features words_from_documents html_blocks word_numeric_flags sentences_core roman_to_int enum_level fragment_merge gutter_histogram gutter_runs prose_columns column_major_order repeated_header_footer "
    "style_space_stats block_types merge_paragraphs tree_depth channel_cuts symbol_column_merge token_in_block asof_heading resolve_labels unit_edges markdown_pages effective_recall pairwise_f1 windowdiff_score streamed_line_types"
).split()
ALL = bool(os.environ.get("QUIREFLOW_ALL"))


@pytest.mark.parametrize("name", sorted(SQL) if ALL else SOME)
def test_same_as_sql(spark, name):
    columns, rows = spark_rows(QUERIES[name](spark, DIR))
    want_columns, want = sql_rows(SQL[name], DIR)
    assert columns == want_columns
    assert rows == want
    assert rows


@pytest.mark.parametrize("name", ["xycut_strict", "grid_regions_strict", "infer_grid_strict", "file_properties"] if not ALL else sorted(set(QUERIES) - set(SQL)))
def test_rows_without_sql(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["block_text", "numbering_units", "column_major_order"])
def test_partitions_do_not_matter(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for n in ("1", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(spark_rows(QUERIES[name](spark, DIR)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]


def test_every_word_has_a_place_in_a_column(spark):
    words = {(r["doc_id"], r["line_no"], r["word_no"]) for r in QUERIES["words_from_documents"](spark, DIR).select("doc_id", "line_no", "word_no").collect()}
    placed = [(r["doc_id"], r["line_no"], r["word_no"]) for r in QUERIES["column_major_order"](spark, DIR).collect()]
    assert len(placed) == len(words) and set(placed) == words
    rows = QUERIES["order_fixer_strict"](spark, DIR)
    assert rows.count() == rows.select("doc_id", "line_no", "row_no").distinct().count() > QUERIES["lines_from_documents"](spark, DIR).count()
