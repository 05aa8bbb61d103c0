"""Blocks and the words in their boxes, worked out in batches of statements."""

import random

import duckdb
import numpy as np
import pytest

from quireflow.operators import layouts
from quireflow.plans.catalogue import QUERIES, SQL

from .compare import TABLES, spark_rows, sql_rows
from .test_queries import DIR
from .test_scale import plan


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Statements without a key, without rows or without an order, with names that are blank, padded or of many blanks, and images over all of a page."""
    path = tmp_path_factory.mktemp("odd")
    con = duckdb.connect()
    changed = {
        "customer": "SELECT * REPLACE (CASE c_custkey % 7 WHEN 0 THEN '  ' WHEN 1 THEN ' The  Old   House ' WHEN 2 THEN NULL WHEN 3 THEN '12 3 4' ELSE c_name END AS c_name) FROM t",
        "orders": "SELECT * REPLACE (CASE WHEN o_orderkey % 97 <> 0 THEN o_orderkey END AS o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS o_orderpriority) FROM t WHERE o_orderkey % 13 <> 0 AND (o_orderkey % 97 <> 0 OR o_orderkey = 97)",
        "lineitem": "SELECT * REPLACE (CASE WHEN l_orderkey <> 97 THEN l_orderkey END AS l_orderkey) FROM t WHERE l_orderkey % 5 <> 0 AND (l_orderkey % 97 <> 0 OR l_orderkey = 97)",
        "part": "SELECT * REPLACE (CASE p_partkey % 9 WHEN 0 THEN ' ' WHEN 1 THEN ' long  name, that goes on. ' ELSE p_name END AS p_name) FROM t WHERE p_partkey % 17 <> 0",
    }
    for t in TABLES:
        con.execute(f"CREATE OR REPLACE VIEW t AS SELECT * FROM '{DIR}/{t}.parquet'")
        con.execute(f"COPY ({changed.get(t, 'SELECT * FROM t')}) TO '{path}/{t}.parquet' (FORMAT parquet)")
    return str(path)


def same(spark, name, odd):
    columns, rows = spark_rows(QUERIES[name](spark, odd))
    assert (columns, rows) == sql_rows(SQL[name], odd)
    assert rows


def moved(spark, name):
    """By what rows are dealt out, and how often a document's lines are made."""
    found = plan(QUERIES[name](spark, DIR))
    return [x.split("hashpartitioning(")[1].split(")")[0] for x in found.split("\n") if "Exchange hashpartitioning(" in x], found


def words_stay(spark, name):
    """Lines go out by part and by order; words are neither moved nor joined."""
    by, found = moved(spark, name)
    assert "MapInArrow" in found and by and not [x for x in by if x.count(",") > 1 or "line_no" in x], by


def test_holders_are_those_of_a_plain_loop(monkeypatch):
    monkeypatch.setattr(layouts, "PAIRS", 50)
    rng = random.Random(2)
    boxes = sorted((rng.randrange(40), k, *(x := rng.uniform(0, 80), y := rng.uniform(0, 80)), x + rng.choice([10, 30, 50]), y + rng.choice([10, 30])) for k in range(200))
    points = sorted((rng.randrange(42), rng.uniform(0, 100), rng.uniform(0, 100)) for _ in range(800))
    b = dict(zip(("of", "idx", "left", "top", "right", "bottom"), map(np.array, zip(*boxes, strict=True)), strict=True))
    found = layouts.holders(*map(np.array, zip(*points, strict=True)), b).tolist()
    want = [min(((r[4] - r[2]) * (r[5] - r[3]), r[1], k) for k, r in enumerate(boxes) if r[0] == d and r[2] - 0.01 <= x <= r[4] + 0.01 and r[3] - 0.01 <= y <= r[5] + 0.01)[2:] if any(r[0] == d and r[2] - 0.01 <= x <= r[4] + 0.01 and r[3] - 0.01 <= y <= r[5] + 0.01 for r in boxes) else (-1,) for d, x, y in points]
    assert found == [w[0] for w in want] and 100 < sum(k >= 0 for k in found) < 700


def test_words_in_blocks(spark, odd):
    same(spark, "token_in_block", odd)
    words_stay(spark, "token_in_block")


def test_words_in_no_block(spark, odd):
    same(spark, "unclaimed_words", odd)
    words_stay(spark, "unclaimed_words")


def test_share_of_words_in_blocks(spark, odd):
    same(spark, "token_coverage", odd)
    words_stay(spark, "token_coverage")


def test_blocks_that_hold_other_words(spark, odd):
    same(spark, "unfaithful_blocks", odd)
    words_stay(spark, "unfaithful_blocks")


def test_share_of_boxes_that_words_fill(spark, odd):
    same(spark, "bbox_tightness", odd)
    words_stay(spark, "bbox_tightness")


def test_blocks_in_table_regions(spark, odd):
    same(spark, "block_overlap", odd)
    by, found = moved(spark, "block_overlap")
    assert "SortMergeJoin" not in found and "Union" in found and found.count("ArrowEvalPython") == 1  # a statement's lines are made once


def test_headings_above(spark, odd):
    same(spark, "asof_heading", odd)
    by, found = moved(spark, "asof_heading")
    assert "SortMergeJoin" not in found and "Union" in found and found.count("ArrowEvalPython") == 1  # a statement's lines are made once


def test_images_at_blocks(spark, odd):
    same(spark, "image_attach", odd)
    by, found = moved(spark, "image_attach")
    assert "SortMergeJoin" not in found and found.count("ArrowEvalPython") == 1  # a statement's lines are made once


def test_rules_of_exports(spark, odd):
    same(spark, "export_invariants", odd)
    by, found = moved(spark, "export_invariants")
    assert "LeftAnti" not in found and found.count("ArrowEvalPython") == 1  # blocks are made once for all rules
