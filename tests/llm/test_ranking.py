"""Ranked search against a plain loop over all documents and items."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from quireflow.llm import queries, ranking

from ..compare import spark_rows, sql_rows

DIR = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def brute(docs, items, best=50):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, total = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    rows = []
    for item, text in items:
        scores = []
        for d, bag in bags:
            if bag:
                m = 50 + 50 * sum(bag.values()) * n_docs // total
                score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 20 * m)) for t in set(terms(text)) if bag[t])
                if score > 0:
                    scores.append((-score, d is None, d))
        rows += [(item, k + 1, d, -s) for k, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:best])]
    return rows


def found(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


def table(spark, name):
    return [tuple(r) for r in spark.read.parquet(f"{DIR}/{name}.parquet").select({"documents": "doc_id", "benchmark": "item_id"}[name], "text").collect()]


def test_query_same_as_brute_force(spark):
    assert found(queries.op12_ranked_search(spark, DIR)) == sorted(brute(table(spark, "documents"), table(spark, "benchmark")), key=str)


def test_query_same_as_sql(spark):
    assert spark_rows(queries.op12_ranked_search(spark, DIR)) == sql_rows(queries.ORACLE_SQL["op12_ranked_search"], DIR)


@pytest.mark.parametrize("block", [1, 300])
def test_blocks_and_pieces_do_not_matter(spark, monkeypatch, block):
    monkeypatch.setattr(ranking, "ENTRIES", 100)
    docs, items = spark.read.parquet(f"{DIR}/documents.parquet").limit(60), spark.read.parquet(f"{DIR}/benchmark.parquet").limit(5)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = brute(rows, [(r["item_id"], r["text"]) for r in items.collect()], 7)
    assert found(ranking.ranked(docs.repartition(9), items, best=7, block_bytes=block)) == sorted(want, key=str)


def test_radix_sort_and_sums():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 1 << 40, 5000) >> rng.integers(0, 40, 5000)
    assert (ranking.radix_order(keys) == np.argsort(keys, kind="stable")).all()
    values = rng.integers(1, 100, 5000)
    distinct, sums = ranking.accumulated(keys % 97, values)
    assert dict(zip(distinct.tolist(), sums.tolist())) == {k: int(values[keys % 97 == k].sum()) for k in set((keys % 97).tolist())}


def test_a_long_text_in_pieces(monkeypatch):
    text = "Ab1 é-x" * 500
    monkeypatch.setattr(ranking, "PIECE", 37)
    assert {k.decode(): n for k, n in ranking.terms_of(text).items()} == Counter(terms(text))


def test_odd_rows(spark):
    docs = [(1, "red Red blue", "x"), (2, None, "y"), (3, "", "y"), (None, "red red blue", "z"), (4, "red red blue", None), (4, "red red blue", None), (5, "... !!", "q"), (6, "word " * 300_000, "q"), (7, "green", "q")]
    items = [(10, "Blue red!", "k"), (11, None, "k"), (12, "missing", "k"), (None, "green", "k"), (13, "", "k"), (14, "blue RED", "k")]
    d = spark.createDataFrame(docs, "doc_id long, text string, item string")
    i = spark.createDataFrame(items, "item_id long, text string, score string")
    want = brute([x[:2] for x in docs], [x[:2] for x in items])
    assert found(ranking.ranked(d, i)) == sorted(want, key=str) and want
    assert found(ranking.ranked(d, i, best=2)) == sorted(brute([x[:2] for x in docs], [x[:2] for x in items], 2), key=str)
    assert ranking.ranked(d.limit(0), i).count() == 0
    assert ranking.ranked(d, i.limit(0)).count() == 0
    assert ranking.ranked(d, i.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
