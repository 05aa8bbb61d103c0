"""Spelling variants against all pairs by their edit, at every size of subtree, and against SQL."""

import random
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quireflow.llm import queries, spelling

from ..compare import spark_rows, sql_rows

DIR = "/root/testdata/sf0.001"


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_pairs(words):
    words = sorted(words)
    return sorted((a, b) for k, a in enumerate(words) for b in words[k + 1 :] if one_edit(a, b))


def brute(docs, limit=7):
    seen = Counter()
    for doc_id, text in docs:
        run = ""
        for c in [*(text or ""), " "]:
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c.lower() if c < "a" else c
            elif run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                k = h % len(run)
                seen[run[:k] + run[k + 1 :] if h % 31 == 0 else run] += 1
                run = ""
    n = {w: c for w, c in seen.items() if c >= 2 and len(w) >= limit}
    near = {w: [] for w in n}
    for a, b in brute_pairs(n):
        near[a].append(b)
        near[b].append(a)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    rows = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n[w], len(near[w]), form[w] and n[form[w]]))
    return sorted(rows, key=str)


def found(df):
    return sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()), key=str)


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abé", max_size=7), max_size=60), st.integers(0, 3))
def test_trie_finds_all_pairs_once(words, depth):
    words = sorted({"xyz"[:depth] + w for w in words})
    pairs = [tuple(sorted((words[a], words[b]))) for a, b in zip(*(x.tolist() for x in spelling.ErrataTrie(words, depth).pairs()))]
    assert sorted(pairs) == brute_pairs(words)


@pytest.mark.parametrize("limit", [2, 15, 10_000])
def test_top_of_the_trie_by_joins(spark, limit):
    rng = random.Random(limit)
    words = {"".join(rng.choice("aab") for _ in range(rng.randrange(1, 8))) for _ in range(120)} | {"aaaaaab" + x for x in ("", "c", "d", "cd", "dd")}
    df = spark.createDataFrame([(w, "x") for w in words], "word string, prefix string")
    assert sorted(tuple(sorted(r)) for r in spelling.near_words(df, limit=limit).collect()) == brute_pairs(words)


def test_query_same_as_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]
    assert found(queries.op11_spelling_variants(spark, DIR)) == brute(docs)


def test_query_same_as_sql(spark):
    assert spark_rows(queries.op11_spelling_variants(spark, DIR)) == sql_rows(queries.ORACLE_SQL["op11_spelling_variants"], DIR)


def test_chains_ties_and_odd_rows(spark):
    text = " ".join(["Colours"] * 400 + ["colour×"] * 30 + ["coloùrs"] * 2 + ["colourss"] * 40 + ["colurss"] * 3 + ["colouss"] * 40 + ["ABCDEFG"] * 5)
    docs = [(1, text, "a"), (1, text, "a"), (2, None, "b"), (None, "Xylophone xylophone 7xylophone", None), (3, "", "c"), (4, "y" * 9_000 + " " + "y" * 9_000, "c"), (5, "short words only", "c")]
    df = spark.createDataFrame(docs, "doc_id long, text string, word string")
    want = brute([x[:2] for x in docs])
    assert found(spelling.variants(df)) == want == found(spelling.variants(df, limit=2 * len(want)))
    assert any(r[2] != r[0] and r[2] != r[1] for r in want)  # a chain of two forms
    assert spelling.variants(df.limit(0)).count() == 0
