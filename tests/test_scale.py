"""Plans of queries over statements: what is dealt out by document stays there, and no document costs a call of its own."""

import pytest
from pyspark.sql import functions as F

from quireflow.operators import tables
from quireflow.plans.catalogue import QUERIES

from .test_queries import DIR


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["channel_cuts", "cell_assignment", "stitch_runs"])
def test_words_of_rows_are_not_moved(spark, name):
    """Lines go out by part and by order (a customer's tables by customer, too); words never do."""
    moved = [x.split("hashpartitioning(")[1] for x in plan(QUERIES[name](spark, DIR)).split("\n") if "Exchange hashpartitioning(" in x]
    assert moved and not [x for x in moved if "line_no" in x or "bin" in x] and len([x for x in moved if x.startswith("doc_id")]) <= (name == "stitch_runs") * 2


@pytest.mark.parametrize("name", ["infer_grid_strict", "levels_strict", "grid_regions_strict", "units_strict", "signature_stacks_strict", "rect_clusters", "runin_overflow_strict"])
def test_documents_go_to_python_in_batches(spark, name):
    found = plan(QUERIES[name](spark, DIR))
    assert "MapInArrow" in found and "FlatMapGroups" not in found


def test_cuts_of_many_documents_in_one_batch(spark):
    """Two rows that leave a gap, three of which one crosses it, a lone word, and words of no document."""
    rows = [(1, 1, 0.0, 20.0), (1, 1, 40.0, 60.0), (1, 1, 44.0, 50.0), (1, 2, 0.0, 30.0), (1, 2, 36.0, 60.0), (2, 1, 0.0, 20.0), (2, 1, 40.0, 60.0), (2, 2, 0.0, 60.0), (3, 1, 5.0, 9.0), (None, 1, 0.0, 4.0), (None, 1, 20.0, 24.0)]
    words = spark.createDataFrame(rows, "doc_id long, line_no long, x0 double, x1 double").coalesce(1)
    assert {tuple(r) for r in tables.channel_cuts(words).collect()} == {(1, 33.0), (None, 12.0)}
    placed = tables.words_in_cells(words.withColumn("word_no", F.lit(7)), ["line_no", "word_no"])
    assert placed.columns == ["doc_id", "line_no", "word_no", "col"]
    assert sorted((r["doc_id"] or 0, r["line_no"], r["col"]) for r in placed.collect()) == [(0, 1, 0), (0, 1, 0), (1, 1, 0), (1, 1, 1), (1, 1, 1), (1, 2, 0), (1, 2, 1), (2, 1, 0), (2, 1, 0), (2, 2, 0), (3, 1, 0)]


def test_clusters_by_squares_are_those_of_all_pairs(spark):
    import random

    from quireflow.operators import details

    rng = random.Random(5)
    rows = [(doc, i, float(rng.randrange(-300, 900)), float(rng.randrange(-300, 900))) for doc in range(5) for i in range(60)]
    found = {(r["doc_id"], r["id"]): r["cluster"] for r in details.box_clusters(spark.createDataFrame(rows, "doc_id long, id long, x double, y double"), 40.0, 2.0).collect()}
    want = {(doc, i): i for doc, i, _, _ in rows}
    for _ in range(60):
        for doc, i, x, y in rows:
            want[doc, i] = min(want[d, j] for d, j, u, v in rows if d == doc and abs(x - u) <= 42 and abs(y - v) <= 42)
    assert found == want and len(set(want.items())) == 300


def test_words_of_statements_are_grouped_where_they_are(spark):
    from quireflow.sources import lift

    found = plan(lift.statement_words(lift.statement_lines(spark, DIR)).groupBy("doc_id", "line_no").count())
    assert "Exchange" not in found[: found.index("Union")] and "Exchange" in found


def test_rules_and_words_meet_where_documents_are(spark):
    """At most the numbers of rows, one an order, are moved by document."""
    found = plan(QUERIES["ruled_tables"](spark, DIR))
    moved = [x.split("hashpartitioning(")[1].split(")")[0] for x in found.split("\n") if "Exchange hashpartitioning(doc_id" in x]
    assert "MapInArrow" in found and len(moved) <= 1 and not [x for x in moved if x.count(",") > 1]


def test_cells_of_many_documents_are_those_of_all_pairs():
    import random

    import numpy as np

    from quireflow.operators import rulings

    rng = random.Random(7)
    rows = sorted((doc, rng.random() < 0.5, 10.0 * rng.randrange(8), 10.0 * a, 10.0 * (a + rng.randrange(1, 8))) for doc in range(40) for a in (rng.randrange(6) for _ in range(24)))
    want = {}
    for doc in range(40):
        points = {(h, v, v[0], h[0]) for d, o, *h in rows if d == doc and o for e, q, *v in rows if e == doc and not q and h[1] - 3 <= v[0] <= h[2] + 3 and v[1] - 3 <= h[0] <= v[2] + 3 for h, v in [(tuple(h), tuple(v))]}
        crossed = {p[:2] for p in points}
        for h, v, x, y in points:
            fits = [(q[3], p[2]) for p in points if p[0] == h and p[2] > x for q in points if q[1] == v and q[3] > y and (q[0], p[1]) in crossed]
            if fits:
                want[doc, y, x] = min([min(fits), *([want[doc, y, x]] if (doc, y, x) in want else [])])
    found = rulings.cells(*(np.array(c) for c in zip(*rows, strict=True)))
    assert {tuple(r[:3]): tuple(r[3:]) for r in zip(*(c.tolist() for c in found), strict=True)} == want and len(want) > 100


@pytest.mark.parametrize(("name", "most"), [("line_groups", 1), ("evaluated_tables", 4), ("export_breaches", 1)])
def test_lines_are_moved_to_their_customer_alone(spark, name, most):
    """Nothing is moved by document and line or written in between; statements' lines and words meet where they are."""
    found = plan(QUERIES[name](spark, DIR))
    moved = [x.split("hashpartitioning(")[1].split(")")[0] for x in found.split("\n") if "Exchange hashpartitioning(" in x]
    by_document = [x for x in moved if x.startswith(("doc_id", "o_custkey", "doc#"))]
    assert "ExistingRDD" not in found and not [x for x in moved if "line_no" in x or "part#" in x] and len(by_document) <= most, moved


def test_cells_of_tables_are_no_checkpoint(spark):
    assert "ExistingRDD" not in plan(QUERIES["built_tables"](spark, DIR))


def test_ids_that_lead_into_a_cycle():
    from quireflow.operators.exports import _n_circling as n

    assert n(["a", "b", "c"], [None, "a", "x"]) == 0 and n([], []) == 0 and n([None, "b"], ["b", None]) == 0
    assert n(["a", "b", "c", "d"], ["b", "a", "a", None]) == 3 and n(["a"], ["a"]) == 1 and n(["a", "a"], [None, "a"]) == 0
    assert n([str(k) for k in range(3000)], [str(k + 1) for k in range(2999)] + ["2990"]) == 3000


@pytest.mark.parametrize("name", ["page_regions", "claimed_words"])
def test_pages_are_brought_together_by_lines(spark, name):
    """Lines go out by part and by order; words are neither moved nor written, and no round asks whether words are left."""
    found = plan(QUERIES[name](spark, DIR))
    moved = [x.split("hashpartitioning(")[1].split(")")[0] for x in found.split("\n") if "Exchange hashpartitioning(" in x]
    assert "MapInArrow" in found and "ExistingRDD" not in found and "Join" not in found[: found.index("Union")]
    assert moved and not [x for x in moved if x.count(",") > 1 or x.startswith("doc_id")], moved


def test_words_of_texts_are_those_of_lines(spark):
    import numpy as np
    import pyarrow as pa

    from quireflow.sources import lift

    texts = ["one two", "  led  by   blanks ", "", " ", None, "\ttab\tis a letter ", "x", "ünï 😀😀 z", "w " * 40, "a" * 70 + "  b"]
    lines = spark.createDataFrame(list(enumerate(texts)), "no long, text string").withColumn("left", F.col("no") * 7.5)
    want = sorted((r["no"], r["word_no"], r["word"], r["x0"], r["x1"]) for r in lift.words_of_lines(lines, F.col("left")).collect())
    no, word_no, word, letters, x0, x1 = lift.words_of_texts(pa.array(texts), np.arange(len(texts)) * 7.5)
    assert list(zip(no.tolist(), word_no.tolist(), word.to_pylist(), x0.tolist(), x1.tolist(), strict=True)) == want
    assert letters.tolist() == [len(w) for w in word.to_pylist()] and len(lift.words_of_texts(pa.array([""]), np.zeros(1))[0]) == 0


def test_pages_at_once_are_those_one_by_one():
    """Random pages of words, one line or thirty: regions and claims of all are those of each, claims those of a plain loop."""
    import random

    import numpy as np
    import pyarrow as pa

    from quireflow.operators import regions

    rng = random.Random(5)
    rows, boxes = [], []
    for doc in range(150):
        places, top = sorted(rng.sample(range(60, 560, 20), rng.choice([2, 3, 4]))), 50.0
        for line in range(rng.choice([1, 3, 6, 14, 30])):
            top += rng.choice([12, 12, 14, 30, 50])
            cells = [(x, rng.choice(["12", "3.10", "1999", "name"])) for x in places if rng.random() < 0.9] if rng.random() < 0.7 else [(72 + 33 * k, "prose") for k in range(rng.choice([1, 3, 14]))]
            rows += [(doc, line, w, x, x + rng.choice([5.0, 6.0]) * len(w), top, top + 10) for x, w in cells]
        boxes += [(doc, k, 0.0, a := rng.uniform(0, 200), 600.0, a + rng.uniform(20, 200)) for k in rng.sample(range(5), rng.randrange(5))]
    names = ("of", "line", "word", "x0", "x1", "top", "bottom")

    def words(some):
        w = {n: pa.array(c) if n == "word" else np.array(c) for n, c in zip(names, zip(*some, strict=True), strict=True)}
        return w | {"letters": np.array([len(r[2]) for r in some])}

    def found(some):
        return sorted((int(d), int(r), *b.tolist()) for d, r, b in zip(*(regions.found(words(some))[k] for k in (0, 1)), regions.found(words(some))[2].T, strict=True))

    alone = [[r for r in rows if r[0] == doc] for doc in range(150)]
    assert found(rows) == [x for one in alone for x in found(one)] and len(found(rows)) > 40
    of, priority, *box = (np.array(c) for c in zip(*boxes, strict=True))
    word, candidate = regions.claims(words(rows), np.arange(len(rows)), of, priority, np.stack(box))
    want, taken = set(), set()
    for c in sorted(range(len(boxes)), key=lambda c: boxes[c][:2]):
        doc, _, x0, top, x1, bottom = boxes[c]
        held = [k for k, r in enumerate(rows) if r[0] == doc and k not in taken and x0 <= (r[3] + r[4]) / 2 <= x1 and top <= (r[5] + r[6]) / 2 <= bottom]
        if len(held) >= regions.LEAST_WORDS:
            taken.update(held)
            want.update((k, c) for k in held)
    assert set(zip(word.tolist(), candidate.tolist(), strict=True)) == want and len(want) > 500


def test_batches_in_pieces_of_whole_documents():
    import pyarrow as pa

    from quireflow.operators import batches

    xs = [[{"a": 10 * d + k} for k in range(n)] for d, n in enumerate((3, 0, 9, 1, 1, 0, 2))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(xs, pa.list_(pa.struct([("a", pa.int64())])))], ["doc_id", "xs"])
    parts = list(batches.pieces(batch, rows=4))
    assert [p.column(0).to_pylist() for p in parts] == [[0, 1], [2], [3, 4, 5, 6]]
    assert [batches.flat(p)[1]["a"].to_pylist() for p in parts] == [[0, 1, 2], list(range(20, 29)), [30, 40, 60, 61]]
    assert batches.flat(parts[2])[0].tolist() == [0, 1, 3, 3]


def test_rows_that_stand_together_are_stacked_by_document():
    import pyarrow as pa

    from quireflow.operators import batches

    def rows(ids, n=None):
        return pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "x": pa.array(ids, pa.int64()), "n": pa.array(n or [{7: 5, 3: 1, 4: 2, 9: 9}[i] for i in ids], pa.int64())})

    parts = list(batches.stacked(iter([rows([7, 7]), rows([]), rows([7, 7]), rows([7, 3, 4]), rows([4, *[9] * 4]), rows([9] * 5)]), "n", rows=4))
    assert [p.column(0).to_pylist() for p in parts] == [[7, 3], [4], [9]]
    assert [[len(x) for x in p.column(1).to_pylist()] for p in parts] == [[5, 1], [2], [9]]
    assert [batches.flat(p)[1]["x"].to_pylist() for p in parts] == [[7] * 5 + [3], [4, 4], [9] * 9]
    assert list(batches.stacked(iter([]), "n")) == list(batches.stacked(iter([rows([])]), "n")) == []
    with pytest.raises(ValueError):
        list(batches.stacked(iter([rows([7, 3, 7], [2, 1, 2])]), "n"))
