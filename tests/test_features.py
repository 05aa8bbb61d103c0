"""Features of lines as arrays: those of the SQL, worked out once."""

import random

import duckdb
import pyarrow as pa
import pytest

from quireflow.functions import features
from quireflow.plans import sql as S
from quireflow.plans.catalogue import QUERIES

from .test_queries import DIR
from .test_scale import plan

WORDS = (
    "a I of The the ARTICLE Section section 12 1. 1.2.1 (a) (ii) a) iv. $ $40 -$40 (12) ($5) 5% % 50%, 1999 1,999 01/02/2020 Mar-12 13-40 4-5-20 - -- Mr. Dr. end. end; end: : INC. a.b. “quote” Ärzte äpfel Über, • * – © http://x.y "
    "page Page: PO P.O. Box TX Springfield, 12345 12345-6789 Ohio, .... and between acres miles whereas Whereas now, therefore NOW x-y 😀 ﬀ ſ 日本 3.14. 9999.5 999.5 12m .5 5. ''x (x x)(y and, word Word WORD McDonald O'Neil wOrd ... ! ? 3 7 21 ?x? [a] 1999."
).split() + ["", " ", "\t", "a\tb", "1.\tA"]


def test_features_are_those_of_the_sql(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.choice([1, 1, 2, 2, 3, 4, 5, 6, 8, 12, 20]))) for _ in range(6000)]
    texts = [t for t in texts if t.strip(" ")]
    con = duckdb.connect()
    con.register("src", pa.table({"k": range(len(texts)), "text": texts}))
    want = con.execute(f"WITH {S.features('src', 'k')} SELECT {', '.join(features.FEATURES)} FROM features ORDER BY k").fetchall()
    monkeypatch.setattr(features, "PIECE", 20_000)
    found = features.of_texts(pa.array(texts))
    assert list(found) == list(features.FEATURES)
    assert list(zip(*(pa.array(c).to_pylist() for c in found.values()), strict=True)) == want
    assert {len(c) for c in features.of_texts(pa.array([], pa.string())).values()} == {0}


def test_features_of_statements_are_worked_out_in_batches(spark):
    found = plan(QUERIES["statement_line_features"](spark, DIR))
    assert found.count("ArrowEvalPython") == 1 and "RLIKE" not in found


@pytest.mark.parametrize("name", ["line_numbered", "line_prose_continuation"])
def test_filters_do_not_work_features_out_again(spark, name):
    """A filter on a feature stands behind the features, and takes none of their steps in front of them."""
    found = plan(QUERIES[name](spark, DIR))
    assert found.count("ArrowEvalPython") == 1 and "RLIKE" not in found and found.index("Filter") < found.index("ArrowEvalPython")
