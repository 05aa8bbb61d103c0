"""Words and lines by example."""

import pytest
from pyspark.sql import functions as F

from quireflow.functions import lines as L
from quireflow.functions import text as T
from quireflow.functions import words as W
from quireflow.plans.catalogue import QUERIES, SQL


def features(spark, text):
    rows = L.with_features(spark.createDataFrame([(text,)], "text string")).collect()
    return rows[0]


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("Audit Rights", "header"),
        ("13. Audit Rights", "header"),
        ("4. 400 WESTLAKE PROJECT", "header"),
        ("SECTION 3 DEFINITIONS", "header"),
        ("The parties agree to the terms that are set out below.", "para"),
        ("and the rest of the sentence goes on here", "para"),
        ("• first point of the list that goes on for a while", "list_item"),
        ("(a) the first of the things that are listed here", "list_item"),
        ("ring 12 $ 400.00 5% 01/02/2020", "table_row"),
        ("Introduction ........ 4", "table_row"),
    ],
)
def test_line_types(spark, text, kind):
    assert features(spark, text)["line_type"] == kind


def test_blank_lines_have_no_features(spark):
    assert L.with_features(spark.createDataFrame([("  ",), (None,), ("",)], "text string")).count() == 0


@pytest.mark.parametrize(
    ("word", "number", "year", "date"),
    [
        ("12", True, False, False), ("1,234.5", True, False, False), ("(12)", True, False, False), ("-$40", True, False, False), ("1999", False, True, False), ("1,999", True, False, False),
        ("12m", False, False, False), ("abc", False, False, False), ("01/02/2020", False, False, True), ("Mar-12", False, False, True), ("13-40", False, False, False), ("4-5-20", False, False, True),
    ],
)
def test_words(spark, word, number, year, date):
    w = F.col("w")
    row = spark.createDataFrame([(word,)], "w string").select(W.is_number(w), W.is_year(w), W.is_date(w)).first()
    assert tuple(row) == (number, year, date)


@pytest.mark.parametrize(("word", "kind"), [("1.", "integer"), ("1.2.1", "integer"), ("12", None), ("(ii)", "roman"), ("(a)", "letter"), ("a", None), ("(a", None), ("50%", None), ("a1", "letter")])
def test_enumerators(spark, word, kind):
    assert spark.createDataFrame([(word,)], "w string").select(L.numbered_kind(F.col("w"))).first()[0] == kind


@pytest.mark.parametrize(("roman", "value"), [("XIV", 14), ("mcmxcix", 1999), ("I", 1)])
def test_roman(spark, roman, value):
    assert spark.createDataFrame([(roman,)], "w string").select(T.roman_value(F.col("w"))).first()[0] == value


def test_sentences_keep_abbreviations(spark):
    text = "Dr. Roe met Mr. Doe. They talked! Did they? Yes."
    found = spark.createDataFrame([(text,)], "t string").select(T.sentences(F.col("t"))).first()[0]
    assert found == ["Dr. Roe met Mr. Doe.", "They talked!", "Did they?", "Yes."]


def test_zero_vector_stays(spark):
    found = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<double>").select(T.l2_normalized(F.col("v"))).collect()
    assert [r[0] for r in found] == [[0.0, 0.0], [0.6, 0.8]]


def test_rounding_keeps_the_sign_of_zero_as_sql_does(spark, tmp_path):
    import math

    import duckdb

    vectors = [[-1e-8, 1.0], [1e-8, -1.0], [0.0, 0.0], [-0.0, 3.0], [0.0000005, 1.0], [-0.0000015, -1.0], [3.0, -4.0]]
    spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = {r["vec_id"]: r["unit"] for r in QUERIES["embedding_l2_normalize"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    signed = lambda unit: [(x, math.copysign(1, x)) for x in unit]
    assert {k: signed(v) for k, v in found.items()} == {k: signed(v) for k, v in con.execute(SQL["embedding_l2_normalize"]).fetchall()}
    assert signed(found[0])[0] == (0.0, -1.0)


def test_prose_is_told_from_headers_before_its_features(spark):
    """No header is left out, and lines of prose are."""
    heads = ["Audit Rights", "% of all", "4. 400 WESTLAKE PROJECT", "(b) The Terms", "iv. Closing", "a) Rest", "Of The And", "Note: and so on", "SECTION 3, a, b", "Ärzte Und Äpfel", "1 x"]
    prose = ["The parties agree to the terms that are set out below.", "and the rest of it", "Some of the goods, which were sold, were sent back late in the year", "Every small line begins with one large letter", "", None]
    rows = spark.createDataFrame([(t,) for t in heads + prose], "text string").withColumn("may", L.may_be_header(F.col("text")))
    assert {r["text"] for r in rows.filter("may").collect()} == set(heads)
    assert {r["text"] for r in L.with_features(rows).filter("header AND NOT may").collect()} == set()
