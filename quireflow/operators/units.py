"""Clause units: where they start, what belongs to them, runs of alike rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDINAL = r"^(?:ARTICLE|SECTION|ITEM)\s+(?:[IVXLC]+|[0-9]+)\b"


def starts_unit(text: Column, numbered: Column, n_words: Column) -> Column:
    """A numbered line of two words and more, an ARTICLE or SECTION, or up to six words all upper case without digits."""
    capital = text.rlike(r"\p{Lu}") & ~text.rlike(r"\p{Ll}|[0-9]") & (n_words <= 6)
    return (numbered & (n_words >= 2)) | text.rlike(ORDINAL) | capital


def with_units(lines: DataFrame) -> DataFrame:
    """lines (starts) with unit_id: how many units have started; what is before the first is unit 0."""
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("unit_id", F.sum(F.col("starts").cast("int")).over(w).cast("long"))


def runs_of(rows: DataFrame, flag: Column, least: int = 3) -> DataFrame:
    """doc_id, first_line, n: runs of `least` and more rows that all have the flag."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    numbered = rows.withColumn("_n", F.row_number().over(w)).filter(flag)
    runs = numbered.withColumn("_run", F.col("_n") - F.row_number().over(w)).groupBy("doc_id", "_run").agg(F.min("line_no").alias("first_line"), F.count(F.lit(1)).alias("n"))
    return runs.filter(F.col("n") >= least).drop("_run")
