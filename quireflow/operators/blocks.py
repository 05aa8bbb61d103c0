"""Lines to blocks, joins of neighbouring blocks, and style statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireflow.functions import lines as L

from .formation import island

# A step of this many font sizes, or a shift of this many points, begins a block
STEP, SHIFT = 2.0, 200


def with_blocks(lines: DataFrame) -> DataFrame:
    """Lines with features -> the same with block_idx.

    A block begins with a change of size or weight, a numbered line, a table row, behind a table row, after a wide step
    down or a shift to the side.
    """
    w = Window.partitionBy("doc_id").orderBy("line_no")
    before = lambda c: F.lag(c).over(w)
    new = (
        (F.col("size") != before("size"))
        | (F.col("weight") != before("weight"))
        | F.col("numbered")
        | F.col("list_item")
        | F.col("table_row")
        | before("table_row")
        | (F.col("top") - before("top") > STEP * F.col("size"))
        | (F.abs(F.col("left") - before("left")) > SHIFT)
    )
    flagged = lines.withColumn("_new", F.coalesce(new, F.lit(True)))
    return flagged.withColumn("block_idx", (island(F.col("_new"), ["doc_id"], ["line_no"]) - 1).cast("long")).drop("_new")


def block_type() -> Column:
    """Type of a block from its lines' features."""
    return (
        F.when(F.bool_or("table_row"), "table_row")
        .when(F.bool_or(F.col("list_item") | (F.col("numbered") & ~F.col("header"))), "list_item")
        .when(F.bool_and("header"), "header")
        .otherwise("para")
    )


def blocks(lines: DataFrame, letter: float = 6.0) -> DataFrame:
    """One row a block: type, text, box, size, weight, lines."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    return lines.groupBy("doc_id", "block_idx").agg(
        block_type().alias("block_type"),
        F.array_join(F.transform(ordered, lambda s: s["text"]), " ").alias("block_text"),
        F.min("left").alias("left"),
        F.min("top").alias("top"),
        F.max(F.col("left") + letter * F.length("text")).alias("right"),
        F.max(F.col("top") + F.col("size")).alias("bottom"),
        F.max("size").alias("size"),
        F.max("weight").alias("weight"),
        F.count(F.lit(1)).alias("n_lines"),
        F.min("line_no").alias("first_line"),
    )


def merged_runs(rows: DataFrame, joins: Column, by: list, order: list) -> DataFrame:
    """rows with `run`: a row that joins the one before is in its run."""
    return rows.withColumn("_new", ~F.coalesce(joins, F.lit(False))).withColumn("run", (island(F.col("_new"), by, order) - 1).cast("long")).drop("_new")


def without_hyphens(text: Column) -> Column:
    """Words parted at line ends whole again."""
    return F.regexp_replace(text, "-\n", "")


def spacing(lines: DataFrame, by: list, order: list) -> DataFrame:
    """Gaps between lines of one style that follow each other, rounded to a tenth."""
    w = Window.partitionBy(*by).orderBy(*order)
    same = (F.lag("size").over(w) == F.col("size")) & (F.lag("weight").over(w) == F.col("weight"))
    gap = F.round(F.col("top") - F.lag("top").over(w), 1)
    return lines.withColumn("gap", F.when(same, gap)).filter("gap > 0")


def with_modes(lines: DataFrame, by: list, order: list) -> DataFrame:
    """lines with `mode`: the most frequent gap of their style in the document, the smallest of equals; as spacing() and most_frequent(), by windows."""
    w = Window.partitionBy(*by).orderBy(*order)
    same = (F.lag("size").over(w) == F.col("size")) & (F.lag("weight").over(w) == F.col("weight"))
    gap = F.round(F.col("top") - F.lag("top").over(w), 1)
    lines = lines.withColumn("_gap", F.when(same & (gap > 0), gap))
    lines = lines.withColumn("_n", F.count("_gap").over(Window.partitionBy("doc_id", "size", "weight", "_gap")))
    rank = F.when(F.col("_gap").isNotNull(), F.struct(F.col("_n"), -F.col("_gap")))
    return lines.withColumn("mode", F.max_by("_gap", rank).over(Window.partitionBy("doc_id", "size", "weight"))).drop("_gap", "_n")


def most_frequent(counts: DataFrame, by: list, value: str) -> DataFrame:
    """Of each group the value with the largest n, the smallest of equals."""
    return counts.groupBy(*by).agg(F.max_by(value, F.struct("n", -F.col(value))).alias(f"mode_{value}"), F.max("n").alias("n_mode"))


def is_delimited(text: Column) -> Column:
    return L.ends_with_delimiter(text)
