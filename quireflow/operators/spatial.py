"""Joins of boxes: points in rectangles, overlaps, the nearest above, what is in none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Slack of a point in a rectangle, share of a box that must be inside another
SLACK, INSIDE = 0.01, 0.9


def _side(a: str | Column, c: str) -> Column:
    return F.col(f"{a}.{c}") if isinstance(a, str) else a[c]


def intersection(a: str | Column, b: str | Column) -> Column:
    """Shared area of the boxes with the columns of two aliases, or of two structs."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(_side(a, hi), _side(b, hi)) - F.greatest(_side(a, lo), _side(b, lo)))
    return side("left", "right") * side("top", "bottom")


def area(a: str | Column) -> Column:
    return (_side(a, "right") - _side(a, "left")) * (_side(a, "bottom") - _side(a, "top"))


def smallest_around(points: DataFrame, boxes: DataFrame, ids: list, by: str = "doc_id") -> DataFrame:
    """ids, block_idx: of the boxes of the same document that hold a point (x, y) the smallest, the first of equals."""
    p, b = points.alias("p"), boxes.alias("b")
    inside = (
        (F.col(f"p.{by}") == F.col(f"b.{by}"))
        & (F.col("p.x") >= F.col("b.left") - SLACK)
        & (F.col("p.x") <= F.col("b.right") + SLACK)
        & (F.col("p.y") >= F.col("b.top") - SLACK)
        & (F.col("p.y") <= F.col("b.bottom") + SLACK)
    )
    best = F.min_by("b.block_idx", F.struct(area("b"), F.col("b.block_idx")))
    return p.join(b, inside).groupBy(*[F.col(f"p.{c}").alias(c) for c in ids]).agg(best.alias("block_idx"))


def nearest_above(rows: DataFrame, heads: DataFrame, by: str = "doc_id") -> DataFrame:
    """rows with `above`: the id of the last of `heads` (top, id) that is not below the row's top. One sort, no pairs."""
    tagged = rows.withColumn("_head", F.lit(None).cast("long")).unionByName(heads.select(by, "top", F.col("id").alias("_head")), allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy("top", F.col("_head").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    return tagged.withColumn("above", F.last("_head", ignorenulls=True).over(w)).filter("_head IS NULL").drop("_head")
