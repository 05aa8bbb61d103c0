"""Blocks as Markdown, HTML, JSON, layout predictions and outlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import escaped


def markdown_block(block_type: Column, text: Column, level: Column, bold: Column) -> Column:
    body = F.when(bold & (block_type != "header"), F.concat(F.lit("**"), text, F.lit("**"))).otherwise(text)
    return (
        F.when(block_type == "header", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), text))
        .when(block_type == "list_item", F.concat(F.lit("- "), body))
        .when(block_type == "table_row", F.concat(F.lit("| "), F.replace(body, F.lit("|"), F.lit("\\|")), F.lit(" |")))
        .otherwise(body)
    )


def html_block(block_type: Column, text: Column, level: Column) -> Column:
    tag = F.when(block_type == "header", "h4").when(block_type == "list_item", "li").when(block_type == "table_row", "tr").otherwise("p")
    return F.concat(F.lit("<"), tag, F.lit(' style="margin-left:'), (level * 20).cast("string"), F.lit('px">'), escaped(text), F.lit("</"), tag, F.lit(">"))


def joined(rows: DataFrame, by: str, order: str, value: str, mark: str, name: str) -> DataFrame:
    """One row a group: its values in order, joined."""
    ordered = F.array_sort(F.collect_list(F.struct(order, value)))
    return rows.groupBy(by).agg(F.array_join(F.transform(ordered, lambda s: s[value]), mark).alias(name))


def json_document(blocks: DataFrame) -> DataFrame:
    """doc_id, json: a document's blocks in order."""
    fields = F.struct("block_idx", F.col("block_type").alias("tag"), "block_text", F.struct("left", "top", "right", "bottom").alias("bbox"))
    return blocks.groupBy("doc_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(fields)).alias("blocks"))).alias("json"))
