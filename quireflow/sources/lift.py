"""Lifting tables into positioned lines, words and blocks.

A line of text has a page and a top by its number; words get their x range in proportion to their letters, six points
each. Statements are documents of their own, one an order, with a title, headings, clauses, table rows and furniture.

Arrays that are never empty are exploded by the outer forms: before others Spark tests the array's size in a filter of
its own, and so works the whole array out twice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINES_A_PAGE = 50
TOP, LEADING, LEFT, LETTER = 72, 12, 72, 6
STATEMENT_TOP, FOLIO_TOP, FOOTER_TOP = 72, 760, 775
PAGE_WIDTH, PAGE_HEIGHT = 612.0, 792.0
# Left edges of a statement row's cells: name, quantity, currency sign, price, discount, date.
CELL_LEFTS = (72, 280, 330, 342, 430, 490)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_lines(documents: DataFrame) -> DataFrame:
    """doc_id, line_no, page_idx, top, text: the lines of each document that are not blank, trimmed."""
    lines = documents.select("doc_id", F.posexplode_outer(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "text"))
    lines = lines.withColumn("text", F.trim("text")).filter("text <> ''")
    return lines.select(
        "doc_id",
        F.col("line_no").cast("long").alias("line_no"),
        F.expr(f"line_no DIV {LINES_A_PAGE}").alias("page_idx"),
        (F.lit(TOP) + LEADING * (F.col("line_no") % LINES_A_PAGE)).cast("double").alias("top"),
        "text",
    )


#: Words of a line that are laid out together.
STRETCH = 16


def words_of_lines(lines: DataFrame, left: Column | None = None) -> DataFrame:
    """Each line's words with word_no and x0, x1, laid out in proportion to their letters from the line's left.

    A line comes apart into stretches of words with their offsets, a stretch into words; nothing is shuffled, and a
    word's offset is looked up in its stretch alone.
    """
    others = [c for c in lines.columns if c != "text"]
    single = F.when(F.col("text").contains("  "), F.regexp_replace("text", "  +", " ")).otherwise(F.col("text"))
    rows = lines.withColumn("_left", left if left is not None else F.lit(float(LEFT))).withColumn("_text", F.trim(single)).filter("_text <> ''")
    rows = rows.withColumn("_w", F.split("_text", " ")).withColumn("_k", F.sequence(F.lit(0), F.floor((F.size("_w") - 1) / STRETCH).cast("int")))
    stretches = F.transform("_k", lambda k: F.array_join(F.slice("_w", k * STRETCH + 1, STRETCH), " "))
    rows = rows.withColumn("_s", F.when(F.size("_k") == 1, F.array("_text")).otherwise(stretches))
    starts = F.aggregate("_s", F.array(F.lit(0)), lambda ns, s: F.array_append(ns, F.element_at(ns, -1) + F.length(s) + 1))
    rows = rows.withColumn("_n", F.when(F.size("_k") == 1, F.array(F.lit(0))).otherwise(starts))
    rows = rows.select(*others, "_left", F.posexplode_outer("_s").alias("_no", "_s"), "_n").withColumn("_n", F.get("_n", F.col("_no")))
    words = rows.select(*others, "_left", "_no", "_s", "_n", F.posexplode_outer(F.split("_s", " ")).alias("_at", "word"))
    before = F.col("_n") + F.when(F.col("_at") == 0, 0).otherwise(F.length(F.call_function("substring_index", F.col("_s"), F.lit(" "), F.col("_at"))) + 1)
    words = words.select(*others, "_left", (F.col("_no") * STRETCH + F.col("_at")).cast("long").alias("word_no"), "word", before.alias("_n"))
    words = words.withColumn("x0", F.col("_left") + LETTER * F.col("_n")).withColumn("x1", F.col("x0") + LETTER * F.length("word"))
    return words.drop("_left", "_n")


def words_of_texts(texts: pa.Array, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """As words_of_lines(), for the texts of a batch: text (its place), word_no, word, its letters, x0, x1."""
    texts = pc.fill_null(texts, "")
    if pc.any(pc.match_substring(texts, "  ")).as_py():
        texts = pc.replace_substring_regex(texts, "  +", " ")
    texts = pc.ascii_trim(texts, " ")
    some = np.flatnonzero(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    lists = pc.split_pattern(texts if len(some) == len(texts) else texts.take(pa.array(some)), " ")
    words, n = lists.flatten(), np.diff(lists.offsets.to_numpy())
    letters = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    first, text = np.cumsum(n) - n, np.repeat(some, n)
    before = np.cumsum(letters + 1) - letters - 1
    x0 = left[text] + LETTER * (before - np.repeat(before[first], n))
    return text, np.arange(len(text)) - np.repeat(first, n), words, letters, x0, x0 + LETTER * letters


def conversation_blocks(conversations: DataFrame) -> DataFrame:
    """doc_id, block_idx, block_type, block_text: a conversation's turns in order."""
    return conversations.select(
        F.col("conv_id").alias("doc_id"),
        F.col("turn").alias("block_idx"),
        F.when(F.col("role") == "user", "header").otherwise("para").alias("block_type"),
        F.trim(F.coalesce("text", F.lit(""))).alias("block_text"),
    )


def html_blocks(pages: DataFrame) -> DataFrame:
    """page_id, block_no, tag, text: text blocks of h1, p, li, footer and div elements, scripts, styles and comments out."""
    h = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<title>.*?</title>", "")
    h = F.regexp_replace(h, r"(?i)<(h1|p|li|footer|div)\b[^>]*>", "\x01$1\x02")
    h = F.regexp_replace(h, r"(?i)</(?:h1|p|li|footer|div|article|nav|ul|body|html)>", "\x01")
    h = F.regexp_replace(h, "<[^>]*>", " ")
    blocks = pages.select("page_id", F.posexplode_outer(F.split(h, "\x01")).alias("_n", "_b")).filter(F.col("_b").contains("\x02"))
    text = F.element_at(F.split("_b", "\x02"), 2)
    for entity, char in (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    blocks = blocks.withColumn("text", F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))).withColumn("tag", F.lower(F.element_at(F.split("_b", "\x02"), 1)))
    blocks = blocks.filter("text <> ''")
    order = F.row_number().over(Window.partitionBy("page_id").orderBy("_n")) - 1
    return blocks.select("page_id", order.cast("long").alias("block_no"), "tag", "text")


def _day(date: str) -> Column:
    return F.date_format(date, "MM/dd/yyyy")


def statement_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows among the statements' lines: dealt out by order, so that what follows by doc_id needs no exchange."""
    items, parts = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    rows = items.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = rows.withColumn("n", F.row_number().over(w))
    cells = F.array(
        F.coalesce("p_name", F.lit("Unknown")),
        F.col("l_quantity").cast("long").cast("string"),
        F.lit("$"),
        F.format_string("%.2f", "l_extendedprice"),
        F.concat(F.round(F.col("l_discount") * 100).cast("long").cast("string"), F.lit("%")),
        _day("l_shipdate"),
    )
    return rows.select(
        F.col("l_orderkey").alias("doc_id"),
        (F.col("n") + 4).cast("long").alias("line_no"),
        F.lit("row").alias("kind"),
        (F.lit(168.0) + 14 * F.col("n")).alias("top"),
        F.lit(72.0).alias("left"),
        F.lit(10.0).alias("size"),
        F.lit(400).alias("weight"),
        F.array_join(cells, " ").alias("text"),
        cells.alias("cells"),
    )


def statement_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line_no, kind, top, left, size, weight, text and a row's cells: the statement of each order.

    Orders are dealt out by their key before their lines are made, as rows are, so that the union of both stays dealt out
    by doc_id: lines and words of a document are grouped where they are.
    """
    orders, customers = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    heads = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")
    heads = heads.select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_orderdate", "c_name").repartition("o_orderkey")
    lit, none = F.lit, F.array().cast("array<string>")
    line = lambda no, kind, top, left, size, weight, text: F.struct(
        lit(no).cast("long").alias("line_no"), lit(kind).alias("kind"), lit(float(top)).alias("top"), left.cast("double").alias("left"), lit(float(size)).alias("size"), lit(weight).alias("weight"), text.alias("text")
    )
    name = F.coalesce("c_name", lit("Unknown"))
    fixed = F.array(
        line(0, "title", 72, lit(306) - 3 * F.length(name), 14, 700, name),
        line(1, "heading", 96, lit(72), 12, 700, F.concat(lit("SECTION "), (F.col("o_orderkey") % 9 + 1).cast("string"), lit(". ORDER "), F.col("o_orderkey").cast("string"))),
        line(2, "clause", 120, lit(90), 10, 400, F.concat(lit("(a) Priority of this order is "), F.col("o_orderpriority"), lit("."))),
        line(3, "clause", 132, lit(90), 10, 400, F.concat(lit("(b) Status is "), F.col("o_orderstatus"), lit(" since "), _day("o_orderdate"), lit("."))),
        line(4, "lead", 156, lit(72), 10, 400, lit("Terms as follows:")),
        line(98, "folio", FOLIO_TOP, lit(290), 8, 400, F.concat(lit("Page "), (F.col("o_orderkey") % 7 + 1).cast("string"))),
        line(99, "footer", FOOTER_TOP, lit(200), 8, 400, lit("All amounts are stated in dollars.")),
    )
    heads = heads.select(F.col("o_orderkey").alias("doc_id"), F.explode_outer(fixed).alias("l")).select("doc_id", "l.*", none.alias("cells"))
    return heads.unionByName(statement_rows(spark, sf_dir))


def statement_words(lines: DataFrame) -> DataFrame:
    """doc_id, line_no, cell_no, word_no, word, x0, x1, top, bottom, size: a row's cells begin at CELL_LEFTS."""
    lefts = F.array(*[F.lit(float(x)) for x in CELL_LEFTS])
    whole = F.array(F.struct(F.lit(0).alias("cell_no"), F.col("text").alias("text"), F.col("left").alias("left")))
    cells = F.transform("cells", lambda c, i: F.struct(i.alias("cell_no"), c.alias("text"), F.get(lefts, i).alias("left")))
    parts = lines.select("doc_id", "line_no", "kind", "top", "size", "weight", F.explode_outer(F.when(F.size("cells") > 0, cells).otherwise(whole)).alias("c"))
    parts = parts.select("doc_id", "line_no", "kind", "top", "size", "weight", F.col("c.cell_no").cast("long").alias("cell_no"), F.col("c.text").alias("text"), F.col("c.left").alias("left"))
    words = words_of_lines(parts, F.col("left"))
    return words.withColumn("bottom", F.col("top") + F.col("size")).drop("left")
