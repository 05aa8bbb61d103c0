"""What is not content: running heads and feet, folios, stamps, junk, doubled rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Zones of the page, share of pages, words of a furniture line, grid of positions
HEADER_ZONE, FOOTER_ZONE, NEAR = 0.18, 0.9, 20
FURNITURE_WORDS, FURNITURE_SHARE = 6, 0.04
POSITION_GRID = 0.06
CHROME_TOP, CHROME_BOTTOM, CHROME_WORDS = 0.11, 0.89, 30
FOLIO = r"(?i)^(?:page\s+)?[0-9ivxlcdm]+(?:\s+of\s+[0-9ivxlcdm]+)?$"
EMAIL, URL, PAGE_FOLIO = r"^\S+@\S+\.\S+$", r"(?i)^(?:https?://|www\.)\S+$", r"^(?:[0-9]{1,3}|-\s*[0-9]{1,3}\s*-|[A-Za-z]-[0-9]{1,3})$"
LOWER_ROMAN = r"^m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})$"
CJK = "[\\x{2E80}-\\x{9FFF}\\x{AC00}-\\x{D7AF}\\x{F900}-\\x{FAFF}\\x{FF00}-\\x{FFEF}\\x{1F300}-\\x{1FAFF}]"
LEADER = "[._�]{2,}"


def letters_only(text: Column) -> Column:
    return F.regexp_replace(text, "[^a-zA-Z]+", "")


def repeated_edges(lines: DataFrame, height: float) -> DataFrame:
    """doc_id, zone, text_key, top, left, n_pages: places in the head or foot zone whose text comes back on other pages.

    Lines are one where their letters are the same and their places less than NEAR points apart in both directions;
    neighbours meet by cells of that size. Their pages must follow each other (two apart at most on average, or three
    quarters of the steps) and be more than half of all, or more than a fifth or five where they reach past the third
    page; a line without letters needs no share.
    """
    zone = F.when(F.col("top") < HEADER_ZONE * height, "header").when(F.col("top") > FOOTER_ZONE * height, "footer")
    keyed = lines.withColumn("zone", zone).filter("zone IS NOT NULL").withColumn("text_key", letters_only(F.col("text")))
    places = keyed.groupBy("doc_id", "zone", "text_key", "top", "left").agg(F.collect_set("page_idx").alias("pages"))
    cell = lambda c: F.floor(F.col(c) / NEAR)
    around = lambda c: F.explode(F.sequence(cell(c) - 1, cell(c) + 1))
    a = places.select("doc_id", "zone", "text_key", "top", "left", around("top").alias("cy")).withColumn("cx", around("left"))
    b = places.select("doc_id", "zone", "text_key", cell("top").alias("cy"), cell("left").alias("cx"), F.col("top").alias("y"), F.col("left").alias("x"), "pages")
    near = (F.abs(F.col("top") - F.col("y")) < NEAR) & (F.abs(F.col("left") - F.col("x")) < NEAR)
    met = a.join(b, ["doc_id", "zone", "text_key", "cy", "cx"]).filter(near)
    met = met.groupBy("doc_id", "zone", "text_key", "top", "left").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("pages")))).alias("pages"))
    n = F.size("pages")
    steps = F.array_sort(F.transform(F.slice("pages", F.lit(2), F.greatest(n - 1, F.lit(0))), lambda p, i: p - F.get("pages", i)))
    all_pages = lines.groupBy("doc_id").agg(F.countDistinct("page_idx").alias("n_all"))
    found = met.filter(n > 1).withColumn("n_pages", n.cast("long")).withColumn("steps", steps).join(all_pages, "doc_id")
    at = (F.col("n_pages") - 2) * 0.75
    lower, upper = (F.get("steps", f(at).cast("int")) for f in (F.floor, F.ceil))
    follow = ((F.element_at("pages", -1) - F.get("pages", F.lit(0))) / (F.col("n_pages") - 1) <= 2) | (lower + (at - F.floor(at)) * (upper - lower) <= 2)
    many = (F.col("n_pages") > 0.2 * F.col("n_all")) | (F.col("n_pages") > 5)
    share = (F.col("n_pages") > 0.5 * F.col("n_all")) | (F.col("text_key") == "") | (many & (F.element_at("pages", -1) > 2))
    return found.filter(follow & share).select("doc_id", "zone", "text_key", "top", "left", "n_pages")


def is_folio(text: Column) -> Column:
    return text.rlike(FOLIO)


def is_furniture(text: Column) -> Column:
    """The whole text is a folio, an address of mail or web, or a small roman number."""
    return (text != "") & (text.rlike(EMAIL) | text.rlike(URL) | F.lower(text).rlike(PAGE_FOLIO) | text.rlike(LOWER_ROMAN))


def is_corner(top: Column, bottom: Column, left: Column) -> Column:
    """Pinned to the head or foot of the page, right of the middle. All as shares of the page."""
    return (bottom < 0.055) | ((top > 0.91) & (left > 0.55)) | ((top > 0.88) & (left > 0.70))


def without_leaders(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, LEADER, " "), " +", " "))


def without_cjk(text: Column) -> Column:
    """CJK and emoji out, unless no letter or digit would be left."""
    rest = F.regexp_replace(text, CJK, "")
    return F.when(rest.rlike("[0-9A-Za-z]"), rest).otherwise(text)


def is_junk_token(token: Column) -> Column:
    """A quarter or more of it marks, two at least, or letters and digits mixed more than once."""
    marks = F.length(F.regexp_replace(token, r"[\p{L}0-9]", ""))
    return ((marks >= 2) & (marks * 4 >= F.length(token))) | token.rlike("[a-z][0-9][a-z]|[0-9][a-z][0-9]")


def is_junk(text: Column) -> Column:
    """Most tokens are junk."""
    toks = F.filter(F.split(text, " +"), lambda t: t != "")
    return F.size(F.filter(toks, is_junk_token)) * 2 > F.size(toks)


def merged_rules(rules: DataFrame, keys=("doc_id",)) -> DataFrame:
    """Horizontal rules within a point of each other are one: keys, y, x0, x1 of their unions where they touch."""
    keys = list(keys)
    snapped = rules.withColumn("y", F.round("top"))
    w = Window.partitionBy(*keys, "y").orderBy("x0", "x1")
    reach = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = snapped.withColumn("_new", F.coalesce(F.col("x0") > reach + 1, F.lit(False)))
    joined = flagged.withColumn("_run", F.sum(F.col("_new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return joined.groupBy(*keys, "y", "_run").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.count(F.lit(1)).alias("n")).drop("_run")
