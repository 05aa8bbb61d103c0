"""Words to lines to segments, columns of a page, and reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of line forming, in points or times the font size
SAME_LINE, LEAST_STEP, SEGMENT_GAP, FRAGMENT_GAP = 0.5, 1.5, 2.5, 0.10
# Fixed values of the column search: bins, quiet share of rows, least gutter and margin as shares of the page
BINS, QUIET, GUTTER, MARGIN = 300, 0.08, 0.025, 0.06
PROSE_LINES, PROSE_WORDS = 5, 6


def island(flag: Column, by: list, order: list) -> Column:
    """Number of the run that a row is in: how many flags there are up to it."""
    w = Window.partitionBy(*by).orderBy(*order)
    return F.sum(F.when(flag, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))


def grouped_lines(words: DataFrame, keys=("doc_id",)) -> DataFrame:
    """words with `line`: a word more than half a font size below the one before begins a new line."""
    order = [F.round("top", 1), "x0", "word_no"]
    w = Window.partitionBy(*keys).orderBy(*order)
    step = F.abs(F.col("top") - F.lag("top").over(w)) > F.greatest(SAME_LINE * F.greatest("size", F.lag("size").over(w)), F.lit(LEAST_STEP))
    flagged = words.withColumn("_new", F.coalesce(step, F.lit(False)))
    return flagged.withColumn("line", island(F.col("_new"), list(keys), order).cast("long")).drop("_new")


def segments(words: DataFrame, keys=("doc_id", "line_no")) -> DataFrame:
    """words with `seg_no`: a gap of more than 2.5 font sizes begins a new segment of the line."""
    order = ["x0", "cell_no", "word_no"]
    w = Window.partitionBy(*keys).orderBy(*order)
    flagged = words.withColumn("_new", F.coalesce(F.col("x0") - F.lag("x1").over(w) > SEGMENT_GAP * F.col("size"), F.lit(False)))
    return flagged.withColumn("seg_no", island(F.col("_new"), list(keys), order).cast("long")).drop("_new")


def merged_fragments(pieces: DataFrame, keys=("doc_id", "line_no")) -> DataFrame:
    """Pieces closer than a tenth of the font size are one word."""
    order = ["x0", "piece_no"]
    w = Window.partitionBy(*keys).orderBy(*order)
    far = F.col("x0") - F.lag("x1").over(w) > FRAGMENT_GAP * F.least("size", F.lag("size").over(w))
    flagged = pieces.withColumn("_new", F.coalesce(far, F.lit(False)))
    numbered = flagged.withColumn("word_no", island(F.col("_new"), list(keys), order).cast("long"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "piece_no", "piece"))), lambda s: s["piece"]), "")
    return numbered.groupBy(*keys, "word_no").agg(text.alias("word"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))


def without_glyph_marks(word: Column) -> Column:
    return F.regexp_replace(word, r"\(cid:[0-9]+\)", "")


def gutter_histogram(words: DataFrame, width: float, keys=("doc_id", "page_idx")) -> DataFrame:
    """keys, bin, n: how many of a page's rows have a word over each bin of its width; empty bins have no row."""
    size = width / BINS
    to_bin = lambda x: F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(x / size)))
    covered = words.select(*keys, F.col("top").alias("_row"), F.explode(F.sequence(to_bin(F.col("x0")), to_bin(F.col("x1")))).alias("bin")).distinct()
    return covered.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))


def _page_gutters(words: DataFrame, width: float, keys: list) -> DataFrame:
    """keys, gutters: the gutters of each page as (left, right), in order.

    A sweep over the page's width: a word adds one to the count where it begins and takes it away behind its end, as far
    as no word before it in its row covers the place. The bin -1, which each row's first word adds to, tells how many
    rows there are. Every step groups by the page at least, so words that are dealt out by document stay where they are.
    """
    size = width / BINS
    to_bin = lambda x: F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(x / size))).cast("int")
    row = Window.partitionBy(F.xxhash64(*keys, "top"), *keys, "top").orderBy("a")  # a hash in front tells rows apart at once when they are sorted
    before = F.max("b").over(row.rowsBetween(Window.unboundedPreceding, -1))
    spans = words.select(*keys, "top", "x0", "x1", to_bin(F.col("x0")).alias("a"), to_bin(F.col("x1")).alias("b")).withColumn("covered", before)
    spans = spans.withColumn("a", F.when(F.col("covered") >= F.col("a"), F.col("covered") + 1).otherwise(F.col("a")))
    turn = lambda bin_, n: F.struct(bin_.alias("bin"), n.alias("n"))
    new = (F.col("a") <= F.col("b")).cast("int")
    both = F.array(turn(F.col("a"), new), turn(F.col("b") + 1, -new))
    both = F.when(F.col("covered").isNull(), F.array(turn(F.lit(-1), F.lit(1)), turn(F.col("a"), new), turn(F.col("b") + 1, -new))).otherwise(both)
    turns = spans.select(*keys, "x0", "x1", F.explode_outer(both).alias("t")).select(*keys, "x0", "x1", "t.*")
    counts = turns.groupBy(*keys, "bin").agg(F.sum("n").alias("n"), F.min("x0").alias("lo"), F.max("x1").alias("hi"))
    pages = counts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("turns"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    pages = pages.withColumn("most", F.floor(QUIET * F.col("turns")[0]["n"])).withColumn("turns", F.slice("turns", 2, F.size("turns")))

    def step(s, t):
        level = s["level"] + t["n"]
        opens, ends = (s["level"] > F.col("most")) & (level <= F.col("most")), (s["level"] <= F.col("most")) & (level > F.col("most"))
        run = F.struct((s["begin"] * size).alias("left"), (t["bin"] * size).alias("right"))
        return F.struct(level.alias("level"), F.when(opens, t["bin"]).otherwise(s["begin"]).alias("begin"), F.when(ends, F.array_append(s["runs"], run)).otherwise(s["runs"]).alias("runs"))

    start = F.from_json(F.lit('{"level":0,"begin":0,"runs":[]}'), "struct<level:bigint,begin:int,runs:array<struct<left:double,right:double>>>")
    runs = F.aggregate("turns", start, step, lambda s: F.array_append(s["runs"], F.struct((s["begin"] * size).alias("left"), F.lit(float(width)).alias("right"))))
    inner = MARGIN * (F.col("hi") - F.col("lo"))
    wide = lambda r: (r["right"] - r["left"] >= GUTTER * width) & (r["left"] > F.col("lo") + inner) & (r["right"] < F.col("hi") - inner)
    return pages.select(*keys, F.filter(runs, wide).alias("gutters"))


def gutter_runs(words: DataFrame, width: float, keys=("doc_id", "page_idx")) -> DataFrame:
    """keys, left, right: runs of bins that at most 8 % of the rows cross, wide enough and away from the text's edges."""
    found = _page_gutters(words, width, list(keys)).select(*keys, F.explode("gutters").alias("g"))
    return found.select(*keys, F.round("g.left", 4).alias("left"), F.round("g.right", 4).alias("right"))


def column_index(centre: Column, splits: Column) -> Column:
    return F.size(F.filter(splits, lambda s: s <= centre)).cast("long")


def column_major(words: DataFrame, gutters: DataFrame, keys=("doc_id", "page_idx")) -> DataFrame:
    """words with col and reading_no: column by column, in each from top to bottom.

    A document's gutters go to its words in one row, by document alone, so words dealt out by document are not moved.
    """
    doc, page = keys
    splits = gutters.groupBy(doc, page).agg(F.array_sort(F.collect_list((F.col("left") + F.col("right")) / 2)).alias("splits"))
    splits = splits.groupBy(doc).agg(F.map_from_entries(F.collect_list(F.struct(page, "splits"))).alias("splits"))
    placed = words.join(splits.hint("shuffle_hash"), doc, "left")
    mine = F.coalesce(F.try_element_at("splits", F.col(page)), F.array().cast("array<double>"))
    placed = placed.withColumn("col", column_index((F.col("x0") + F.col("x1")) / 2, mine)).drop("splits")
    w = Window.partitionBy(F.xxhash64(doc, page), doc, page).orderBy("col", "top", "x0", "word_no")
    return placed.withColumn("reading_no", (F.row_number().over(w) - 1).cast("long"))
