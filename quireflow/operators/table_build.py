"""Tables from their lines: columns from all rows at once, cells with spans, wrapped lines, groups and headers.

A line is a row of cells or other text inside a table. Columns are the stretches between gaps that most rows share,
found by a sweep over where gaps begin and end; nothing is counted bin by bin. Cells take the columns whose middles they
cover. Tables of two columns are first drawn together, since one of their cells often stands on lines of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quireflow.sources.shared import stored

from .levels import let
from .tables import is_numericish

# Bins of a table's width, share of rows that must agree, a full-width row, near left edges of two columns
BINS, AGREE, FULL_ROW, NEAR_FIRST, NEAR_OTHER = 800, 0.6, 0.6, 20.0, 40.0
#: A line further from its neighbour than this many times the other gap stands alone; share of numbers in a header.
FARTHER, HEADER_NUMBERS = 3, 0.3
KEYS = ["doc_id", "table_no"]
CELL = "struct<x0:double,x1:double,text:string>"
LINE = f"struct<line_no:bigint,is_row:boolean,top:double,bottom:double,cells:array<{CELL}>>"


def evaluated(lines: DataFrame) -> DataFrame:
    """doc_id, table_no, n_cols, longest_run: most cells of a row, and most rows that follow each other."""
    w = Window.partitionBy(*KEYS).orderBy("line_no")
    run = lines.withColumn("run", F.sum((~F.col("is_row")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = run.groupBy(*KEYS, "run").agg(F.count_if("is_row").alias("n"), F.max(F.when(F.col("is_row"), F.size("cells")).otherwise(1)).alias("cols"))
    return runs.groupBy(*KEYS).agg(F.max("cols").cast("long").alias("n_cols"), F.max("n").alias("longest_run"))


def _text_joined(a, b):
    return F.struct(F.least(a["x0"], b["x0"]).alias("x0"), F.greatest(a["x1"], b["x1"]).alias("x1"), F.concat_ws(" ", a["text"], b["text"]).alias("text"))


def compacted(lines: DataFrame) -> DataFrame:
    """Lines of tables of two columns, drawn together from the first down.

    Text before a row that begins within 20 points of it and ends before its second cell is the beginning of the row's
    first cell. Text behind a row that begins within 40 points of one of its further cells goes on with the nearest of
    them. Texts that stand beside each other are a row.
    """
    order = F.array_sort(F.collect_list(F.struct("line_no", "is_row", "top", "bottom", "cells")))

    def line(no, is_row, top, bottom, cells):
        return F.struct(no.alias("line_no"), is_row.alias("is_row"), top.alias("top"), bottom.alias("bottom"), cells.alias("cells"))

    def step(s, x):
        p = s["now"]
        first, other = F.get(p["cells"], F.lit(0)), F.get(x["cells"], F.lit(0))
        head = ~p["is_row"] & x["is_row"] & (F.abs(other["x0"] - first["x0"]) < NEAR_FIRST) & ~((F.size(x["cells"]) == 2) & (F.get(x["cells"], F.lit(1))["x0"] < first["x1"]))
        begun = line(x["line_no"], F.lit(True), F.least(p["top"], x["top"]), F.greatest(p["bottom"], x["bottom"]), F.transform(x["cells"], lambda c, i: F.when(i == 0, _text_joined(first, c)).otherwise(c)))
        shift = F.transform(p["cells"], lambda c, i: F.when((i > 0) & (F.abs(other["x0"] - c["x0"]) < NEAR_OTHER), F.struct(F.abs(other["x0"] - c["x0"]).alias("d"), (-i).alias("i"))))
        tail = F.array_min(F.filter(shift, lambda d: d.isNotNull()))
        text = F.aggregate(F.slice(x["cells"], 2, F.size(x["cells"])), other, lambda a, c: _text_joined(a, c))
        goes_on = p["is_row"] & ~x["is_row"] & tail.isNotNull()
        wrapped = line(p["line_no"], F.lit(True), p["top"], F.greatest(p["bottom"], x["bottom"]), F.transform(p["cells"], lambda c, i: F.when(i == -tail["i"], _text_joined(c, text)).otherwise(c)))
        beside = ~p["is_row"] & ~x["is_row"] & (F.least(p["bottom"], x["bottom"]) > F.greatest(p["top"], x["top"]))
        both = line(p["line_no"], F.lit(True), F.least(p["top"], x["top"]), F.greatest(p["bottom"], x["bottom"]), F.array_sort(F.concat(p["cells"], x["cells"])))
        one = F.when(head, begun).when(goes_on, wrapped).when(beside, both)
        apart = F.struct(x.alias("now"), F.when(p.isNotNull(), F.array_append(s["done"], p)).otherwise(s["done"]).alias("done"))
        return F.when(F.coalesce(head | goes_on | beside, F.lit(False)), F.struct(one.alias("now"), s["done"].alias("done"))).otherwise(apart)

    start = F.from_json(F.lit('{"done":[]}'), f"struct<now:{LINE},done:array<{LINE}>>")
    drawn = lines.groupBy(*KEYS).agg(order.alias("xs")).withColumn("xs", F.transform("xs", lambda x: x.cast(LINE)))
    drawn = drawn.select(*KEYS, F.explode(F.aggregate("xs", start, lambda s, x: let(F.struct(s.alias("s"), x.alias("x")), lambda b: step(b["s"], b["x"])), lambda s: F.array_append(s["done"], s["now"]))).alias("x"))
    return drawn.select(*KEYS, "x.*")


def column_spans(lines: DataFrame, page_width: float = 612.0) -> DataFrame:
    """doc_id, table_no, cols: the columns (l, r) of each table for which rows agree on at least two."""
    cell = F.col("cells")[0]
    rows = lines.filter("is_row AND size(cells) > 0").filter(~((F.size("cells") == 1) & (cell["x1"] - cell["x0"] > FULL_ROW * page_width)))
    cells = rows.select(*KEYS, "line_no", F.size("cells").alias("n"), F.explode("cells").alias("c")).select(*KEYS, "line_no", "n", "c.x0", "c.x1")
    extent = cells.groupBy(*KEYS).agg(F.min("x0").alias("lo"), F.max("x1").alias("hi"), F.count_distinct("line_no").alias("n_rows"), F.max("n").alias("most"))
    extent = extent.filter("n_rows >= 2 AND hi > lo").withColumn("width", (F.col("hi") - F.col("lo")) / BINS)
    along = Window.partitionBy(*KEYS, "line_no").orderBy("x0", "x1")
    gaps = cells.withColumn("b", F.lead("x0").over(along)).filter("b > x1").join(extent, KEYS)
    to_bin = lambda x: F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor((F.col(x) - F.col("lo")) / F.col("width")))).cast("int")
    ends = F.array(F.struct(to_bin("x1").alias("bin"), F.lit(1).alias("d")), F.struct(to_bin("b").alias("bin"), F.lit(-1).alias("d")))
    turns = gaps.select(*KEYS, "lo", "width", "n_rows", F.explode(ends).alias("e")).groupBy(*KEYS, "lo", "width", "n_rows", "e.bin").agg(F.sum("e.d").alias("d"))
    w = Window.partitionBy(*KEYS).orderBy("bin")
    levels = turns.withColumn("n", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("next", F.lead("bin").over(w))
    levels = levels.withColumn("sep", F.col("n") >= F.greatest(F.lit(2), F.floor(AGREE * F.col("n_rows"))))
    levels = levels.withColumn("run", F.sum((F.col("sep") & ~F.coalesce(F.lag("sep").over(w), F.lit(False))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    seps = levels.filter("sep").groupBy(*KEYS, "lo", "width", "run").agg(F.min("bin").alias("i"), F.max("next").alias("j"))
    seps = seps.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.col("lo") + (F.col("i") + F.col("j")) / 2 * F.col("width"))).alias("seps"))
    placed = cells.join(seps, KEYS).withColumn("k", F.size(F.filter("seps", lambda s: s <= (F.col("x0") + F.col("x1")) / 2)))
    cols = placed.groupBy(*KEYS, "k").agg(F.round(F.min("x0"), 2).alias("l"), F.round(F.max("x1"), 2).alias("r"))
    by_k = Window.partitionBy(*KEYS).orderBy("k")
    after, before = F.lead("l").over(by_k), F.lag("r").over(by_k)
    cols = cols.withColumn("_r", F.when(F.col("r") > after, F.round((after + F.col("r")) / 2, 2)).otherwise(F.col("r"))).withColumn("_l", F.when(before > F.col("l"), F.round((F.col("l") + before) / 2, 2)).otherwise(F.col("l")))
    tables = cols.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct(F.col("_l").alias("l"), F.col("_r").alias("r")))).alias("cols"), F.min(F.col("_r") > F.col("_l")).alias("sound"))
    return tables.join(extent.select(*KEYS, "most"), KEYS).filter((F.size("cols") >= 2) & F.col("sound") & (F.size("cols") <= F.col("most"))).select(*KEYS, "cols")


def _covered(cell, cols):
    """First column (from 0) and number of columns whose middles lie in a cell; else the column nearest to its middle."""
    inside = F.filter(F.transform(cols, lambda c, i: F.when(((c["l"] + c["r"]) / 2 >= cell["x0"]) & ((c["l"] + c["r"]) / 2 <= cell["x1"]), i)), lambda i: i.isNotNull())
    middle = (cell["x0"] + cell["x1"]) / 2
    nearest = F.array_min(F.transform(cols, lambda c, i: F.struct(F.abs((c["l"] + c["r"]) / 2 - middle).alias("d"), i.alias("i"))))["i"]
    first = F.when(F.size(inside) > 0, F.get(inside, F.lit(0))).otherwise(nearest)
    return F.struct(first.alias("col"), F.greatest(F.size(inside), F.lit(1)).alias("span"), cell["x0"].alias("x0"), cell["text"].alias("text"))


def built(lines: DataFrame, page_width: float = 612.0) -> DataFrame:
    """doc_id, table_no, row_no, col_no, colspan, kind, text: the cells of each table.

    lines: doc_id, table_no, line_no, is_row, top, bottom, cells (x0, x1, text). Text of one cell between two lines goes to
    the row that is nearer, where it lies within a column and does not end with a colon; any other is a group over all
    columns. The first row is a header when it has two texts and few numbers. Tables without columns of their own give
    none; two texts in one column are one cell.
    """
    n_cols = F.max(F.when(F.col("is_row"), F.size("cells")).otherwise(1)).over(Window.partitionBy(*KEYS))
    lines = stored(lines.select(*KEYS, "line_no", "is_row", "top", "bottom", "cells").withColumn("n_cols", n_cols))
    lines = lines.filter("n_cols <> 2").drop("n_cols").unionByName(compacted(lines.filter("n_cols = 2").drop("n_cols")))
    rows = lines.join(column_spans(lines, page_width), KEYS)
    rows = rows.withColumn("placed", F.transform("cells", lambda c: _covered(c, F.col("cols"))))
    w = Window.partitionBy(*KEYS).orderBy("line_no")
    above, below = F.col("top") - F.lag("bottom").over(w), F.lead("top").over(w) - F.col("bottom")
    one = F.get("placed", F.lit(0))
    cell, column = F.get("cells", F.lit(0)), F.get("cols", one["col"])
    after, before = F.get("cols", one["col"] + 1), F.when(one["col"] > 0, F.get("cols", one["col"] - 1))
    within = (cell["x0"] > F.coalesce(before["r"], F.lit(-1.0))) & (cell["x1"] < F.coalesce(after["l"], F.lit(1e9))) & (cell["x0"] < column["r"])
    fits = (F.size("placed") == 1) & (one["span"] == 1) & within & ~F.rtrim(cell["text"]).endswith(":")
    way = F.when(F.col("is_row"), "row").when(~F.coalesce(fits, F.lit(False)) | above.isNull() | below.isNull(), "group").when((above < 0) | (above < below), "up").when((above > below) & (above < FARTHER * below), "down").otherwise("group")
    rows = rows.withColumn("way", way)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    kept = F.last(F.when(F.col("way").isin("row", "group"), F.struct("line_no", "way")), ignorenulls=True).over(past)
    rows = rows.withColumn("up", kept).withColumn("next", F.lead(F.struct("line_no", "way")).over(w))
    home = F.when((F.col("way") == "up") & (F.col("up.way") == "row"), F.col("up.line_no")).when((F.col("way") == "down") & (F.col("next.way") == "row"), F.col("next.line_no")).otherwise(F.col("line_no"))
    rows = rows.withColumn("home", home).withColumn("kind", F.when((F.col("way") == "row") | (F.col("home") != F.col("line_no")), "row").otherwise("group"))
    whole = F.array(F.struct(F.lit(0).alias("col"), F.size("cols").alias("span"), cell["x0"].alias("x0"), F.array_join(F.transform("cells", lambda c: c["text"]), " ").alias("text")))
    flat = rows.select(*KEYS, "home", "kind", "line_no", F.explode(F.when(F.col("kind") == "group", whole).otherwise(F.col("placed"))).alias("p")).select(*KEYS, "home", "kind", "line_no", "p.*")
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "x0", "text"))), lambda t: t["text"]), " ")
    cells = flat.groupBy(*KEYS, "home", "kind", "col").agg(F.max("span").cast("long").alias("colspan"), texts.alias("text"))
    by_home = Window.partitionBy(*KEYS).orderBy("home")
    cells = cells.withColumn("row_no", (F.dense_rank().over(by_home) - 1).cast("long"))
    of_row = Window.partitionBy(*KEYS, "row_no")
    header = (F.col("row_no") == 0) & (F.col("kind") == "row") & (F.count(F.lit(1)).over(of_row) >= 2) & (F.avg(is_numericish(F.col("text")).cast("int")).over(of_row) < HEADER_NUMBERS)
    return cells.select(*KEYS, "row_no", F.col("col").cast("long").alias("col_no"), "colspan", F.when(header, "header").otherwise(F.col("kind")).alias("kind"), "text")
