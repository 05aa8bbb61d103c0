"""Tables, joins of boxes, labels, units and renderings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from quireflow.operators import batches as BT
from quireflow.operators import filters as FL
from quireflow.operators import hierarchy as H
from quireflow.operators import labels as LB
from quireflow.operators import layouts as LO
from quireflow.operators import regions as RG
from quireflow.operators import render as R
from quireflow.operators import spatial as SP
from quireflow.operators import strict
from quireflow.operators import tables as TB
from quireflow.operators import units as U
from quireflow.sources import lift

from . import sql as S
from .block_queries import _BLOCKS, _NODES, _blocks, _nodes
from .layout_queries import _swords
from .line_queries import _statements
from .registry import query
from .structure_queries import _page_words

_n = lambda: F.count(F.lit(1)).alias("n")

# tables


def _row_words(spark, d):
    """The words of the statements' rows, which stay dealt out by document as the rows are."""
    return lift.statement_words(lift.statement_rows(spark, d))


def _grid(spark, d):
    """doc_id, row_no, col, cell: the cells of the statements' rows."""
    rows = lift.statement_lines(spark, d).filter("kind = 'row'")
    return rows.select("doc_id", F.col("line_no").alias("row_no"), "top", F.posexplode("cells").alias("col", "cell")).withColumn("col", F.col("col").cast("long"))


_GRID = f"{S.STATEMENTS}, grid AS (SELECT doc_id, line_no AS row_no, top, unnest(range(len(cells))) AS col, unnest(cells) AS cell FROM statement WHERE kind = 'row')"
_CUTS = f"""{S.STATEMENT_WORDS}, rwords AS (SELECT * FROM swords WHERE kind = 'row'),
    ext AS (SELECT doc_id, count(DISTINCT line_no) AS rows, floor(min(x0) / 2)::BIGINT AS lo, ceil(max(x1) / 2)::BIGINT AS hi FROM rwords GROUP BY doc_id),
    bins AS (SELECT doc_id, rows, unnest(range(lo, hi)) AS bin FROM ext),
    cov AS (SELECT DISTINCT doc_id, line_no, unnest(range(floor(x0 / 2)::BIGINT, ceil(x1 / 2)::BIGINT)) AS bin FROM rwords),
    cnt AS (SELECT doc_id, bin, count(*) AS n FROM cov GROUP BY ALL),
    qt AS (SELECT doc_id, bin FROM bins LEFT JOIN cnt USING (doc_id, bin) WHERE coalesce(n, 0) <= 0.12 * rows),
    qr AS (SELECT *, bin - row_number() OVER (PARTITION BY doc_id ORDER BY bin) AS run FROM qt),
    cuts AS (SELECT doc_id, (min(bin) + max(bin) + 1) * 2.0::DOUBLE / 2 AS cut FROM qr GROUP BY doc_id, run HAVING (max(bin) + 1 - min(bin)) * 2 >= 4)"""


@query(f"""WITH {_BLOCKS}, t AS (SELECT doc_id, block_idx, block_idx - row_number() OVER (PARTITION BY doc_id ORDER BY block_idx) AS run FROM blocks WHERE block_type = 'table_row')
    SELECT doc_id, min(block_idx) AS first_block, count(*)::BIGINT AS n FROM t GROUP BY doc_id, run HAVING count(*) >= 2""")
def table_spans(spark, d):
    rows = _blocks(spark, d).filter("block_type = 'table_row'")
    rows = rows.withColumn("run", F.col("block_idx") - F.row_number().over(Window.partitionBy("doc_id").orderBy("block_idx")))
    return rows.groupBy("doc_id", "run").agg(F.min("block_idx").alias("first_block"), _n()).filter("n >= 2").drop("run")


@query(f"WITH {_CUTS} SELECT doc_id, cut FROM cuts")
def channel_cuts(spark, d):
    return TB.channel_cuts(_row_words(spark, d))


@query(f"""WITH {_CUTS}, cl AS (SELECT doc_id, list(cut) AS cs FROM cuts GROUP BY doc_id)
    SELECT doc_id, line_no, cell_no, word_no, len(list_filter(coalesce(cs, []), lambda c: c <= (x0 + x1) / 2))::BIGINT AS col FROM rwords LEFT JOIN cl USING (doc_id)""")
def cell_assignment(spark, d):
    return TB.words_in_cells(_row_words(spark, d), ["line_no", "cell_no", "word_no"])


@query(f"""WITH {_GRID}, r AS (SELECT doc_id, row_no, top, count(*) AS used FROM grid WHERE cell <> '' GROUP BY ALL), m AS (SELECT *, max(used) OVER (PARTITION BY doc_id) AS cols, top - lag(top) OVER (PARTITION BY doc_id ORDER BY row_no) AS gap FROM r)
    SELECT doc_id, row_no, used::BIGINT AS used, coalesce(used <= greatest(1, (cols - 1) // 2) AND gap < 0.6 * 10, false) AS wrapped FROM m""")
def table_rows(spark, d):
    """Rows with the number of their cells, and whether one only goes on with the row before."""
    rows = _grid(spark, d).filter("cell <> ''").groupBy("doc_id", "row_no", "top").agg(F.count(F.lit(1)).alias("used"))
    rows = rows.withColumn("cols", F.max("used").over(Window.partitionBy("doc_id"))).withColumn("gap", F.col("top") - F.lag("top").over(Window.partitionBy("doc_id").orderBy("row_no")))
    wrapped = (F.col("used") <= F.greatest(F.lit(1), F.expr("(cols - 1) DIV 2"))) & (F.col("gap") < 0.6 * 10)
    return rows.select("doc_id", "row_no", "used", F.coalesce(wrapped, F.lit(False)).alias("wrapped"))


_NUMERIC = f"(regexp_matches(cell, {S.q(TB.NUMERIC)}) AND NOT regexp_matches(cell, '^(?:19|20)[0-9]{{2}}$'))"


@query(f"WITH {_GRID}, f AS (SELECT doc_id, row_no, avg({_NUMERIC}::INT) AS s FROM grid GROUP BY ALL) SELECT doc_id, row_no, round(s, 6) AS numeric_share, s < 0.3 AS header_like FROM f")
def header_rows(spark, d):
    rows = _grid(spark, d).groupBy("doc_id", "row_no").agg(F.avg(TB.is_numericish(F.col("cell")).cast("int")).alias("s"))
    return rows.select("doc_id", "row_no", F.round("s", 6).alias("numeric_share"), (F.col("s") < 0.3).alias("header_like"))


@query(f"""WITH {_GRID}, s AS (SELECT doc_id, col, bool_and(cell IN ('$', '€', '£', '¥', '')) AS symbol FROM grid GROUP BY ALL),
    m AS (SELECT g.*, symbol, lag(CASE WHEN symbol THEN cell END) OVER (PARTITION BY g.doc_id, row_no ORDER BY col) AS sign FROM grid g JOIN s USING (doc_id, col))
    SELECT doc_id, row_no, col, coalesce(sign, '') || cell AS cell FROM m WHERE NOT symbol""")
def symbol_column_merge(spark, d):
    """Columns of currency signs alone go into the cell to their right."""
    grid = _grid(spark, d)
    signs = grid.groupBy("doc_id", "col").agg(F.bool_and(F.col("cell").isin(*TB.SYMBOLS, "")).alias("symbol"))
    marked = grid.join(signs, ["doc_id", "col"])
    sign = F.lag(F.when(F.col("symbol"), F.col("cell"))).over(Window.partitionBy("doc_id", "row_no").orderBy("col"))
    return marked.withColumn("sign", sign).filter("NOT symbol").select("doc_id", "row_no", "col", F.concat(F.coalesce("sign", F.lit("")), "cell").alias("cell"))


_STACK = """st AS (SELECT doc_id, line_no, top + CASE WHEN line_no > 7 THEN 60 ELSE 0 END AS y FROM statement WHERE kind = 'row'),
    sg AS (SELECT *, y - lag(y) OVER (PARTITION BY doc_id ORDER BY line_no) AS gap FROM st), sm AS (SELECT *, median(gap) OVER (PARTITION BY doc_id) AS med FROM sg)"""


@query(f"WITH {S.STATEMENTS}, {_STACK} SELECT doc_id, line_no, sum(coalesce(gap > 1.8 * med, false)::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)::BIGINT AS table_no FROM sm")
def stacked_split(spark, d):
    """Tables on top of each other, parted where the step is far wider than usual."""
    rows = lift.statement_lines(spark, d).filter("kind = 'row'").withColumn("y", F.col("top") + F.when(F.col("line_no") > 7, 60).otherwise(0))
    rows = rows.withColumn("gap", F.col("y") - F.lag("y").over(Window.partitionBy("doc_id").orderBy("line_no"))).withColumn("med", F.median("gap").over(Window.partitionBy("doc_id")))
    return TB.islands_by_gap(rows, F.col("gap") > TB.STACK_GAP * F.col("med"), ["doc_id"], ["line_no"], "table_no").select("doc_id", "line_no", "table_no")


@query(f"""WITH {_CUTS}, c AS (SELECT t.doc_id, list(round(cut) ORDER BY cut) AS cs, o_custkey FROM cuts t JOIN orders ON o_orderkey = t.doc_id GROUP BY t.doc_id, o_custkey),
    l AS (SELECT *, lag(cs) OVER (PARTITION BY o_custkey ORDER BY doc_id) AS pc FROM c),
    j AS (SELECT *, coalesce(len(cs) = len(pc) AND list_bool_and([abs(x - pc[i]) <= 4 for x, i in cs]), false) AS same FROM l)
    SELECT o_custkey, doc_id, sum((NOT same)::INT) OVER (PARTITION BY o_custkey ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM j""")
def stitch_runs(spark, d):
    """A customer's tables that follow each other with the same cuts, within four points, are one run."""
    cuts = TB.cut_lists(_row_words(spark, d))
    orders = lift.read(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_custkey")
    t = cuts.join(orders, "doc_id").withColumn("cs", F.transform("cuts", lambda c: F.round(c)))
    w = Window.partitionBy("o_custkey").orderBy("doc_id")
    t = t.withColumn("pc", F.lag("cs").over(w))
    same = (F.size("cs") == F.size("pc")) & F.forall(F.zip_with("cs", "pc", lambda a, b: F.abs(a - b) <= TB.STITCH_SHIFT), lambda b: b)
    return TB.islands_by_gap(t, ~F.coalesce(same, F.lit(False)), ["o_custkey"], ["doc_id"], "run").select("o_custkey", "doc_id", "run")


@query(f"""WITH {_GRID} SELECT doc_id, round(avg((cell <> '')::INT), 6) AS fill, round(avg((len(regexp_extract_all(cell, '[0-9]+\\.[0-9]+')) > 1)::INT), 6) AS multi_number,
    round(avg((len(string_split(cell, ' ')) >= 6)::INT), 6) AS prose FROM grid GROUP BY doc_id""")
def grid_quality(spark, d):
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    cell = F.col("cell")
    return _grid(spark, d).groupBy("doc_id").agg(
        share(cell != "").alias("fill"), share(F.regexp_count(cell, F.lit(r"[0-9]+\.[0-9]+")) > 1).alias("multi_number"), share(F.size(F.split(cell, " ")) >= 6).alias("prose")
    )


@query(f"""WITH {S.STATEMENTS}, h AS (SELECT doc_id, line_no, '<tr>' || array_to_string([ '<td>' || replace(replace(replace(c, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</td>' for c in cells], '') || '</tr>' AS r FROM statement WHERE kind = 'row')
    SELECT doc_id, '<table>' || string_agg(r, '' ORDER BY line_no) || '</table>' AS html FROM h GROUP BY doc_id""")
def table_html(spark, d):
    rows = lift.statement_lines(spark, d).filter("kind = 'row'").select("doc_id", "line_no", TB.html_row(F.col("cells"), F.lit("td")).alias("row"))
    tables = R.joined(rows, "doc_id", "line_no", "row", "", "inner")
    return tables.select("doc_id", F.concat(F.lit("<table>"), "inner", F.lit("</table>")).alias("html"))


@query()
def infer_grid_strict(spark, d):
    """Grids of words without rules: cuts, rows with their continuations, fill."""
    return strict.inferred_grids(_row_words(spark, d))


@query(f"""WITH {_CUTS}, r AS (SELECT doc_id, line_no, cell_no, min(x0) AS l, max(x1) AS r FROM rwords GROUP BY ALL), p AS (SELECT *, lag(l) OVER o AS pl, lag(r) OVER o AS pr FROM r WINDOW o AS (PARTITION BY doc_id, cell_no ORDER BY line_no))
    SELECT doc_id, line_no, count(*) FILTER (WHERE abs(l - pl) <= 6)::BIGINT AS n_left, count(*) FILTER (WHERE abs(r - pr) <= 6)::BIGINT AS n_right, count(*) FILTER (WHERE abs((l + r) - (pl + pr)) / 2 <= 6)::BIGINT AS n_centre FROM p GROUP BY ALL""")
def row_alignment(spark, d):
    """Cells of a row that stand left, right or centred under those of the row before."""
    cells = _row_words(spark, d).groupBy("doc_id", "line_no", "cell_no").agg(F.min("x0").alias("l"), F.max("x1").alias("r"))
    w = Window.partitionBy("doc_id", "cell_no").orderBy("line_no")
    p = cells.withColumn("pl", F.lag("l").over(w)).withColumn("pr", F.lag("r").over(w))
    near = lambda a, b: F.count_if(F.abs(a - b) <= 6)
    return p.groupBy("doc_id", "line_no").agg(near(F.col("l"), F.col("pl")).alias("n_left"), near(F.col("r"), F.col("pr")).alias("n_right"), near((F.col("l") + F.col("r")) / 2, (F.col("pl") + F.col("pr")) / 2).alias("n_centre"))


_REGION = f"""{_BLOCKS}, rg AS (SELECT doc_id, min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b, count(*)::BIGINT AS n FROM blocks WHERE block_type = 'table_row' GROUP BY doc_id)"""


@query(f'WITH {_REGION} SELECT doc_id, l AS "left", t AS top, r AS "right", b AS bottom, n FROM rg')
def table_regions(spark, d):
    rows = _blocks(spark, d).filter("block_type = 'table_row'")
    return rows.groupBy("doc_id").agg(F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"), _n())


# boxes

_TOKENS = f"""{_BLOCKS}, {S.STATEMENT_WORDS.split(S.STATEMENTS, 1)[1].lstrip(',')}, pt AS (SELECT doc_id, line_no, cell_no, word_no, (x0 + x1) / 2 AS x, (top + bottom) / 2 AS y FROM swords),
    held AS (SELECT p.doc_id, line_no, cell_no, word_no, arg_min(block_idx, ((r - l) * (b - t), block_idx)) AS block_idx FROM pt p JOIN blocks k ON p.doc_id = k.doc_id AND x >= l - 0.01 AND x <= r + 0.01 AND y >= t - 0.01 AND y <= b + 0.01 GROUP BY ALL)"""


def _laid_out(spark, d):
    """The lines of each statement as _pages(), with what their blocks need."""
    lines = lift.statement_lines(spark, d).withColumn("text", F.trim("text")).filter("doc_id IS NOT NULL AND text <> ''")
    in_cells = F.size("cells") > 0
    texts, left = F.when(in_cells, F.col("cells")).otherwise(F.array("text")), F.when(~in_cells, F.col("left"))
    n = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    words = ["line_no", (F.col("kind") == "row").alias("is_row"), "top", (F.col("top") + F.col("size")).alias("bottom"), left.alias("left"), texts.alias("texts")]
    return lines.select("doc_id", *words, F.col("left").alias("line_left"), "size", "weight", "text", n.alias("n_lines"))


def _blocks_and_words(batch):
    """The lines (document, number, block), blocks and words of a batch of _laid_out()."""
    of, xs = BT.flat(batch)
    number = lambda c: xs[c].to_numpy(zero_copy_only=False)
    order = np.lexsort((number("line_no"), of))
    lines = {"top": number("top")[order], "left": number("line_left")[order], "size": number("size")[order], "weight": number("weight")[order]}
    block, b = LO.blocks(of[order], lines, xs["text"].take(pa.array(order)))
    return (of[order], number("line_no")[order], block), b, _page_words(batch)


def _of_statements(spark, d, made, schema):
    """made(lines, blocks, words) of the statements of each batch, as regions.mapped() takes it."""
    return RG.mapped(_laid_out(spark, d), lambda batch: made(*_blocks_and_words(batch)), f"doc_id long, {schema}", n_rows="n_lines")


def _lost_words(spark, d):
    """The words of statements without a key, which no block holds."""
    return lift.statement_words(lift.statement_lines(spark, d).filter("doc_id IS NULL"))


@query(f"WITH {_TOKENS} SELECT doc_id, line_no, cell_no, word_no, block_idx FROM held")
def token_in_block(spark, d):
    def made(lines, b, w):
        word, held, _ = LO.of_words(w, lines[2], b)
        return w["of"][word], w["line"][word], w["cell_no"][word], w["word_no"][word], b["idx"][held]

    return _of_statements(spark, d, made, "line_no long, cell_no long, word_no long, block_idx long")


@query(f"WITH {_TOKENS} SELECT doc_id, count(*)::BIGINT AS n FROM pt ANTI JOIN held USING (doc_id, line_no, cell_no, word_no) GROUP BY doc_id")
def unclaimed_words(spark, d):
    def made(lines, b, w):
        of, n = np.unique(w["of"][~LO.of_words(w, lines[2], b)[2]], return_counts=True)
        return of, n

    return _of_statements(spark, d, made, "n long").union(_lost_words(spark, d).groupBy("doc_id").agg(_n()))


@query(f"""WITH {_REGION} SELECT k.doc_id, block_idx, round(greatest(0.0, least(k.r, g.r) - greatest(k.l, g.l)) * greatest(0.0, least(k.b, g.b) - greatest(k.t, g.t)) / ((k.r - k.l) * (k.b - k.t)), 6) AS share
    FROM blocks k JOIN rg g USING (doc_id)""")
def block_overlap(spark, d):
    """Share of each block that the table region of its document covers."""
    w = Window.partitionBy("doc_id")
    row = F.col("block_type") == "table_row"
    region = F.struct(*[f(F.when(row, F.col(c))).over(w).alias(c) for f, c in ((F.min, "left"), (F.min, "top"), (F.max, "right"), (F.max, "bottom"))])
    blocks = _blocks(spark, d).filter("doc_id IS NOT NULL").select("doc_id", "block_idx", F.struct("left", "top", "right", "bottom").alias("a"), region.alias("b"))
    return blocks.filter("b.left IS NOT NULL").select("doc_id", "block_idx", F.round(SP.intersection("a", "b") / SP.area("a"), 6).alias("share"))


@query(f"""WITH {_BLOCKS} SELECT a.doc_id, a.block_idx, (SELECT arg_max(h.block_idx, (h.t, h.block_idx)) FROM blocks h WHERE h.doc_id = a.doc_id AND h.block_type = 'header' AND h.t <= a.t AND h.block_idx <> a.block_idx AND (h.t < a.t)) AS above
    FROM blocks a WHERE a.block_type <> 'header'""")
def asof_heading(spark, d):
    """The heading nearest above each other block."""
    is_head = F.col("block_type") == "header"
    # a heading stands behind the other blocks of its top: it is above none of them
    higher = Window.partitionBy("doc_id").orderBy("top", is_head).rowsBetween(Window.unboundedPreceding, -1)
    head = F.when(is_head & F.col("doc_id").isNotNull(), F.struct("top", "block_idx"))
    blocks = _blocks(spark, d).select("doc_id", "block_idx", "block_type", F.max(head).over(higher)["block_idx"].alias("above"))
    return blocks.filter("block_type <> 'header'").select("doc_id", "block_idx", "above")


_IMAGES = "img AS (SELECT o_orderkey AS doc_id, (o_orderkey % 5) * 60.0::DOUBLE + 72 AS il, (o_custkey % 50) * 10.0::DOUBLE + 90 AS it, (o_orderkey % 5) * 60.0::DOUBLE + 78 AS ir, (o_custkey % 50) * 10.0::DOUBLE + 96 AS ib FROM orders)"


@query(f"""WITH {_BLOCKS}, {_IMAGES}, ins AS (SELECT i.doc_id, arg_min(block_idx, ((r - l) * (b - t), block_idx)) AS inside FROM img i JOIN blocks k ON i.doc_id = k.doc_id
        AND greatest(0, least(r, ir) - greatest(l, il)) * greatest(0, least(b, ib) - greatest(t, it)) >= 0.9 * (ir - il) * (ib - it) GROUP BY i.doc_id)
    SELECT i.doc_id, inside, (SELECT arg_max(k.block_idx, (k.t, k.block_idx)) FROM blocks k WHERE k.doc_id = i.doc_id AND k.t < it) AS above FROM img i LEFT JOIN ins USING (doc_id)""")
def image_attach(spark, d):
    """Images go to the smallest block around them, else to the last one above."""
    k = F.col("o_orderkey")
    left, top = (k % 5) * 60.0 + 72, (F.col("o_custkey") % 50) * 10.0 + 90
    images = lift.read(spark, d, "orders").select(k.alias("doc_id"), F.struct(left.alias("left"), top.alias("top"), (left + 6).alias("right"), (top + 6).alias("bottom")).alias("a"))
    images = images.groupBy("doc_id").agg(F.collect_list("a").alias("images"))
    blocks = _blocks(spark, d).groupBy("doc_id").agg(F.collect_list(F.struct("block_idx", "left", "top", "right", "bottom")).alias("blocks"))
    pairs = images.join(blocks.hint("shuffle_hash"), "doc_id", "left").withColumn("blocks", F.coalesce("blocks", F.array()))
    inside = lambda b: F.exists("images", lambda a: SP.intersection(a, b) >= SP.INSIDE * SP.area(a))
    smallest = F.array_min(F.transform(F.filter("blocks", inside), lambda b: F.struct(SP.area(b).alias("area"), b["block_idx"].alias("block_idx"))))
    rows = pairs.select("doc_id", smallest["block_idx"].alias("inside"), "blocks", F.explode("images").alias("a"))
    higher = F.transform(F.filter("blocks", lambda b: b["top"] < F.col("a.top")), lambda b: F.struct(b["top"].alias("top"), b["block_idx"].alias("block_idx")))
    return rows.select("doc_id", F.array_max(higher)["block_idx"].alias("above"), "inside")


# labels


def _labelled(spark, d):
    return _blocks(spark, d).withColumn("label", LB.resolved(F.col("block_type"), F.col("block_text")))


_FURNITURE = f"(w <> '' AND (regexp_matches(w, {S.q(FL.EMAIL)}) OR regexp_matches(w, {S.q(FL.URL)}) OR regexp_matches(lower(w), {S.q(FL.PAGE_FOLIO)}) OR regexp_matches(w, {S.q(FL.LOWER_ROMAN)})))"
_NWORDS = "len(list_filter(string_split(w, ' '), lambda x: x <> ''))"
_PROSE = rf"(regexp_matches(w, {S.q(LB.PROSE)}) OR regexp_matches(w, {S.q(LB.PROSE_END)}) OR regexp_matches(w, '^[^\p{{L}}]*\p{{Ll}}') OR (w[-1] = '.' AND {_NWORDS} >= 5 AND regexp_matches(w, '\s\p{{Ll}}{{4,}}')))"
_CROSS = f"regexp_matches(w, {S.q(LB.CROSS_REFERENCE)})"
_LABELLED = f"""{_BLOCKS}, lab AS (SELECT *, CASE WHEN block_type = 'header' AND ({_NWORDS} > 12 OR {_FURNITURE} OR {_PROSE} OR {_CROSS}) THEN 'Paragraph' WHEN block_type = 'header' THEN 'Section Header'
    WHEN block_type = 'list_item' THEN 'List Item' WHEN block_type = 'table_row' THEN 'Table Row' ELSE 'Paragraph' END AS label FROM (SELECT *, block_text AS w FROM blocks))"""


@query(f"WITH {_LABELLED} SELECT doc_id, block_idx, label FROM lab")
def resolve_labels(spark, d):
    return _labelled(spark, d).select("doc_id", "block_idx", "label")


@query(f"WITH {S.LINES} SELECT doc_id, line_no FROM (SELECT *, text AS w FROM lines) WHERE {_PROSE}")
def prose_header(spark, d):
    lines = lift.document_lines(lift.read(spark, d, "documents"))
    return lines.filter(LB.is_prose_header(F.col("text"))).select("doc_id", "line_no")


@query(f"WITH {S.STATEMENTS}, x AS (SELECT doc_id, line_no, CASE doc_id % 2 WHEN 0 THEN replace(text, '.', ' of') ELSE text END AS w FROM statement WHERE kind = 'heading') SELECT doc_id, line_no, {_CROSS} AS is_reference FROM x")
def cross_ref_header(spark, d):
    heads = lift.statement_lines(spark, d).filter("kind = 'heading'")
    text = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("."), F.lit(" of"))).otherwise(F.col("text"))
    return heads.select("doc_id", "line_no", LB.is_cross_reference(text).alias("is_reference"))


@query(f"""WITH {_BLOCKS}, c AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS nb FROM blocks), h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY b - t DESC, block_idx) AS rk FROM c WHERE nb <= 12 AND weight > 400)
    SELECT doc_id, block_idx, CASE rk WHEN 1 THEN 'Title' ELSE 'Paragraph' END AS label FROM h""")
def cover_title(spark, d):
    """On a page of few blocks the tallest bold one is the title, the other bold ones are not headings."""
    blocks = _blocks(spark, d).withColumn("nb", F.count(F.lit(1)).over(Window.partitionBy("doc_id"))).filter((F.col("nb") <= LB.COVER_BLOCKS) & (F.col("weight") > 400))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc(F.col("bottom") - F.col("top")), "block_idx"))
    return blocks.select("doc_id", "block_idx", F.when(rank == 1, "Title").otherwise("Paragraph").alias("label"))


@query(f"""WITH {_BLOCKS}, n AS (SELECT *, lag(block_type) OVER o AS p, lead(block_type) OVER o AS f FROM blocks WINDOW o AS (PARTITION BY doc_id ORDER BY block_idx))
    SELECT doc_id, block_idx, block_type FROM n WHERE block_type <> 'table_row' AND (p = 'table_row' OR f = 'table_row')""")
def embedded_fragment(spark, d):
    """Blocks beside a table row that are none themselves."""
    w = Window.partitionBy("doc_id").orderBy("block_idx")
    near = _blocks(spark, d).withColumn("p", F.lag("block_type").over(w)).withColumn("f", F.lead("block_type").over(w))
    return near.filter("block_type <> 'table_row' AND (p = 'table_row' OR f = 'table_row')").select("doc_id", "block_idx", "block_type")


@query(f"""WITH {S.STATEMENTS}, c AS (SELECT doc_id, line_no, abs((left_ + left_ + 6 * len(text)) / 2 - 306) <= 6.12 AND 6 * len(text) < 0.6 * 612 AS centred FROM statement),
    p AS (SELECT *, bool_and(centred) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS lead FROM c) SELECT doc_id, line_no, centred, lead FROM p WHERE centred""")
def centered_split(spark, d):
    """Centred lines, and which of them lead their document."""
    right = F.col("left") + 6 * F.length("text")
    lines = lift.statement_lines(spark, d).withColumn("centred", LB.is_centred(F.col("left"), right, lift.PAGE_WIDTH))
    lead = F.bool_and("centred").over(Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("lead", lead).filter("centred").select("doc_id", "line_no", "centred", "lead")


@query(f"""WITH {_NODES}, b AS ({"WITH " + _BLOCKS + " SELECT * FROM blocks"}) SELECT 'box_order' AS rule, count(*) FILTER (WHERE l > r OR t > b)::BIGINT AS n FROM b UNION ALL SELECT 'outside_page', count(*) FILTER (WHERE l < 0 OR t < 0) FROM b
    UNION ALL SELECT 'empty_text', count(*) FILTER (WHERE trim(block_text, ' ') = '') FROM b UNION ALL SELECT 'missing_parent', count(*) FROM nodes a ANTI JOIN nodes p ON p.doc_id = a.doc_id AND p.id = a.parent WHERE a.parent IS NOT NULL
    UNION ALL SELECT 'parent_after_child', count(*) FROM nodes WHERE parent >= id UNION ALL SELECT 'double_id', count(*) - count(DISTINCT (doc_id, block_idx)) FROM b""")
def export_invariants(spark, d):
    """How many rows break each rule of an export."""
    flag = lambda bad: F.coalesce(bad, F.lit(False)).cast("long")
    bad = {"box_order": (F.col("left") > F.col("right")) | (F.col("top") > F.col("bottom")), "outside_page": (F.col("left") < 0) | (F.col("top") < 0), "empty_text": F.trim("block_text") == ""}
    ids = _blocks(spark, d).groupBy("doc_id", "block_idx").agg((F.count(F.lit(1)) - 1).alias("double_id"), *[F.sum(flag(b)).alias(c) for c, b in bad.items()])
    nodes = _nodes(spark, d).filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.collect_list("id").alias("ids"), F.collect_list(F.struct("id", "parent")).alias("nodes"))
    parents = F.filter("nodes", lambda n: n["parent"].isNotNull())
    orphans = F.filter(parents, lambda n: ~F.array_contains("ids", n["parent"]))
    late = F.filter(parents, lambda n: n["parent"] >= n["id"])
    nodes = nodes.select(F.size(orphans).alias("missing_parent"), F.size(late).alias("parent_after_child"))

    def counts(rows, *rules):
        sums = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in rules])
        return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(c).alias("n")) for c in rules])).alias("r")).select("r.*")

    return counts(ids, *bad, "double_id").union(counts(nodes, "missing_parent", "parent_after_child"))


@query()
def annotation_json(spark, d):
    """Blocks as annotations of the export format."""
    b = _labelled(spark, d)
    bounds = F.struct("top", "left", "right", "bottom")
    body = F.create_map(F.lit("0"), F.struct(bounds.alias("bounds"), F.col("block_text").alias("rawText")))
    return b.select("doc_id", "block_idx", F.to_json(F.struct(F.concat(F.lit("ann-"), F.col("block_idx").cast("string")).alias("id"), F.col("label").alias("annotationLabel"), F.col("block_text").alias("rawText"), F.lit(0).alias("page"), body.alias("annotation_json"))).alias("json"))


# units

_UNITS = rf"""{S.STATEMENT_FEATURES}, us AS (SELECT *, ((numbered AND n_words >= 2) OR regexp_matches(text, {S.q(U.ORDINAL)}) OR (regexp_matches(text, '\p{{Lu}}') AND NOT regexp_matches(text, '\p{{Ll}}|[0-9]') AND n_words <= 6)) AS starts FROM features),
    units AS (SELECT *, sum(starts::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)::BIGINT AS unit_id FROM us)"""


def _units(spark, d):
    lines = _statements(spark, d)
    return U.with_units(lines.withColumn("starts", U.starts_unit(F.col("text"), F.col("numbered"), F.col("n_words"))))


@query(f"WITH {_UNITS} SELECT doc_id, line_no FROM units WHERE starts")
def unit_starts(spark, d):
    return _units(spark, d).filter("starts").select("doc_id", "line_no")


@query(f"WITH {_UNITS} SELECT doc_id, line_no, unit_id FROM units")
def numbering_units(spark, d):
    return _units(spark, d).select("doc_id", "line_no", "unit_id")


@query(f"""WITH {S.STATEMENTS}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM statement), f AS (SELECT *, k - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM n WHERE regexp_matches(text, '\\s[0-9]{{1,4}}/'))
    SELECT doc_id, min(line_no) AS first_line, count(*)::BIGINT AS n FROM f GROUP BY doc_id, run HAVING count(*) >= 3""")
def toc_runs(spark, d):
    """Runs of three and more lines with a number before their end."""
    return U.runs_of(lift.statement_lines(spark, d), F.col("text").rlike(r"\s[0-9]{1,4}/"))


@query(f"""WITH {S.STATEMENTS}, w AS (SELECT doc_id, line_no, string_split(text, ' ')[1] AS f FROM statement), n AS (SELECT *, coalesce(f = lag(f) OVER o, false) OR coalesce(f = lead(f) OVER o, false) AS same, row_number() OVER o AS k FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY line_no)),
    r AS (SELECT *, k - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM n WHERE same) SELECT doc_id, min(line_no) AS first_line, count(*)::BIGINT AS n FROM r GROUP BY doc_id, run HAVING count(*) >= 2""")
def prefix_runs(spark, d):
    """Runs of lines that share their first word with a neighbour."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    first = F.element_at(F.split("text", " "), 1)
    lines = lift.statement_lines(spark, d).withColumn("f", first)
    same = F.coalesce(F.col("f") == F.lag("f").over(w), F.lit(False)) | F.coalesce(F.col("f") == F.lead("f").over(w), F.lit(False))
    return U.runs_of(lines.withColumn("same", same), F.col("same"), 2)


@query(f'WITH {_UNITS} SELECT doc_id, unit_id, min(left_) AS "left", min(top) AS top, max(left_ + 6 * len(text)) AS "right", max(top + size) AS bottom, count(*)::BIGINT AS n FROM units GROUP BY doc_id, unit_id')
def unit_bounds(spark, d):
    return _units(spark, d).groupBy("doc_id", "unit_id").agg(F.min("left").alias("left"), F.min("top").alias("top"), F.max(F.col("left") + 6 * F.length("text")).alias("right"), F.max(F.col("top") + F.col("size")).alias("bottom"), _n())


@query(f"""WITH {_UNITS}, f AS (SELECT doc_id, unit_id, min(line_no) AS line_no, arg_min(text, line_no) AS text FROM units GROUP BY ALL), l AS (SELECT *, CASE WHEN regexp_matches(text, {S.q(U.ORDINAL)}) THEN 1 ELSE 2 END AS level FROM f)
    SELECT doc_id, unit_id, max(CASE WHEN level = 1 THEN unit_id END) OVER (PARTITION BY doc_id ORDER BY unit_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_section, level::BIGINT AS level FROM l""")
def unit_edges(spark, d):
    """Units and the section unit before them."""
    firsts = _units(spark, d).groupBy("doc_id", "unit_id").agg(F.min_by("text", "line_no").alias("text"))
    firsts = firsts.withColumn("level", F.when(F.col("text").rlike(U.ORDINAL), 1).otherwise(2).cast("long"))
    section = H.last_before(F.when(F.col("level") == 1, F.col("unit_id")), ["doc_id"], ["unit_id"])
    return firsts.select("doc_id", "unit_id", section.alias("last_section"), "level")


@query()
def units_strict(spark, d):
    """Units nested by a stack of enumerators."""
    return strict.nested_units(_units(spark, d).select("doc_id", "line_no", "unit_id", "kind", "starts", "text"))


# renderings

_RANKED = f"""{_BLOCKS}, sz AS (SELECT doc_id, size, least(6, dense_rank() OVER (PARTITION BY doc_id ORDER BY size DESC)) AS level FROM (SELECT DISTINCT doc_id, size FROM blocks WHERE block_type = 'header')),
    rk AS (SELECT k.*, coalesce(level, 6)::INT AS level FROM blocks k LEFT JOIN sz ON k.doc_id = sz.doc_id AND k.size = sz.size)"""


def _ranked(spark, d):
    """Blocks with the level of their size among their document's heading sizes; 6 where no heading has it."""
    blocks = _blocks(spark, d)
    sizes = F.collect_set(F.when(F.col("block_type") == "header", F.col("size"))).over(Window.partitionBy("doc_id"))
    level = F.when(F.array_contains("sizes", F.col("size")), F.least(F.lit(6), F.size(F.filter("sizes", lambda s: s >= F.col("size"))))).otherwise(6)
    return blocks.withColumn("sizes", sizes).withColumn("level", level).drop("sizes")


@query(f"""WITH {_RANKED}, m AS (SELECT doc_id, block_idx, CASE block_type WHEN 'header' THEN repeat('#', level) || ' ' || block_text WHEN 'list_item' THEN '- ' || bt WHEN 'table_row' THEN '| ' || replace(bt, '|', '\\|') || ' |' ELSE bt END AS md
    FROM (SELECT *, CASE WHEN weight > 400 AND block_type <> 'header' THEN '**' || block_text || '**' ELSE block_text END AS bt FROM rk)) SELECT doc_id, string_agg(md, chr(10) || chr(10) ORDER BY block_idx) AS markdown FROM m GROUP BY doc_id""")
def markdown_pages(spark, d):
    rows = _ranked(spark, d).withColumn("md", R.markdown_block(F.col("block_type"), F.col("block_text"), F.col("level"), F.col("weight") > 400))
    return R.joined(rows, "doc_id", "block_idx", "md", "\n\n", "markdown")


@query(f"""WITH {_LABELLED} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY block_idx) - 1)::BIGINT AS order_index, label, 1.0::DOUBLE AS score, 1::INT AS page, [l, t, r, b]::DOUBLE[] AS bbox, block_text AS content FROM lab""")
def layout_predictions(spark, d):
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("block_idx")) - 1
    box = F.array("left", "top", "right", "bottom")
    return _labelled(spark, d).select("doc_id", order.cast("long").alias("order_index"), "label", F.lit(1.0).alias("score"), F.lit(1).alias("page"), box.alias("bbox"), F.col("block_text").alias("content"))


@query()
def json_blocks(spark, d):
    return R.json_document(_blocks(spark, d))


@query(f"""WITH {_RANKED}, h AS (SELECT *, CASE block_type WHEN 'header' THEN 'h4' WHEN 'list_item' THEN 'li' WHEN 'table_row' THEN 'tr' ELSE 'p' END AS tag FROM rk)
    SELECT doc_id, string_agg('<' || tag || ' style="margin-left:' || level * 20 || 'px">' || replace(replace(replace(block_text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</' || tag || '>', chr(10) ORDER BY block_idx) AS html FROM h GROUP BY doc_id""")
def html_blocks_render(spark, d):
    rows = _ranked(spark, d).withColumn("h", R.html_block(F.col("block_type"), F.col("block_text"), F.col("level")))
    return R.joined(rows, "doc_id", "block_idx", "h", "\n", "html")


@query(f"WITH {_NODES}, s AS (SELECT doc_id, line_no AS id, text FROM statement) SELECT t.doc_id, string_agg(repeat('  ', depth::INT) || text[1:40], chr(10) ORDER BY t.id) AS outline FROM tree t JOIN s ON s.doc_id = t.doc_id AND s.id = t.id GROUP BY t.doc_id")
def tree_outline(spark, d):
    tree = H.with_depth_and_root(_nodes(spark, d))
    text = lift.statement_lines(spark, d).select("doc_id", F.col("line_no").alias("id"), "text")
    rows = tree.join(text, ["doc_id", "id"]).withColumn("line", F.concat(F.repeat(F.lit("  "), F.col("depth").cast("int")), F.substring("text", 1, 40)))
    return R.joined(rows, "doc_id", "id", "line", "\n", "outline")
