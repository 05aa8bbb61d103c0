"""Style statistics, blocks, joined blocks and hierarchy."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quireflow.operators import blocks as B
from quireflow.operators import hierarchy as H
from quireflow.operators import strict
from quireflow.sources import lift

from . import sql as S
from .layout_queries import _swords
from .line_queries import _features, _statements
from .registry import query

_BLOCKS = f"""{S.STATEMENT_FEATURES}, b0 AS (SELECT *, coalesce(size <> lag(size) OVER o OR weight <> lag(weight) OVER o OR numbered OR list_item OR table_row OR lag(table_row) OVER o
        OR top - lag(top) OVER o > 2.0 * size OR abs(left_ - lag(left_) OVER o) > 200, true) AS nw FROM features WINDOW o AS (PARTITION BY doc_id ORDER BY line_no)),
    bl AS (SELECT *, (sum(nw::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) - 1)::BIGINT AS block_idx FROM b0),
    blocks AS (SELECT doc_id, block_idx, CASE WHEN bool_or(table_row) THEN 'table_row' WHEN bool_or(list_item OR (numbered AND NOT header)) THEN 'list_item' WHEN bool_and(header) THEN 'header' ELSE 'para' END AS block_type,
        string_agg(text, ' ' ORDER BY line_no) AS block_text, min(left_) AS l, min(top) AS t, max(left_ + 6 * len(text)) AS r, max(top + size) AS b, max(size) AS size, max(weight)::INT AS weight, count(*)::BIGINT AS n_lines, min(line_no) AS first_line
        FROM bl GROUP BY ALL)"""


_RUNIN = r"^((?:[^ .]+ ){0,3}[^ .]+\.)\s+(.+)$"


def _lined(spark, d):
    return B.with_blocks(_statements(spark, d))


def _blocks(spark, d):
    return B.blocks(_lined(spark, d))


# statistics

_GAPS = f"""{S.STATEMENTS}, g0 AS (SELECT *, CASE WHEN lag(size) OVER o = size AND lag(weight) OVER o = weight THEN round(top - lag(top) OVER o, 1) END AS gap FROM statement WINDOW o AS (PARTITION BY doc_id ORDER BY line_no)),
    gaps AS (SELECT * FROM g0 WHERE gap > 0)"""


def _gaps(spark, d):
    return B.spacing(lift.statement_lines(spark, d), ["doc_id"], ["line_no"])


@query(f"""WITH {_GAPS}, c AS (SELECT size, weight, gap, count(*) AS n FROM gaps GROUP BY ALL), m AS (SELECT size, weight, arg_max(gap, (n, -gap)) AS mode_gap FROM c GROUP BY ALL)
    SELECT size, weight::INT AS weight, mode_gap, count(*)::BIGINT AS n, round(avg(gap), 4) AS avg_gap, median(gap) AS median_gap FROM gaps JOIN m USING (size, weight) GROUP BY ALL""")
def style_space_stats(spark, d):
    gaps = _gaps(spark, d)
    mode = B.most_frequent(gaps.groupBy("size", "weight", "gap").agg(F.count(F.lit(1)).alias("n")), ["size", "weight"], "gap").select("size", "weight", "mode_gap")
    stats = gaps.groupBy("size", "weight").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("gap"), 4).alias("avg_gap"), F.median("gap").alias("median_gap"))
    return stats.join(mode, ["size", "weight"])


@query(f"""WITH {S.STATEMENTS}, w AS (SELECT size, weight, len(string_split(text, ' ')) AS n FROM statement)
    SELECT size, weight::INT AS weight, count(*)::BIGINT AS n_lines, round(avg(n), 4) AS avg_words, median(n)::DOUBLE AS median_words, round(stddev_pop(n), 4) AS std_words FROM w GROUP BY ALL""")
def style_word_stats(spark, d):
    w = lift.statement_lines(spark, d).withColumn("n", F.size(F.split("text", " ")))
    return w.groupBy("size", "weight").agg(F.count(F.lit(1)).alias("n_lines"), F.round(F.avg("n"), 4).alias("avg_words"), F.median("n").alias("median_words"), F.round(F.stddev_pop("n"), 4).alias("std_words"))


@query(f"WITH {_GAPS}, c AS (SELECT doc_id, gap, count(*) AS n FROM gaps GROUP BY ALL) SELECT doc_id, arg_max(gap, (n, -gap)) AS mode_gap, max(n)::BIGINT AS n_mode FROM c GROUP BY doc_id")
def page_mode_space(spark, d):
    return B.most_frequent(_gaps(spark, d).groupBy("doc_id", "gap").agg(F.count(F.lit(1)).alias("n")), ["doc_id"], "gap")


@query(f"WITH {S.STATEMENTS}, s AS (SELECT size, weight, count(*)::BIGINT AS n FROM statement GROUP BY ALL) SELECT size, weight::INT AS weight, n, dense_rank() OVER (ORDER BY size DESC, weight DESC)::INT AS class FROM s")
def style_classes(spark, d):
    styles = lift.statement_lines(spark, d).groupBy("size", "weight").agg(F.count(F.lit(1)).alias("n"))
    return styles.withColumn("class", F.dense_rank().over(Window.orderBy(F.desc("size"), F.desc("weight"))))


@query(f"""WITH {S.STATEMENTS}, s AS (SELECT doc_id, size, weight, count(*)::BIGINT AS n FROM statement GROUP BY ALL), m AS (SELECT doc_id, arg_max(size, (n, -size)) AS ms FROM (SELECT doc_id, size, sum(n) AS n FROM s GROUP BY ALL) GROUP BY doc_id)
    SELECT doc_id, size, weight::INT AS weight FROM s JOIN m USING (doc_id) WHERE size > ms OR weight > 400""")
def header_styles(spark, d):
    lines = lift.statement_lines(spark, d)
    mode = B.most_frequent(lines.groupBy("doc_id", "size").agg(F.count(F.lit(1)).alias("n")), ["doc_id"], "size")
    styles = lines.select("doc_id", "size", "weight").distinct()
    return styles.join(mode, "doc_id").filter((F.col("size") > F.col("mode_size")) | (F.col("weight") > 400)).select("doc_id", "size", "weight")


@query(f"""WITH {S.STATEMENTS}, s AS (SELECT size, weight, count(*)::BIGINT AS n FROM statement GROUP BY ALL), m AS (SELECT avg(n) AS a, stddev_pop(n) AS d FROM s)
    SELECT size, weight::INT AS weight, n, n > a + 2 * d AS is_para FROM s, m""")
def para_classes(spark, d):
    styles = lift.statement_lines(spark, d).groupBy("size", "weight").agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy(F.lit(0))  # a row for each style
    return styles.withColumn("is_para", F.col("n") > F.avg("n").over(every) + 2 * F.stddev_pop("n").over(every))


@query(f"""WITH {_BLOCKS}, m AS (SELECT doc_id, block_idx, string_agg(repeat(CASE WHEN weight > 400 THEN '1' ELSE '0' END, len(string_split(text, ' '))), '' ORDER BY line_no) AS bold_mask FROM bl GROUP BY ALL)
    SELECT doc_id, block_idx, bold_mask, round((len(bold_mask) - len(replace(bold_mask, '1', ''))) / len(bold_mask), 6) AS bold_ratio FROM m""")
def emphasis_mask(spark, d):
    bits = F.repeat(F.when(F.col("weight") > 400, "1").otherwise("0"), F.size(F.split("text", " ")))
    lines = _lined(spark, d).withColumn("bits", bits)
    mask = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "bits"))), lambda s: s["bits"]), "")
    out = lines.groupBy("doc_id", "block_idx").agg(mask.alias("bold_mask"))
    ones = F.length("bold_mask") - F.length(F.replace("bold_mask", F.lit("1"), F.lit("")))
    return out.withColumn("bold_ratio", F.round(ones / F.length("bold_mask"), 6))


@query(f"""WITH {_BLOCKS}, r AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY size DESC) AS rk FROM blocks WHERE t < 396)
    SELECT doc_id, block_idx, rk::INT AS rank, block_text FROM r WHERE rk <= 2""")
def title_candidates(spark, d):
    upper = _blocks(spark, d).filter(F.col("top") < lift.PAGE_HEIGHT / 2)
    ranked = upper.withColumn("rank", F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.desc("size"))))
    return ranked.filter("rank <= 2").select("doc_id", "block_idx", "rank", "block_text")


@query(f"WITH {S.STATEMENT_WORDS}, g AS (SELECT round(x0 - lag(x1) OVER (PARTITION BY doc_id, line_no ORDER BY x0), 1) AS gap FROM swords) SELECT gap, count(*)::BIGINT AS n FROM g WHERE gap IS NOT NULL GROUP BY gap")
def gap_histogram(spark, d):
    w = Window.partitionBy("doc_id", "line_no").orderBy("x0")
    gaps = _swords(spark, d).select(F.round(F.col("x0") - F.lag("x1").over(w), 1).alias("gap"))
    return gaps.filter("gap IS NOT NULL").groupBy("gap").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {S.STATEMENT_WORDS}, g AS (SELECT doc_id, line_no, x0 - lag(x1) OVER (PARTITION BY doc_id, line_no ORDER BY x0) AS gap FROM swords)
    SELECT doc_id, line_no, (1 + count(*) FILTER (WHERE gap > 2.8 * 6))::BIGINT AS n_cells FROM g GROUP BY ALL""")
def possible_cells(spark, d):
    """Cells of a line by gaps of more than 2.8 blanks."""
    w = Window.partitionBy("doc_id", "line_no").orderBy("x0")
    gaps = _swords(spark, d).withColumn("gap", F.col("x0") - F.lag("x1").over(w))
    return gaps.groupBy("doc_id", "line_no").agg((1 + F.count_if(F.col("gap") > 2.8 * 6)).alias("n_cells"))


# blocks


@query(f"WITH {_BLOCKS} SELECT doc_id, line_no, block_idx FROM bl")
def block_islands(spark, d):
    return _lined(spark, d).select("doc_id", "line_no", "block_idx")


@query(f"WITH {_BLOCKS} SELECT doc_id, block_idx, block_type, n_lines FROM blocks")
def block_types(spark, d):
    return _blocks(spark, d).select("doc_id", "block_idx", "block_type", "n_lines")


@query(f'WITH {_BLOCKS} SELECT doc_id, block_idx, l AS "left", t AS top, r AS "right", b AS bottom FROM blocks')
def block_bounds(spark, d):
    return _blocks(spark, d).select("doc_id", "block_idx", "left", "top", "right", "bottom")


@query(f"WITH {_BLOCKS} SELECT doc_id, block_idx, block_text FROM blocks")
def block_text(spark, d):
    return _blocks(spark, d).select("doc_id", "block_idx", "block_text")


@query()
def blocks_strict(spark, d):
    """Blocks by a fold that remembers whether it is in a table or a list."""
    return strict.folded_blocks(_features(spark, d).select("doc_id", "line_no", "text", "line_type", "delimiter", "numbered", "continuing"))


@query(f"WITH {_BLOCKS} SELECT doc_id, block_idx, regexp_extract(block_text, {S.q(_RUNIN)}, 1) AS title, regexp_extract(block_text, {S.q(_RUNIN)}, 2) AS body FROM blocks WHERE regexp_matches(block_text, {S.q(_RUNIN)})")
def runin_split(spark, d):
    """A heading of up to four words and what runs on behind its full stop."""
    rows = _blocks(spark, d).filter(F.col("block_text").rlike(_RUNIN))
    return rows.select("doc_id", "block_idx", F.regexp_extract("block_text", _RUNIN, 1).alias("title"), F.regexp_extract("block_text", _RUNIN, 2).alias("body"))


@query(rf"""WITH {S.STATEMENTS} SELECT doc_id, line_no, regexp_extract(lower(text), '^section\s+([0-9]+\.?[0-9]*)', 1) AS number, trim(regexp_replace(lower(text), '^section\s+[0-9]+\.?[0-9]*\.?', ''), ' ') AS rest
    FROM statement WHERE regexp_matches(lower(text), '^section\s+[0-9]+')""")
def section_split(spark, d):
    low = F.lower("text")
    rows = lift.statement_lines(spark, d).filter(low.rlike(r"^section\s+[0-9]+"))
    return rows.select("doc_id", "line_no", F.regexp_extract(low, r"^section\s+([0-9]+\.?[0-9]*)", 1).alias("number"), F.trim(F.regexp_replace(low, r"^section\s+[0-9]+\.?[0-9]*\.?", "")).alias("rest"))


@query("SELECT doc_id, regexp_replace(replace(coalesce(text, ''), 'tion ', 'tion-' || chr(10)), '-' || chr(10), '', 'g') AS text FROM documents")
def dehyphenate(spark, d):
    return lift.read(spark, d, "documents").select("doc_id", B.without_hyphens(F.replace(F.coalesce("text", F.lit("")), F.lit("tion "), F.lit("tion-\n"))).alias("text"))


# joins of neighbours

_RUN = """m0 AS (SELECT *, {flag} AS j FROM features WINDOW o AS (PARTITION BY doc_id ORDER BY line_no)),
    m1 AS (SELECT *, (sum((NOT coalesce(j, false))::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) - 1)::BIGINT AS run FROM m0)"""
_PARA = _RUN.format(flag="line_type = 'para' AND lag(line_type) OVER o = 'para' AND NOT lag(delimiter) OVER o")


def _runs(lines, joins):
    return B.merged_runs(lines, joins, ["doc_id"], ["line_no"])


def _before(c):
    return F.lag(c).over(Window.partitionBy("doc_id").orderBy("line_no"))


@query(f"WITH {S.FEATURES}, {_PARA} SELECT doc_id, run, count(*)::BIGINT AS n_lines, min(line_no) AS first_line FROM m1 GROUP BY doc_id, run")
def merge_paragraphs(spark, d):
    """Paragraph lines go on with the paragraph before unless that ended in a sentence mark."""
    lines = _features(spark, d)
    runs = _runs(lines, (F.col("line_type") == "para") & (_before("line_type") == "para") & ~_before("delimiter"))
    return runs.groupBy("doc_id", "run").agg(F.count(F.lit(1)).alias("n_lines"), F.min("line_no").alias("first_line"))


_HEAD = _RUN.format(flag="header AND lag(header) OVER o AND size = lag(size) OVER o AND left_ = lag(left_) OVER o")


@query(f"WITH {S.STATEMENT_FEATURES}, {_HEAD} SELECT doc_id, run, count(*)::BIGINT AS n_lines FROM m1 WHERE header GROUP BY doc_id, run")
def merge_headers(spark, d):
    lines = _statements(spark, d)
    runs = _runs(lines, F.col("header") & _before("header") & (F.col("size") == _before("size")) & (F.col("left") == _before("left")))
    return runs.filter("header").groupBy("doc_id", "run").agg(F.count(F.lit(1)).alias("n_lines"))


_LISTS = _RUN.format(flag="(line_type = 'para' AND lag(line_type) OVER o = 'list_item' AND NOT lag(delimiter) OVER o) OR (line_type = 'list_item' AND lag(text) OVER o LIKE '%:')")


@query(f"WITH {S.STATEMENT_FEATURES}, {_LISTS} SELECT doc_id, run, string_agg(line_type, ',' ORDER BY line_no) AS types FROM m1 GROUP BY doc_id, run")
def merge_list_para(spark, d):
    """A paragraph goes on with a list item that has no end, a list item with the line that announces it."""
    lines = _statements(spark, d)
    after_item = (F.col("line_type") == "para") & (_before("line_type") == "list_item") & ~_before("delimiter")
    announced = (F.col("line_type") == "list_item") & _before("text").endswith(":")
    runs = _runs(lines, after_item | announced)
    types = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line_type"))), lambda s: s["line_type"]), ",")
    return runs.groupBy("doc_id", "run").agg(types.alias("types"))


@query(f"WITH {_BLOCKS}, s AS (SELECT doc_id, block_idx, avg(header::INT) AS share FROM bl GROUP BY ALL) SELECT doc_id, line_no, round(share, 6) AS share FROM bl JOIN s USING (doc_id, block_idx) WHERE share > 0.75")
def para_to_headers(spark, d):
    """Lines of blocks that are headers for more than three quarters."""
    share = F.avg(F.col("header").cast("int")).over(Window.partitionBy("doc_id", "block_idx"))
    return _lined(spark, d).withColumn("share", share).filter("share > 0.75").select("doc_id", "line_no", F.round("share", 6).alias("share"))


@query(f"""WITH {_BLOCKS}, rw AS (SELECT doc_id, line_no, cells[1] AS cell, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM features WHERE len(cells) > 0),
    hd AS (SELECT DISTINCT p_name FROM part WHERE p_size > 25)
    SELECT doc_id, run, count(*)::BIGINT AS n, round(avg((p_name IS NOT NULL)::INT), 6) AS share FROM rw LEFT JOIN hd ON cell = p_name GROUP BY ALL HAVING count(*) >= 2 AND avg((p_name IS NOT NULL)::INT) >= 0.67""")
def toc_label(spark, d):
    """Runs of rows whose first cells are mostly known headings."""
    rows = _statements(spark, d).filter(F.size("cells") > 0).select("doc_id", "line_no", F.get("cells", F.lit(0)).alias("cell"))
    rows = rows.withColumn("run", F.col("line_no") - F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")))
    heads = lift.read(spark, d, "part").filter("p_size > 25").select(F.col("p_name").alias("cell"), F.lit(1).alias("hit")).distinct()
    runs = rows.join(heads, "cell", "left").groupBy("doc_id", "run").agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce("hit", F.lit(0))).alias("s"))
    return runs.filter("n >= 2 AND s >= 0.67").select("doc_id", "run", "n", F.round("s", 6).alias("share"))


# hierarchy

_LEVELS = {"title": 0, "heading": 1, "clause": 2, "lead": 2, "row": 3, "folio": 1, "footer": 1}
_LEVEL_SQL = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _LEVELS.items()) + " END"
_NODES = f"""{S.STATEMENTS}, lv AS (SELECT doc_id, line_no, {_LEVEL_SQL} AS level FROM statement),
    nodes AS (SELECT a.doc_id, a.line_no AS id, (SELECT max(b.line_no) FROM lv b WHERE b.doc_id = a.doc_id AND b.line_no < a.line_no AND b.level < a.level) AS parent FROM lv a),
    tree AS (WITH RECURSIVE t AS (SELECT doc_id, id, parent, id AS root, parent AS up, 0::BIGINT AS depth FROM nodes UNION ALL
        SELECT t.doc_id, t.id, t.parent, n.id, n.parent, t.depth + 1 FROM t JOIN nodes n ON n.doc_id = t.doc_id AND n.id = t.up) SELECT * FROM t WHERE up IS NULL)"""


def _nodes(spark, d):
    level = F.create_map(*[F.lit(x) for kv in _LEVELS.items() for x in kv])[F.col("kind")]
    lines = lift.statement_lines(spark, d).select("doc_id", "line_no", level.alias("level"))
    return H.with_parents(lines, max(_LEVELS.values()) + 1).select("doc_id", F.col("line_no").alias("id"), "parent")


@query(f"WITH {_BLOCKS}, s AS (SELECT DISTINCT doc_id, size FROM blocks WHERE block_type = 'header') SELECT doc_id, size, least(6, dense_rank() OVER (PARTITION BY doc_id ORDER BY size DESC))::INT AS level FROM s")
def heading_rank(spark, d):
    sizes = _blocks(spark, d).filter("block_type = 'header'").select("doc_id", "size").distinct()
    return sizes.withColumn("level", F.least(F.lit(6), F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.desc("size")))))


@query(f"""WITH {_BLOCKS} SELECT doc_id, block_idx, last_value(CASE WHEN block_type = 'header' THEN block_text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS heading FROM blocks""")
def header_chain(spark, d):
    """The heading that a block stands under."""
    blocks = _blocks(spark, d)
    heading = H.last_before(F.when(F.col("block_type") == "header", F.col("block_text")), ["doc_id"], ["block_idx"])
    return blocks.select("doc_id", "block_idx", heading.alias("heading"))


@query(f"WITH {_NODES} SELECT doc_id, id, parent, depth FROM tree")
def tree_depth(spark, d):
    return H.with_depth_and_root(_nodes(spark, d)).select("doc_id", "id", "parent", "depth")


@query(f"WITH {_NODES} SELECT doc_id, id, root FROM tree")
def subtree_root(spark, d):
    return H.with_depth_and_root(_nodes(spark, d)).select("doc_id", "id", "root")


@query(f"""WITH {S.STATEMENTS}, f AS (SELECT doc_id, line_no, kind = 'row' AS item, text FROM statement),
    g AS (SELECT doc_id, line_no, item, last_value(CASE WHEN item THEN NULL WHEN text LIKE '%:' THEN line_no ELSE -1 END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS intro FROM f)
    SELECT doc_id, line_no, intro FROM g WHERE item AND intro >= 0""")
def list_intro_parent(spark, d):
    """Items in a row behind a line that ends with a colon are its children."""
    lines = lift.statement_lines(spark, d).withColumn("item", F.col("kind") == "row")
    w = Window.partitionBy("doc_id").orderBy("line_no")
    lines = lines.withColumn("intro", F.when(~F.col("item"), F.when(F.col("text").endswith(":"), F.col("line_no")).otherwise(F.lit(-1))))
    found = lines.withColumn("intro", F.last("intro", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return found.filter("item AND intro >= 0").select("doc_id", "line_no", "intro")


@query(f"WITH {_NODES} SELECT doc_id, parent, list(id ORDER BY id) AS children FROM nodes WHERE parent IS NOT NULL GROUP BY ALL")
def parent_child_edges(spark, d):
    return H.children(_nodes(spark, d))


@query()
def levels_strict(spark, d):
    """Levels by a stack of open styles."""
    return strict.stacked_levels(_blocks(spark, d).select("doc_id", "block_idx", "block_type", "size", "weight", "left"))


