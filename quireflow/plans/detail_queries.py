"""Details of layout: visual flags, rules between boxes, column spans, footers, clusters of boxes, unit predicates, alignment."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from quireflow.operators import blocks as BL
from quireflow.operators import details as D
from quireflow.operators import exports as E
from quireflow.operators import hierarchy as H
from quireflow.operators import layouts as LO
from quireflow.operators import strict
from quireflow.sources import lift

from . import sql as S
from .block_queries import _BLOCKS, _LEVELS, _blocks
from .document_queries import _CUTS, _TOKENS, _of_statements, _row_words
from .layout_queries import _PAGED, _paged, _swords
from .line_queries import _features, _lines, _statements
from .registry import query


@query()
def noun_chunks_strict(spark, d):
    """Runs of capitalised words of each line, with a number before or behind them."""
    return strict.noun_chunks(_lines(spark, d))


@query(f"""WITH {_PAGED}, m AS (SELECT doc_id, page_idx, arg_max(size, (n, -size)) AS ms FROM (SELECT doc_id, page_idx, size, count(*) AS n FROM paged GROUP BY ALL) GROUP BY ALL),
    g AS (SELECT p.*, ms, top - lag(top) OVER o AS before, lead(top) OVER o - top AS behind FROM paged p JOIN m USING (doc_id, page_idx) WINDOW o AS (PARTITION BY p.doc_id, p.page_idx ORDER BY line_no))
    SELECT doc_id, page_idx, line_no, size > 4.0 / 3 * ms AS large, coalesce(before <= min(before) OVER (PARTITION BY size), false) AS tight_before, coalesce(behind > 1.5 * size, false) AS gap_behind FROM g""")
def visual_line_flags(spark, d):
    """Lines larger than the page's usual size, as tight as any of their size, and with a gap behind."""
    return D.visual_flags(_paged(spark, d))


@query(f"""WITH {_BLOCKS} SELECT doc_id, block_idx, abs((l + r) / 2 - 306) <= 6.12 AND r - l < 306 AS centred, b >= 264 AND b <= 528 AS middle_third FROM blocks""")
def block_centering(spark, d):
    middle = F.abs((F.col("left") + F.col("right")) / 2 - 306) <= 6.12
    return _blocks(spark, d).select("doc_id", "block_idx", (middle & (F.col("right") - F.col("left") < 306)).alias("centred"), ((F.col("bottom") >= 264) & (F.col("bottom") <= 528)).alias("middle_third"))


_RULES = "rl AS (SELECT o_orderkey AS doc_id, 60.0 + (o_custkey % 12) * 12 AS y, 60.0::DOUBLE AS x1, 560.0::DOUBLE AS x2 FROM orders)"


@query(f"""WITH {_BLOCKS}, {_RULES}, n AS (SELECT *, lead(t) OVER o AS nt, lead(l) OVER o AS nl FROM blocks WINDOW o AS (PARTITION BY doc_id ORDER BY block_idx))
    SELECT n.doc_id, block_idx FROM n JOIN rl ON n.doc_id = rl.doc_id AND b <= y AND y <= nt + 2 AND x1 <= nl AND x2 >= nl""")
def rule_between_boxes(spark, d):
    """Blocks with a drawn rule between them and the next."""
    rules = lift.read(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), (60.0 + (F.col("o_custkey") % 12) * 12).alias("y"), F.lit(60.0).alias("x1"), F.lit(560.0).alias("x2"))
    w = Window.partitionBy("doc_id").orderBy("block_idx")
    pairs = _blocks(spark, d).withColumn("nt", F.lead("top").over(w)).withColumn("nl", F.lead("left").over(w))
    return pairs.join(rules, "doc_id").filter("bottom <= y AND y <= nt + 2 AND x1 <= nl AND x2 >= nl").select("doc_id", "block_idx")


@query(f"""WITH {S.STATEMENT_WORDS}, p AS (SELECT doc_id, line_no, cell_no, word_no, top, size, lag(top) OVER o AS pt, lag(size) OVER o AS ps FROM swords WINDOW o AS (PARTITION BY doc_id ORDER BY line_no, cell_no, word_no))
    SELECT doc_id, count(*) FILTER (WHERE abs((top + size / 2) - (pt + ps / 2)) < 0.005 * 792 OR abs(top - pt) < size / 4)::BIGINT AS n_same, count(*)::BIGINT AS n FROM p WHERE pt IS NOT NULL GROUP BY doc_id""")
def same_top_pairs(spark, d):
    """Neighbouring words on one line, by their middles or tops."""
    w = Window.partitionBy("doc_id").orderBy("line_no", "cell_no", "word_no")
    p = _swords(spark, d).withColumn("pt", F.lag("top").over(w)).withColumn("ps", F.lag("size").over(w)).filter("pt IS NOT NULL")
    same = (F.abs(F.col("top") + F.col("size") / 2 - F.col("pt") - F.col("ps") / 2) < 0.005 * lift.PAGE_HEIGHT) | (F.abs(F.col("top") - F.col("pt")) < F.col("size") / 4)
    return p.groupBy("doc_id").agg(F.count_if(same).alias("n_same"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {S.STATEMENT_FEATURES}, c AS (SELECT doc_id, line_no, weight > 400 AND NOT table_row AS bold, lag(weight > 400) OVER (PARTITION BY doc_id ORDER BY line_no) AS pb FROM features)
    SELECT doc_id, line_no, coalesce(pb, false) AS goes_on FROM c WHERE bold""")
def special_lists(spark, d):
    """Bold lines, which in a run are items of a list."""
    bold = (F.col("weight") > 400) & ~F.col("table_row")
    before = F.lag(F.col("weight") > 400).over(Window.partitionBy("doc_id").orderBy("line_no"))
    return _statements(spark, d).withColumn("bold", bold).withColumn("goes_on", F.coalesce(before, F.lit(False))).filter("bold").select("doc_id", "line_no", "goes_on")


@query(f"""WITH {_CUTS}, g AS (SELECT doc_id, line_no, x1 AS a, lead(x0) OVER (PARTITION BY doc_id, line_no ORDER BY x0) AS b FROM rwords), q AS (SELECT DISTINCT doc_id, line_no, unnest(range(ceil(a / 4)::BIGINT, floor(b / 4)::BIGINT)) AS bin FROM g WHERE b - a >= 8),
    n AS (SELECT doc_id, count(DISTINCT line_no) AS rows FROM rwords GROUP BY doc_id), s AS (SELECT doc_id, bin, count(*) AS k FROM q GROUP BY ALL), u AS (SELECT s.doc_id, bin, bin - row_number() OVER (PARTITION BY s.doc_id ORDER BY bin) AS run FROM s JOIN n ON n.doc_id = s.doc_id WHERE k >= 0.6 * rows)
    SELECT doc_id, min(bin) * 4.0::DOUBLE AS "left", (max(bin) + 1) * 4.0::DOUBLE AS "right" FROM u GROUP BY doc_id, run""")
def global_column_spans(spark, d):
    """Separators of a table's columns: where at least 60 % of its rows have a gap."""
    return D.gap_support(_row_words(spark, d))


@query(f"""WITH {_CUTS}, c AS (SELECT doc_id, line_no, cell_no, min(x0) AS l, max(x1) AS r FROM rwords GROUP BY ALL), h AS (SELECT doc_id, cell_no AS span, l AS hl, r AS hr FROM c WHERE line_no = 5),
    o AS (SELECT c.doc_id, line_no, cell_no, span, greatest(0, least(r, hr) - greatest(l, hl)) AS s FROM c JOIN h USING (doc_id)) SELECT doc_id, line_no, cell_no, arg_max(span, (s, -span)) AS span FROM o WHERE s > 0 GROUP BY ALL""")
def align_columns(spark, d):
    """Cells under the first row's spans: the one that they overlap most."""
    cells = _row_words(spark, d).groupBy("doc_id", "line_no", "cell_no").agg(F.min("x0").alias("l"), F.max("x1").alias("r"))
    spans = cells.filter("line_no = 5").select("doc_id", F.col("cell_no").alias("span"), F.col("l").alias("hl"), F.col("r").alias("hr"))
    shared = F.greatest(F.lit(0.0), F.least("r", "hr") - F.greatest("l", "hl"))
    pairs = cells.join(spans, "doc_id").withColumn("s", shared).filter("s > 0")
    return pairs.groupBy("doc_id", "line_no", "cell_no").agg(F.max_by("span", F.struct("s", -F.col("span"))).alias("span"))


@query(f"""WITH {_BLOCKS}, t AS (SELECT *, max(CASE WHEN block_type = 'table_row' THEN block_idx END) OVER (PARTITION BY doc_id) AS last FROM blocks) SELECT doc_id, block_idx, block_text FROM t WHERE block_idx > last""")
def table_footers(spark, d):
    """What follows the last row of a document's tables."""
    last = F.max(F.when(F.col("block_type") == "table_row", F.col("block_idx"))).over(Window.partitionBy("doc_id"))
    return _blocks(spark, d).withColumn("last", last).filter("block_idx > last").select("doc_id", "block_idx", "block_text")


@query(f"""WITH {S.STATEMENTS}, r AS (SELECT doc_id, min(top) AS rt FROM statement WHERE kind = 'row' GROUP BY doc_id), a AS (SELECT s.doc_id, line_no, text, row_number() OVER (PARTITION BY s.doc_id ORDER BY top DESC) AS k FROM statement s JOIN r USING (doc_id) WHERE top < rt AND rt - top <= 60)
    SELECT doc_id, line_no, text FROM a WHERE k <= 2""")
def header_above_table(spark, d):
    """At most two lines close above a table."""
    lines = lift.statement_lines(spark, d)
    tops = lines.filter("kind = 'row'").groupBy("doc_id").agg(F.min("top").alias("rt"))
    near = lines.join(tops, "doc_id").filter("top < rt AND rt - top <= 60")
    return near.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("top")))).filter("k <= 2").select("doc_id", "line_no", "text")


_RECTS = "rects AS (SELECT l_orderkey AS doc_id, l_linenumber::BIGINT * 1000000 + l_partkey AS id, (l_partkey % 40) * 10.0::DOUBLE AS x, (l_suppkey % 30) * 10.0::DOUBLE AS y FROM lineitem)"


@query(f"""WITH RECURSIVE {_RECTS}, dr AS (SELECT doc_id, id, min(x) AS x, min(y) AS y FROM rects GROUP BY ALL), e AS (SELECT a.doc_id, a.id AS a, b.id AS b FROM dr a JOIN dr b ON a.doc_id = b.doc_id AND a.id <> b.id AND abs(a.x - b.x) <= 42 AND abs(a.y - b.y) <= 42),
    w AS (SELECT doc_id, id, id AS m FROM dr UNION SELECT e.doc_id, e.b, w.m FROM w JOIN e ON e.doc_id = w.doc_id AND e.a = w.id WHERE w.m < e.b) SELECT doc_id, id, min(m) AS cluster FROM w GROUP BY doc_id, id""")
def rect_clusters(spark, d):
    """Boxes of 40 points that touch, directly or by others, are one cluster."""
    i = lift.read(spark, d, "lineitem")
    rects = i.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber").cast("long") * 1000000 + F.col("l_partkey")).alias("id"), ((F.col("l_partkey") % 40) * 10.0).alias("x"), ((F.col("l_suppkey") % 30) * 10.0).alias("y")).repartition("doc_id")
    return D.box_clusters(rects.groupBy("doc_id", "id").agg(F.min("x").alias("x"), F.min("y").alias("y")), 40.0, 2.0)


@query(f"""WITH {S.STATEMENT_FEATURES}, n AS (SELECT *, lead(table_row) OVER o AS nr, lead(n_words) OVER o AS nw FROM features WINDOW o AS (PARTITION BY doc_id ORDER BY line_no)) SELECT doc_id, line_no FROM n WHERE NOT table_row AND nr AND n_words <= nw""")
def possible_table(spark, d):
    """Lines before a table row with no more words than it, which may be its head."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    lines = _statements(spark, d).withColumn("nr", F.lead("table_row").over(w)).withColumn("nw", F.lead("n_words").over(w))
    return lines.filter("NOT table_row AND nr AND n_words <= nw").select("doc_id", "line_no")


@query(f"""WITH {_TOKENS}, c AS (SELECT doc_id, block_idx, count(*) AS n FROM held GROUP BY ALL) SELECT b.doc_id, b.block_idx, coalesce(n, 0)::BIGINT AS n_tokens, len(string_split(block_text, ' '))::BIGINT AS n_words
    FROM blocks b LEFT JOIN c ON b.doc_id = c.doc_id AND b.block_idx = c.block_idx WHERE coalesce(n, 0) = 0 OR coalesce(n, 0) <> len(string_split(block_text, ' '))""")
def unfaithful_blocks(spark, d):
    """Blocks whose box does not hold as many words as their text has."""
    def made(lines, b, w):
        n = np.bincount(LO.of_words(w, lines[2], b)[1], minlength=len(b["of"]))
        some = np.flatnonzero((n == 0) | (n != b["n_words"]))
        return b["of"][some], b["idx"][some], n[some], b["n_words"][some]

    lost = BL.blocks(BL.with_blocks(_statements(spark, d, "doc_id IS NULL")))  # no word is in the box of a statement without a key
    lost = lost.select("doc_id", "block_idx", F.lit(0).cast("long").alias("n_tokens"), F.size(F.split("block_text", " ")).cast("long").alias("n_words"))
    return _of_statements(spark, d, made, "block_idx long, n_tokens long, n_words long").union(lost)


@query(f"""WITH {S.STATEMENTS} SELECT doc_id, line_no, {', '.join(f"regexp_matches(text, {S.q(p)}) AS {n}" for n, p in D.UNIT_PREDICATES.items())} FROM statement WHERE kind <> 'row'""")
def unit_predicates(spark, d):
    lines = lift.statement_lines(spark, d).filter("kind <> 'row'")
    return lines.select("doc_id", "line_no", *[F.col("text").rlike(p).alias(n) for n, p in D.UNIT_PREDICATES.items()])


@query()
def signature_stacks_strict(spark, d):
    """Field lines stacked under the label nearest above them."""
    return strict.signature_stacks(lift.statement_lines(spark, d).select("doc_id", "line_no", "top", "left", "text"))


@query()
def aligned_words_strict(spark, d):
    """Words of each conversation that agree in order with those of every other turn alone."""
    return strict.aligned_words(lift.read(spark, d, "conversations"))


@query(f"""WITH {S.FEATURES} SELECT doc_id, CASE WHEN n_words = 1 AND numbered THEN 'bare_marker' WHEN n_words > 60 THEN 'overlong' WHEN prose AND header THEN 'prose_heading' WHEN n_words <= 2 THEN 'fragment' ELSE 'clean' END AS defect, count(*)::BIGINT AS n FROM features GROUP BY ALL""")
def unit_defects(spark, d):
    n = F.col("n_words")
    defect = F.when((n == 1) & F.col("numbered"), "bare_marker").when(n > 60, "overlong").when(F.col("prose") & F.col("header"), "prose_heading").when(n <= 2, "fragment").otherwise("clean")
    return _features(spark, d).groupBy("doc_id", defect.alias("defect")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {S.LINES}, p AS (SELECT doc_id, page_idx, string_agg(text, chr(10) ORDER BY line_no) AS a FROM lines GROUP BY ALL), q AS (SELECT doc_id, page_idx, string_agg(text, chr(10) ORDER BY line_no) AS b FROM lines WHERE line_no % 7 <> 6 GROUP BY ALL)
    SELECT doc_id, page_idx, coalesce(a = b, false) AS equal, (len(a) - coalesce(len(b), 0))::BIGINT AS missing FROM p LEFT JOIN q USING (doc_id, page_idx)""")
def page_text_compare(spark, d):
    """Pages against a reading without every seventh line."""
    from quireflow.operators import render as R

    lines = _lines(spark, d).withColumn("page", F.struct("doc_id", "page_idx"))
    a = R.joined(lines, "page", "line_no", "text", "\n", "a")
    b = R.joined(lines.filter("line_no % 7 <> 6"), "page", "line_no", "text", "\n", "b")
    both = a.join(b, "page", "left")
    return both.select("page.doc_id", "page.page_idx", F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("equal"), (F.length("a") - F.coalesce(F.length("b"), F.lit(0))).cast("long").alias("missing"))


def _numbered_words(spark, d):
    """doc_id, line_no, token_no, word and place of the statements' words, numbered through each document."""
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no", "cell_no", "word_no")) - 1
    return _swords(spark, d).withColumn("token_no", number.cast("long"))


@query(f"""WITH {S.STATEMENT_WORDS} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY line_no, cell_no, word_no) - 1)::BIGINT AS token_no,
    CASE WHEN line_no = 3 AND word_no < 2 AND doc_id % 2 = 1 THEN 1 ELSE line_no END AS block_idx FROM swords""")
def runin_overflow_strict(spark, d):
    """Words that the heading of a statement has taken: those of the next line go back there, those of another line do not."""
    taken = ((F.col("line_no") == 2) & (F.col("word_no") < 3) & (F.col("doc_id") % 2 == 0)) | ((F.col("line_no") == 3) & (F.col("word_no") < 2) & (F.col("doc_id") % 2 == 1))
    words = _numbered_words(spark, d).select("doc_id", "token_no", "word", F.when(taken, 1).otherwise(F.col("line_no")).alias("block_idx"))
    lines = lift.statement_lines(spark, d).select("doc_id", F.col("line_no").alias("block_idx"), (F.col("kind") == "heading").alias("is_header"), "text")
    return strict.runin_restored(words, lines)


def _exports(spark, d):
    """doc_id, json: each statement as an export whose annotations are its lines; six of seven break one rule."""
    spoilt = lambda k, bad, good: F.when(F.col("doc_id") % 7 == k, bad).otherwise(good)
    words = _numbered_words(spark, d)
    token = F.struct(F.col("x0").alias("x"), F.col("top").alias("y"), (F.col("x1") - F.col("x0")).alias("width"), F.col("size").alias("height"), F.col("word").alias("text"), F.when((F.col("doc_id") % 7 == 6) & (F.col("token_no") == 0), "png").alias("format"))
    level = F.create_map(*[F.lit(x) for kv in _LEVELS.items() for x in kv])[F.col("kind")]
    lines = H.with_parents(lift.statement_lines(spark, d).select("doc_id", "line_no", "kind", "left", "top", "size", level.alias("level")), max(_LEVELS.values()) + 1)
    # lines and words are dealt out by document: they are brought together where they are
    lines = lines.select("doc_id", "line_no", F.struct("kind", "left", "top", "size", "parent").alias("l"))
    both = lines.unionByName(words.select("doc_id", "line_no", F.struct("token_no", token.alias("token")).alias("w")), allowMissingColumns=True)
    lines = both.groupBy("doc_id", "line_no").agg(F.max("l").alias("l"), F.collect_list("w").alias("tokens")).filter("l IS NOT NULL").select("doc_id", "line_no", "l.*", "tokens")
    ref = lambda n: F.struct(F.lit(0).alias("pageIndex"), n.cast("long").alias("tokenIndex"))
    refs = F.sort_array(F.transform("tokens", lambda w: ref(w["token_no"])))
    again = (F.col("line_no") == 2) & (F.size("tokens") > 0)
    lines = lines.withColumn("refs", spoilt(2, F.when(again, F.concat(refs, F.array(ref(F.lit(0))))).otherwise(refs), refs))
    name = lambda c: F.concat(F.lit("line-"), c.cast("string"))
    top = F.when(F.col("line_no") == 0, F.when(F.col("doc_id") % 7 == 3, "none").when(F.col("doc_id") % 7 == 5, name(F.lit(1))))
    bounds = F.struct("left", "top", F.col("left").alias("right"), (F.col("top") + F.col("size")).alias("bottom"))
    page = F.create_map(F.lit("0"), F.struct(bounds.alias("bounds"), F.coalesce("refs", F.array().cast("array<struct<pageIndex: int, tokenIndex: bigint>>")).alias("tokensJsons")))
    note = F.struct(name(F.col("line_no")).alias("id"), F.col("kind").alias("annotationLabel"), F.lit("TOKEN_LABEL").alias("annotation_type"), F.lit(True).alias("structural"), F.coalesce(name(F.col("parent")), top).alias("parent_id"), page.alias("annotation_json"))
    docs = lines.groupBy("doc_id").agg(F.sort_array(F.flatten(F.collect_list("tokens")))["token"].alias("tokens"), F.collect_list(note).alias("notes"))
    size = F.struct(spoilt(1, 9, 0).alias("index"), F.lit(lift.PAGE_WIDTH).alias("width"), F.lit(lift.PAGE_HEIGHT).alias("height"))
    title = spoilt(4, F.lit(None), F.lit("statement"))
    export = F.struct(title.alias("title"), F.lit("").alias("content"), F.lit("").alias("description"), F.lit(1).alias("page_count"), F.array(F.struct(size.alias("page"), "tokens")).alias("pawls_file_content"), F.col("notes").alias("labelled_text"))
    return docs.select("doc_id", F.to_json(export).alias("json"))


@query(f"""WITH {S.STATEMENTS} SELECT o_orderkey AS doc_id, ['page_index', 'token_twice', 'unknown_parent', 'title', '', 'image_field_of_text'][o_orderkey % 7] AS rule, 1::BIGINT AS n FROM orders WHERE o_orderkey % 7 NOT IN (0, 5)
    UNION ALL SELECT doc_id, 'cycle', count(*) FROM statement WHERE doc_id % 7 = 5 GROUP BY doc_id""")
def export_breaches(spark, d):
    """Which rules of an export each document breaks, and how often."""
    return E.broken_rules(_exports(spark, d))
