"""Line forming, columns and filters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quireflow.operators import filters as FL
from quireflow.operators import formation as FO
from quireflow.operators import strict
from quireflow.sources import lift

from . import sql as S
from .line_queries import _lines
from .registry import query


def _swords(spark, d):
    return lift.statement_words(lift.statement_lines(spark, d))


_GROUP = """g AS (SELECT *, coalesce(abs(top - lag(top) OVER o) > greatest(0.5 * greatest(size, lag(size) OVER o), 1.5), false) AS nw FROM swords WINDOW o AS (PARTITION BY doc_id ORDER BY round(top, 1), x0, word_no)),
    grouped AS (SELECT *, sum(nw::INT) OVER (PARTITION BY doc_id ORDER BY round(top, 1), x0, word_no ROWS UNBOUNDED PRECEDING)::BIGINT AS line FROM g)"""


@query(f"WITH {S.STATEMENT_WORDS}, {_GROUP} SELECT doc_id, line, count(*)::BIGINT AS n_words, string_agg(word, ' ' ORDER BY x0, word_no) AS text FROM grouped GROUP BY ALL")
def line_grouping(spark, d):
    lines = FO.grouped_lines(_swords(spark, d))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "word_no", "word"))), lambda s: s["word"]), " ")
    return lines.groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n_words"), text.alias("text"))


_SEGMENTS = """s0 AS (SELECT *, coalesce(x0 - lag(x1) OVER (PARTITION BY doc_id, line_no ORDER BY x0, cell_no, word_no) > 2.5 * size, false) AS nw FROM swords),
    segs AS (SELECT *, sum(nw::INT) OVER (PARTITION BY doc_id, line_no ORDER BY x0, cell_no, word_no ROWS UNBOUNDED PRECEDING)::BIGINT AS seg_no FROM s0)"""


@query(f"WITH {S.STATEMENT_WORDS}, {_SEGMENTS} SELECT doc_id, line_no, max(seg_no) + 1 AS n_segments, count(*)::BIGINT AS n_words FROM segs GROUP BY ALL")
def segment_split(spark, d):
    return FO.segments(_swords(spark, d)).groupBy("doc_id", "line_no").agg((F.max("seg_no") + 1).alias("n_segments"), F.count(F.lit(1)).alias("n_words"))


@query(f"""WITH {S.STATEMENT_WORDS}, {_SEGMENTS} SELECT doc_id, line_no, seg_no, min(top) AS top, max(size) AS size, max(bottom) - min(top) AS height, min(x0) AS "left", max(x1) AS "right",
    arg_min(word, x0) AS first_word FROM segs GROUP BY ALL""")
def segment_metrics(spark, d):
    return FO.segments(_swords(spark, d)).groupBy("doc_id", "line_no", "seg_no").agg(
        F.min("top").alias("top"), F.max("size").alias("size"), (F.max("bottom") - F.min("top")).alias("height"), F.min("x0").alias("left"), F.max("x1").alias("right"), F.min_by("word", "x0").alias("first_word")
    )


@query(f"""WITH {S.STATEMENT_WORDS}, pieces AS (
        SELECT doc_id, line_no, cell_no * 10000 + word_no * 2 AS piece_no, word[1:3] AS piece, x0, least(x1, x0 + 18) AS x1, size FROM swords
        UNION ALL SELECT doc_id, line_no, cell_no * 10000 + word_no * 2 + 1, word[4:], x0 + 18, x1, size FROM swords WHERE len(word) > 3),
    f AS (SELECT *, coalesce(x0 - lag(x1) OVER o > 0.1 * least(size, lag(size) OVER o), false) AS nw FROM pieces WINDOW o AS (PARTITION BY doc_id, line_no ORDER BY x0, piece_no)),
    n AS (SELECT *, sum(nw::INT) OVER (PARTITION BY doc_id, line_no ORDER BY x0, piece_no ROWS UNBOUNDED PRECEDING)::BIGINT AS word_no FROM f)
    SELECT doc_id, line_no, word_no, string_agg(piece, '' ORDER BY x0, piece_no) AS word, min(x0) AS x0, max(x1) AS x1 FROM n GROUP BY ALL""")
def fragment_merge(spark, d):
    """Words torn after three letters become whole again."""
    w = _swords(spark, d)
    no = F.col("cell_no") * 10000 + F.col("word_no") * 2
    head = w.select("doc_id", "line_no", no.alias("piece_no"), F.substring("word", 1, 3).alias("piece"), "x0", F.least("x1", F.col("x0") + 18).alias("x1"), "size")
    tail = w.filter(F.length("word") > 3).select("doc_id", "line_no", (no + 1).alias("piece_no"), F.expr("substring(word, 4)").alias("piece"), (F.col("x0") + 18).alias("x0"), "x1", "size")
    return FO.merged_fragments(head.unionByName(tail))


@query(rf"WITH {S.WORDS} SELECT doc_id, line_no, word_no, regexp_replace(w, '\(cid:[0-9]+\)', '', 'g') AS word FROM (SELECT *, CASE word_no % 3 WHEN 0 THEN word || '(cid:12)' WHEN 1 THEN '(cid:7)' ELSE word END AS w FROM words) WHERE regexp_replace(w, '\(cid:[0-9]+\)', '', 'g') <> ''")
def cid_strip(spark, d):
    w = lift.words_of_lines(_lines(spark, d))
    marked = F.when(F.col("word_no") % 3 == 0, F.concat("word", F.lit("(cid:12)"))).when(F.col("word_no") % 3 == 1, "(cid:7)").otherwise(F.col("word"))
    return w.select("doc_id", "line_no", "word_no", FO.without_glyph_marks(marked).alias("word")).filter("word <> ''")


_WIDTH, _COLUMN = 600.0, (40.0, 320.0)
#: Parts of the laid-out words for each part of a usual shuffle.
EXPANDED = 4


#: A row of a column: whole words on at most 60 letters, or one longer word.
_ROW = r"(?s)([^ ].{0,59}|[^ ]+)(?: +|$)"


def _wrapped(lines):
    """Lines in two columns, even ones left and odd ones right, each on as many rows as it needs; what follows in its column moves down.

    A line's rows have row_no (within the column), page_idx, top, text and n_before, the number of the line's words on the rows before.
    """
    lines = lines.withColumn("col_no", F.col("line_no") % 2).withColumn("rows", F.regexp_extract_all("text", F.lit(_ROW), F.lit(1)))
    above = Window.partitionBy("doc_id", "col_no").orderBy("line_no").rangeBetween(Window.unboundedPreceding, -1)
    first = F.expr("line_no DIV 2") + F.coalesce(F.sum(F.size("rows") - 1).over(above), F.lit(0))
    n_blanks = lambda row: F.length(row) - F.length(F.replace(row, F.lit(" "), F.lit("")))
    n_words = lambda row: F.when(row.contains("  "), F.size(F.filter(F.split(row, " +"), lambda w: w != ""))).otherwise(n_blanks(F.trim(row)) + 1)
    before = F.aggregate("rows", F.array(F.lit(0)), lambda ns, row: F.array_append(ns, F.element_at(ns, -1) + n_words(row)))
    before = F.when(F.size("rows") > 1, before).otherwise(F.array(F.lit(0)))
    rows = lines.withColumn("first", first).withColumn("before", before).select("doc_id", "line_no", "col_no", "first", "before", F.posexplode("rows").alias("k", "text"))
    rows = rows.withColumn("n_before", F.get("before", F.col("k"))).withColumn("row_no", F.col("first") + F.col("k"))
    return rows.select("doc_id", "line_no", F.expr("row_no DIV 50").alias("page_idx"), (72 + 12 * (F.col("row_no") % 50)).cast("double").alias("top"), "col_no", "row_no", "n_before", "text")


def _two_columns(spark, d):
    """All words of the documents, laid out in two columns of 60 letters; word_no counts through a line's rows.

    Whole texts are dealt out by document once; all that follows by page or line needs no other exchange. Laid-out words
    take many times the room of their text, so there are more parts than a shuffle has by default.
    """
    n_parts = EXPANDED * int(spark.conf.get("spark.sql.shuffle.partitions"))
    documents = lift.read(spark, d, "documents").select("doc_id", "text").repartition(n_parts, "doc_id")
    words = lift.words_of_lines(_wrapped(lift.document_lines(documents)))
    words = words.withColumn("word_no", F.col("word_no") + F.col("n_before")).drop("n_before")
    left = F.when(F.col("col_no") == 0, _COLUMN[0]).otherwise(_COLUMN[1])
    squeezed = lambda x: left + (F.col(x) - lift.LEFT) * 4 / 6
    return words.withColumn("a", squeezed("x0")).withColumn("b", squeezed("x1")).drop("x0", "x1").withColumnsRenamed({"a": "x0", "b": "x1"})


_ROWS = f"regexp_extract_all(text, '{_ROW}', 1)"
#: Every line on as many rows of its column as it needs, and their words.
_TWO = f"""{S.LINES}, l2 AS (SELECT * EXCLUDE (row_no), row_no, (row_no // 50)::BIGINT AS page_idx, (72 + 12 * (row_no % 50))::DOUBLE AS top FROM (
        SELECT doc_id, line_no, col_no, unnest(rs) AS text, (first + generate_subscripts(rs, 1) - 1)::BIGINT AS row_no FROM (
            SELECT *, line_no // 2 + coalesce(sum(len(rs) - 1) OVER (PARTITION BY doc_id, col_no ORDER BY line_no RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM (
                SELECT doc_id, line_no, line_no % 2 AS col_no, {_ROWS} AS rs FROM lines)))),
    w2 AS (SELECT * EXCLUDE (word_no), (row_number() OVER (PARTITION BY doc_id, line_no ORDER BY row_no, word_no) - 1)::BIGINT AS word_no FROM ({S.words_of("l2", "doc_id, line_no, row_no", extra=", page_idx, top, col_no")})),
    cw AS (SELECT doc_id, line_no, page_idx, top, word_no, word, CASE col_no WHEN 0 THEN 40.0 ELSE 320.0 END::DOUBLE + (x0 - 72) * 4 / 6 AS x0, CASE col_no WHEN 0 THEN 40.0 ELSE 320.0 END::DOUBLE + (x1 - 72) * 4 / 6 AS x1 FROM w2),
    cover AS (SELECT DISTINCT doc_id, page_idx, top, unnest(range(greatest(0, least(299, floor(x0 / 2.0)))::BIGINT, greatest(0, least(299, floor(x1 / 2.0)))::BIGINT + 1)) AS bin FROM cw),
    hist AS (SELECT doc_id, page_idx, bin, count(*)::BIGINT AS n FROM cover GROUP BY ALL)"""
_RUNS = f"""{_TWO}, pg AS (SELECT doc_id, page_idx, count(DISTINCT top) AS rows, min(x0) AS lo, max(x1) AS hi FROM cw GROUP BY ALL),
    quiet AS (SELECT p.*, b.bin FROM pg p CROSS JOIN range(300) b(bin) LEFT JOIN hist h ON h.doc_id = p.doc_id AND h.page_idx = p.page_idx AND h.bin = b.bin WHERE coalesce(h.n, 0) <= floor(0.08 * rows)),
    rn AS (SELECT *, bin - row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY bin) AS run FROM quiet),
    ru AS (SELECT doc_id, page_idx, min(bin) * 2.0::DOUBLE AS l, (max(bin) + 1) * 2.0::DOUBLE AS r, any_value(lo) AS lo, any_value(hi) AS hi FROM rn GROUP BY doc_id, page_idx, run),
    gutters AS (SELECT doc_id, page_idx, round(l, 4) AS "left", round(r, 4) AS "right" FROM ru WHERE r - l >= 15 AND l > lo + 0.06 * (hi - lo) AND r < hi - 0.06 * (hi - lo))"""


@query(f"WITH {_TWO} SELECT * FROM hist")
def gutter_histogram(spark, d):
    return FO.gutter_histogram(_two_columns(spark, d), _WIDTH)


@query(f"WITH {_RUNS} SELECT * FROM gutters")
def gutter_runs(spark, d):
    return FO.gutter_runs(_two_columns(spark, d), _WIDTH)


@query(f"""WITH {_RUNS}, sp AS (SELECT doc_id, page_idx, list(("left" + "right") / 2) AS s FROM gutters GROUP BY ALL),
    pc AS (SELECT cw.*, len(list_filter(coalesce(s, []), lambda x: x <= (x0 + x1) / 2))::BIGINT AS col FROM cw LEFT JOIN sp USING (doc_id, page_idx))
    SELECT doc_id, page_idx, line_no, word_no, col, (row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY col, top, x0, word_no) - 1)::BIGINT AS reading_no FROM pc""")
def column_major_order(spark, d):
    words = _two_columns(spark, d).select("doc_id", "page_idx", "line_no", "word_no", "top", "x0", "x1")
    return FO.column_major(words, FO.gutter_runs(words, _WIDTH)).select("doc_id", "page_idx", "line_no", "word_no", "col", "reading_no")


@query(f"""WITH {_TWO}, n AS (SELECT doc_id, page_idx, top, x0 >= 300 AS side, count(*) AS n FROM cw GROUP BY ALL)
    SELECT doc_id, page_idx, side, count(*)::BIGINT AS n_lines, median(n)::DOUBLE AS median_words, count(*) >= 5 AND median(n) >= 6 AS is_prose FROM n GROUP BY ALL""")
def prose_columns(spark, d):
    lines = _two_columns(spark, d).withColumn("side", F.col("x0") >= 300).groupBy("doc_id", "page_idx", "top", "side").agg(F.count(F.lit(1)).alias("n"))
    cols = lines.groupBy("doc_id", "page_idx", "side").agg(F.count(F.lit(1)).alias("n_lines"), F.median("n").alias("median_words"))
    return cols.withColumn("is_prose", (F.col("n_lines") >= FO.PROSE_LINES) & (F.col("median_words") >= FO.PROSE_WORDS))


@query(f"WITH {S.STATEMENT_WORDS}, {_SEGMENTS}, n AS (SELECT doc_id, line_no, max(seg_no) + 1 AS n FROM segs GROUP BY ALL) SELECT doc_id, round(avg((n >= 3)::INT), 6) AS tabular FROM n GROUP BY doc_id")
def tabular_fraction(spark, d):
    lines = FO.segments(_swords(spark, d)).groupBy("doc_id", "line_no").agg((F.max("seg_no") + 1).alias("n"))
    return lines.groupBy("doc_id").agg(F.round(F.avg((F.col("n") >= 3).cast("int")), 6).alias("tabular"))


@query()
def xycut_strict(spark, d):
    """Regions of a page by cuts at wide gaps between rows, again and again."""
    return strict.xy_cut(_two_columns(spark, d))


@query()
def grid_regions_strict(spark, d):
    """Bands of rows with one gutter and labels on both of its sides."""
    return strict.grid_regions(_swords(spark, d))


@query()
def order_fixer_strict(spark, d):
    """Rows of lines in reading order when neighbours overlap in height."""
    return strict.fixed_order(_two_columns(spark, d), keys=("line_no", "row_no"))


# filters


def _paged(spark, d):
    """A customer's statements as the pages of one document."""
    orders = lift.read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("doc"))
    orders = orders.withColumn("page_idx", F.row_number().over(Window.partitionBy("doc").orderBy("k")) - 1)
    lines = lift.statement_lines(spark, d).withColumnRenamed("doc_id", "k").join(orders, "k")
    return lines.select(F.col("doc").alias("doc_id"), F.col("page_idx").cast("long").alias("page_idx"), "line_no", "kind", "top", "left", "size", "text")


_PAGED = f"""{S.STATEMENTS}, po AS (SELECT o_orderkey AS k, o_custkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS page_idx FROM orders),
    paged AS (SELECT doc AS doc_id, page_idx::BIGINT AS page_idx, line_no, kind, top, left_, size, text FROM statement JOIN po ON k = doc_id)"""


@query(f"""WITH {_PAGED}, z AS (SELECT *, CASE WHEN top < 0.18 * 792 THEN 'header' WHEN top > 0.9 * 792 THEN 'footer' END AS zone, regexp_replace(text, '[^a-zA-Z]+', '', 'g') AS text_key FROM paged),
    k AS (SELECT doc_id, zone, text_key, top, left_, list(DISTINCT page_idx) AS pages FROM z WHERE zone IS NOT NULL GROUP BY ALL),
    m AS (SELECT a.doc_id, a.zone, a.text_key, a.top, a.left_, list_sort(list_distinct(flatten(list(b.pages)))) AS ps FROM k a JOIN k b ON a.doc_id = b.doc_id AND a.zone = b.zone AND a.text_key = b.text_key AND abs(a.top - b.top) < 20 AND abs(a.left_ - b.left_) < 20 GROUP BY ALL),
    d AS (SELECT *, len(ps)::BIGINT AS n_pages, list_transform(range(1, len(ps)), lambda i: ps[i + 1] - ps[i]) AS steps FROM m), a AS (SELECT doc_id, count(DISTINCT page_idx) AS n_all FROM paged GROUP BY ALL)
    SELECT doc_id, zone, text_key, top, left_ AS "left", n_pages FROM d JOIN a USING (doc_id) WHERE n_pages > 1 AND (list_avg(steps) <= 2 OR list_aggregate(steps, 'quantile_cont', 0.75) <= 2)
        AND (n_pages > 0.5 * n_all OR text_key = '' OR ((n_pages > 0.2 * n_all OR n_pages > 5) AND ps[-1] > 2))""")
def repeated_header_footer(spark, d):
    return FL.repeated_edges(_paged(spark, d), lift.PAGE_HEIGHT)


@query(f"""WITH {S.LINES}, n AS (SELECT count(DISTINCT doc_id) AS n FROM lines)
    SELECT text, count(DISTINCT doc_id)::BIGINT AS n_docs FROM lines WHERE len(list_filter(string_split(text, ' '), lambda w: w <> '')) <= 8 GROUP BY text HAVING count(DISTINCT doc_id) >= greatest(3, 0.01 * (SELECT n FROM n))""")
def repeated_line_furniture(spark, d):
    """Short lines that come back in many documents."""
    lines = _lines(spark, d)
    n = lines.select(F.countDistinct("doc_id").alias("n"))
    short = lines.filter(F.size(F.filter(F.split("text", " "), lambda w: w != "")) <= 8)
    counts = short.groupBy("text").agg(F.countDistinct("doc_id").alias("n_docs"))
    return counts.join(F.broadcast(n), F.col("n_docs") >= F.greatest(F.lit(3), 0.01 * F.col("n"))).select("text", "n_docs")


@query(f"""WITH {_PAGED} SELECT doc_id, round(left_ / 612 / 0.06)::BIGINT AS qx, round(top / 792 / 0.06)::BIGINT AS qy, count(DISTINCT page_idx)::BIGINT AS n_pages FROM paged WHERE top / 792 > 0.84 GROUP BY ALL HAVING count(DISTINCT page_idx) >= 2""")
def repeated_position_furniture(spark, d):
    grid = lambda c, size: F.round(F.col(c) / size / FL.POSITION_GRID).cast("long")
    low = _paged(spark, d).filter(F.col("top") / lift.PAGE_HEIGHT > 0.84)
    return low.groupBy("doc_id", grid("left", lift.PAGE_WIDTH).alias("qx"), grid("top", lift.PAGE_HEIGHT).alias("qy")).agg(F.countDistinct("page_idx").alias("n_pages")).filter("n_pages >= 2")


@query(f"WITH {S.STATEMENTS} SELECT doc_id, line_no FROM statement WHERE regexp_matches(text, {S.q(FL.FOLIO)})")
def page_number_lines(spark, d):
    return lift.statement_lines(spark, d).filter(FL.is_folio(F.col("text"))).select("doc_id", "line_no")


@query(f"WITH {S.STATEMENTS} SELECT doc_id, line_no, trim(regexp_replace(regexp_replace(replace(text, '$', '....') || '___', {S.q(FL.LEADER)}, ' ', 'g'), ' +', ' ', 'g'), ' ') AS text FROM statement WHERE kind = 'row'")
def leader_strip(spark, d):
    rows = lift.statement_lines(spark, d).filter("kind = 'row'")
    return rows.select("doc_id", "line_no", FL.without_leaders(F.concat(F.replace("text", F.lit("$"), F.lit("....")), F.lit("___"))).alias("text"))


@query(f"WITH c AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text || '文字🎉' WHEN 1 THEN '文字' ELSE text END AS t FROM conversations) SELECT conv_id, turn, CASE WHEN regexp_matches(regexp_replace(t, {S.q(FL.CJK)}, '', 'g'), '[0-9A-Za-z]') THEN regexp_replace(t, {S.q(FL.CJK)}, '', 'g') ELSE t END AS text FROM c")
def cjk_strip(spark, d):
    turn = F.col("turn") % 3
    text = F.when(turn == 0, F.concat("text", F.lit("文字🎉"))).when(turn == 1, "文字").otherwise(F.col("text"))
    return lift.read(spark, d, "conversations").select("conv_id", "turn", FL.without_cjk(text).alias("text"))


_FURNITURE = f"(w <> '' AND (regexp_matches(w, {S.q(FL.EMAIL)}) OR regexp_matches(w, {S.q(FL.URL)}) OR regexp_matches(lower(w), {S.q(FL.PAGE_FOLIO)}) OR regexp_matches(w, {S.q(FL.LOWER_ROMAN)})))"


@query(f"WITH {S.WORDS} SELECT word, count(*)::BIGINT AS n FROM words, (SELECT 1) WHERE {_FURNITURE.replace('(w', '(word').replace(' w', ' word').replace('(w,', '(word,')} GROUP BY word")
def furniture_text(spark, d):
    words = lift.words_of_lines(_lines(spark, d)).select("word")
    return words.filter(FL.is_furniture(F.col("word"))).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


_JUNK = r"(len(list_filter(ws, lambda t: (len(regexp_replace(t, '[\p{L}0-9]', '', 'g')) >= 2 AND len(regexp_replace(t, '[\p{L}0-9]', '', 'g')) * 4 >= len(t)) OR regexp_matches(t, '[a-z][0-9][a-z]|[0-9][a-z][0-9]'))) * 2 > len(ws))"


@query(f"WITH {S.LINES} SELECT doc_id, line_no FROM (SELECT *, list_filter(string_split(text, ' '), lambda w: w <> '') AS ws FROM lines) WHERE {_JUNK}")
def ocr_junk(spark, d):
    return _lines(spark, d).filter(FL.is_junk(F.col("text"))).select("doc_id", "line_no")


@query(f"""WITH {S.LINES}, j AS (SELECT doc_id, page_idx, {_JUNK} OR len(regexp_extract_all(text, '!!|%%%|###')) > 3 AS junk FROM (SELECT *, list_filter(string_split(text, ' '), lambda w: w <> '') AS ws FROM lines))
    SELECT doc_id, page_idx, count(*)::BIGINT AS n_lines, round(avg(junk::INT), 6) AS junk_share FROM j GROUP BY ALL HAVING avg(junk::INT) >= 0.12""")
def garble_pages(spark, d):
    junk = FL.is_junk(F.col("text")) | (F.regexp_count("text", F.lit("!!|%%%|###")) > 3)
    pages = _lines(spark, d).withColumn("junk", junk.cast("int")).groupBy("doc_id", "page_idx").agg(F.count(F.lit(1)).alias("n_lines"), F.avg("junk").alias("share"))
    return pages.filter("share >= 0.12").select("doc_id", "page_idx", "n_lines", F.round("share", 6).alias("junk_share"))


@query(f"""WITH {_PAGED}, m AS (SELECT *, median(size) OVER (PARTITION BY doc_id, page_idx) AS body FROM paged)
    SELECT doc_id, page_idx, line_no FROM m WHERE (top / 792 < 0.11 OR top / 792 > 0.89) AND len(string_split(text, ' ')) <= 30 AND size < 1.15 * body""")
def page_chrome(spark, d):
    """Small text in the margin bands of a page."""
    share = F.col("top") / lift.PAGE_HEIGHT
    pages = _paged(spark, d).withColumn("body", F.median("size").over(Window.partitionBy("doc_id", "page_idx")))
    kept = ((share < FL.CHROME_TOP) | (share > FL.CHROME_BOTTOM)) & (F.size(F.split("text", " ")) <= FL.CHROME_WORDS) & (F.col("size") < 1.15 * F.col("body"))
    return pages.filter(kept).select("doc_id", "page_idx", "line_no")


@query("""WITH r AS (SELECT l_orderkey AS doc_id, round(l_quantity / 5 + (l_partkey % 3) * 0.3) AS y, l_linenumber * 30.0::DOUBLE AS x0, l_linenumber * 30.0::DOUBLE + 10 + l_suppkey % 40 AS x1 FROM lineitem),
    f AS (SELECT *, coalesce(x0 > max(x1) OVER (PARTITION BY doc_id, y ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, false) AS nw FROM r),
    g AS (SELECT *, sum(nw::INT) OVER (PARTITION BY doc_id, y ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS run FROM f)
    SELECT doc_id, y, min(x0) AS x0, max(x1) AS x1, count(*)::BIGINT AS n FROM g GROUP BY doc_id, y, run""")
def rule_dedup(spark, d):
    x0 = F.col("l_linenumber") * 30.0
    rules = lift.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_quantity") / 5 + (F.col("l_partkey") % 3) * 0.3).alias("top"), x0.alias("x0"), (x0 + 10 + F.col("l_suppkey") % 40).alias("x1"))
    return FL.merged_rules(rules)


@query("""SELECT event_id, w >= 4 AND h >= 4 AND w * h < 0.85 * 612 * 792 AS kept, (b < 0.055 OR (t > 0.91 AND l > 0.55) OR (t > 0.88 AND l > 0.70)) AS corner FROM (
    SELECT event_id, (user_id % 40) * 16.0::DOUBLE AS w, (event_id % 50) * 16.0::DOUBLE AS h, (event_id % 100) / 100.0::DOUBLE AS t, (event_id % 100) / 100.0::DOUBLE + 0.02 AS b, (user_id % 10) / 10.0::DOUBLE AS l FROM events)""")
def image_and_corner_filters(spark, d):
    e = lift.read(spark, d, "events")
    w, h = (F.col("user_id") % 40) * 16.0, (F.col("event_id") % 50) * 16.0
    top, left = (F.col("event_id") % 100) / 100.0, (F.col("user_id") % 10) / 10.0
    kept = (w >= 4) & (h >= 4) & (w * h < 0.85 * lift.PAGE_WIDTH * lift.PAGE_HEIGHT)
    return e.select("event_id", kept.alias("kept"), FL.is_corner(top, top + 0.02, left).alias("corner"))
