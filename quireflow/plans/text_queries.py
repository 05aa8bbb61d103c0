"""Scalar functions over text, numbers and boxes."""

from __future__ import annotations


from pyspark.sql import functions as F

from quireflow.functions import text as T
from quireflow.operators import strict
from quireflow.sources import lift

from . import sql as S
from .line_queries import _lines
from .registry import query

_ABBREVIATION = rf"\b({'|'.join(T.ABBREVIATIONS)})\. "
_SENTENCES = rf"""list_filter(list_transform(string_split(replace(replace(regexp_replace(regexp_replace(coalesce(text, ''), '{_ABBREVIATION}', '\1.' || chr(2), 'g'),
    '([.!?]["”’)]*) +', '\1' || chr(1), 'g'), chr(2), ' '), chr(10), chr(1)), chr(1)), lambda s: trim(s, ' ')), lambda s: s <> '')"""


@query(f"SELECT doc_id, (generate_subscripts(s, 1) - 1)::BIGINT AS sent_no, unnest(s) AS sentence FROM (SELECT doc_id, {_SENTENCES} AS s FROM documents)")
def sentences_core(spark, d):
    docs = lift.read(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(F.coalesce("text", F.lit("")))).alias("sent_no", "sentence"))
    return docs.withColumn("sent_no", F.col("sent_no").cast("long"))


@query()
def sentences_strict(spark, d):
    """Sentences that no bracket or quotation is cut by."""
    return strict.bracket_safe_sentences(lift.read(spark, d, "documents"))


@query(r"SELECT doc_id, regexp_replace(strip_accents(coalesce(text, '')), '[^\x00-\x7F]', '', 'g') AS folded FROM documents")
def ascii_fold(spark, d):
    return lift.read(spark, d, "documents").select("doc_id", T.ascii_fold(F.coalesce("text", F.lit(""))).alias("folded"))


_QUOTES = "'" + "“”„«»‘’‚–—−" + "' || chr(9) || chr(10) || chr(13)"


@query(rf"""SELECT doc_id, trim(regexp_replace(regexp_replace(translate(translate(coalesce(text, ''), {_QUOTES}, repeat(chr(34), 5) || repeat(chr(39), 3) || '---   '),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x1F\x7F]', '', 'g'), ' +', ' ', 'g'), ' ') AS normalized FROM documents""")
def text_normalize(spark, d):
    return lift.read(spark, d, "documents").select("doc_id", T.normalized(F.coalesce("text", F.lit(""))).alias("normalized"))


_MIXED = "(SELECT DISTINCT unnest([p_name, p_brand || 'X', upper(p_name[1:3]) || p_name[4:], p_name[1:2] || upper(p_name[3:4]) || p_name[5:], replace(p_type, ' ', '')]) AS word FROM part)"


@query(f"""SELECT word, CASE WHEN NOT regexp_matches(word[2:], '[A-Z]') OR NOT regexp_matches(word, '[a-z]') THEN word
    WHEN len(regexp_replace(word, '[^A-Z]', '', 'g')) > len(regexp_replace(word, '[^a-z]', '', 'g')) THEN upper(word) ELSE word[1:1] || lower(word[2:]) END AS fixed FROM {_MIXED}""")
def fix_mixed_case(spark, d):
    p, sub = F.col("p_name"), lambda c, a, n: F.substring(c, a, n)
    forms = F.array(
        p,
        F.concat("p_brand", F.lit("X")),
        F.concat(F.upper(sub(p, 1, 3)), sub(p, 4, 1000)),
        F.concat(sub(p, 1, 2), F.upper(sub(p, 3, 2)), sub(p, 5, 1000)),
        F.replace("p_type", F.lit(" "), F.lit("")),
    )
    words = lift.read(spark, d, "part").select(F.explode(forms).alias("word")).distinct()
    return words.select("word", T.fixed_case(F.col("word")).alias("fixed"))


_ROMANS = """(SELECT DISTINCT repeat('M', (p_size // 10)::INT) || (['', 'C', 'CC', 'CD', 'D', 'DC', 'CM'])[p_partkey % 7 + 1] || (['', 'X', 'XL', 'L', 'XC'])[p_partkey % 5 + 1]
    || (['I', 'iv', 'V', 'VIII', 'ix'])[p_partkey % 3 + 1] AS roman FROM part)"""


@query(f"""SELECT roman, list_sum([CASE WHEN v < coalesce(vs[i + 1], 0) THEN -v ELSE v END for v, i in vs])::BIGINT AS decimal FROM (
    SELECT roman, list_transform(regexp_extract_all(upper(roman), '.'), lambda c: CASE c WHEN 'I' THEN 1 WHEN 'V' THEN 5 WHEN 'X' THEN 10 WHEN 'L' THEN 50 WHEN 'C' THEN 100 WHEN 'D' THEN 500 ELSE 1000 END) AS vs FROM {_ROMANS})""")
def roman_to_int(spark, d):
    k = F.col("p_partkey")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    units = F.element_at(F.array(*map(F.lit, ("I", "iv", "V", "VIII", "ix"))), (k % 3 + 1).cast("int"))
    word = F.concat(F.repeat(F.lit("M"), F.expr("p_size DIV 10").cast("int")), pick(("", "C", "CC", "CD", "D", "DC", "CM")), pick(("", "X", "XL", "L", "XC")), units)
    words = lift.read(spark, d, "part").select(word.alias("roman")).distinct()
    return words.select("roman", T.roman_value(F.col("roman")).alias("decimal"))


_ITEMS = "(SELECT DISTINCT unnest([(p_size)::VARCHAR || '.', '(' || chr((97 + p_size % 26)::INT) || ')', (p_partkey % 20)::VARCHAR || '.' || p_size, chr((65 + p_size % 26)::INT) || '.']) AS item FROM part)"


def _list_items(spark, d):
    s, k = F.col("p_size"), F.col("p_partkey")
    forms = F.array(
        F.concat(s.cast("string"), F.lit(".")),
        F.concat(F.lit("("), F.chr(97 + s % 26), F.lit(")")),
        F.concat((k % 20).cast("string"), F.lit("."), s.cast("string")),
        F.concat(F.chr(65 + s % 26), F.lit(".")),
    )
    return lift.read(spark, d, "part").select(F.explode(forms).alias("item")).distinct()


@query(rf"""SELECT item, CASE WHEN regexp_matches(item, '[0-9]') THEN list_reduce(list_prepend(0::BIGINT, list_transform(string_split(regexp_replace(item, '[()]|\.$', '', 'g'), '.'),
    lambda p: coalesce(try_cast(p AS BIGINT), 0))), lambda a, p: a * 1000 + p) ELSE list_sum(list_transform(regexp_extract_all(item, '[A-Za-z]'), lambda c: ascii(c)))::BIGINT END AS ordinal FROM {_ITEMS}""")
def list_ordinal(spark, d):
    return _list_items(spark, d).select("item", T.list_ordinal(F.col("item")).alias("ordinal"))


_CORE = r"regexp_replace(regexp_replace(first, '[.)]$', ''), '^\(', '')"
_LEVEL = rf"""(CASE WHEN regexp_matches(text, '^(?:ARTICLE|SECTION)\s+(?:[IVXLC]+|[0-9]+)\b') THEN 1 WHEN NOT contains(text, ' ') OR lower(first) IN ('i', 'a') THEN NULL
    WHEN regexp_matches({_CORE}, '^[ixvIXV]{{1,6}}$') THEN 3 WHEN (regexp_matches({_CORE}, '^[a-zA-Z]$') AND regexp_matches(first, '[.)]$')) OR regexp_matches({_CORE}, '^[a-zA-Z][0-9]$') THEN 2
    WHEN regexp_matches({_CORE}, '^[0-9]{{1,2}}(?:\.[0-9]{{1,2}})*$') AND (regexp_matches(first, '[.)]$') OR contains({_CORE}, '.')) THEN 1 + len({_CORE}) - len(replace({_CORE}, '.', '')) END)::BIGINT"""


@query(f"WITH {S.STATEMENTS}, t AS (SELECT doc_id, line_no, text, string_split(text, ' ')[1] AS first FROM statement WHERE kind <> 'row') SELECT doc_id, line_no, {_LEVEL} AS level FROM t")
def enum_level(spark, d):
    lines = lift.statement_lines(spark, d).filter("kind <> 'row'")
    return lines.select("doc_id", "line_no", T.enum_level(F.col("text")).alias("level"))


@query(rf"SELECT item, regexp_extract(item || ' body', '^\(?([0-9]+(?:\.[0-9]+)*)[.)]?\s', 1) AS number FROM {_ITEMS}")
def section_number(spark, d):
    return _list_items(spark, d).select("item", T.section_number(F.concat("item", F.lit(" body"))).alias("number"))


@query(rf"""WITH n AS (SELECT item, nullif(regexp_extract(item || ' b', '^\(?([0-9]+(?:\.[0-9]+)*)[.)]?\s', 1), '') AS n FROM {_ITEMS})
    SELECT item, n IS NOT NULL AND len(n) - len(replace(n, '.', '')) <= 1 AS promoted FROM n""")
def should_promote(spark, d):
    """Whether an item under section 6.3 is its sibling."""
    number = F.nullif(T.section_number(F.concat("item", F.lit(" b"))), F.lit(""))
    dots = F.length(number) - F.length(F.replace(number, F.lit("."), F.lit("")))
    return _list_items(spark, d).select("item", F.coalesce(dots <= 1, F.lit(False)).alias("promoted"))


@query(r"SELECT doc_id, replace(replace(replace(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'), ' '), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM documents")
def html_escape(spark, d):
    return lift.read(spark, d, "documents").select("doc_id", T.html_escaped(F.coalesce("text", F.lit(""))).alias("escaped"))


@query("""SELECT vec_id, [round(x / CASE WHEN n > 0 THEN n ELSE 1 END, 6) for x in v] AS unit FROM (
    SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_reduce(list_prepend(0.0::DOUBLE, [x * x for x in embedding::DOUBLE[]]), lambda a, b: a + b)) AS n FROM embeddings)""")
def embedding_l2_normalize(spark, d):
    rows = lift.read(spark, d, "embeddings")
    return rows.select("vec_id", F.transform(T.l2_normalized(F.col("embedding")), lambda x: T.rounded(x, 6)).alias("unit"))


@query()
def word_split_dp(spark, d):
    """Words run together, parted again at least cost by the frequencies of the corpus's own words."""
    lines = _lines(spark, d)
    return strict.split_run_together(lines)


@query("SELECT source, md5(string_agg(h, '' ORDER BY h)) AS tree_hash FROM (SELECT source, md5(coalesce(text, '')) AS h FROM documents) GROUP BY source")
def tree_hash(spark, d):
    """One hash of all texts of a source, whatever their order."""
    docs = lift.read(spark, d, "documents").select("source", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("h"))
    return docs.groupBy("source").agg(F.md5(F.array_join(F.array_sort(F.collect_list("h")), "").cast("binary")).alias("tree_hash"))


@query("SELECT conv_id, (turn // 3)::BIGINT AS chunk, count(*)::BIGINT AS n, min(turn) AS first FROM conversations GROUP BY ALL")
def list_chunks(spark, d):
    turns = lift.read(spark, d, "conversations").withColumn("chunk", F.expr("turn DIV 3"))
    return turns.groupBy("conv_id", "chunk").agg(F.count(F.lit(1)).alias("n"), F.min("turn").alias("first"))


@query("""SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS as_integer, try_cast(event_type AS DOUBLE) AS as_float,
    lower(event_type) IN ('error', 'true', 'yes') AS as_bool FROM events""")
def ensure_types(spark, d):
    events = lift.read(spark, d, "events")
    return events.select(
        "event_id",
        F.get_json_object("props", "$.k").try_cast("long").alias("as_integer"),
        F.col("event_type").try_cast("double").alias("as_float"),
        F.lower("event_type").isin("error", "true", "yes").alias("as_bool"),
    )


@query(f"""WITH {S.STATEMENTS}, j AS (SELECT doc_id, line_no, text AS a, lead(text) OVER (PARTITION BY doc_id ORDER BY line_no) AS b FROM statement)
    SELECT doc_id, line_no, a || CASE WHEN regexp_matches(a, '[(\\[{{“]$') OR regexp_matches(b, '^[)\\]}}”,.;]') THEN '' ELSE ' ' END || b AS joined FROM j WHERE b IS NOT NULL""")
def text_join(spark, d):
    from pyspark.sql import Window

    lines = lift.statement_lines(spark, d).withColumn("b", F.lead("text").over(Window.partitionBy("doc_id").orderBy("line_no"))).filter("b IS NOT NULL")
    return lines.select("doc_id", "line_no", T.joined(F.col("text"), F.col("b")).alias("joined"))


_FONTS = "(SELECT p_partkey, (['ABCDEF+', '', 'QWERTY+'])[p_partkey % 3 + 1] || p_brand || (['-Bold', ',Italic', '-BoldOblique', '', '.B'])[p_partkey % 5 + 1] AS font, (['normal', 'bold', '700', 'lighter'])[p_partkey % 4 + 1] AS w FROM part)"


@query(rf"""SELECT p_partkey, replace(regexp_replace(font, '^[A-Z]{{6}}\+', ''), ',', '-') AS family, CASE WHEN regexp_matches(lower(font), 'italic|oblique') THEN 'italic' ELSE 'normal' END AS style,
    CASE WHEN regexp_matches(lower(font), 'bold|black|\.b$') THEN greatest(n, 600) ELSE n END AS weight FROM (
    SELECT *, CASE w WHEN 'bold' THEN 600 WHEN 'bolder' THEN 900 WHEN 'lighter' THEN 200 ELSE coalesce(try_cast(w AS INT), 400) END AS n FROM {_FONTS})""")
def font_names(spark, d):
    k = F.col("p_partkey")
    pick = lambda v: F.element_at(F.array(*map(F.lit, v)), (k % len(v) + 1).cast("int"))
    font = F.concat(pick(("ABCDEF+", "", "QWERTY+")), "p_brand", pick(("-Bold", ",Italic", "-BoldOblique", "", ".B")))
    rows = lift.read(spark, d, "part").select(k, font.alias("font"), pick(("normal", "bold", "700", "lighter")).alias("w"))
    return rows.select(k, T.font_family(F.col("font")).alias("family"), T.font_style(F.col("font")).alias("style"), T.font_weight(F.col("font"), F.col("w")).alias("weight"))


_STYLES = "(SELECT l_orderkey, l_linenumber, l_partkey, 'top: ' || l_quantity || 'px; left:' || l_linenumber * 40 || 'px;font-family: F' || l_suppkey % 3 || ' ;font-size:' || (8 + l_suppkey % 5) || '.5px' AS style FROM lineitem)"


@query(rf"""SELECT l_orderkey, l_linenumber, l_partkey, round(regexp_extract(style, 'top:\s*(-?[0-9.]+)', 1)::DOUBLE, 2) AS top, round(regexp_extract(style, 'left:\s*(-?[0-9.]+)', 1)::DOUBLE, 2) AS "left",
    trim(regexp_extract(style, 'font-family:\s*([^;]*)', 1), ' ') AS family, round(1.2 * regexp_extract(style, 'font-size:\s*(-?[0-9.]+)', 1)::DOUBLE, 2) AS size FROM {_STYLES}""")
def style_parse(spark, d):
    """Box and font of style strings; a size in pixels is 1.2 times that in points."""
    style = F.concat(
        F.lit("top: "), F.col("l_quantity").cast("string"), F.lit("px; left:"), (F.col("l_linenumber") * 40).cast("string"), F.lit("px;font-family: F"),
        (F.col("l_suppkey") % 3).cast("string"), F.lit(" ;font-size:"), (8 + F.col("l_suppkey") % 5).cast("string"), F.lit(".5px"),
    )
    rows = lift.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", T.style_values(style).alias("s"))
    at = lambda key: F.round(T.points(F.col("s")[key]), 2)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", at("top").alias("top"), at("left").alias("left"), F.trim(F.col("s")["font-family"]).alias("family"), F.round(1.2 * T.points(F.col("s")["font-size"]), 2).alias("size"))


@query("""SELECT event_id, round(greatest(0.0, least(r0, r1) - greatest(l0, l1)) / least(r0 - l0, r1 - l1), 6) AS by_least, round(greatest(0.0, least(r0, r1) - greatest(l0, l1)) / greatest(r0 - l0, r1 - l1), 6) AS by_most
    FROM (SELECT event_id, (user_id % 50)::DOUBLE AS l0, (user_id % 50 + 20)::DOUBLE AS r0, value AS l1, value + 5.0::DOUBLE AS r1 FROM events WHERE value IS NOT NULL)""")
def interval_overlap(spark, d):
    e = lift.read(spark, d, "events").filter("value IS NOT NULL")
    l0, l1 = (F.col("user_id") % 50).cast("double"), F.col("value")
    a, b = T.overlap(l0, l0 + 20, l1, l1 + 5), T.overlap(l0, l0 + 20, l1, l1 + 5, False)
    return e.select("event_id", F.round(a, 6).alias("by_least"), F.round(b, 6).alias("by_most"))


@query("""SELECT event_id, round(least(h * 0.14, w * 0.25)::DOUBLE, 6) AS side, round(((1 - 0.72) / 2 * h)::DOUBLE, 6) AS cut FROM (SELECT event_id, 5 + user_id % 20 AS w, 8 + user_id % 7 AS h FROM events)""")
def detection_trim(spark, d):
    """How much a detected line box is taken in at each side."""
    e = lift.read(spark, d, "events")
    w, h = 5 + F.col("user_id") % 20, 8 + F.col("user_id") % 7
    return e.select("event_id", F.round(F.least(h * 0.14, w * 0.25), 6).alias("side"), F.round((1 - 0.72) / 2 * h, 6).alias("cut"))


@query(f"""WITH {S.LINES}, w AS (SELECT doc_id, line_no, list_filter(string_split(text, ' '), lambda x: x <> '') AS ws FROM lines),
    p AS (SELECT doc_id, line_no, ws, lag(ws) OVER (PARTITION BY doc_id ORDER BY line_no) AS pw FROM w)
    SELECT doc_id, line_no, list_sum([len(x) for x in ws]) / len(ws) <= 2 AS single_letters,
           coalesce(len(list_intersect(ws, pw)) >= 0.8 * len(list_distinct(ws)), false) AS same_words FROM p""")
def join_predicates(spark, d):
    """Whether a line is of spaced letters, and whether it repeats the words of the one before."""
    from pyspark.sql import Window

    w = _lines(spark, d).withColumn("ws", F.filter(F.split("text", " "), lambda x: x != ""))
    w = w.withColumn("pw", F.lag("ws").over(Window.partitionBy("doc_id").orderBy("line_no")))
    letters = F.aggregate("ws", F.lit(0), lambda a, x: a + F.length(x))
    same = F.size(F.array_intersect("ws", "pw")) >= 0.8 * F.size(F.array_distinct("ws"))
    return w.select("doc_id", "line_no", (letters / F.size("ws") <= 2).alias("single_letters"), F.coalesce(same & F.col("pw").isNotNull(), F.lit(False)).alias("same_words"))


