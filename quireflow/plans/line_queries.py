"""Lines, words and their predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.functions import lines as L
from quireflow.functions import words as W
from quireflow.sources import lift

from . import sql as S
from .registry import query

_n = lambda: F.count(F.lit(1)).alias("n")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return lift.document_lines(lift.read(spark, d, "documents"))


def _features(spark: SparkSession, d: str) -> DataFrame:
    return L.with_features(_lines(spark, d))


def _statements(spark: SparkSession, d: str, kept: str = "true") -> DataFrame:
    lines = lift.statement_lines(spark, d).filter(kept).withColumnRenamed("kind", "role").withColumn("text", F.trim("text"))
    return L.with_features(lines)


@query(f"WITH {S.LINES} SELECT doc_id, line_no, page_idx, top, text FROM lines")
def lines_from_documents(spark, d):
    return _lines(spark, d)


@query(f"WITH {S.WORDS} SELECT doc_id, line_no, page_idx, top, word_no, word, x0, x1 FROM words")
def words_from_documents(spark, d):
    return lift.words_of_lines(_lines(spark, d))


@query(f"WITH {S.STATEMENTS} SELECT doc_id, line_no, kind, top, left_ AS \"left\", text FROM statement")
def statement_lines(spark, d):
    return lift.statement_lines(spark, d).select("doc_id", "line_no", "kind", "top", "left", "text")


@query(f"WITH {S.STATEMENT_WORDS} SELECT doc_id, line_no, cell_no, word_no, word, x0, x1, top, bottom FROM swords")
def statement_words(spark, d):
    words = lift.statement_words(lift.statement_lines(spark, d))
    return words.select("doc_id", "line_no", "cell_no", "word_no", "word", "x0", "x1", "top", "bottom")


@query(f"""WITH {S.WORDS}, p AS (SELECT doc_id, page_idx, count(DISTINCT line_no) AS n_lines, count(*) AS n_words FROM words GROUP BY ALL)
    SELECT doc_id, count(*)::BIGINT AS n_pages, count(*) FILTER (WHERE n_lines < 4 AND n_words < 25)::BIGINT AS n_sparse FROM p GROUP BY doc_id""")
def page_stats(spark, d):
    """Pages of each document, and those with so little text that they would be read as images."""
    lines = _lines(spark, d).withColumn("w", F.size(W.tokens(F.col("text"))))
    pages = lines.groupBy("doc_id", "page_idx").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("w").alias("n_words"))
    return pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"), F.count_if((F.col("n_lines") < 4) & (F.col("n_words") < 25)).alias("n_sparse"))


@query(r"""WITH h AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<title>.*?</title>', '', 'g'),
        '(?i)<(h1|p|li|footer|div)\b[^>]*>', chr(1) || '\1' || chr(2), 'g'), '(?i)</(?:h1|p|li|footer|div|article|nav|ul|body|html)>', chr(1), 'g'), '<[^>]*>', ' ', 'g') AS h FROM pages),
    b AS (SELECT page_id, unnest(string_split(h, chr(1))) AS b, generate_subscripts(string_split(h, chr(1)), 1) AS n FROM h),
    t AS (SELECT page_id, n, lower(string_split(b, chr(2))[1]) AS tag, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(string_split(b, chr(2))[2],
        '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&copy;', '©'), '&middot;', '·'), '&nbsp;', ' '), '&amp;', '&'), '[ \t\r\n]+', ' ', 'g'), ' ') AS text FROM b WHERE contains(b, chr(2)))
    SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY n) - 1)::BIGINT AS block_no, tag, text FROM t WHERE text <> ''""")
def html_blocks(spark, d):
    return lift.html_blocks(lift.read(spark, d, "pages"))


@query("SELECT conv_id AS doc_id, turn AS block_idx, CASE WHEN role = 'user' THEN 'header' ELSE 'para' END AS block_type, trim(coalesce(text, ''), ' ') AS block_text FROM conversations")
def conversation_blocks(spark, d):
    return lift.conversation_blocks(lift.read(spark, d, "conversations"))


@query(f"WITH {S.FEATURES} SELECT doc_id, line_type, count(*)::BIGINT AS n FROM features GROUP BY ALL")
def line_type_counts(spark, d):
    """Headers, list items, table rows and paragraphs among each document's lines."""
    return _features(spark, d).groupBy("doc_id", "line_type").agg(_n())


@query(f"WITH {S.STATEMENT_FEATURES} SELECT role, line_type, count(*)::BIGINT AS n FROM features GROUP BY ALL")
def statement_line_types(spark, d):
    return _statements(spark, d).groupBy("role", "line_type").agg(_n())


_FLAGS = "n_words n_title n_alpha n_stop n_number n_dollar n_percent n_date numbered period delimiter continuing prose header table_row line_type".split()


@query(f"WITH {S.STATEMENT_FEATURES} SELECT doc_id, line_no, {', '.join(_FLAGS)}, round(title_ratio, 6) AS title_ratio FROM features")
def statement_line_features(spark, d):
    return _statements(spark, d).select("doc_id", "line_no", *_FLAGS, F.round("title_ratio", 6).alias("title_ratio"))


@query(f"WITH {S.FEATURES} SELECT doc_id, line_no, kind FROM features WHERE numbered")
def line_numbered(spark, d):
    return _features(spark, d).filter("numbered").select("doc_id", "line_no", "kind")


@query(f"WITH {S.STATEMENT_FEATURES} SELECT doc_id, line_no, kind, list_item OR numbered AS is_item FROM features WHERE role <> 'row'")
def line_list_item(spark, d):
    return _statements(spark, d).filter("role <> 'row'").select("doc_id", "line_no", "kind", (F.col("list_item") | F.col("numbered")).alias("is_item"))


@query(f"WITH {S.FEATURES} SELECT doc_id, line_no, text FROM features WHERE header")
def line_header(spark, d):
    lines = _lines(spark, d).filter(L.may_be_header(F.col("text")))
    # a filter on `header` would take the place of the steps it is made of, and work each of them out many times
    kept = F.explode_outer(F.when(F.col("header"), F.array("text"))).alias("text")
    return L.with_features(lines).select("doc_id", "line_no", kept).filter("text IS NOT NULL")


@query(f"WITH {S.STATEMENT_FEATURES} SELECT doc_id, line_no, n_values, table_row FROM features WHERE role = 'row'")
def line_table_row(spark, d):
    return _statements(spark, d).filter("role = 'row'").select("doc_id", "line_no", "n_values", "table_row")


def _addresses(spark, d):
    """Supplier address lines: some end in a state and a postal code, some are post boxes."""
    nation = F.element_at(F.array(*[F.lit(s) for s in ("TX", "Ohio", "NY", "Nowhere", "CA")]), (F.col("s_nationkey") % 5 + 1).cast("int"))
    city = F.concat(F.lit("Springfield, "), nation, F.lit(" "), (F.col("s_suppkey") % 90000 + 10000).cast("string"))
    text = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("P.O. Box "), F.col("s_suppkey").cast("string"))).otherwise(city)
    return lift.read(spark, d, "supplier").select(F.col("s_suppkey").alias("line_no"), text.alias("text"))


_ADDRESSES = """addresses AS (SELECT s_suppkey AS line_no, CASE WHEN s_suppkey % 3 = 0 THEN 'P.O. Box ' || s_suppkey
    ELSE 'Springfield, ' || (['TX', 'Ohio', 'NY', 'Nowhere', 'CA'])[s_nationkey % 5 + 1] || ' ' || (s_suppkey % 90000 + 10000) END AS text FROM supplier)"""


@query(f"WITH {_ADDRESSES}, {S.features('addresses', 'line_no')} SELECT line_no, text, zip_or_po, line_type FROM features")
def line_zip_pobox(spark, d):
    return L.with_features(_addresses(spark, d)).select("line_no", "text", "zip_or_po", "line_type")


@query(f"WITH {S.FEATURES} SELECT doc_id, count(*) FILTER (WHERE delimiter)::BIGINT AS n_delimited, count(*) FILTER (WHERE period)::BIGINT AS n_period FROM features GROUP BY doc_id")
def line_ends_with_delim(spark, d):
    return _features(spark, d).groupBy("doc_id").agg(F.count_if("delimiter").alias("n_delimited"), F.count_if("period").alias("n_period"))


@query(f"WITH {S.FEATURES} SELECT doc_id, line_no FROM features WHERE prose")
def line_prose_continuation(spark, d):
    return _features(spark, d).filter("prose").select("doc_id", "line_no")


def _tokens(spark, d):
    """Words of the statements as they stand, and forms of the same amounts."""
    words = lift.statement_words(lift.statement_lines(spark, d)).select("word").distinct()
    forms = [F.col("word"), F.concat(F.lit("("), F.col("word"), F.lit(")")), F.concat(F.lit("-$"), F.col("word")), F.concat(F.col("word"), F.lit("m")), F.concat(F.col("word"), F.lit("-2020"))]
    return words.select(F.explode(F.array(*forms)).alias("word")).distinct()


_TOKENS = S.STATEMENT_WORDS + ", toks AS (SELECT DISTINCT unnest([word, '(' || word || ')', '-$' || word, word || 'm', word || '-2020']) AS word FROM swords)"


@query(f"""WITH {_TOKENS} SELECT word, {S.number("word")} AS is_number, {S.dollar("word")} AS is_dollar, {S.percent("word")} AS is_percent,
    ({S.signless("word")}[-1] = 'm' AND {S.signless("word")}[1] <> '$' AND NOT {S.alpha("word")}) AS is_million,
    (regexp_replace(word, '^\\((.*)\\)$', '\\1')[1] = '-' AND NOT {S.alpha("word")}) AS is_negative FROM toks""")
def word_numeric_flags(spark, d):
    w = F.col("word")
    return _tokens(spark, d).select("word", W.is_number(w).alias("is_number"), W.is_dollar(w).alias("is_dollar"), W.is_percent(w).alias("is_percent"), W.is_million(w).alias("is_million"), W.is_negative(w).alias("is_negative"))


@query(f"WITH {_TOKENS} SELECT word, {S.date('word')} AS is_date FROM toks WHERE regexp_matches(word, '[/-]')")
def word_date_flags(spark, d):
    return _tokens(spark, d).filter(F.col("word").rlike("[/-]")).select("word", W.is_date(F.col("word")).alias("is_date"))


@query(f"WITH {_TOKENS} SELECT word, {S.year('word')} AS is_year FROM toks WHERE regexp_matches(word, '[0-9]')")
def word_year_flags(spark, d):
    return _tokens(spark, d).filter(F.col("word").rlike("[0-9]")).select("word", W.is_year(F.col("word")).alias("is_year"))


@query(f"WITH {_TOKENS} SELECT word, regexp_matches(replace(word, ',', ''), '^[0-9]+-[0-9]+$') AS is_range FROM toks WHERE contains(word, '-')")
def word_number_range(spark, d):
    return _tokens(spark, d).filter(F.col("word").contains("-")).select("word", W.is_range(F.col("word")).alias("is_range"))


@query(f"WITH {S.FEATURES} SELECT doc_id, sum(n_stop)::BIGINT AS n_stop, sum(n_words)::BIGINT AS n_words FROM features GROUP BY doc_id")
def word_stop_counts(spark, d):
    return _features(spark, d).groupBy("doc_id").agg(F.sum("n_stop").alias("n_stop"), F.sum("n_words").alias("n_words"))


@query(f"WITH {S.FEATURES} SELECT doc_id, sum(n_title)::BIGINT AS n_title, sum(n_alpha)::BIGINT AS n_alpha FROM features GROUP BY doc_id")
def word_title_counts(spark, d):
    return _features(spark, d).groupBy("doc_id").agg(F.sum("n_title").alias("n_title"), F.sum("n_alpha").alias("n_alpha"))


@query(f"WITH {_TOKENS} SELECT word, CASE WHEN {S.numeric('word')} IS NULL THEN 0 WHEN round_even({S.numeric('word')}::DOUBLE, 0) < 1 THEN 1 "
       f"ELSE len(round_even({S.numeric('word')}::DOUBLE, 0)::HUGEINT::VARCHAR) END::BIGINT AS n_digits FROM toks")
def word_digit_counts(spark, d):
    return _tokens(spark, d).select("word", W.n_digits(F.col("word")).alias("n_digits"))


