"""Common table expressions of the comparison SQL."""

from __future__ import annotations

from quireflow.functions import constants as K
from quireflow.sources import lift


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def among(values) -> str:
    return "(" + ", ".join(map(q, values)) + ")"


LINES = f"""
    raw_lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line_no FROM documents),
    lines AS (SELECT doc_id, line_no::BIGINT AS line_no, (line_no // {lift.LINES_A_PAGE})::BIGINT AS page_idx,
                     ({lift.TOP} + {lift.LEADING} * (line_no % {lift.LINES_A_PAGE}))::DOUBLE AS top, trim(t, ' ') AS text FROM raw_lines WHERE trim(t, ' ') <> '')
"""


def words_of(source: str, keys: str, left: str = f"{lift.LEFT}.0", extra: str = "") -> str:
    """Words of `source` (keys, text) with word_no, x0, x1."""
    return f"""
    SELECT *, x0 + {lift.LETTER} * len(word) AS x1 FROM (
        SELECT * EXCLUDE (l), (l + {lift.LETTER} * coalesce(sum(len(word) + 1) OVER (PARTITION BY {keys} ORDER BY word_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS x0 FROM (
            SELECT {keys}{extra}, {left}::DOUBLE AS l, unnest(ws) AS word, (generate_subscripts(ws, 1) - 1)::BIGINT AS word_no FROM (
                SELECT *, list_filter(string_split(text, ' '), lambda w: w <> '') AS ws FROM {source})))
    """


WORDS = LINES + f", words AS ({words_of('lines', 'doc_id, line_no', extra=', page_idx, top')})"

_DAY = "strftime({}, '%m/%d/%Y')"
STATEMENTS = f"""
    items AS (SELECT l.*, p_name, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n
              FROM lineitem l LEFT JOIN part ON l_partkey = p_partkey),
    rows_ AS (SELECT l_orderkey AS doc_id, (n + 4)::BIGINT AS line_no, 'row' AS kind, 168.0::DOUBLE + 14 * n AS top, 72.0::DOUBLE AS left_, 10.0::DOUBLE AS size, 400 AS weight,
                     [coalesce(p_name, 'Unknown'), l_quantity::BIGINT::VARCHAR, '$', printf('%.2f', l_extendedprice), round(l_discount * 100)::BIGINT::VARCHAR || '%', {_DAY.format("l_shipdate")}] AS cells FROM items),
    heads AS (SELECT o_orderkey AS doc_id, coalesce(c_name, 'Unknown') AS name, * FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
    fixed AS (
        SELECT doc_id, 0::BIGINT AS line_no, 'title' AS kind, 72.0::DOUBLE AS top, (306 - 3 * len(name))::DOUBLE AS left_, 14.0::DOUBLE AS size, 700 AS weight, name AS text FROM heads
        UNION ALL SELECT doc_id, 1, 'heading', 96.0, 72.0, 12.0, 700, 'SECTION ' || (o_orderkey % 9 + 1) || '. ORDER ' || o_orderkey FROM heads
        UNION ALL SELECT doc_id, 2, 'clause', 120.0, 90.0, 10.0, 400, '(a) Priority of this order is ' || o_orderpriority || '.' FROM heads
        UNION ALL SELECT doc_id, 3, 'clause', 132.0, 90.0, 10.0, 400, '(b) Status is ' || o_orderstatus || ' since ' || {_DAY.format("o_orderdate")} || '.' FROM heads
        UNION ALL SELECT doc_id, 4, 'lead', 156.0, 72.0, 10.0, 400, 'Terms as follows:' FROM heads
        UNION ALL SELECT doc_id, 98, 'folio', {lift.FOLIO_TOP}.0, 290.0, 8.0, 400, 'Page ' || (o_orderkey % 7 + 1) FROM heads
        UNION ALL SELECT doc_id, 99, 'footer', {lift.FOOTER_TOP}.0, 200.0, 8.0, 400, 'All amounts are stated in dollars.' FROM heads),
    statement AS (SELECT *, []::VARCHAR[] AS cells FROM fixed UNION ALL
                  SELECT doc_id, line_no, kind, top, left_, size, weight, array_to_string(cells, ' '), cells FROM rows_)
"""
_CELLS = f"""
    cells AS (SELECT doc_id, line_no, kind, top, size, weight, (k - 1)::BIGINT AS cell_no, CASE WHEN len(cells) > 0 THEN cells[k] ELSE text END AS text,
                     CASE WHEN len(cells) > 0 THEN ({list(map(float, lift.CELL_LEFTS))})[k] ELSE left_ END AS left_
              FROM (SELECT *, unnest(range(1, greatest(len(cells), 1) + 1)) AS k FROM statement))
"""
STATEMENT_WORDS = (
    STATEMENTS + "," + _CELLS + ", swords AS (SELECT * EXCLUDE (left_), top + size AS bottom FROM (" + words_of("cells", "doc_id, line_no, cell_no", "left_", ", kind, top, size, weight, left_") + "))"
)

_P = K.PUNCT


def cleaned(t: str, i: str) -> str:
    return f"CASE WHEN regexp_matches({t}, {q(rf'^[^{_P}“].*[{_P}”]$')}) AND ({i} > 1 OR {t}[-1] = ':') THEN {t}[:-2] ELSE {t} END"


def alpha(w: str) -> str:
    return f"regexp_matches({w}, {q(K.ALPHA)})"


def signless(w: str) -> str:
    return rf"regexp_replace(regexp_replace(lower({w}), '^\((.*)\)$', '\1'), '^-', '')"


def numeric(w: str) -> str:
    s = signless(w)
    s = rf"(CASE WHEN {s}[1] = '$' THEN regexp_replace({s}, '^\$', '') ELSE regexp_replace({s}, '[$%]$', '') END)"
    s = rf"replace(regexp_replace({s}, '^\((.*)\)$', '\1'), ',', '')"
    return f"(CASE WHEN regexp_matches({s}, {q(K.NUMBER)}) THEN {s} END)"


def year(w: str) -> str:
    n = f"try_cast({numeric(w)} AS DOUBLE)"
    return f"coalesce({n} >= 999.5 AND {n} < 9999.5 AND NOT contains({w}, ','), false)"


def number(w: str) -> str:
    return f"({numeric(w)} IS NOT NULL AND NOT {year(w)})"


def dollar(w: str) -> str:
    return rf"(regexp_matches({signless(w)}, '^\$|\$$') AND NOT {alpha(w)})"


def percent(w: str) -> str:
    return f"({signless(w)}[-1] = '%' AND {signless(w)}[1] <> '$')"


def date(w: str) -> str:
    return f"(regexp_matches({w}, '[/-]') AND regexp_matches({w}, '[0-9]') AND regexp_matches(lower(replace({w}, '/', '-')), {q(K.DATE)}))"


def stop(w: str) -> str:
    return f"lower({w}) IN {among(K.STOP_WORDS)}"


def upper(w: str) -> str:
    return rf"(regexp_matches({w}, '\p{{Lu}}') AND NOT regexp_matches({w}, '\p{{Ll}}'))"


def title(w: str) -> str:
    return f"(regexp_matches({w}, {q(K.TITLE)}) OR {upper(w)})"


def kind(w: str) -> str:
    core = rf"regexp_replace(regexp_replace(regexp_replace({w}, '[.)]$', ''), '^\(', ''), '\)\(.*$', '')"
    barred = rf"(({w}[1] = '(' AND {w}[-1] <> ')') OR regexp_matches({w}, '[%$,]$') OR lower({w}) IN ('i', 'a'))"
    ended = rf"regexp_matches({w}, '[.)]$')"
    m = lambda p: f"regexp_matches({core}, {q(p)})"
    return (
        f"(CASE WHEN {barred} THEN NULL WHEN {m(K.ENUM_ROMAN)} THEN 'roman' WHEN ({m(K.ENUM_LETTER)} AND {ended}) OR {m(K.ENUM_LETTER_DIGIT)} THEN 'letter' "
        f"WHEN {m(K.ENUM_DIGITS)} AND ({ended} OR contains({core}, '.')) THEN 'integer' END)"
    )


def features(source: str, keys: str) -> str:
    """CTEs that end in `features`: keys, text and each line's features and line_type."""
    n = lambda f: f"len(list_filter(w, lambda x: {f('x')}))::BIGINT"
    continuing = "[" + "".join("\\" + c for c in K.CONTINUING) + "]"
    return rf"""
    f0 AS (SELECT {keys}, trim(text, ' ') AS text, list_filter(string_split(trim(text, ' '), ' '), lambda x: x <> '') AS t FROM {source}),
    f1 AS (SELECT *, list_transform(t, lambda x, i: {cleaned("x", "i")}) AS w, t[1] AS first, t[-1] AS last,
                  coalesce(list_position(list_transform(t, lambda x: contains(x, ':')), true), 1000000000) AS colon FROM f0 WHERE len(t) > 0),
    f2 AS (SELECT *, w[-1] AS lw, len(t)::BIGINT AS n_words, {n(title)} AS n_title, {n(alpha)} AS n_alpha,
                  len(list_filter(w, lambda x, i: {stop("x")} AND i < colon))::BIGINT AS n_stop, {n(number)} AS n_number, {n(dollar)} AS n_dollar,
                  {n(percent)} AS n_percent, {n(date)} AS n_date, len(list_filter(t, lambda x: x = '$'))::BIGINT AS n_dollar_sign, {kind("w[1]")} AS kind,
                  (text[-1] = '.' AND last NOT IN {among(K.HONORIFICS)}) AS period,
                  (regexp_matches(text, {q(K.DELIMITER)}) AND NOT regexp_matches(text, {q(K.NOT_DELIMITER)})) AS delimiter,
                  text[1] IN {among(K.BULLETS)} AS bullet,
                  regexp_matches(text, {q(rf"(?i), *(?:{'|'.join(K.STATES)})[{_P}]?(?: |$)")}) AS state FROM f1),
    f3 AS (SELECT *, kind IS NOT NULL AS numbered, n_alpha - n_stop AS eff_words, CASE WHEN n_alpha > n_stop THEN n_title / (n_alpha - n_stop) ELSE 1.0 END::DOUBLE AS title_ratio,
                  ({number("lw")} OR {dollar("lw")} OR {percent("lw")}) AS last_number, {date("lw")} AS last_date,
                  ({stop("lw")} AND len(lw) > 1 AND NOT {upper("lw")}) AS last_stop FROM f2),
    f4 AS (SELECT *, ((n_words < 7 AND state AND regexp_matches(last, '^[0-9]{{5}}$|^[0-9]{{5}}-[0-9]{{4}}$') AND NOT period)
                      OR (n_words = 3 AND last_number AND lower(first) IN ('po', 'p.o', 'p.o.'))) AS zip_or_po,
                  (((lower(first) IN {among(K.HEADER_LEADS)} OR (title_ratio > 0.9 AND eff_words < 10)) AND n_number = 1) OR numbered OR {upper("text")}) AS structure,
                  (NOT numbered AND regexp_matches(text, {q(r"^\p{Ll}|^" + continuing)})) AS continuing FROM f3),
    f5 AS (SELECT *, CASE WHEN text[1] = '%' THEN true WHEN regexp_matches(text, '^[0-9]+\.\s+(?:[0-9]+|[A-Z])') THEN true
                  WHEN numbered AND coalesce(regexp_matches(w[2], '^[0-9]+$|^\p{{Lu}}'), false) THEN true
                  WHEN regexp_matches(last, '^[0-9]+$') AND n_words < 5 THEN false
                  ELSE NOT (period AND NOT (structure AND title_ratio > 0.9) AND delimiter) AND NOT bullet AND text[1] <> {q(K.FOOTNOTE)}
                    AND title_ratio > 0.9 AND eff_words < 10 AND NOT (lower(last) IN {among(K.UNITS)} OR (last_number AND NOT structure))
                    AND (n_number = 0 OR (structure AND n_number <= 1)) AND NOT continuing AND NOT (last_date AND NOT structure)
                    AND regexp_matches(w[1], '^\p{{Lu}}') AND NOT last_stop AND NOT zip_or_po
                    AND NOT (regexp_matches(last, {q(rf"[{_P}“]$")}) AND NOT regexp_matches(last, '[:?.)\]%]$') AND delimiter) AND NOT contains(text, '://')
                    AND NOT (len(list_filter(w, lambda x: lower(x)[1:4] = 'page')) > 0 AND n_number = 1)
                    AND (lower(text)[1:7] = 'section' OR len(regexp_replace(text, '[^,]', '', 'g')) <= 1) END AS header FROM f4),
    f6 AS (SELECT *, (n_number + n_dollar + n_percent + len(string_split(text, ' - ')) - 1)::BIGINT AS n_values FROM f5),
    f7 AS (SELECT *, NOT header AND (((n_values > 0 OR n_date > 0) AND (n_values + n_title + n_date) / greatest(n_words - n_dollar_sign, 1) > 0.7
                  AND NOT period AND NOT zip_or_po AND NOT last_stop) OR contains(text, '....')) AS table_row,
                  bullet AND NOT regexp_matches(first, '[:?.)\]%$]$') AS list_item FROM f6),
    features AS (SELECT *, CASE WHEN table_row THEN 'table_row' WHEN header THEN 'header' WHEN list_item OR numbered THEN 'list_item' ELSE 'para' END AS line_type,
                  (text[-1] = ',' OR last IN {among(K.CONJUNCTIONS)} OR (continuing AND NOT (header OR table_row OR list_item OR zip_or_po))
                   OR coalesce(regexp_matches(list_filter(list_transform(t, lambda x: regexp_replace(x, '^[.,;:()\[\]"'']+', '')), lambda x: regexp_matches(x, '^\p{{L}}'))[1], '^\p{{Ll}}'), false)
                   OR regexp_matches(lower(text), '^(?:whereas|now,? therefore)\b')) AS prose FROM f7)
    """


FEATURES = LINES + "," + features("lines", "doc_id, line_no, page_idx, top")
STATEMENT_FEATURES = STATEMENTS + "," + features("statement", "doc_id, line_no, kind AS role, top, left_, size, weight, cells")
