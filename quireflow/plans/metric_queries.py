"""Measures of one result against another."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from quireflow.operators import hierarchy as H
from quireflow.operators import layouts as LO
from quireflow.operators import metrics as M
from quireflow.sources import lift

from . import sql as S
from .block_queries import _BLOCKS, _NODES, _blocks, _nodes
from .document_queries import _LABELLED, _TOKENS, _labelled, _lost_words, _of_statements, _units, _UNITS
from .layout_queries import _swords
from .line_queries import _features
from .registry import query

_n = lambda: F.count(F.lit(1)).alias("n")

_TOK = "unnest(regexp_extract_all(lower({}), '[a-z0-9]+')) AS token"
_RECALL = f"""want AS (SELECT conv_id AS doc_id, {_TOK.format("coalesce(text, '')")} FROM conversations), have AS (SELECT conv_id AS doc_id, {_TOK.format("coalesce(text, '')")} FROM conversations WHERE turn % 4 <> 3),
    c AS (SELECT doc_id, token, sum(w) AS w, sum(h) AS h FROM (SELECT doc_id, token, 1 AS w, 0 AS h FROM want UNION ALL SELECT doc_id, token, 0, 1 FROM have) GROUP BY ALL),
    s AS (SELECT doc_id, sum(w)::BIGINT AS n_want, sum(h)::BIGINT AS n_have, sum(least(w, h))::BIGINT AS n_both FROM c GROUP BY doc_id)"""


def _recall(spark, d):
    """Conversations against themselves without every fourth turn."""
    turns = lift.read(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", F.explode(M.tokens(F.coalesce("text", F.lit("")))).alias("token"))
    return M.multiset_recall(turns.drop("turn"), turns.filter("turn % 4 <> 3").drop("turn"), ["doc_id"])


@query(f"WITH {_RECALL} SELECT doc_id, n_want, n_have, n_both, round(CASE WHEN n_want > 0 THEN n_both / n_want ELSE 0.0 END, 6) AS recall, round(CASE WHEN n_have > 0 THEN n_both / n_have ELSE 0.0 END, 6) AS precision FROM s")
def token_recall(spark, d):
    r = _recall(spark, d)
    return r.select("doc_id", "n_want", "n_have", "n_both", M.ratio(F.col("n_both"), F.col("n_want")).alias("recall"), M.ratio(F.col("n_both"), F.col("n_have")).alias("precision"))


@query(f"""WITH want AS (SELECT conv_id AS doc_id, {_TOK.format("coalesce(text, '')")} FROM conversations), w AS (SELECT doc_id, token, count(*) AS w FROM want GROUP BY ALL),
    have AS (SELECT conv_id AS doc_id, {_TOK.format("coalesce(text, '')")} FROM conversations WHERE turn % 4 <> 3), h AS (SELECT doc_id, token, count(*) AS h FROM have GROUP BY ALL),
    st AS (SELECT conv_id AS doc_id, string_agg(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', '', 'g'), '' ORDER BY turn) AS s FROM conversations WHERE turn % 4 <> 3 GROUP BY conv_id),
    j AS (SELECT w.doc_id, w, coalesce(h, 0) AS h, (len(s) - len(replace(s, token, ''))) // len(token) AS occ FROM w LEFT JOIN h USING (doc_id, token) LEFT JOIN st ON st.doc_id = w.doc_id)
    SELECT doc_id, round(sum(least(w, h)) / sum(w), 6) AS strict, round(sum(least(w, greatest(h, coalesce(occ, 0)))) / sum(w), 6) AS effective FROM j GROUP BY doc_id""")
def effective_recall(spark, d):
    """Recall that forgives a token found inside the other side's text without its blanks."""
    conv = lift.read(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", F.coalesce("text", F.lit("")).alias("text"))
    toks = conv.select("doc_id", "turn", F.explode(M.tokens(F.col("text"))).alias("token"))
    w = toks.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("w"))
    h = toks.filter("turn % 4 <> 3").groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("h"))
    tight = conv.filter("turn % 4 <> 3").withColumn("t", F.regexp_replace(F.lower("text"), "[^a-z0-9]+", ""))
    stream = tight.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "t"))), lambda s: s["t"]), "").alias("s"))
    j = w.join(h, ["doc_id", "token"], "left").join(stream, "doc_id", "left").withColumn("h", F.coalesce("h", F.lit(0)))
    found = F.coalesce(F.expr("(length(s) - length(replace(s, token, ''))) DIV length(token)"), F.lit(0))
    share = lambda c: F.round(F.sum(F.least("w", c)) / F.sum("w"), 6)
    return j.groupBy("doc_id").agg(share(F.col("h")).alias("strict"), share(F.greatest(F.col("h"), found)).alias("effective"))


@query(f"WITH {_BLOCKS} SELECT block_type, count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS n_docs FROM blocks GROUP BY ALL")
def tag_counts(spark, d):
    return _blocks(spark, d).groupBy("block_type").agg(_n(), F.countDistinct("doc_id").alias("n_docs"))


@query(f"""WITH {_LABELLED} SELECT doc_id, count(*)::BIGINT AS n_annotations, count(*) FILTER (WHERE label = 'Section Header')::BIGINT AS n_headings,
    count(*) FILTER (WHERE label <> 'Section Header' AND size > 12)::BIGINT AS n_roots, sum(len(block_text))::BIGINT AS n_letters FROM lab GROUP BY doc_id""")
def export_metrics(spark, d):
    return _labelled(spark, d).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_annotations"), F.count_if(F.col("label") == "Section Header").alias("n_headings"),
        F.count_if((F.col("label") != "Section Header") & (F.col("size") > 12)).alias("n_roots"), F.sum(F.length("block_text")).alias("n_letters"),
    )


@query(f"WITH {_TOKENS}, a AS (SELECT doc_id, count(*) AS n FROM pt GROUP BY doc_id), h AS (SELECT doc_id, count(*) AS m FROM held GROUP BY doc_id) SELECT doc_id, n::BIGINT AS n_tokens, round(coalesce(m, 0) / n, 6) AS coverage FROM a LEFT JOIN h USING (doc_id)")
def token_coverage(spark, d):
    def made(lines, b, w):
        of, n = np.unique(w["of"], return_counts=True)
        held = np.bincount(w["of"][LO.of_words(w, lines[2], b)[0]], minlength=of[-1] + 1 if len(of) else 0)
        return of, n, held[of]

    lost = _lost_words(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tokens"), F.lit(0).cast("long").alias("m"))
    every = _of_statements(spark, d, made, "n_tokens long, m long").union(lost)
    return every.select("doc_id", "n_tokens", M.ratio(F.col("m"), F.col("n_tokens")).alias("coverage"))


@query(f"""WITH {_BLOCKS}, {S.STATEMENT_WORDS.split(S.STATEMENTS, 1)[1].lstrip(',')}, a AS (SELECT s.doc_id, bl.block_idx, sum((x1 - x0) * s.size) AS covered FROM swords s JOIN bl ON s.doc_id = bl.doc_id AND s.line_no = bl.line_no GROUP BY ALL)
    SELECT k.doc_id, k.block_idx, round(covered / ((r - l) * (b - t)), 6) AS tightness, covered / ((r - l) * (b - t)) < 0.5 AS loose FROM blocks k JOIN a USING (doc_id, block_idx)""")
def bbox_tightness(spark, d):
    """Share of a block's box that its words fill."""
    def made(lines, b, w):
        area, n = LO.covered(w, *lines, len(b["of"]))
        some = np.flatnonzero(n)
        return b["of"][some], b["idx"][some], area[some], *(b[c][some] for c in ("left", "top", "right", "bottom"))

    blocks = _of_statements(spark, d, made, "block_idx long, covered double, left double, top double, right double, bottom double")
    t = F.col("covered") / ((F.col("right") - F.col("left")) * (F.col("bottom") - F.col("top")))
    return blocks.select("doc_id", "block_idx", F.round(t, 6).alias("tightness"), (t < 0.5).alias("loose"))


@query("""WITH p AS (SELECT doc_id, regexp_matches(coalesce(text, ''), '!!|%%%|###|\\| ') AS bad FROM documents), j AS (SELECT quality, CASE WHEN bad THEN 0 ELSE 1 END AS guess FROM labels JOIN p USING (doc_id)),
    c AS (SELECT k AS label, count(*) FILTER (WHERE quality = k AND guess = k) AS tp, count(*) FILTER (WHERE quality <> k AND guess = k) AS fp, count(*) FILTER (WHERE quality = k AND guess <> k) AS fn FROM j, (VALUES (0), (1)) v(k) GROUP BY k)
    SELECT label, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 6) AS f1 FROM c""")
def label_f1(spark, d):
    """A rule's labels against the given ones, each label against the rest."""
    guess = F.when(F.coalesce("text", F.lit("")).rlike(r"!!|%%%|###|\| "), 0).otherwise(1)
    rows = lift.read(spark, d, "labels").join(lift.read(spark, d, "documents").select("doc_id", guess.alias("guess")), "doc_id")
    rows = rows.select("quality", "guess", F.explode(F.array(F.lit(0), F.lit(1))).alias("label"))
    hit = lambda a, b: F.count_if(((F.col("quality") == F.col("label")) == a) & ((F.col("guess") == F.col("label")) == b))
    c = rows.groupBy("label").agg(hit(True, True).alias("tp"), hit(False, True).alias("fp"), hit(True, False).alias("fn"))
    return c.withColumn("f1", M.f1(F.col("tp"), F.col("fp"), F.col("fn")))


_GOLD = "gold AS (SELECT doc_id, k AS gold_id, 72.0 + k * 150 AS gt, 72.0 + (k + 1) * 150 AS gb FROM (SELECT DISTINCT o_orderkey AS doc_id FROM orders) CROSS JOIN range(5) r(k))"


@query(f"""WITH {_BLOCKS}, {_GOLD}, o AS (SELECT b.doc_id, block_idx, gold_id, greatest(0, least(b, gb) - greatest(t, gt)) / (b - t) AS s FROM blocks b JOIN gold USING (doc_id))
    SELECT doc_id, block_idx, arg_max(gold_id, (s, -gold_id))::BIGINT AS gold_id, round(max(s), 6) AS score FROM o GROUP BY ALL HAVING max(s) >= 0.5""")
def overlap_assign(spark, d):
    """Each block goes to the region that covers most of it, half of it at least."""
    gold = lift.read(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id")).distinct().select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    gold = gold.select("doc_id", F.col("k").cast("long").alias("gold_id"), (72.0 + F.col("k") * 150).alias("gt"), (72.0 + (F.col("k") + 1) * 150).alias("gb"))
    s = F.greatest(F.lit(0.0), F.least("bottom", "gb") - F.greatest("top", "gt")) / (F.col("bottom") - F.col("top"))
    best = _blocks(spark, d).join(gold, "doc_id").withColumn("s", s).groupBy("doc_id", "block_idx").agg(F.max_by("gold_id", F.struct("s", -F.col("gold_id"))).alias("gold_id"), F.max("s").alias("s"))
    return best.filter("s >= 0.5").select("doc_id", "block_idx", "gold_id", F.round("s", 6).alias("score"))


@query("""WITH t AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS ws FROM benchmark), k AS (SELECT item_id, ws, unnest(ws) AS w FROM t),
    p AS (SELECT a.item_id AS a, b.item_id AS b, count(*) AS i, any_value(len(a.ws)) AS n, any_value(len(b.ws)) AS m FROM k a JOIN k b ON a.w = b.w AND a.item_id < b.item_id GROUP BY ALL)
    SELECT a, b, round(i / (n + m - i), 6) AS jaccard FROM p WHERE i / (n + m - i) >= 0.2""")
def jaccard_pairs(spark, d):
    """Benchmark items that share a fifth of their words and more."""
    items = lift.read(spark, d, "benchmark").select("item_id", F.array_distinct(M.tokens(F.col("text"))).alias("ws"))
    pairs = M.similar_sets(items, Fraction(1, 5))
    return pairs.select("a", "b", F.round(F.col("shared") / (F.col("n") + F.col("m") - F.col("shared")), 6).alias("jaccard"))


@query(f"""WITH {_BLOCKS}, o AS (SELECT doc_id, block_idx, row_number() OVER (PARTITION BY doc_id ORDER BY t DESC, l, block_idx) AS g FROM blocks), n AS (SELECT *, lead(g) OVER (PARTITION BY doc_id ORDER BY block_idx) AS ng FROM o)
    SELECT doc_id, round(avg((ng > g)::INT), 6) AS agreement FROM n WHERE ng IS NOT NULL GROUP BY doc_id""")
def reading_order_agreement(spark, d):
    """Neighbours that another order (from the foot of the page up) has the same way round."""
    g = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("top"), "left", "block_idx"))
    rows = _blocks(spark, d).select("doc_id", "block_idx", g.alias("g")).withColumn("ng", F.lead("g").over(Window.partitionBy("doc_id").orderBy("block_idx")))
    return rows.filter("ng IS NOT NULL").groupBy("doc_id").agg(F.round(F.avg((F.col("ng") > F.col("g")).cast("int")), 6).alias("agreement"))


_CLUSTERS = f"""{_UNITS}, cl AS (SELECT doc_id, line_no, unit_id AS p, CASE WHEN line_no < 4 THEN 0 WHEN line_no < 90 THEN 1 ELSE 2 END AS g FROM units)"""


def _clusters(spark, d):
    gold = F.when(F.col("line_no") < 4, 0).when(F.col("line_no") < 90, 1).otherwise(2)
    return _units(spark, d).select("doc_id", "line_no", F.col("unit_id").alias("p"), gold.alias("g"))




@query(f"""WITH {_CLUSTERS}, b AS (SELECT doc_id, sum(n * (n - 1) // 2) AS shared FROM (SELECT doc_id, p, g, count(*) AS n FROM cl GROUP BY ALL) GROUP BY doc_id),
    p AS (SELECT doc_id, sum(n * (n - 1) // 2) AS pp FROM (SELECT doc_id, p, count(*) AS n FROM cl GROUP BY ALL) GROUP BY doc_id), g AS (SELECT doc_id, sum(n * (n - 1) // 2) AS gg FROM (SELECT doc_id, g, count(*) AS n FROM cl GROUP BY ALL) GROUP BY doc_id)
    SELECT doc_id, shared::BIGINT AS shared, pp::BIGINT AS pairs, gg::BIGINT AS gold_pairs, round(CASE WHEN pp + gg > 0 THEN 2 * shared / (pp + gg) ELSE 0.0 END, 6) AS f1 FROM b JOIN p USING (doc_id) JOIN g USING (doc_id)""")
def pairwise_f1(spark, d):
    """Pairs of lines in one unit on both sides, counted from group sizes rather than pair by pair."""
    c = _clusters(spark, d)

    def pairs(keys, name):
        n = c.groupBy("doc_id", *keys).agg(F.count(F.lit(1)).alias("n"))
        return n.groupBy("doc_id").agg(F.sum(F.expr("n * (n - 1) DIV 2")).alias(name))

    out = pairs(["p", "g"], "shared").join(pairs(["p"], "pairs"), "doc_id").join(pairs(["g"], "gold_pairs"), "doc_id")
    return out.withColumn("f1", M.ratio(2 * F.col("shared"), F.col("pairs") + F.col("gold_pairs")))


@query(f"""WITH {_CLUSTERS}, i AS (SELECT doc_id, p, g, count(*) AS n FROM cl GROUP BY ALL), ps AS (SELECT doc_id, p, count(*) AS a FROM cl GROUP BY ALL), gs AS (SELECT doc_id, g, count(*) AS b FROM cl GROUP BY ALL)
    SELECT doc_id, g::INT AS g, round(max(n / (a + b - n)), 6) AS iou FROM i JOIN ps USING (doc_id, p) JOIN gs USING (doc_id, g) GROUP BY doc_id, g""")
def unit_iou(spark, d):
    c = _clusters(spark, d)
    i = c.groupBy("doc_id", "p", "g").agg(F.count(F.lit(1)).alias("n"))
    a, b = c.groupBy("doc_id", "p").agg(F.count(F.lit(1)).alias("a")), c.groupBy("doc_id", "g").agg(F.count(F.lit(1)).alias("b"))
    return i.join(a, ["doc_id", "p"]).join(b, ["doc_id", "g"]).groupBy("doc_id", "g").agg(F.round(F.max(F.col("n") / (F.col("a") + F.col("b") - F.col("n"))), 6).alias("iou"))


@query(f"""WITH {_CLUSTERS}, f AS (SELECT doc_id, g, count(DISTINCT p) AS n FROM cl GROUP BY ALL), m AS (SELECT doc_id, p, count(DISTINCT g) AS n FROM cl GROUP BY ALL), a AS (SELECT doc_id, avg((n > 1)::INT) AS x FROM f GROUP BY doc_id), b AS (SELECT doc_id, avg((n > 1)::INT) AS y FROM m GROUP BY doc_id)
    SELECT doc_id, round(x, 6) AS fragmented, round(y, 6) AS merged FROM a JOIN b USING (doc_id)""")
def fragmentation_merge(spark, d):
    c = _clusters(spark, d)
    share = lambda key, other, name: c.groupBy("doc_id", key).agg(F.countDistinct(other).alias("n")).groupBy("doc_id").agg(F.round(F.avg((F.col("n") > 1).cast("int")), 6).alias(name))
    return share("g", "p", "fragmented").join(share("p", "g", "merged"), "doc_id")


_MASKS = f"""{S.FEATURES}, mk AS (SELECT doc_id, line_no, delimiter::INT AS ref, (n_words < 12)::INT AS hyp FROM features),
    mn AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n, sum(ref) OVER (PARTITION BY doc_id) AS ones,
        sum(ref) OVER o AS cr, sum(hyp) OVER o AS ch FROM mk WINDOW o AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
    kk AS (SELECT *, greatest(1, CASE WHEN ones > 0 THEN round_even(n / (2 * ones), 0) ELSE floor(n / 2) END)::BIGINT AS k FROM mn),
    ws AS (SELECT a.doc_id, a.k, b.cr - a.cr + a.ref AS r, b.ch - a.ch + a.hyp AS h FROM kk a JOIN kk b ON a.doc_id = b.doc_id AND b.i = a.i + a.k - 1 WHERE a.i + a.k <= a.n)"""


def _scores(spark, d):
    masks = _features(spark, d).select("doc_id", "line_no", F.col("delimiter").cast("long").alias("ref"), (F.col("n_words") < 12).cast("long").alias("hyp"))
    return M.window_scores(masks, "doc_id", "line_no")


@query(f"WITH {_MASKS} SELECT doc_id, k, round(avg(((r > 0) <> (h > 0))::INT), 6) AS pk FROM ws GROUP BY doc_id, k")
def pk_score(spark, d):
    return _scores(spark, d).select("doc_id", "k", "pk")


@query(f"WITH {_MASKS} SELECT doc_id, k, round(avg((r <> h)::INT), 6) AS windowdiff FROM ws GROUP BY doc_id, k")
def windowdiff_score(spark, d):
    return _scores(spark, d).select("doc_id", "k", "windowdiff")


@query(f"""WITH {S.FEATURES}, x AS (SELECT source, lang, line_type FROM features JOIN documents USING (doc_id))
    SELECT lang, source, count(*)::BIGINT AS n_lines, round(avg((line_type = 'para')::INT), 6) AS para_share FROM x GROUP BY ROLLUP (lang, source)""")
def metrics_rollup(spark, d):
    lines = _features(spark, d).join(lift.read(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id")
    return lines.rollup("lang", "source").agg(F.count(F.lit(1)).alias("n_lines"), F.round(F.avg((F.col("line_type") == "para").cast("int")), 6).alias("para_share"))


@query(f"""WITH {_NODES} SELECT depth, count(*)::BIGINT AS n, count(*) FILTER (WHERE parent IS NULL)::BIGINT AS n_roots, count(DISTINCT doc_id)::BIGINT AS n_docs FROM tree GROUP BY depth""")
def diagnostics(spark, d):
    """Nodes, roots and documents at each depth of the trees."""
    tree = H.with_depth_and_root(_nodes(spark, d))
    return tree.groupBy("depth").agg(_n(), F.count_if(F.col("parent").isNull()).alias("n_roots"), F.countDistinct("doc_id").alias("n_docs"))


@query("""WITH b AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS w FROM benchmark), d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'))) AS w FROM documents),
    n AS (SELECT item_id, count(*) AS n FROM b GROUP BY ALL), m AS (SELECT item_id, doc_id, count(*) AS i FROM b JOIN d USING (w) GROUP BY ALL)
    SELECT item_id, doc_id, round(i / n, 6) AS recall FROM m JOIN n USING (item_id) WHERE i = n""")
def benchmark_recall(spark, d):
    """Documents that hold every word of a benchmark item."""
    words = lambda table, key: lift.read(spark, d, table).select(key, F.array_distinct(M.tokens(F.coalesce("text", F.lit("")))).alias("ws"))
    return M.holding_all(words("benchmark", "item_id"), words("documents", "doc_id")).select("item_id", "doc_id", F.lit(1.0).alias("recall"))
