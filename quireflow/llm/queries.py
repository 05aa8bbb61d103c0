"""The queries of this subpackage, by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact_dedup, fingerprints, html_text, licenses, mixing, near_dedup, packing, quality, ranking, spelling, suffix_dedup, warc
from .common import LOWER, UPPER, table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_pairs(table(spark, sf_dir, "documents"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).drop("n_chunks")


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.find_repeats(table(spark, sf_dir, "documents")))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_bpe_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(bpe.decoded(bpe.encoded(table(spark, sf_dir, "documents"))))


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_html_extraction,
        op3_quality_classifier,
        op4_document_fingerprints,
        op5_source_mixing,
        op6_best_fit_packing,
        op7_exact_dedup,
        op8_minhash_near_dedup,
        op9_warc_bundles,
        op10_suffix_dedup,
        op11_spelling_variants,
        op12_ranked_search,
        op13_bpe_coding,
    )
}

_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORDS = r"[^\x20\x09-\x0D]+"

ORACLE_SQL = {
    "op1_license_scan": licenses.oracle_sql(),
    "op5_source_mixing": rf"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORDS}'))::BIGINT AS size,
                          md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS k FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS w FROM d GROUP BY source),
        r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src, w * 2.0::DOUBLE AS cap FROM s),
        q AS (SELECT *, ([3, 1, 2])[src % 3 + 1]::DOUBLE AS g FROM r),
        l AS (SELECT *, (SELECT sum(w) FROM q) * 1.5::DOUBLE - (sum(cap) OVER o - cap) AS lf,
                     (SELECT sum(g) FROM q) - (sum(g) OVER o - g) AS rs FROM q WINDOW o AS (ORDER BY cap / g, src)),
        f AS (SELECT lf, rs FROM l WHERE lf * g < cap * rs ORDER BY cap / g, src LIMIT 1),
        t AS (SELECT source, src, w, CASE WHEN lf * g < cap * rs THEN g * (SELECT lf FROM f) / (SELECT rs FROM f) ELSE cap END AS target FROM l),
        b AS (SELECT *, (w + {mixing.BLOCK_TOKENS - 1}) // {mixing.BLOCK_TOKENS} AS blocks FROM t),
        u AS (SELECT *, (CASE WHEN w > 0 THEN floor(target * blocks / w + 0.5::DOUBLE) ELSE 0 END)::BIGINT AS slots FROM b),
        v AS (SELECT *, sum(slots) OVER (ORDER BY src) AS hi, sum(slots) OVER () AS n FROM u),
        i AS (SELECT unnest(range((SELECT max(n) FROM v)::BIGINT)) AS slot),
        y AS (SELECT slot, floor(slot / {mixing.STRIDE}.0::DOUBLE) * {mixing.STRIDE * mixing.GOLDEN % 1!r}::DOUBLE AS a, (slot % {mixing.STRIDE} + 1) * {mixing.GOLDEN!r}::DOUBLE AS c FROM i),
        z AS (SELECT slot, (a - floor(a)) + (c - floor(c)) AS x FROM y),
        k AS (SELECT slot, floor((x - floor(x)) * (SELECT max(n) FROM v)) AS x FROM z),
        m AS (SELECT k.slot, v.src, v.blocks, row_number() OVER (PARTITION BY v.src ORDER BY k.slot) - 1 AS rank FROM k JOIN v ON k.x >= v.hi - v.slots AND k.x < v.hi),
        e AS (SELECT src, least(count(*), max(blocks) * {mixing.MOST_REPEATS}) AS got FROM m GROUP BY src),
        p AS (SELECT d.doc_id, d.size, t.src, t.w, t.target, t.blocks, coalesce(e.got, 0) AS got,
                     (sum(d.size) OVER (PARTITION BY t.src ORDER BY k, d.doc_id) - d.size)::BIGINT AS a
              FROM d JOIN u t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN e ON e.src = t.src)
        SELECT p.doc_id, p.size, p.w AS source_size, p.target, p.src::BIGINT AS src, m.slot AS first_slot,
               (CASE WHEN p.w = 0 THEN 0 ELSE (got // p.blocks) * size + greatest(0, least(size, (got % p.blocks) * {mixing.BLOCK_TOKENS} - a)) END)::BIGINT AS taken
        FROM p LEFT JOIN m ON p.size > 0 AND m.src = p.src AND m.rank = p.a // {mixing.BLOCK_TOKENS} AND m.rank < p.got
    """,
    "op7_exact_dedup": f"""
        WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
        g AS (SELECT *, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n)
        SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
    """,
    "op8_minhash_near_dedup": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_WORDS}') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                  ELSE list_transform(range(len(ws) - 4), lambda i: array_to_string(ws[i + 1:i + 5], ' ')) END) AS x FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
        r AS (SELECT a AS id, a AS m FROM l UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.id WHERE r.m < l.b),
        c AS (SELECT id, min(m) AS m FROM r GROUP BY id)
        SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.m, w.doc_id) AS component_id, coalesce(c.m, w.doc_id) = w.doc_id AS kept
        FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.id = w.doc_id
    """,
    "op9_warc_bundles": """
        WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, url, sha1(h) AS x, strlen(h)::BIGINT AS payload_bytes, min(page_id) OVER (PARTITION BY h) AS first FROM p)
        SELECT page_id, url, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, payload_bytes,
               list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                 ((('0x' || substr(x, (i * 5 // 4 + 1)::BIGINT, 2))::INT >> (3 - i * 5 % 4)::INT) & 31) + 1, 1)), 'string_agg', '') AS payload_digest,
               CASE WHEN page_id <> first THEN first END AS refers_to FROM d
    """,
    "op11_spelling_variants": f"""
        WITH RECURSIVE r AS (SELECT run, coalesce(doc_id::VARCHAR, '') || ':' || run AS named, count(*) AS n FROM (
            SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{UPPER}', '{LOWER}') AS run FROM documents) WHERE length(run) >= 7 GROUP BY ALL),
        h AS (SELECT run, n, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(strlen(named)), lambda i: list_concat([('0x' || substr(hex(named), 2 * i + 1, 2))::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1])))),
                 lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)) AS h FROM r),
        o AS (SELECT n AS times, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h),
        w AS (SELECT word, sum(times)::BIGINT AS n FROM o WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
        v AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS x FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
        p AS (SELECT a.word AS a, b.word AS b, b.n FROM v a JOIN v b ON a.x = b.x AND a.i = b.i AND a.word <> b.word
              UNION SELECT v.word, w.word, w.n FROM v JOIN w ON w.word = v.x UNION SELECT w.word, v.word, v.n FROM v JOIN w ON w.word = v.x),
        c AS (SELECT *, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS k FROM p),
        f AS (SELECT w.word, w.n, coalesce(c.n_near, 0) AS n_near, CASE WHEN c.n >= 10 * w.n THEN c.b END AS form, CASE WHEN c.n >= 10 * w.n THEN c.n END AS form_n FROM w LEFT JOIN c ON c.a = w.word AND c.k = 1),
        t AS (SELECT word, word AS root FROM f WHERE form IS NULL UNION ALL SELECT f.word, t.root FROM t JOIN f ON f.form = t.word)
        SELECT f.word, form, root, n, n_near, form_n FROM f JOIN t USING (word)
    """,
    "op12_ranked_search": rf"""
        WITH d AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '{_TERMS}')), '{UPPER}', '{LOWER}') AS term FROM documents),
        z AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
        c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM z),
        i AS (SELECT DISTINCT item_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '{_TERMS}')), '{UPPER}', '{LOWER}') AS term FROM benchmark),
        tf AS (SELECT doc_id, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM i) GROUP BY ALL),
        w AS (SELECT term, floor(1000 * ln((2 * (SELECT docs FROM c) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf GROUP BY term),
        m AS (SELECT doc_id, 50 + (50 * n * docs) // terms AS m FROM z, c),
        s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM i JOIN tf USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL),
        r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {ranking.BEST}
    """,
}
