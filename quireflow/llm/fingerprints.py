"""Winnowed document fingerprints, with DataFrame functions only.

A text is a sequence of short tokens: at most four characters of a word each, with the white space behind them. A gram
is four tokens in a row. Of every window of eight gram hashes the smallest is chosen, the rightmost where there are
ties, and its position is kept. Whatever two texts share over 11 tokens (eight grams) holds a whole window and so a
common fingerprint. A text with fewer grams is one window, one with fewer tokens one gram; a text of fewer than 16
tokens also has its single tokens in its fingerprint, since few grams outlive an edit there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty

TOKEN = r"[^\x20\x09-\x0D]{1,4}[\x20\x09-\x0D]*|[\x20\x09-\x0D]+"
GRAM, WINDOW, SHORT = 4, 8, 16
#: Rows that one slice of the id order is meant to hold, and the most slices.
SLICE_ROWS = 512
MOST_SLICES = 1 << 16


def _gram_hashes(tokens: Column) -> Column:
    at = F.sequence(F.lit(0), F.greatest(F.size(tokens) - GRAM, F.lit(0)))
    hashes = F.transform(at, lambda i: F.hash(*[F.get(tokens, i + j) for j in range(GRAM)]))
    return F.when(F.size(tokens) == 0, F.array().cast("array<int>")).otherwise(hashes)


def _winnowed(hashes: Column) -> Column:
    """Positions whose hash is the rightmost smallest of some window.

    Such a hash has in a row before it hashes at least as large and behind it larger ones, together with it at least
    as many as a window holds.
    """

    def run(i: Column, step: int, larger) -> Column:
        h = F.get(hashes, i)
        out = F.when(~larger(F.get(hashes, i + step), h), 0)
        for j in range(2, WINDOW):
            out = out.when(~larger(F.get(hashes, i + j * step), h), j - 1)
        return out.otherwise(WINDOW - 1)

    before = lambda i: run(i, -1, lambda x, h: F.coalesce(x >= h, F.lit(False)))
    behind = lambda i: run(i, 1, lambda x, h: F.coalesce(x > h, F.lit(False)))
    reach = F.least(F.lit(WINDOW), F.size(hashes))
    chosen = F.filter(F.sequence(F.lit(0), F.size(hashes) - 1), lambda i: before(i) + behind(i) + 1 >= reach)
    return F.when(F.size(hashes) == 0, F.array().cast("array<int>")).otherwise(chosen)


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with `name` (chosen hashes in order) and `name`_at (their gram positions) for the text in column `text`."""
    df = df.withColumn("_t", F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0)))
    df = df.withColumn("_h", _gram_hashes(F.col("_t"))).withColumn(f"{name}_at", _winnowed(F.col("_h")))
    grams = F.transform(f"{name}_at", lambda i: F.get(F.col("_h"), i))
    singles = F.when(F.size("_t") < SHORT, F.transform("_t", lambda t: F.hash(t))).otherwise(F.array().cast("array<int>"))
    return df.withColumn(name, F.concat(grams, singles)).drop("_t", "_h")


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two fingerprints' hash sets; two empty ones are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def as_string(fingerprint: str) -> Column:
    return F.array_join(F.transform(fingerprint, lambda h: F.lpad(F.hex(h.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def _slice(cuts: list[int]) -> Column:
    """How many cuts are below doc_id: first by groups of cuts, then within the group, so a row meets some 2 * sqrt(cuts) of them."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    groups = F.array(*[F.array(*map(F.lit, cuts[k : k + step])) for k in range(0, len(cuts), step)])
    below = lambda splits: F.size(F.filter(splits, lambda s: s < F.col("doc_id")))
    last = below(F.array(*[F.lit(cuts[min(k + step, len(cuts)) - 1]) for k in range(0, len(cuts), step)]))
    inside = F.coalesce(F.get(groups, last), F.array().cast("array<bigint>"))
    return F.when(last * step >= len(cuts), len(cuts)).otherwise(last * step + below(inside))


def with_next(docs: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, fp, fp_at, next_text, next_fp: each row beside the next by descending id (after the last: the first).

    The ids are cut at their approximate quantiles into slices of a few hundred rows, and a slice's rows are sorted
    together; its last row takes the first of the next slice. The driver sees a split and an id for each slice, at
    most MOST_SLICES. Null ids come last, rows with the same id by text.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    n = max(1, min(MOST_SLICES, -(-docs.count() // SLICE_ROWS)))
    cuts = rows.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)] or [0.5], 10 * n + 1000)).first()[0] if n > 1 else None
    slice_ = F.when(F.col("doc_id").isNull(), -1).otherwise(_slice(sorted(set(cuts or []))))
    rows = rows.withColumn("slice", slice_)
    heads = sorted(rows.groupBy("slice").agg(F.max("doc_id").alias("doc_id")).collect(), reverse=True, key=lambda r: r[0])

    spark = docs.sparkSession
    order = [(heads[(k + 1) % len(heads)], heads[k][0]) for k in range(len(heads))]
    firsts = spark.createDataFrame([(h[1], before) for h, before in order], "doc_id long, slice int")
    firsts = with_fingerprint(_first_texts(rows, firsts), "edge_text", "edge_fp").drop("edge_fp_at")

    by_id = [F.col("slice"), F.col("doc_id").desc_nulls_last(), F.col("text")]
    dealt = with_fingerprint(rows.repartition("slice").sortWithinPartitions(*by_id), "text", "fp")
    w = Window.partitionBy("slice").orderBy(*by_id[1:])
    beside = dealt.withColumn("_text", F.lead("text").over(w)).withColumn("_fp", F.lead("fp").over(w))
    joined = beside.join(firsts, "slice", "left")
    return joined.select("doc_id", "text", "fp", "fp_at", F.coalesce("_text", "edge_text").alias("next_text"), F.coalesce("_fp", "edge_fp").alias("next_fp"))


def _first_texts(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """slice, edge_text: the first text of the slice that follows each slice; firsts has its id, bound in number."""
    wanted = firsts.withColumnsRenamed({"doc_id": "first_id", "slice": "before"})
    found = rows.select("doc_id", "text").join(F.broadcast(wanted), F.col("doc_id").eqNullSafe(F.col("first_id")))
    return found.groupBy(F.col("before").alias("slice")).agg(F.min("text").alias("edge_text"))


def fingerprint_pairs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, positions.

    The edited text has its last third (rounded down, in code points) replaced by as many from the start of the next
    document, or all of that where it is shorter. Null texts are empty; an empty table gives an empty result.
    """
    if docs.isEmpty():
        empty = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, positions array<int>"
        return docs.sparkSession.createDataFrame([], empty)
    both = with_next(docs, id_col=id_col, text_col=text_col).withColumn("n_chars", F.length("text").cast("long"))
    keep = (F.col("n_chars") - F.floor(F.col("n_chars") / 3)).cast("int")
    third = F.floor(F.col("n_chars") / 3).cast("int")
    both = both.withColumn("edited", F.concat(F.substring("text", F.lit(1), keep), F.substring("next_text", F.lit(1), third)))
    both = with_fingerprint(both, "edited", "edited_fp")
    return both.select(
        F.col("doc_id").alias(id_col),
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_string("fp").alias("fingerprint"),
        as_string("edited_fp").alias("edited_fingerprint"),
        likeness("fp", "edited_fp").alias("near_edited"),
        likeness("fp", "next_fp").alias("near_next"),
        F.col("fp_at").alias("positions"),
    )
