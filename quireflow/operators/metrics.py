"""How well a result matches another: recall, F1, segmentation, coverage, order."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def multiset_recall(want: DataFrame, have: DataFrame, by: list) -> DataFrame:
    """by, n_want, n_have, n_both: tokens of either side counted, shared ones as often as on the side with fewer."""
    a = want.groupBy(*by, "token").agg(F.count(F.lit(1)).alias("w"))
    b = have.groupBy(*by, "token").agg(F.count(F.lit(1)).alias("h"))
    both = a.join(b, [*by, "token"], "full").select(*by, F.coalesce("w", F.lit(0)).alias("w"), F.coalesce("h", F.lit(0)).alias("h"))
    return both.groupBy(*by).agg(F.sum("w").alias("n_want"), F.sum("h").alias("n_have"), F.sum(F.least("w", "h")).alias("n_both"))


def ratio(a: Column, b: Column, digits: int = 6) -> Column:
    return F.round(F.when(b > 0, a / b).otherwise(0.0), digits)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn)


def with_commonness(words: DataFrame, counted: DataFrame) -> DataFrame:
    """words (id, w) with n_rows: in how many rows of counted (w) a word is; none gives 0."""
    return words.join(counted.groupBy("w").agg(F.count(F.lit(1)).alias("n_rows")), "w", "left").fillna(0, ["n_rows"])


def holding_all(items: DataFrame, texts: DataFrame) -> DataFrame:
    """item_id, doc_id where the words ws of a text hold all words ws of an item (item_id, ws; doc_id, ws; both sets).

    Only the texts that hold the item's rarest word are looked at, so common words join nothing.
    """
    item_words, text_words = items.select("item_id", F.explode("ws").alias("w")), texts.select("doc_id", F.explode("ws").alias("w"))
    counted = text_words.join(item_words.select("w").distinct(), "w", "left_semi")
    rarest = with_commonness(item_words, counted).groupBy("item_id").agg(F.min(F.struct("n_rows", "w")).alias("r"))
    met = rarest.filter("r.n_rows > 0").select("item_id", F.col("r.w").alias("w")).join(text_words, "w").select("item_id", "doc_id")
    both = met.join(items.select("item_id", F.col("ws").alias("wanted")), "item_id").join(texts, "doc_id")
    return both.filter(F.size(F.array_except("wanted", "ws")) == 0).select("item_id", "doc_id")


def similar_sets(items: DataFrame, share: Fraction) -> DataFrame:
    """a, b, shared, n, m of all pairs of items (item_id, ws; sets) with shared >= share * union, a < b.

    With words from rare to common, two such sets share one of the first n - ceil(share * n) + 1 words of either; the
    sizes differ by the share at most. So the commonest words of a set join nothing.
    """
    p, q = share.numerator, share.denominator
    words = items.select("item_id", F.size("ws").alias("n"), F.explode("ws").alias("w"))
    ranked = with_commonness(words, words).groupBy("item_id", "n").agg(F.array_sort(F.collect_list(F.struct("n_rows", "w"))).alias("ranked"))
    first = ranked.select("item_id", "n", F.explode(F.slice("ranked", F.lit(1), F.expr(f"n - (n * {p} + {q - 1}) DIV {q} + 1").cast("int"))["w"]).alias("w"))
    x, y = first.alias("x"), first.alias("y")
    sizes = (F.col("x.n") * q >= F.col("y.n") * p) & (F.col("y.n") * q >= F.col("x.n") * p)
    met = x.join(y, (F.col("x.w") == F.col("y.w")) & (F.col("x.item_id") < F.col("y.item_id")) & sizes)
    met = met.select(F.col("x.item_id").alias("a"), F.col("y.item_id").alias("b")).distinct()
    sides = met.join(items.select(F.col("item_id").alias("a"), F.col("ws").alias("_x")), "a").join(items.select(F.col("item_id").alias("b"), F.col("ws").alias("_y")), "b")
    pairs = sides.select("a", "b", F.size(F.array_intersect("_x", "_y")).alias("shared"), F.size("_x").alias("n"), F.size("_y").alias("m"))
    return pairs.filter(F.col("shared") * q >= (F.col("n") + F.col("m") - F.col("shared")) * p)


def window_scores(masks: DataFrame, by: str, order: str) -> DataFrame:
    """by, k, pk, windowdiff of boundary flags ref and hyp, over windows of k rows.

    k is half the mean segment of ref, at least 1; pk is the share of windows in which one side has a boundary and the
    other none, windowdiff that in which their numbers differ. Counts within a window are differences of running sums.
    """
    w = Window.partitionBy(by).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    n, ones = F.count(F.lit(1)).over(Window.partitionBy(by)), F.sum("ref").over(Window.partitionBy(by))
    k = F.greatest(F.lit(1), F.when(ones > 0, F.bround(n / (2 * ones))).otherwise(F.floor(n / 2))).cast("long")
    rows = masks.select(by, (F.row_number().over(w) - 1).cast("long").alias("i"), "ref", "hyp", k.alias("k"), n.alias("n"), F.sum("ref").over(upto).alias("cr"), F.sum("hyp").over(upto).alias("ch"))
    ends = rows.select(by, F.col("i").alias("j"), F.col("cr").alias("er"), F.col("ch").alias("eh"))
    starts = rows.filter("i + k <= n").withColumn("j", F.col("i") + F.col("k") - 1).withColumn("sr", F.col("cr") - F.col("ref")).withColumn("sh", F.col("ch") - F.col("hyp"))
    both = starts.join(ends, [by, "j"]).withColumn("r", F.col("er") - F.col("sr")).withColumn("h", F.col("eh") - F.col("sh"))
    return both.groupBy(by, "k").agg(F.round(F.avg(((F.col("r") > 0) != (F.col("h") > 0)).cast("int")), 6).alias("pk"), F.round(F.avg((F.col("r") != F.col("h")).cast("int")), 6).alias("windowdiff"))
