"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame functions only.

Each source's documents are shuffled by a seeded hash and laid end to end, then cut into blocks of equal token
counts. Slot i of the mix takes the golden-ratio point frac((i + 1) * phi) through the cumulative target shares to a
source, so every stretch of the schedule holds the sources in proportion; the slot's rank within its source names
the block it takes, beginning again when the source has been used up. The mix is its first N slots, N being the blocks
that the targets come to: the schedule decides how many blocks a source gives, within a few of its target, and where.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, one_of_each, row_hash, shielded, text_or_empty

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_REPEATS = 2
BLOCK_TOKENS = 128
SEED = "mix-1"
GOLDEN = 0.6180339887498949
#: Slots behind which the points' products begin again, so that they keep their precision however many slots there are.
STRIDE = 1 << 20
CELLS = 4096
BUCKETS = 1024
SLOTS_IN_CHUNK = 4096


def source_targets(sizes: DataFrame, *, weights=WEIGHTS, share: float = SHARE, repeats: int = MOST_REPEATS) -> DataFrame:
    """source, source_size -> these and src (0, 1, ... by code point, null last) and target.

    The sources share `share` times all sizes by weight; a target stops at `repeats` times its source's size and the
    rest is shared again. In order of cap / weight the capped sources come first, so one pass of running sums finds
    the level at which the others stand. The table has a row per source and is the only one handled in one task.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("src") % len(weights) + 1).cast("int")).cast("double")
    ranked = sizes.withColumn("src", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(repeats)))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "src")
    every = Window.partitionBy(F.lit(0))
    left = F.sum("source_size").over(every) * F.lit(share) - (F.sum("cap").over(by_cap) - F.col("cap"))
    rest = F.sum("weight").over(every) - (F.sum("weight").over(by_cap) - F.col("weight"))
    levels = ranked.withColumn("left", left).withColumn("rest", rest)
    open_ = F.col("left") * F.col("weight") < F.col("cap") * F.col("rest")
    first = F.min(F.when(open_, F.struct(F.col("cap") / F.col("weight"), F.col("src"), F.col("left"), F.col("rest")))).over(every)
    levels = levels.withColumn("at", first)
    target = F.when(open_, F.col("weight") * F.col("at.left") / F.col("at.rest")).otherwise(F.col("cap"))
    return levels.select("source", "source_size", "src", target.alias("target"))


def _point(slot):
    """frac((slot + 1) * GOLDEN), from the stride that the slot is in and its place there."""
    frac = lambda x: x - F.floor(x)
    step = STRIDE * GOLDEN % 1
    return frac(frac(F.floor(slot / STRIDE) * F.lit(step)) + frac((slot % STRIDE + 1) * F.lit(GOLDEN)))


def schedule(plan: DataFrame, n_slots: int) -> DataFrame:
    """slot, src, rank: the first n_slots slots of the mix and their ranks within their source.

    plan has src and slots, in whole numbers, with n_slots as their sum; a source's interval is that wide. A slot's
    point falls into one of some equal cells and meets only the sources whose interval touches that cell, so the range
    lookup is an equi-join on evenly used keys; there are more cells than sources. Ranks are counted by chunks of
    slots: counts of a chunk are summed up per source, then slots are numbered within their chunk.
    """
    spark = plan.sparkSession
    used = plan.filter("slots > 0").select("src", "slots")
    n_cells = max(CELLS, 4 * used.count())
    upto = F.sum("slots").over(Window.orderBy("src"))
    shares = used.withColumn("hi", upto).withColumn("lo", F.col("hi") - F.col("slots"))
    cell = lambda x: F.floor(x / n_slots * n_cells)
    cells = shares.select("src", "lo", "hi", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi") - 1))).alias("cell"))
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), F.floor(_point(F.col("id")) * n_slots).alias("x"))
    slots = slots.withColumn("cell", cell(F.col("x"))).join(cells, "cell").filter("x >= lo AND x < hi")
    slots = slots.select("slot", "src", F.floor(F.col("slot") / SLOTS_IN_CHUNK).alias("chunk"))
    counts = slots.groupBy("src", "chunk").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("before", F.sum("n").over(Window.partitionBy("src").orderBy("chunk")) - F.col("n"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("src", "chunk").orderBy("slot")) - 1
    return slots.join(counts, ["src", "chunk"]).select("slot", "src", rank.alias("rank"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, repeats: int = MOST_REPEATS, block_tokens: int = BLOCK_TOKENS, seed: str = SEED, with_hash: bool = False) -> DataFrame:
    """One row per row of docs: id_col, size, source_size, target, taken, src, first_slot.

    first_slot is the place in the mix at which the document first comes, null where it is not taken. Sizes are words; a
    null or empty text has none and is not taken. A null source is a source of its own. Order within a source is by the
    md5 of seed and id, then id, then row, so reruns agree. Repeated ids are separate rows. Very long texts are counted
    where they are read; only their sizes travel. with_hash adds the row hash over all columns, and slots: the places at
    which the document comes for the first, second, ... time.
    """
    words = F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"))
    h1, h2 = row_hash(docs) if with_hash else (F.xxhash64(text_or_empty(text_col)), F.lit(0).cast("long"))
    narrow = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), words.alias("size"), key.alias("_key"), h1.alias("_h1"), h2.alias("_h2"), F.monotonically_increasing_id().alias("_row"))
    narrow = cut(narrow.withColumn("_bucket", F.floor(F.conv(F.substring("_key", 1, 4), 16, 10).cast("long") * BUCKETS / 65536)))

    buckets = narrow.groupBy("source", "_bucket").agg(F.sum("size").alias("n"))
    plan = source_targets(buckets.groupBy("source").agg(F.sum("n").alias("source_size")), weights=weights, share=share, repeats=repeats)
    plan = plan.withColumn("blocks", F.ceil(F.col("source_size") / block_tokens))
    due = F.when(F.col("source_size") > 0, F.floor(F.col("target") * F.col("blocks") / F.col("source_size") + 0.5)).otherwise(0)
    plan = cut(plan.withColumn("slots", due.cast("long")))
    n_slots = plan.agg(F.sum("slots")).first()[0] or 0

    starts = buckets.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("_bucket")) - F.col("n"))
    starts = starts.withColumnRenamed("source", "s").join(plan, F.col("s").eqNullSafe(F.col("source"))).select("source", "_bucket", "before", "src", "source_size", "target")
    starts = starts.withColumnsRenamed({"source": "s", "_bucket": "b"})
    laid = narrow.join(starts, F.col("s").eqNullSafe(F.col("source")) & (F.col("b") == F.col("_bucket")))
    inside = Window.partitionBy("src", "_bucket").orderBy("_key", "_id", "_h1", "_h2", "_row")
    laid = laid.withColumn("at", F.col("before") + F.sum("size").over(inside) - F.col("size"))
    span = F.when(F.col("size") > 0, F.sequence(F.expr(f"at DIV {block_tokens}"), F.expr(f"(at + size - 1) DIV {block_tokens}")))
    carried = ["_row", "_h1", "_h2", "_id", "size", "source_size", "target", "src"]
    pieces = laid.select(*carried, "at", F.explode_outer(span).alias("block"))

    takes = schedule(plan, int(n_slots)).join(plan.select("src", "blocks"), "src").filter(F.col("rank") < repeats * F.col("blocks"))
    takes = takes.groupBy("src", F.expr("rank % blocks").alias("block")).agg(F.sort_array(F.collect_list("slot")).alias("slots"))
    lo = F.greatest(F.col("at"), F.col("block") * block_tokens)
    hi = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block_tokens)
    got = F.coalesce(F.size("slots"), F.lit(0)) * (hi - lo)
    joined = pieces.join(takes, ["src", "block"], "left").withColumn("got", F.when(F.col("slots").isNull() | F.col("block").isNull(), 0).otherwise(got))
    out = joined.groupBy(*carried).agg(F.coalesce(F.sum("got"), F.lit(0)).cast("long").alias("taken"), F.min_by("slots", "block").alias("slots"))
    columns = [F.col("_id").alias(id_col), "size", "source_size", "target", "taken", F.col("src").cast("long").alias("src"), F.get("slots", F.lit(0)).alias("first_slot")]
    return out.select(*columns, *(["_h1", "_h2", "slots"] if with_hash else []))


def mixed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself, with the columns of docs, in the order of its slots: a document comes once for each time that it is taken.

    Partitions are consecutive stretches of the mix. Where a source's last block ends inside a document, its first words
    come as a row of their own, with n_chars set anew where docs has that column. Documents that are not taken are left
    out. Rows are found again by a hash over all of them; those that are equal in all columns take what each is due.
    """
    plain, restored = shielded(docs, text_col, "n_chars")
    place = {c: plain.columns[docs.columns.index(c)] for c in (id_col, text_col, source_col)}
    taken = mix(plain, id_col=place[id_col], text_col=text_col, source_col=place[source_col], with_hash=True, **how).filter("taken > 0")
    due = cut(taken.groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_n"), F.collect_list(F.struct("size", "taken", "slots")).alias("_due")))
    h1, h2 = row_hash(plain)
    rows = one_of_each(plain.withColumns({"_h1": h1, "_h2": h2}), cut(due.filter("_n > 1").select("_h1", "_h2")))
    rows = rows.join(due, ["_h1", "_h2"]).withColumn("_each", F.explode("_due"))
    times = F.sequence(F.lit(0), (F.ceil(F.col("_each.taken") / F.col("_each.size")) - 1).cast("int"))
    rows = rows.withColumn("_part", F.explode(times)).withColumn("_slot", F.get("_each.slots", F.col("_part")))
    size, left = F.col("_each.size"), F.col("_each.taken") - F.col("_part") * F.col("_each.size")
    cut_off = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), 1, F.least(size, left).cast("int")), "")
    rows = rows.withColumn("_cut", left < size).withColumn(text_col, F.when(F.col("_cut"), cut_off).otherwise(F.col(text_col)))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("_cut"), F.length(text_col)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return restored(rows.repartitionByRange("_slot").sortWithinPartitions("_slot", "_h1", "_part"))
