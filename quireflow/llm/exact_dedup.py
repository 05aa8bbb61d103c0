"""Exact deduplication by content-defined chunk recipes, with DataFrame functions only.

A text is cut where its own content says so (after a sentence end, once a chunk has its least length), so equal
passages give equal chunks wherever they stand. Each distinct chunk travels once, to be verified: a 128-bit hash is
the chunk's identifier unless two different chunks share it, and where they do the chunk itself takes the hash's
place. Documents are then compared by their ordered lists of identifiers; the long texts stay where they were read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lower_ascii, one_of_each, row_hash, shielded, text_or_empty

LEAST, MOST = 512, 4096


def chunk_pattern(least: int = LEAST, most: int = MOST) -> str:
    """Cuts after a sentence end from `least` characters on, and at `most` where there is none; covers any text."""
    return rf"(?s).{{{least},{most - 1}}}?[.!?\n]|.{{1,{most}}}"


def _with_chunks(docs: DataFrame, text: str, least: int, most: int) -> DataFrame:
    norm = lower_ascii(text_or_empty(text))
    return docs.withColumn("_norm", norm).withColumn("_chunks", F.regexp_extract_all("_norm", F.lit(chunk_pattern(least, most)), F.lit(0)))


def _hash(chunk, bits: int):
    """Two independently seeded 64-bit hashes; fewer bits only serve to try the way past a collision."""
    parts = [F.xxhash64(F.lit(seed), chunk) for seed in (1, 2)]
    return [F.shiftrightunsigned(p, 64 - bits) for p in parts] if bits < 64 else parts


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, most: int = MOST, hash_bits: int = 64, with_hash: bool = False) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256, n_chunks.

    Texts are equal when they are identical after lower-casing A-Z. Null and empty texts are one group. The row with
    the largest id stays; null ids rank lowest, and of rows that repeat the largest id exactly one is kept. Other
    columns of docs are neither read nor returned (with_hash adds the row hash over all of them); an empty table gives
    an empty result. Texts are cut twice: to verify their chunks, and for the recipes, which are written down.
    """
    h1, h2 = row_hash(docs) if with_hash else (F.lit(0).cast("long"), F.lit(0).cast("long"))
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), h1.alias("_h1"), h2.alias("_h2"))
    chunked = _with_chunks(base, "_text", least, most)

    pair = _hash(F.col("chunk"), hash_bits)
    distinct = chunked.select(F.explode("_chunks").alias("chunk")).select(pair[0].alias("h1"), pair[1].alias("h2"), "chunk").distinct()
    shared = cut(distinct.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1", "h2"))

    lists = chunked.select(
        "_id",
        "_h1",
        "_h2",
        F.monotonically_increasing_id().alias("_row"),
        F.sha2(F.col("_norm").cast("binary"), 256).alias("text_sha256"),
        F.size("_chunks").cast("long").alias("n_chunks"),
        "_chunks",
    )
    if shared.isEmpty():
        recipe = F.flatten(F.transform("_chunks", lambda c: F.array(*_hash(c, hash_bits))))
        recipes = lists.select("_id", "_h1", "_h2", "_row", "text_sha256", "n_chunks", recipe.alias("recipe"))
    else:
        recipes = _recipes_past_collisions(cut(lists), shared, hash_bits)
    recipes = cut(recipes)

    groups = recipes.groupBy("recipe").agg(F.max(F.struct("_id", "_row")).alias("best"), F.count(F.lit(1)).alias("group_size"))
    # a join of two plain shuffles, in which a recipe that very many documents share is split
    repeated = cut(groups.filter("group_size > 1"))
    return recipes.join(repeated, "recipe", "left").select(
        F.col("_id").alias(id_col),
        F.when(F.col("best").isNull(), F.col("_id")).otherwise(F.col("best._id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("best").isNull() | (F.col("_row") == F.col("best._row"))).alias("kept"),
        "text_sha256",
        "n_chunks",
        *(["_h1", "_h2"] if with_hash else []),
    )


def drop_copies(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs that are kept, as they were. Of rows that are equal in all columns one is kept."""
    plain, restored = shielded(docs)
    names = {k: plain.columns[docs.columns.index(how.pop(k, default))] for k, default in (("id_col", "doc_id"), ("text_col", "text"))}
    groups = cut(exact_groups(plain, with_hash=True, **names, **how).filter("group_size > 1").select("kept", "_h1", "_h2"))
    of_row = groups.groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept"))
    h1, h2 = row_hash(plain)
    hashed = plain.withColumns({"_h1": h1, "_h2": h2})
    left = hashed.join(of_row.filter("NOT kept").select("_h1", "_h2"), ["_h1", "_h2"], "left_anti")
    return restored(one_of_each(left, cut(of_row.filter("kept AND n > 1").select("_h1", "_h2"))))


def _recipes_past_collisions(lists: DataFrame, shared: DataFrame, bits: int) -> DataFrame:
    """Recipes in which a chunk whose hash another chunk shares stands for itself."""
    parts = lists.select("_row", F.posexplode("_chunks").alias("pos", "chunk"))
    pair = _hash(F.col("chunk"), bits)
    parts = parts.select("_row", "pos", "chunk", pair[0].alias("h1"), pair[1].alias("h2"))
    parts = parts.join(shared.withColumn("twice", F.lit(True)), ["h1", "h2"], "left")
    name = F.when(F.col("twice"), F.concat(F.lit("="), F.col("chunk"))).otherwise(F.concat(F.hex("h1"), F.lit(":"), F.hex("h2")))
    ordered = parts.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("pos", name.alias("name")))).alias("p")).select("_row", F.col("p.name").alias("recipe"))
    heads = lists.drop("_chunks")
    return heads.join(ordered, "_row", "left").withColumn("recipe", F.coalesce("recipe", F.array().cast("array<string>")))
