"""What a line is: header, list item, table row or paragraph, and the features that tell."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import constants as K
from . import words as W
from .features import FEATURES, of_texts


def enumerator(word: Column) -> tuple[Column, Column]:
    """A first word's enumerator without brackets and end mark (null where it cannot be one), and whether it has an end mark."""
    core = F.regexp_replace(F.regexp_replace(word, r"[.)]$", ""), r"^\(", "")
    core = F.regexp_replace(core, r"\)\(.*$", "")
    barred = (word.startswith("(") & ~word.endswith(")")) | word.rlike("[%$,]$") | F.lower(word).isin("i", "a")
    return F.when(~barred, core), word.rlike(r"[.)]$")


def numbered_kind(word: Column) -> Column:
    """roman, letter or integer for a word that numbers its line, else null."""
    core, ended = enumerator(word)
    dotted = core.contains(".")
    return (
        F.when(core.rlike(K.ENUM_ROMAN), "roman")
        .when(core.rlike(K.ENUM_LETTER) & ended | core.rlike(K.ENUM_LETTER_DIGIT), "letter")
        .when(core.rlike(K.ENUM_DIGITS) & (ended | dotted), "integer")
    )


def ends_with_delimiter(text: Column) -> Column:
    return text.rlike(K.DELIMITER) & ~text.rlike(K.NOT_DELIMITER)


def may_be_header(text: Column) -> Column:
    """False only for lines that are no header, told by few steps: most lines of prose need no features then.

    A header begins with a per cent sign or a number, or is numbered, or begins with a capital and has fewer than ten
    effective words, more than nine tenths of them titles: so few words of small letters that are no stop words, and
    for nearly each of them a capital letter. It has two commas only behind "section".
    """
    t = F.trim(text)
    first = W.cleaned(F.call_function("substring_index", t, F.lit(" "), F.lit(1)), F.lit(0))
    small = F.size(F.filter(F.split(t, " "), lambda w: ~w.isin(*K.STOP_WORDS) & w.rlike(K.ALL_LOWER)))
    capitals = F.length(t) - F.length(F.regexp_replace(t, K.UPPER, ""))
    few_commas = (F.length(t) - F.length(F.replace(t, F.lit(","), F.lit(""))) <= 1) | F.lower(t).startswith("section")
    titles = t.rlike(r"^\p{Lu}") & few_commas & (small < 10) & (capitals >= 0.9 * small)
    return t.startswith("%") | t.rlike("^[0-9]") | numbered_kind(first).isNotNull() | titles


def with_features(df: DataFrame, text: str = "text", only=tuple(FEATURES)) -> DataFrame:
    """df with each line's features, or some of them, among them `line_type`. Lines without a token are left out."""
    typed = ", ".join(f"{c} {FEATURES[c]}" for c in only)

    def found(texts: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(c) for c in of_texts(texts, only).values()], names=list(only))

    # not deterministic for the plan: a filter on a feature would else be worked out for itself, before all others
    features = F.arrow_udf(found, f"struct<{typed}>").asNondeterministic()
    rows = df.filter(F.trim(text) != "").withColumn("_f", features(text))
    return rows.select(*[c for c in df.columns if c not in only], *[F.col("_f")[c].alias(c) for c in only])
