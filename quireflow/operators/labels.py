"""Labels of blocks: headings that are prose, references or furniture are none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .filters import is_furniture

# Most words and tokens of a heading; most blocks of a cover
HEADER_WORDS, HEADER_TOKENS, COVER_BLOCKS = 12, 20, 12
LABELS = {"header": "Section Header", "list_item": "List Item", "table_row": "Table Row", "para": "Paragraph"}
CROSS_REFERENCE = r"(?i)^section\s+[0-9]+(?:\.[0-9]+)*\s+(?:of|to|and)\b"
PROSE = r"(?i)^(?:whereas|now,? therefore)\b"
PROSE_END = r"(?:[,;]|\b(?:for|and|nor|but|or|yet|so))$"


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, " +"), lambda t: t != "")).cast("long")


def is_prose_header(text: Column) -> Column:
    """Recital opener, comma or conjunction at the end, lower-case start, or a sentence of five words and more."""
    sentence = text.endswith(".") & (n_words(text) >= 5) & text.rlike(r"\s\p{Ll}{4,}")
    return text.rlike(PROSE) | text.rlike(PROSE_END) | text.rlike(r"^[^\p{L}]*\p{Ll}") | sentence


def is_cross_reference(text: Column) -> Column:
    return text.rlike(CROSS_REFERENCE)


def resolved(block_type: Column, text: Column) -> Column:
    demoted = (n_words(text) > HEADER_WORDS) | is_furniture(text) | is_prose_header(text) | is_cross_reference(text)
    out = F.when((block_type == "header") & demoted, LABELS["para"])
    for kind, label in LABELS.items():
        out = out.when(block_type == kind, label)
    return out.otherwise(LABELS["para"])


def is_centred(left: Column, right: Column, width: float) -> Column:
    """Middle within a hundredth of the page's, and narrower than 60 % of it."""
    return (F.abs((left + right) / 2 - width / 2) <= 0.01 * width) & (right - left < 0.6 * width)
