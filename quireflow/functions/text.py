"""Scalar functions over text, numbers and boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviations behind which a sentence goes on.
ABBREVIATIONS = ("Mr", "Mrs", "Ms", "Dr", "Prof", "No", "Nos", "Inc", "Ltd", "Co", "Corp", "vs", "Sec", "Art", "Fig", "Jan", "Feb", "Mar", "Apr", "Jun", "Jul", "Aug", "Sep", "Sept", "Oct", "Nov", "Dec", "St", "Jr", "Sr", "approx", "etc")
# Accented letters and their plain forms.
ACCENTED = "áàâäãåāăąçćčďđéèêëēėęěğíìîïīįłñńňóòôöõøōőŕřśšşťţúùûüūůűųýÿžźżÁÀÂÄÃÅÇĆČĎÉÈÊËĚÍÌÎÏŁÑŃŇÓÒÔÖÕØŘŚŠŤÚÙÛÜŮÝŽŹŻ"
PLAIN = "aaaaaaaaacccddeeeeeeeegiiiiiilnnnoooooooorrsssttuuuuuuuuyyzzzAAAAAACCCDEEEEEIIIILNNNOOOOOORSSTUUUUUYZZZ"
ROMAN = (("I", 1), ("V", 5), ("X", 10), ("L", 50), ("C", 100), ("D", 500), ("M", 1000))
MARK, HOLD = "\x01", "\x02"


def sentences(text: Column) -> Column:
    """Sentences of a text: line by line, after . ! or ? with closing quotes and blanks, but not behind an abbreviation."""
    t = F.regexp_replace(text, rf"\b({'|'.join(ABBREVIATIONS)})\. ", "$1." + HOLD)
    t = F.regexp_replace(t, "([.!?][\"”’)]*) +", "$1" + MARK)
    t = F.replace(F.replace(t, F.lit(HOLD), F.lit(" ")), F.lit("\n"), F.lit(MARK))
    return F.filter(F.transform(F.split(t, MARK), lambda s: F.trim(s)), lambda s: s != "")


def ascii_fold(text: Column) -> Column:
    """Accents off, then whatever is still not ASCII out."""
    return F.regexp_replace(F.translate(text, ACCENTED, PLAIN), r"[^\x00-\x7F]", "")


def normalized(text: Column) -> Column:
    """Quotes and dashes of one kind, control characters out, lower case of ASCII letters, single blanks."""
    t = F.translate(text, "“”„«»‘’‚–—−\t\n\r", "\"\"\"\"\"'''---   ")
    t = F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[\x00-\x1F\x7F]", ""), " +", " "))


def fixed_case(word: Column) -> Column:
    """A word of mixed case: upper where most of it is, else lower with its first letter as it was."""
    n_upper = F.length(F.regexp_replace(word, "[^A-Z]", ""))
    n_lower = F.length(F.regexp_replace(word, "[^a-z]", ""))
    inner = F.substring(word, F.lit(2), F.length(word)).rlike("[A-Z]")
    return F.when(~inner | (n_lower == 0), word).when(n_upper > n_lower, F.upper(word)).otherwise(F.concat(F.substring(word, 1, 1), F.lower(F.substring(word, F.lit(2), F.length(word)))))


def roman_value(word: Column) -> Column:
    """Value of a roman numeral in either case: a smaller digit before a larger one counts against it."""
    digits = F.transform(F.filter(F.split(F.upper(word), ""), lambda c: c != ""), lambda c: _roman_digit(c))
    signed = F.transform(digits, lambda v, i: F.when(v < F.coalesce(F.get(digits, i + 1), F.lit(0)), -v).otherwise(v))
    return F.aggregate(signed, F.lit(0).cast("long"), lambda a, v: a + v)


def _roman_digit(c: Column) -> Column:
    out = F.lit(0).cast("long")
    for letter, value in ROMAN:
        out = F.when(c == letter, F.lit(value).cast("long")).otherwise(out)
    return out


def list_ordinal(item: Column) -> Column:
    """Number of a list item: dotted parts in base 1000, letters by the sum of their code points."""
    parts = F.split(F.regexp_replace(item, r"[()]|\.$", ""), r"\.")
    digits = F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 1000 + F.coalesce(F.try_to_number(p, F.lit("999")).cast("long"), F.lit(0).cast("long")))
    letters = F.aggregate(F.filter(F.split(F.regexp_replace(item, "[^A-Za-z]", ""), ""), lambda c: c != ""), F.lit(0).cast("long"), lambda a, c: a + F.ascii(c))
    return F.when(item.rlike("[0-9]"), digits).otherwise(letters)


def section_number(text: Column) -> Column:
    """Outline number at the start of a text, or an empty string."""
    return F.regexp_extract(text, r"^\(?([0-9]+(?:\.[0-9]+)*)[.)]?\s", 1)


def enum_level(text: Column) -> Column:
    """Depth of a text's enumerator: ARTICLE or SECTION 1, romans 3, letters 2, numbers 1 and one more a dot; null for none."""
    first = F.element_at(F.split(text, " "), 1)
    core = F.regexp_replace(F.regexp_replace(first, r"[.)]$", ""), r"^\(", "")
    body = F.size(F.split(F.trim(text), " +")) > 1
    dots = F.length(core) - F.length(F.replace(core, F.lit("."), F.lit("")))
    return (
        F.when(text.rlike(r"^(?:ARTICLE|SECTION)\s+(?:[IVXLC]+|[0-9]+)\b"), 1)
        .when(~body | F.lower(first).isin("i", "a"), None)
        .when(core.rlike("^[ixvIXV]{1,6}$"), 3)
        .when(core.rlike("^[a-zA-Z]$") & first.rlike(r"[.)]$") | core.rlike("^[a-zA-Z][0-9]$"), 2)
        .when(core.rlike(r"^[0-9]{1,2}(?:\.[0-9]{1,2})*$") & (first.rlike(r"[.)]$") | (dots > 0)), 1 + dots)
    ).cast("long")


def html_escaped(text: Column) -> Column:
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        t = F.replace(t, F.lit(char), F.lit(entity))
    return t


def l2_normalized(vector: Column) -> Column:
    """The vector by its length; a zero vector stays."""
    v = F.transform(vector, lambda x: x.cast("double"))
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: x / F.when(length > 0, length).otherwise(1.0))


def rounded(x: Column, places: int) -> Column:
    """To so many places, halves away from zero in binary as DuckDB does it; what rounds to zero keeps its sign, which F.round drops."""
    y = x * 10.0**places
    r = F.rint(y)  # halves to even
    away = F.when((y > 0) & (y - r == 0.5), r + 1).when((y < 0) & (y - r == -0.5), r - 1).otherwise(r)
    return away / 10.0**places


def joined(left: Column, right: Column) -> Column:
    """Two pieces of text with a blank between, except behind an opening and before a closing mark."""
    tight = left.rlike(r"[(\[{“]$") | right.rlike(r"^[)\]}”,.;]")
    return F.concat(left, F.when(tight, "").otherwise(" "), right)


def font_family(name: Column) -> Column:
    """Font name without its subset tag, commas as hyphens."""
    return F.replace(F.regexp_replace(name, r"^[A-Z]{6}\+", ""), F.lit(","), F.lit("-"))


def font_style(name: Column) -> Column:
    return F.when(F.lower(name).rlike("italic|oblique"), "italic").otherwise("normal")


def font_weight(name: Column, weight: Column) -> Column:
    """Numeric weight from the named one, or from the family's name."""
    named = F.when(weight == "bold", 600).when(weight == "bolder", 900).when(weight == "lighter", 200).otherwise(F.coalesce(weight.try_cast("int"), F.lit(400)))
    return F.when(F.lower(name).rlike(r"bold|black|\.b$"), F.greatest(named, F.lit(600))).otherwise(named)


def overlap(l0: Column, r0: Column, l1: Column, r1: Column, by_least: bool = True) -> Column:
    """Shared part of two intervals, as a share of the shorter (or longer) one."""
    width = (F.least if by_least else F.greatest)(r0 - l0, r1 - l1)
    return F.when(width <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(r0, r1) - F.greatest(l0, l1)) / width)


def style_values(style: Column) -> Column:
    """A style string's declarations as a map."""
    return F.str_to_map(F.regexp_replace(style, r"\s*([:;])\s*", "$1"), F.lit(";"), F.lit(":"))


def points(value: Column) -> Column:
    """A length such as 12.5px as a number."""
    return F.regexp_extract(value, r"^(-?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
