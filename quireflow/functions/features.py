"""The features of many lines at once, as arrays.

What a token is gets worked out once for all tokens that are alike, what a line is once for all lines that are alike;
patterns that need a whole line are tried on those lines alone whose first or last token lets them match.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import constants as K

#: Name and type of each feature.
FEATURES = (
    dict.fromkeys("n_words n_title n_alpha n_stop n_number n_dollar n_percent n_date n_dollar_sign".split(), "bigint")
    | {"kind": "string"}
    | dict.fromkeys("period delimiter last_number last_date last_stop bullet state numbered".split(), "boolean")
    | {"eff_words": "bigint", "title_ratio": "double"}
    | dict.fromkeys("zip_or_po structure continuing header".split(), "boolean")
    | {"n_values": "bigint", "table_row": "boolean", "list_item": "boolean", "line_type": "string", "prose": "boolean"}
)
#: Bytes of text that are taken apart together.
PIECE = 2_000_000

_KINDS = pa.array([None, "roman", "letter", "integer"], pa.string())
_TYPES = pa.array(["table_row", "header", "list_item", "para"])


def _np(a) -> np.ndarray:
    return a.to_numpy(zero_copy_only=False)


def _like(a: pa.Array, pattern: str) -> np.ndarray:
    return _np(pc.match_substring_regex(a, pattern))


def _has(a: pa.Array, text: str) -> np.ndarray:
    return _np(pc.match_substring(a, text))


def _among(a: pa.Array, values) -> np.ndarray:
    return _np(pc.is_in(a, pa.array(list(values))))


def _begins(a: pa.Array, text: str) -> np.ndarray:
    return _np(pc.starts_with(a, text))


def _ends(a: pa.Array, text: str) -> np.ndarray:
    return _np(pc.ends_with(a, text))


def _where(mask: np.ndarray, a: pa.Array, test) -> np.ndarray:
    """test() of those of a that the mask keeps, false for others."""
    out, some = np.zeros(len(mask), bool), np.flatnonzero(mask)
    if len(some):
        out[some] = test(a.take(pa.array(some)))
    return out


def _replaced(a: pa.Array, pattern: str, by: str = "") -> pa.Array:
    return pc.replace_substring_regex(a, pattern, by)


def _either(mask: np.ndarray, a: pa.Array, b: pa.Array) -> pa.Array:
    return pc.if_else(pa.array(mask), a, b)


def _chopped(a: pa.Array) -> pa.Array:
    return pc.utf8_slice_codeunits(a, 0, -1)


def _signless(a: pa.Array) -> pa.Array:
    return _replaced(_replaced(pc.utf8_lower(a), r"^\((.*)\)$", r"\1"), "^-")


def _counted(a: pa.Array) -> np.ndarray:
    """Which of some tokens are numbers and no years."""
    w = _signless(a)
    w = _either(_begins(w, "$"), pc.utf8_slice_codeunits(w, 1), _replaced(w, r"[$%]$"))
    w = pc.replace_substring(_replaced(w, r"^\((.*)\)$", r"\1"), ",", "")
    found = _like(w, K.NUMBER)
    some = np.flatnonzero(found & ~_has(a, ","))
    n = np.array([float(x) for x in w.take(pa.array(some)).to_pylist()])
    found[some[(n >= 999.5) & (n < 9999.5)]] = False
    return found


def _word_facts(w: pa.Array) -> dict[str, np.ndarray]:
    low = pc.utf8_lower(w)
    upper = _like(w, K.UPPER) & ~_like(w, K.LOWER)
    digit, money, share = _like(w, "[0-9]"), _has(w, "$"), _has(w, "%")
    dashed = digit & _like(w, "[/-]")
    return {
        "title": _like(w, K.TITLE) | upper,
        "alpha": _like(w, K.ALPHA),
        "stop": _among(low, K.STOP_WORDS),
        "stop_last": _among(low, K.STOP_WORDS) & (_np(pc.utf8_length(w)) > 1) & ~upper,
        "number": _where(digit, w, _counted),
        "dollar": _where(money, w, lambda a: _like(_signless(a), r"^\$|\$$")),
        "percent": _where(share, w, lambda a: _ends(s := _signless(a), "%") & ~_begins(s, "$")),
        "date": _where(dashed, low, lambda a: _like(pc.replace_substring(a, "/", "-"), K.DATE)),
        "page": _begins(low, "page"),
    }


def _kinds(w: pa.Array) -> np.ndarray:
    """The place in _KINDS of words that may number their line."""
    core = _replaced(_replaced(_replaced(w, r"[.)]$"), r"^\("), r"\)\(.*$")
    barred = (_begins(w, "(") & ~_ends(w, ")")) | _like(w, "[%$,]$") | _among(pc.utf8_lower(w), ("i", "a"))
    ended = _like(w, r"[.)]$")
    roman = _like(core, K.ENUM_ROMAN)
    letter = (_like(core, K.ENUM_LETTER) & ended) | _like(core, K.ENUM_LETTER_DIGIT)
    integer = _like(core, K.ENUM_DIGITS) & (ended | _has(core, "."))
    return np.select([barred, roman, letter, integer], [0, 1, 2, 3], 0)


def _of_piece(texts: pa.Array) -> dict[str, np.ndarray]:
    """FEATURES of lines that differ, kind and line_type as places."""
    lists = pc.split_pattern(texts, " ")
    flat, n = lists.flatten(), np.diff(lists.offsets.to_numpy())
    line = np.repeat(np.arange(len(texts)), n)
    if pc.any(pc.equal(flat, "")).as_py():
        some = np.flatnonzero(_np(pc.not_equal(flat, "")))
        flat, line = flat.take(pa.array(some)), line[some]
        n = np.bincount(line, minlength=len(texts))
    coded = flat.dictionary_encode()
    token, t = _np(coded.indices), coded.dictionary
    starts = np.cumsum(n) - n
    ends = starts + n - 1
    at = np.arange(len(token)) - np.repeat(starts, n)
    is_first = at == 0
    firsts, lasts = token[starts], token[ends]

    # tokens without their last mark: the first of a line loses a colon alone
    wrapped = _like(t, rf"^[^{K.PUNCT}“].*[{K.PUNCT}”]$")
    chopped = _chopped(t)
    words = pa.concat_arrays([_either(wrapped, chopped, t), _either(wrapped & _ends(t, ":"), chopped, t)]).dictionary_encode()
    word = _np(words.indices)[token + np.where(is_first, len(t), 0)]
    w = words.dictionary
    facts = _word_facts(w)

    total = lambda values: np.add.reduceat(values.astype(np.int64), starts)
    some_of = lambda flags: np.logical_or.reduceat(flags[token], starts)
    f = {f"n_{c}": total(facts[c][word]) for c in ("title", "alpha", "number", "dollar", "percent", "date")}
    f["n_words"] = n.astype(np.int64)
    colon = np.minimum.reduceat(np.where(_has(t, ":")[token], at, 1 << 30), starts)
    f["n_stop"] = total(facts["stop"][word] & (at < np.repeat(colon, n)))
    f["n_dollar_sign"] = total(_np(pc.equal(t, "$"))[token])
    first_words, back = np.unique(word[starts], return_inverse=True)
    f["kind"] = _kinds(w.take(pa.array(first_words)))[back]
    f["numbered"] = numbered = f["kind"] > 0
    f["period"] = period = (_ends(t, ".") & ~_among(t, K.HONORIFICS))[lasts]
    f["delimiter"] = delimiter = _where(_like(t, "[.;:\"“‘’”']$")[lasts], texts, lambda a: _like(a, K.DELIMITER) & ~_like(a, K.NOT_DELIMITER))
    lastw = word[ends]
    f["last_number"] = (facts["number"] | facts["dollar"] | facts["percent"])[lastw]
    f["last_date"] = facts["date"][lastw]
    f["last_stop"] = facts["stop_last"][lastw]
    f["bullet"] = _among(pc.utf8_slice_codeunits(t, 0, 1), K.BULLETS)[firsts]
    n_commas = _np(pc.count_substring(t, ","))
    f["state"] = _where(some_of(n_commas > 0), texts, lambda a: _like(a, rf"(?i), *(?:{'|'.join(K.STATES)})[{K.PUNCT}]?(?: |$)"))
    f["eff_words"] = f["n_alpha"] - f["n_stop"]
    f["title_ratio"] = np.where(f["eff_words"] > 0, f["n_title"] / np.maximum(f["eff_words"], 1), 1.0)

    low = pc.utf8_lower(t)
    titles = (f["title_ratio"] > 0.9) & (f["eff_words"] < 10)
    zipped = (n < 7) & f["state"] & _like(t, "^[0-9]{5}$|^[0-9]{5}-[0-9]{4}$")[lasts] & ~period
    f["zip_or_po"] = zipped | ((n == 3) & f["last_number"] & _among(low, ("po", "p.o", "p.o."))[firsts])
    all_upper = some_of(_like(t, K.UPPER)) & ~some_of(_like(t, K.LOWER))
    f["structure"] = structure = ((_among(low, K.HEADER_LEADS)[firsts] | titles) & (f["n_number"] == 1)) | numbered | all_upper
    f["continuing"] = ~numbered & _like(t, r"^\p{Ll}|^[" + "".join("\\" + c for c in K.CONTINUING) + "]")[firsts]
    open_end = _like(t, rf"[{K.PUNCT}“]$") & ~_like(t, r"[:?.)\]%]$")
    plain = (
        ~(period & ~(structure & (f["title_ratio"] > 0.9)) & delimiter)
        & ~f["bullet"]
        & ~_begins(t, K.FOOTNOTE)[firsts]
        & titles
        & ~(_among(low, K.UNITS)[lasts] | (f["last_number"] & ~structure))
        & ((f["n_number"] == 0) | (structure & (f["n_number"] <= 1)))
        & ~f["continuing"]
        & ~(f["last_date"] & ~structure)
        & _like(w, r"^\p{Lu}")[word[starts]]
        & ~f["last_stop"]
        & ~f["zip_or_po"]
        & ~(open_end[lasts] & delimiter)
        & ~some_of(_has(t, "://"))
        & ~(np.logical_or.reduceat(facts["page"][word], starts) & (f["n_number"] == 1))
        & (_begins(low, "section")[firsts] | (total(n_commas[token]) <= 1))
    )
    second = (n > 1) & _like(w, r"^[0-9]+$|^\p{Lu}")[word[np.minimum(starts + 1, ends)]]
    ordinal = _where(_like(t, r"^[0-9]+\.")[firsts], texts, lambda a: _like(a, r"^[0-9]+\.\s+(?:[0-9]+|[A-Z])"))
    sure = _begins(t, "%")[firsts] | ordinal | (numbered & second)
    f["header"] = header = sure | (~(_like(t, "^[0-9]+$")[lasts] & (n < 5)) & plain)
    dashes = np.zeros(len(texts), np.int64)
    some = np.flatnonzero(some_of(_np(pc.equal(t, "-"))))
    dashes[some] = _np(pc.count_substring(texts.take(pa.array(some)), " - "))
    f["n_values"] = f["n_number"] + f["n_dollar"] + f["n_percent"] + dashes
    ratio = (f["n_values"] + f["n_title"] + f["n_date"]) / np.maximum(n - f["n_dollar_sign"], 1)
    row = ((f["n_values"] > 0) | (f["n_date"] > 0)) & (ratio > 0.7) & ~period & ~f["zip_or_po"] & ~f["last_stop"]
    f["table_row"] = ~header & (row | some_of(_has(t, "....")))
    f["list_item"] = f["bullet"] & ~_like(t, r"[:?.)\]%$]$")[firsts]
    f["line_type"] = np.select([f["table_row"], header, f["list_item"] | numbered], [0, 1, 2], 3)
    bare = _replaced(t, r"^[.,;:()\[\]\"']+")
    letters = np.where(_like(bare, r"^\p{Ll}"), 2, np.where(_like(bare, r"^\p{L}"), 1, 0))[token]
    place = np.minimum.reduceat(np.where(letters > 0, np.arange(len(token)), len(token)), starts)
    lower_first = np.append(letters, 0)[place] == 2
    calls = _where((_begins(low, "whereas") | _begins(low, "now"))[firsts], texts, lambda a: _like(pc.utf8_lower(a), r"^(?:whereas|now,? therefore)\b"))
    separate = header | f["table_row"] | f["list_item"] | f["zip_or_po"]
    f["prose"] = (_ends(t, ",") | _among(t, K.CONJUNCTIONS))[lasts] | (f["continuing"] & ~separate) | lower_first | calls
    return f


def of_texts(texts: pa.Array, only=tuple(FEATURES)) -> dict[str, pa.Array | np.ndarray]:
    """Features of lines, each of which has a token: kind and line_type as Arrow strings, others as NumPy arrays."""
    coded = pc.ascii_trim(texts, " ").dictionary_encode()
    alike, every = _np(coded.indices), coded.dictionary
    sizes = np.cumsum(_np(pc.binary_length(every)))
    cuts = [0, *(np.flatnonzero(np.diff(sizes // PIECE)) + 1).tolist(), len(every)]
    parts = [_of_piece(every.slice(a, b - a)) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
    if not parts:
        return {c: pa.array([], pa.string()) if FEATURES[c] == "string" else np.empty(0, {"bigint": np.int64, "double": float, "boolean": bool}[FEATURES[c]]) for c in only}
    out = {c: np.concatenate([p[c] for p in parts])[alike] if len(parts) > 1 else parts[0][c][alike] for c in only}
    return out | {c: names.take(pa.array(out[c])) for c, names in (("kind", _KINDS), ("line_type", _TYPES)) if c in out}
