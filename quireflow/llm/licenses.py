"""Licence recognition by sentences and rules, with DataFrame functions only.

A text is cut into sentences, which are normalised (comment leaders off, lower case, white space and quotes unified).
Sentences that speak of licensing are mapped to the identifiers of known licence sentences, in text order; ordered
rules then match runs of identifiers and name the licence, each taking away what it has matched, so that a long form
is found before the short forms that it contains.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, text_or_empty

_BREAK = "\x01"
# Known licence sentences in order of trial. An identifier, the pattern of the normalised sentence (no
# look-around, so that other engines read it too), and 1 where the pattern's group is appended to the identifier.
SENTENCES = (
    ("spdx:", r"spdx-license-identifier:? *([a-z0-9.+-]+)", 1),
    ("apache-header", r"licensed under the apache license,? version 2(?:\.0)?", 0),
    ("apache-file", r"you may not use this file except in compliance with the license", 0),
    ("apache-copy", r"you may obtain a copy of the license at", 0),
    ("apache-basis", r"distributed under the license is distributed on an \"?as is\"? basis", 0),
    ("apache-limits", r"see the license for the specific language governing permissions", 0),
    ("apache-version", r"apache license,? *(?:version|v)? ?2", 0),
    ("agpl-", r"gnu affero general public licen[sc]e,? (?:as published by the free software foundation[;,] either )?(?:version |v)?([0-9](?:\.[0-9])?)", 1),
    ("lgpl-", r"gnu (?:lesser|library) general public licen[sc]e,? (?:as published by the free software foundation[;,] either )?(?:version |v)?([0-9](?:\.[0-9])?)", 1),
    ("gpl-", r"gnu general public licen[sc]e,? (?:as published by the free software foundation[;,] either )?(?:version |v)?([0-9](?:\.[0-9])?)", 1),
    ("gpl-free", r"this (?:program|library|software|file|package) is free software[:;,]? you can redistribute it and/or modify it under the terms of the gnu general public licen[sc]e", 0),
    ("gpl-warranty", r"(?:this|the) (?:program|library|software|file|package) is distributed in the hope that it will be useful", 0),
    ("gpl-implied", r"without even the implied warranty of", 0),
    ("gpl-see", r"see the gnu (?:(?:affero|lesser|library) )?general public licen[sc]e for more details", 0),
    ("gpl-copy", r"you should have received a copy of the gnu (?:(?:affero|lesser|library) )?general public licen[sc]e", 0),
    ("gpl-any", r"gnu general public licen[sc]e", 0),
    ("mpl-", r"mozilla public licen[sc]e,? (?:version |v\. ?|v)?([0-9](?:\.[0-9])?)", 1),
    ("cc0", r"(?:cc0|creative commons zero)", 0),
    ("cc-by-nc-sa-", r"cc[ -]by-nc-sa[ -]?([0-9]\.[0-9])", 1),
    ("cc-by-nc-nd-", r"cc[ -]by-nc-nd[ -]?([0-9]\.[0-9])", 1),
    ("cc-by-nc-", r"cc[ -]by-nc[ -]?([0-9]\.[0-9])", 1),
    ("cc-by-sa-", r"cc[ -]by-sa[ -]?([0-9]\.[0-9])", 1),
    ("cc-by-nd-", r"cc[ -]by-nd[ -]?([0-9]\.[0-9])", 1),
    ("cc-by-", r"cc[ -]by[ -]?([0-9]\.[0-9])", 1),
    ("cc-by-nc-sa-", r"creative commons attribution[ -]non-?commercial[ -]share-?alike,? (?:version |v)?([0-9]\.[0-9])", 1),
    ("cc-by-nc-nd-", r"creative commons attribution[ -]non-?commercial[ -]no-?deriv(?:ative)?s(?: works)?,? (?:version |v)?([0-9]\.[0-9])", 1),
    ("cc-by-nc-", r"creative commons attribution[ -]non-?commercial,? (?:version |v)?([0-9]\.[0-9])", 1),
    ("cc-by-sa-", r"creative commons attribution[ -]share-?alike,? (?:version |v)?([0-9]\.[0-9])", 1),
    ("cc-by-nd-", r"creative commons attribution[ -]no-?deriv(?:ative)?s(?: works)?,? (?:version |v)?([0-9]\.[0-9])", 1),
    ("cc-by-", r"creative commons attribution,? (?:version |v)?([0-9]\.[0-9])", 1),
    ("cc-name", r"creative commons attribution", 0),
    ("mit-grant", r"permission is hereby granted,? free of charge,? to any person obtaining a copy", 0),
    ("mit-notice", r"the above copyright notice and this permission notice shall be included", 0),
    ("mit-name", r"(?:released|licensed|available|distributed|provided)?[a-z ]*under (?:the )?(?:terms of the )?mit licen[sc]e|mit licen[sc]e", 0),
    ("isc-grant", r"permission to use, copy, modify,? and/or distribute this software for any purpose with or without fee is hereby granted", 0),
    ("isc-name", r"\bisc licen[sc]e", 0),
    ("bsd-grant", r"redistribution and use in source and binary forms,? with or without modification,? are permitted", 0),
    ("bsd-source", r"redistributions? of source code must retain the above copyright notice", 0),
    ("bsd-binary", r"redistributions? in binary form must reproduce the above copyright notice", 0),
    ("bsd-endorse", r"may be used to endorse or promote products", 0),
    ("bsd-advert", r"all advertising materials mentioning features", 0),
    ("bsd-name-", r"bsd[ -]([234])[ -]clause", 1),
    ("bsd-any", r"bsd licen[sc]e|bsd-style licen[sc]e", 0),
    ("unlicense", r"this is free and unencumbered software released into the public domain", 0),
    ("public-domain", r"(?:released|placed|dedicated|is) (?:in|into|to) the public domain", 0),
    ("warranty-as-is", r"(?:software|work) is provided .{0,60}as is", 0),
    ("no-liability", r"in no event shall .*liab", 0),
    ("rights-reserved", r"all rights reserved", 0),
    ("copyright", r"copyright|\(c\) *[0-9]{4}", 0),
)
_CUE_WORDS = r"licen[sc]e|copyright|\(c\)|warrant|permission|redistribut|spdx|public domain|all rights reserved|liab(?:le|ility)|endorse"
#: What a sentence must hold to be looked at: a word of licensing, or what makes it a known sentence without such a word.
CUE = "|".join([_CUE_WORDS, *(f"(?:{p})" for _, p, _ in SENTENCES if not re.search(_CUE_WORDS, p.replace("licen[sc]e", "license")))])
# Rules in order. The licence, and the run of identifiers: | parts them, ? marks one that may be missing,
# and a pattern in parentheses is taken over into the licence's name where that ends in a hyphen or a colon.
RULES = (
    ("spdx:", ("spdx:([a-z0-9.+-]+)",)),
    ("apache-2.0", ("apache-header", "apache-file?", "apache-copy?", "apache-basis?", "apache-limits?")),
    ("apache-2.0", ("apache-version",)),
    ("mit", ("mit-name?", "mit-grant", "mit-notice?", "warranty-as-is?", "no-liability?")),
    ("bsd-4-clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-endorse?", "warranty-as-is?", "no-liability?")),
    ("bsd-3-clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "warranty-as-is?", "no-liability?")),
    ("bsd-2-clause", ("bsd-grant", "bsd-source", "bsd-binary", "warranty-as-is?", "no-liability?")),
    ("isc", ("isc-name?", "isc-grant", "warranty-as-is?", "no-liability?")),
    ("unlicense", ("unlicense", "warranty-as-is?", "no-liability?")),
    ("agpl-", ("agpl-([0-9.]+)", "gpl-warranty?", "gpl-implied?", "gpl-see?", "gpl-copy?")),
    ("lgpl-", ("lgpl-([0-9.]+)", "gpl-warranty?", "gpl-implied?", "gpl-see?", "gpl-copy?")),
    ("gpl-", ("gpl-free?", "gpl-([0-9.]+)", "gpl-warranty?", "gpl-implied?", "gpl-see?", "gpl-copy?")),
    ("gpl", ("gpl-free", "gpl-warranty?", "gpl-implied?", "gpl-see?", "gpl-copy?")),
    ("gpl", ("gpl-any",)),
    ("mpl-", ("mpl-([0-9.]+)",)),
    ("cc0-1.0", ("cc0",)),
    ("cc-by-", ("cc-by-((?:nc-)?(?:(?:sa|nd)-)?[0-9.]+)",)),
    ("cc-by", ("cc-name",)),
    ("bsd-", ("bsd-name-([0-9])",)),
    ("bsd", ("bsd-any",)),
    ("mit", ("mit-name",)),
    ("isc", ("isc-name",)),
    ("public-domain", ("public-domain",)),
    ("proprietary", ("copyright?", "rights-reserved")),
)
UNKNOWN = "unknown"


def rule_pattern(run: tuple[str, ...]) -> str:
    """A run as a pattern over identifiers that each end in |, beginning at one's start."""
    parts = []
    for name in run:
        optional, name = name.endswith("?"), name.removesuffix("?")
        name = name if "(" in name else name.replace(".", r"\.")
        parts.append(f"(?:{name}\\|)?" if optional else f"{name}\\|")
    return r"\|" + "".join(parts)


def sentences(text: Column) -> Column:
    """Normalised sentences of a text, empty ones left out.

    A sentence ends at . ! ? ; or : before white space, at an empty line, and at a line end, unless the line stops at
    a comma or a word that calls for more, or the next line goes on in lower case, indented or not. The header of a GNU
    licence does not end within its names or at the marks before "you can redistribute" and "either version".
    """
    t = F.regexp_replace(text, r"(?m)^[ \t]*(?://+|#+|\*+/?|/\*+|--+|;+|<!--|%+|>+)[ \t]*", "")
    t = F.regexp_replace(t, r"\r\n?", "\n")
    t = F.regexp_replace(t, r"(?i)(spdx-license-identifier:)[ \t]+", "$1")
    t = F.regexp_replace(t, r"(?i)(,|\b(?:the|of|a|an|under|by|to|and|or|in|with|for|on|gnu)) *\n", "$1 ")
    t = F.regexp_replace(t, r"\n[ \t]*([a-z])", " $1")
    t = F.regexp_replace(t, r"(?i)\b((?:affero|lesser|library)(?=\s+general\b)|general(?=\s+public\b)|public(?=\s+licen[sc]e\b)|free(?=\s+software\b)|software(?=\s+foundation\b))[ \t]*\n[ \t]*", "$1 ")
    t = F.regexp_replace(t, r"(?i)(\bfree software)[;:,]?[ \t\n]+(you can redistribute\b)", "$1, $2")
    t = F.regexp_replace(t, r"(?i)(\bfree software foundation)[;:,]?[ \t\n]+(either)[ \t\n]+(version\b)", "$1, $2 $3")
    t = F.regexp_replace(t, r"\n+|([.!?;:])[ \t\n]+", "$1" + _BREAK)
    t = F.regexp_replace(F.regexp_replace(lower_ascii(t), "[‘’“”\"'`]+", '"'), r"[ \t\f\x0B\x{A0}]+", " ")
    return F.filter(F.transform(F.split(t, _BREAK), lambda s: F.trim(s)), lambda s: s != "")


def identifier(sentence: Column) -> Column:
    """The identifier of a normalised sentence, UNKNOWN where it is none that is known."""
    out = None
    for name, pattern, takes in SENTENCES:
        value = F.concat(F.lit(name), F.regexp_extract(sentence, pattern, 1)) if takes else F.lit(name)
        out = F.when(sentence.rlike(pattern), value) if out is None else out.when(sentence.rlike(pattern), value)
    return out.otherwise(UNKNOWN)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, sentence_ids, licenses, n_cue_sentences, n_unknown.

    sentence_ids are the identifiers in text order, parted by |; licenses those of the rules that matched, in rule
    order and each once, parted by a comma. A text without any cue (or null) has empty ones. Each row is decided
    on its own, so nothing is shuffled and repeated rows repeat their result.
    """
    df = docs.select(F.col(id_col), text_or_empty(text_col).alias("_text"))
    cued = F.filter(sentences(F.col("_text")), lambda s: s.rlike(CUE))
    df = df.withColumn("_cued", F.when(lower_ascii(F.col("_text")).rlike(CUE), cued).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("_ids", F.transform("_cued", identifier)).drop("_text", "_cued")
    df = df.withColumn("_left", F.when(F.size("_ids") == 0, "").otherwise(F.concat(F.lit("|"), F.array_join("_ids", "|"), F.lit("|"))))
    # every rule sees what the rules before it have left
    found = []
    for k, (name, run) in enumerate(RULES):
        pattern = rule_pattern(run)
        value = F.concat(F.lit(name), F.regexp_extract("_left", pattern, 1)) if name[-1] in "-:" else F.lit(name)
        value = F.when(F.col("_left").rlike(pattern), value)
        df = df.withColumn(f"_r{k}", value).withColumn("_left", F.when(F.col(f"_r{k}").isNotNull(), F.regexp_replace("_left", pattern, "|")).otherwise(F.col("_left")))
        found.append(f"_r{k}")
    names = F.array_distinct(F.array_compact(F.array(*found)))
    return df.select(
        id_col,
        F.array_join("_ids", "|").alias("sentence_ids"),
        F.regexp_replace(F.array_join(names, ","), "spdx:", "").alias("licenses"),
        F.size("_ids").cast("long").alias("n_cue_sentences"),
        F.size(F.filter("_ids", lambda i: i == UNKNOWN)).cast("long").alias("n_unknown"),
    )


def oracle_sql(table: str = "documents") -> str:
    """The same rows in SQL, from the same sentences and rules."""
    q = lambda p: "'" + p.replace("'", "''") + "'"
    sub = lambda t, p, r: f"regexp_replace({t}, {q(p)}, {q(r)}, 'g')"
    low = lambda t: f"translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    t = sub("t", r"(?m)^[ \t]*(?://+|#+|\*+/?|/\*+|--+|;+|<!--|%+|>+)[ \t]*", "")
    t = sub(t, r"\r\n?", "\n")
    t = sub(t, r"(?i)(spdx-license-identifier:)[ \t]+", r"\1")
    t = sub(t, r"(?i)(,|\b(?:the|of|a|an|under|by|to|and|or|in|with|for|on|gnu)) *\n", r"\1 ")
    t = sub(t, r"\n([a-z])", r" \1")
    t = sub(t, r"\n+|([.!?;:])[ \t\n]+", r"\1" + _BREAK)
    t = sub(sub(low(t), "[‘’“”\"'`]+", '"'), r"[ \t\f\x0B\x{A0}]+", " ")
    cases = " ".join(f"WHEN regexp_matches(s, {q(p)}) THEN {q(n)}" + (f" || regexp_extract(s, {q(p)}, 1)" if g else "") for n, p, g in SENTENCES)
    steps, left = [], "step"
    for k, (name, run) in enumerate(RULES):
        p = q(rule_pattern(run))
        value = f"{q(name)} || regexp_extract(l, {p}, 1)" if name[-1] in "-:" else q(name)
        source = f"s{k - 1}" if k else "step"
        steps.append(f"s{k} AS (SELECT doc_id, ids, CASE WHEN regexp_matches(l, {p}) THEN regexp_replace(l, {p}, '|', 'g') ELSE l END AS l, CASE WHEN regexp_matches(l, {p}) THEN list_append(f, {value}) ELSE f END AS f FROM {source})")
        left = f"s{k}"
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM {table}),
        c AS (SELECT doc_id, CASE WHEN regexp_matches({low("t")}, {q(CUE)}) THEN
                  list_filter(list_transform(string_split({t}, '{_BREAK}'), lambda s: trim(s, ' ')), lambda s: s <> '' AND regexp_matches(s, {q(CUE)})) ELSE [] END AS c FROM d),
        i AS (SELECT doc_id, list_transform(c, lambda s: CASE {cases} ELSE '{UNKNOWN}' END) AS ids FROM c),
        step AS (SELECT doc_id, ids, CASE WHEN len(ids) = 0 THEN '' ELSE '|' || array_to_string(ids, '|') || '|' END AS l, []::VARCHAR[] AS f FROM i),
        {", ".join(steps)},
        e AS (SELECT *, list_filter(f, lambda x, k: list_position(f, x) = k) AS names FROM {left})
        SELECT doc_id, coalesce(array_to_string(ids, '|'), '') AS sentence_ids, replace(coalesce(array_to_string(names, ','), ''), 'spdx:', '') AS licenses,
               len(ids)::BIGINT AS n_cue_sentences, len(list_filter(ids, lambda x: x = '{UNKNOWN}'))::BIGINT AS n_unknown FROM e
    """
