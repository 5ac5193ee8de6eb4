"""Licence statements by known sentences and ordered rules.

A text is normalised, with its line feeds and the ends of its sentences kept, and searched for the
known licence sentences. One begins and ends with a line or a sentence, and may go on over single
line feeds, as in wrapped files; comment marks before a line don't count. What remains of a text is the sequence of their identifiers; licence rules, in order,
match parts of that sequence and use them up. Only SQL functions run here, inside each row: there
is no exchange at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_SAID = r"(this|the) (work|program|file|software|code) is (licensed|released|distributed) under the (terms of the )?"
_MAY = r"you (can|may) redistribute it and or modify it under the terms of the "
_BY = r" as published by the free software foundation either version "
_LATER = r" of the license or at your option any later version"
_CC = r"(this (work|text|document) is )?(licensed|released) under (a |the )?"
_CC_END = r" ?[0-9.]*( international| unported| generic)?( public)?( license)?"
_TAG = r"spdx-license-identifier "


def _gnu(name: str, tag: str, version: str, later: bool) -> str:
    """A GNU licence named in a sentence, in its own notice, or by tag."""
    named = version.removesuffix(r"\.0")
    if later:
        return rf"{_SAID}{name} version {named}( of the license)? or any later version|{_MAY}{name}{_BY}{named}{_LATER}|{_TAG}{tag}-{version}(\+|-or-later)"
    return rf"{_SAID}{name} version {named}(\.0)?|{_MAY}{name} version {named} as published by the free software foundation|{_TAG}{tag}-{version}(-only)?"


_GPL, _LGPL, _AGPL = "gnu general public license", "gnu lesser general public license", "gnu affero general public license"

# Fixed values. Identifier, and a pattern for whole normalised sentences: lower case, runs of other
# characters than letters, digits, dots, plus and minus as one space.
SENTENCES: tuple[tuple[str, str], ...] = (
    ("GPLver3+", _gnu(_GPL, "gpl", r"3\.0", True)),
    ("GPLver2+", _gnu(_GPL, "gpl", r"2\.0", True)),
    ("GPLver3", _gnu(_GPL, "gpl", r"3\.0", False)),
    ("GPLver2", _gnu(_GPL, "gpl", r"2\.0", False)),
    ("LGPLver3+", _gnu(_LGPL, "lgpl", r"3\.0", True)),
    ("LGPLver2.1+", _gnu(_LGPL, "lgpl", r"2\.1", True)),
    ("LGPLver3", _gnu(_LGPL, "lgpl", r"3\.0", False)),
    ("LGPLver2.1", _gnu(_LGPL, "lgpl", r"2\.1", False)),
    ("AGPLver3+", _gnu(_AGPL, "agpl", r"3\.0", True)),
    ("AGPLver3", _gnu(_AGPL, "agpl", r"3\.0", False)),
    ("Apache2", rf"(this (work|program|file|software|code) is )?(licensed|released|distributed) under the apache license version 2\.0( the license)?|{_TAG}apache-2\.0"),
    ("MITName", rf"(this (work|program|file|software|code) is )?(licensed|released|distributed) under the (terms of the )?mit license|(the )?mit license( mit)?|{_TAG}mit"),
    ("MITGrant", r"permission is hereby granted free of charge to any person obtaining a copy of this software.*"),
    ("BSDName", r"(this (work|program|file|software|code) is )?(licensed|released|distributed) under the bsd license"),
    ("BSDSource", r"redistributions of source code must retain the above copyright notice.*"),
    ("BSDBinary", r"redistributions in binary form must reproduce the above copyright notice.*"),
    ("BSDEndorse", r"neither the name of .* may be used to endorse or promote products.*"),
    ("BSD3", rf"{_TAG}bsd-3-clause"),
    ("BSD2", rf"{_TAG}bsd-2-clause"),
    ("ISC", rf"permission to use copy modify and( or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies|{_TAG}isc"),
    ("Unlicense", rf"this is free and unencumbered software released into the public domain|{_TAG}unlicense"),
    ("CC0", rf"(this (work|text|document) is )?(licensed|released|dedicated) (under|to) (cc0|cc0 1\.0|the public domain under cc0)|{_TAG}cc0-1\.0"),
    ("CCBYNCSA", rf"{_CC}(cc by-nc-sa|creative commons attribution-noncommercial-sharealike){_CC_END}|{_TAG}cc-by-nc-sa-[0-9.]+"),
    ("CCBYNCND", rf"{_CC}(cc by-nc-nd|creative commons attribution-noncommercial-noderiv(ative)?s){_CC_END}|{_TAG}cc-by-nc-nd-[0-9.]+"),
    ("CCBYNC", rf"{_CC}(cc by-nc|creative commons attribution-noncommercial){_CC_END}|{_TAG}cc-by-nc-[0-9.]+"),
    ("CCBYSA", rf"{_CC}(cc by-sa|creative commons attribution-sharealike){_CC_END}|{_TAG}cc-by-sa-[0-9.]+"),
    ("CCBYND", rf"{_CC}(cc by-nd|creative commons attribution-noderiv(ative)?s){_CC_END}|{_TAG}cc-by-nd-[0-9.]+"),
    ("CCBY", rf"{_CC}(cc by|creative commons attribution){_CC_END}|{_TAG}cc-by-[0-9.]+"),
    ("MPL2", rf"(this (work|program|file|software|code|source code form) is )?(licensed|released|subject to the terms) (under|of) the mozilla public license (v\.|v |version )?2\.0|{_TAG}mpl-2\.0"),
    ("NoWarranty", r"(the|this) (software|program|work) is (provided|distributed) .*without (any )?warrant(y|ies).*"),
    ("AllRights", r"all rights reserved"),
)

# Fixed values. Licence and the identifiers it needs one after the other, in the order of matching.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("BSD-3-Clause", ("BSDSource", "BSDBinary", "BSDEndorse")),
    ("BSD-3-Clause", ("BSD3",)),
    ("BSD-2-Clause", ("BSDSource", "BSDBinary")),
    ("BSD-2-Clause", ("BSD2",)),
    ("MIT", ("MITName", "MITGrant")),
    ("GPL-3.0-or-later", ("GPLver3+",)),
    ("GPL-2.0-or-later", ("GPLver2+",)),
    ("GPL-3.0", ("GPLver3",)),
    ("GPL-2.0", ("GPLver2",)),
    ("LGPL-3.0-or-later", ("LGPLver3+",)),
    ("LGPL-2.1-or-later", ("LGPLver2.1+",)),
    ("LGPL-3.0", ("LGPLver3",)),
    ("LGPL-2.1", ("LGPLver2.1",)),
    ("AGPL-3.0-or-later", ("AGPLver3+",)),
    ("AGPL-3.0", ("AGPLver3",)),
    ("Apache-2.0", ("Apache2",)),
    ("MIT", ("MITName",)),
    ("MIT", ("MITGrant",)),
    ("BSD", ("BSDName",)),
    ("ISC", ("ISC",)),
    ("Unlicense", ("Unlicense",)),
    ("CC0-1.0", ("CC0",)),
    ("CC-BY-NC-SA", ("CCBYNCSA",)),
    ("CC-BY-NC-ND", ("CCBYNCND",)),
    ("CC-BY-NC", ("CCBYNC",)),
    ("CC-BY-SA", ("CCBYSA",)),
    ("CC-BY-ND", ("CCBYND",)),
    ("CC-BY", ("CCBY",)),
    ("MPL-2.0", ("MPL2",)),
    ("All-Rights-Reserved", ("AllRights",)),
)

#: Marks inside known sentences that would end them: what is before and after one stays.
INNER_MARKS = (r"(Foundation);(\s[^A-Za-z0-9]*either)", r"(License-Identifier):(\s)", r"( v)\.(\s+[0-9])")
#: Every known sentence has one of these, whatever stands between its words: others are not normalised.
NEEDED = r"(?i)licen[sc]e|permission|redistribution|endorse|warrant|reserved|domain|cc0|mozilla|commons|cc[^a-z0-9.+-]+by"
#: What a line may begin with besides words: comment marks, white space.
_MARGIN = r"(?m)^[^A-Za-z0-9+\n]+"
#: A sentence ends at a mark followed by white space, or at an empty line.
_END = r"(?<=[.!?;:])[ \t\r\n]+|\n(?:[ \t\r]*\n)+"


def normalised(text: Column) -> Column:
    """Lower case, other characters as one space; a line feed where a line ends, a form feed where a
    sentence does."""
    plain = F.translate(text, "\f", " ")
    for mark in INNER_MARKS:
        plain = F.regexp_replace(plain, mark, "$1$2")
    plain = F.regexp_replace(plain, _MARGIN, "")
    plain = F.regexp_replace(F.lower(F.regexp_replace(plain, _END, "\f")), r"[^a-z0-9.+\n\f-]+", " ")
    return F.regexp_replace(F.regexp_replace(plain, r"[ .-]*([\n\f])[ .-]*", "$1"), r"^[ .-]+|[ .-]+$", "")


def sentence_ids(text: Column, sentences: tuple[tuple[str, str], ...] = SENTENCES) -> Column:
    """Identifiers of the known sentences of a text, in order. Patterns with alternatives stand in
    groups, and the first that fits a sentence names it."""
    wrapped = "|".join(pattern.replace(".*", r"[^\f]*?").replace(" ", r"[ \n]") for _, pattern in sentences)
    said = F.regexp_extract_all(normalised(text), F.lit(rf"(?<![^\n\f])(?:{wrapped})(?![^\n\f])"), F.lit(0))

    def name(sentence: Column) -> Column:
        found = F.lit(None).cast("string")
        for identifier, pattern in reversed(sentences):
            found = F.when(sentence.rlike(f"^(?:{pattern})$"), F.lit(identifier)).otherwise(found)
        return found

    named = F.transform(F.transform(said, lambda s: F.translate(s, "\n", " ")), name)
    return F.coalesce(F.filter(named, lambda x: x.isNotNull()), F.array().cast("array<string>"))


def licenses_of(ids: Column, rules: tuple[tuple[str, tuple[str, ...]], ...] = RULES) -> tuple[Column, Column]:
    """Licences found, in the order of the rules and each once, and the sequence that no rule used."""
    left = F.concat(F.lit(" "), F.array_join(ids, "  "), F.lit(" "))
    found = []
    for name, needed in rules:
        part = " " + "  ".join(needed) + " "
        found.append(F.when(F.instr(left, part) > 0, F.lit(name)))
        left = F.replace(left, F.lit(part), F.lit("  "))
    return F.array_distinct(F.array_compact(F.array(*found))), F.trim(F.regexp_replace(left, " +", " "))


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, sentences (identifiers in order), licenses, unmatched
    (identifiers that no rule used, joined by spaces) and verdict: none, known, several or partial
    (known sentences, but not those of any licence).

    A null or empty text has no sentences. Repeated rows repeat; an empty table gives no rows.
    """
    read = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    named = read.select("doc_id", F.when(F.col("text").rlike(NEEDED), sentence_ids(F.col("text"))).otherwise(F.array().cast("array<string>")).alias("sentences"))
    found, left = licenses_of(F.col("sentences"))
    named = named.select("doc_id", "sentences", found.alias("licenses"), left.alias("unmatched"))
    verdict = (
        F.when(F.size("licenses") > 1, "several")
        .when(F.size("licenses") == 1, "known")
        .when(F.size("sentences") > 0, "partial")
        .otherwise("none")
    )
    return named.withColumn("verdict", verdict)
