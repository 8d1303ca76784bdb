"""License scans: ordered signature rules over the words of a text.

A text becomes its lower-case words, joined by single spaces. A rule is a regular expression over that form,
with keywords of which a text must hold one for the rule to be tried (the prefilter; each alternative of the
expression has one of them), a label, a priority and a confidence. Every match is a detection with an interval of
words. A detection is suppressed if its interval lies within that of a detection of the same or a higher priority
(of two equal ones the earlier rule stays).

Rules are made from license names and from the phrases in which they are given notice of, plus rules for the
words of the licenses themselves. Base phrases are rules of their own, counted at every place and never
suppressed.

Defined cases: a null text is empty (no words, no labels, score 0); a very long text is scanned whole; repeated rows
each get the same answer; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, row_key

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Label, pattern of the name, keywords, pattern of the short identifier.
NAMES = (
    ("mit", "(?:mit|expat) (?:open source )?licen[cs]e", "mit expat", "mit"),
    ("mit-0", "mit no attribution(?: licen[cs]e)?", "mit", "mit 0"),
    ("apache-1.1", "apache (?:software )?licen[cs]e(?: version)? (?:v ?)?1 1", "apache", "apache 1 1"),
    ("apache-2.0", "apache (?:software )?licen[cs]e(?: version)? (?:v ?)?2(?: 0)?", "apache", "apache 2 0"),
    ("gpl-1.0", "(?:gnu )?general public licen[cs]e(?: version| v)? ?1(?: 0)?", "general", "gpl 1 0(?: only| or later)?"),
    ("gpl-2.0", "(?:gnu )?general public licen[cs]e(?: version| v)? ?2(?: 0)?", "general", "gpl 2 0(?: only| or later)?"),
    ("gpl-3.0", "(?:gnu )?general public licen[cs]e(?: version| v)? ?3(?: 0)?", "general", "gpl 3 0(?: only| or later)?"),
    ("gpl", "gnu (?:general public licen[cs]e|gpl)", "gnu", "gpl"),
    ("lgpl-2.0", "(?:gnu )?library general public licen[cs]e(?: version| v)? ?2(?: 0)?", "library", "lgpl 2 0(?: only| or later)?"),
    ("lgpl-2.1", "(?:gnu )?lesser general public licen[cs]e(?: version| v)? ?2 1", "lesser", "lgpl 2 1(?: only| or later)?"),
    ("lgpl-3.0", "(?:gnu )?lesser general public licen[cs]e(?: version| v)? ?3(?: 0)?", "lesser", "lgpl 3 0(?: only| or later)?"),
    ("agpl-3.0", "(?:gnu )?affero general public licen[cs]e(?:(?: version| v)? ?3(?: 0)?)?", "affero", "agpl 3 0(?: only| or later)?"),
    ("gfdl", "gnu free documentation licen[cs]e", "documentation", "gfdl 1 [123]"),
    ("bsd-2-clause", "(?:simplified bsd|2 clause bsd|bsd 2 clause|freebsd) licen[cs]e", "bsd freebsd", "bsd 2 clause"),
    ("bsd-3-clause", "(?:modified bsd|new bsd|revised bsd|3 clause bsd|bsd 3 clause) licen[cs]e", "bsd", "bsd 3 clause"),
    ("bsd-4-clause", "(?:original bsd|4 clause bsd|bsd 4 clause) licen[cs]e", "bsd", "bsd 4 clause"),
    ("bsd", "bsd (?:style )?licen[cs]e", "bsd", "bsd"),
    ("0bsd", "(?:zero clause bsd|0bsd|bsd zero clause)(?: licen[cs]e)?", "zero 0bsd", "0bsd"),
    ("isc", "isc licen[cs]e", "isc", "isc"),
    ("mpl-1.0", "mozilla public licen[cs]e(?: version| v)? 1 0", "mozilla", "mpl 1 0"),
    ("mpl-1.1", "mozilla public licen[cs]e(?: version| v)? 1 1", "mozilla", "mpl 1 1"),
    ("mpl-2.0", "mozilla public licen[cs]e(?: version| v)? 2 0", "mozilla", "mpl 2 0"),
    ("epl-1.0", "eclipse public licen[cs]e(?: version| v)? 1 0", "eclipse", "epl 1 0"),
    ("epl-2.0", "eclipse public licen[cs]e(?: version| v)? 2 0", "eclipse", "epl 2 0"),
    ("eupl-1.1", "european union public licen[cs]e(?: version| v)? 1 1", "european", "eupl 1 1"),
    ("eupl-1.2", "european union public licen[cs]e(?: version| v)? 1 2", "european", "eupl 1 2"),
    ("cddl-1.0", "common development and distribution licen[cs]e(?:(?: version)? 1 0)?", "development", "cddl 1 0"),
    ("cpl-1.0", "common public licen[cs]e(?:(?: version)? 1 0)?", "common", "cpl 1 0"),
    ("artistic-1.0", "artistic licen[cs]e(?: version)? 1 0", "artistic", "artistic 1 0"),
    ("artistic-2.0", "artistic licen[cs]e(?: version)? 2 0", "artistic", "artistic 2 0"),
    ("zlib", "zlib(?: libpng)? licen[cs]e", "zlib", "zlib"),
    ("libpng", "libpng licen[cs]e", "libpng", "libpng 2 0"),
    ("bsl-1.0", "boost software licen[cs]e", "boost", "bsl 1 0"),
    ("busl-1.1", "business source licen[cs]e(?: 1 1)?", "business", "busl 1 1"),
    ("sspl-1.0", "server side public licen[cs]e", "server", "sspl 1 0"),
    ("elastic-2.0", "elastic licen[cs]e(?: 2 0)?", "elastic", "elastic 2 0"),
    ("unlicense", "the unlicen[cs]e", "unlicense unlicence", "unlicense"),
    ("wtfpl", "do what the fuck you want to public licen[cs]e", "fuck", "wtfpl"),
    ("ofl-1.1", "(?:sil )?open font licen[cs]e(?: 1 1)?", "font", "ofl 1 1"),
    ("psf-2.0", "python software foundation licen[cs]e", "python", "psf 2 0"),
    ("php-3.01", "php licen[cs]e(?: version)?(?: 3 01)?", "php", "php 3 01"),
    ("ruby", "ruby licen[cs]e", "ruby", "ruby"),
    ("vim", "vim licen[cs]e", "vim", "vim"),
    ("openssl", "openssl licen[cs]e", "openssl", "openssl"),
    ("postgresql", "postgresql licen[cs]e", "postgresql", "postgresql"),
    ("ms-pl", "microsoft public licen[cs]e", "microsoft", "ms pl"),
    ("ms-rl", "microsoft reciprocal licen[cs]e", "microsoft", "ms rl"),
    ("ncsa", "university of illinois ncsa open source licen[cs]e", "ncsa", "ncsa"),
    ("upl-1.0", "universal permissive licen[cs]e(?: 1 0)?", "universal", "upl 1 0"),
    ("osl-3.0", "open software licen[cs]e(?: 3 0)?", "software", "osl 3 0"),
    ("afl-3.0", "academic free licen[cs]e(?: 3 0)?", "academic", "afl 3 0"),
    ("odbl-1.0", "open (?:data commons open )?database licen[cs]e", "database", "odbl 1 0"),
    ("odc-by-1.0", "open data commons attribution licen[cs]e", "commons", "odc by 1 0"),
    ("pddl-1.0", "public domain dedication and licen[cs]e", "dedication", "pddl 1 0"),
    ("cc0-1.0", "(?:cc0|creative commons zero)(?: 1 0)?(?: universal)?(?: public domain dedication)?", "cc0 zero", "cc0 1 0"),
    ("cc-by-3.0", "(?:cc by|creative commons attribution)(?: licen[cs]e)? 3 0", "3", "cc by 3 0"),
    ("cc-by-4.0", "(?:cc by|creative commons attribution)(?: licen[cs]e)? 4 0", "4", "cc by 4 0"),
    ("cc-by-sa-3.0", "(?:cc by sa|creative commons attribution share ?alike)(?: licen[cs]e)? 3 0", "3", "cc by sa 3 0"),
    ("cc-by-sa-4.0", "(?:cc by sa|creative commons attribution share ?alike)(?: licen[cs]e)? 4 0", "4", "cc by sa 4 0"),
    ("cc-by-nc-4.0", "(?:cc by nc|creative commons attribution non ?commercial)(?: licen[cs]e)? 4 0", "4", "cc by nc 4 0"),
    ("cc-by-nd-4.0", "(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s)(?: licen[cs]e)? 4 0", "4", "cc by nd 4 0"),
    ("cc-by-nc-sa-4.0", "(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: licen[cs]e)? 4 0", "4", "cc by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", "(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s)(?: licen[cs]e)? 4 0", "4", "cc by nc nd 4 0"),
)

# The phrases around a name, their priority (1 is the highest) and confidence.
NOTICES = (
    ("(?:released|licen[cs]ed|distributed|published|provided|offered|available|covered|governed) (?:to you )?(?:under|by) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{name}", 1, 0.99),
    ("(?:terms (?:and conditions )?of|permitted (?:under|by)|subject to|accordance with|compliance with) (?:the )?{name}", 2, 0.95),
    ("(?:see|read|copy of|refer to) (?:the )?{name}", 2, 0.9),
    ("{name} (?:applies|shall apply|as published by|for (?:more )?details|text)", 2, 0.9),
    ("{name}", 3, 0.8),
)

# Label, pattern, keywords, priority, confidence.
TEXTS = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "hereby", 1, 0.99),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies", "permission", 2, 0.9),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "hereby", 1, 0.99),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution", 1, 0.97),
    ("bsd-3-clause", "neither the name of .{1,120} nor the names of (?:its|the) contributors may be used to endorse or promote products", "endorse", 1, 0.98),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display", "advertising", 1, 0.98),
    ("apache-2.0", "you may not use this file except in compliance with the license", "compliance", 2, 0.9),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license", "applicable", 2, 0.9),
    ("gpl", "this program is free software you can redistribute it and or modify it", "redistribute", 1, 0.95),
    ("lgpl", "this library is free software you can redistribute it and or modify it", "redistribute", 1, 0.95),
    ("gpl", "without even the implied warranty of merchantability or fitness for a particular purpose", "merchantability", 3, 0.6),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla", 1, 0.99),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1", "mozilla", 1, 0.99),
    ("epl-1.0", "this program and the accompanying materials are made available under the terms of the eclipse public license", "eclipse", 1, 0.97),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", "liable", 1, 0.97),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered", 1, 0.99),
    ("public-domain", "(?:released|placed|dedicated) (?:in|into|to) the public domain", "domain", 2, 0.9),
    ("cc0-1.0", "waived all copyright and related or neighbou?ring rights", "waived", 1, 0.97),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software", "hereby", 1, 0.99),
    ("ofl-1.1", "this font software is licensed under the sil open font license", "font", 1, 0.99),
    ("all-rights-reserved", "all rights reserved", "reserved", 3, 0.5),
    ("proprietary", "(?:proprietary and confidential|confidential and proprietary)", "proprietary", 2, 0.8),
    ("proprietary", "may not be (?:reproduced|copied|distributed) without (?:the )?(?:prior )?(?:written )?permission", "permission", 2, 0.8),
    ("gpl", "you should have received a copy of the gnu general public license along with this program", "received", 1, 0.97),
    ("lgpl", "you should have received a copy of the gnu lesser general public license along with this (?:library|program)", "received", 1, 0.97),
    ("agpl-3.0", "you should have received a copy of the gnu affero general public license along with this program", "received", 1, 0.98),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty", "hope", 2, 0.9),
    ("lgpl", "this library is distributed in the hope that it will be useful but without any warranty", "hope", 2, 0.9),
    ("gpl", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", "verbatim", 2, 0.9),
    ("gpl-2.0", "either version 2 of the license or at your option any later version", "option", 1, 0.95),
    ("gpl-3.0", "either version 3 of the license or at your option any later version", "option", 1, 0.95),
    ("lgpl-2.1", "either version 2 1 of the license or at your option any later version", "option", 1, 0.95),
    ("gpl-3.0", "the gnu general public license is a free copyleft license for software and other kinds of works", "copyleft", 1, 0.97),
    ("agpl-3.0", "the gnu affero general public license is a free copyleft license for software and other kinds of works", "copyleft", 1, 0.97),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "documentation", 1, 0.98),
    ("apache-2.0", "see the license for the specific language governing permissions and limitations under the license", "governing", 2, 0.95),
    ("apache-2.0", "you may obtain a copy of the license at(?: http)? www apache org licenses license 2 0", "obtain", 1, 0.98),
    ("apache-1.1", "this product includes software developed by the apache software foundation", "apache", 1, 0.95),
    ("bsd", "redistributions of source code must retain the above copyright notice", "redistributions", 2, 0.95),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice", "redistributions", 2, 0.95),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", "merchantability", 2, 0.9),
    ("x11", "except as contained in this notice the name of .{1,120} shall not be used in advertising or otherwise", "advertising", 1, 0.97),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software", "disclaims", 2, 0.9),
    ("hpnd", "permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted", "hereby", 1, 0.97),
    ("zlib", "the origin of this software must not be misrepresented", "misrepresented", 1, 0.97),
    ("zlib", "altered source versions must be plainly marked as such", "altered", 2, 0.95),
    ("mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at", "mpl", 1, 0.99),
    ("epl-2.0", "made available under the terms of the eclipse public license 2 0", "eclipse", 1, 0.98),
    ("artistic-1.0", "the intent of this document is to state the conditions under which a package may be copied", "intent", 1, 0.97),
    ("psf-2.0", "psf is making python available to licensee on an as is basis", "psf", 1, 0.98),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software", "compile", 1, 0.98),
    ("wtfpl", "you just do what the fuck you want to", "fuck", 1, 0.98),
    ("beerware", "if we meet some day and you think this stuff is worth it you can buy me a beer in return", "beer", 1, 0.99),
    ("json", "the software shall be used for good not evil", "evil", 1, 0.98),
    ("ofl-1.1", "(?:the )?font software may be sold as part of a larger software package", "font", 1, 0.95),
    ("openssl", "this product includes software developed by the openssl project", "openssl", 1, 0.97),
    ("php-3.01", "this product includes php software freely available from", "php", 1, 0.97),
    ("sspl-1.0", "if you make the functionality of the program or a modified version available to third parties as a service", "functionality", 1, 0.98),
    ("busl-1.1", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use", "licensor", 1, 0.99),
    ("elastic-2.0", "you may not provide the software to third parties as a hosted or managed service", "hosted", 1, 0.98),
    ("commons-clause", "the license does not grant to you the right to sell the software", "sell", 1, 0.97),
    ("cc-by-4.0", "(?:creative commons )?attribution 4 0 international", "attribution", 2, 0.95),
    ("cc-by-sa-4.0", "(?:creative commons )?attribution share ?alike 4 0 international", "attribution", 2, 0.95),
    ("cc-by-nc-4.0", "(?:creative commons )?attribution non ?commercial 4 0 international", "attribution", 2, 0.95),
    ("cc-by-nd-4.0", "(?:creative commons )?attribution no ?derivatives 4 0 international", "attribution", 2, 0.95),
    ("cc-by-nc-sa-4.0", "(?:creative commons )?attribution non ?commercial share ?alike 4 0 international", "attribution", 2, 0.95),
    ("cc-by-nc-nd-4.0", "(?:creative commons )?attribution non ?commercial no ?derivatives 4 0 international", "attribution", 2, 0.95),
    ("public-domain", "no (?:known )?copyright restrictions", "restrictions", 2, 0.7),
    ("proprietary", "unauthori[sz]ed (?:copying|reproduction|distribution|disclosure) of this (?:file|software|material|document)", "unauthorized unauthorised", 2, 0.9),
    ("proprietary", "(?:for )?evaluation purposes only", "evaluation", 3, 0.6),
    ("all-rights-reserved", "no part of this (?:publication|book|work|document) may be reproduced", "reproduced", 2, 0.85),
    ("eula", "end user licen[cs]e agreement", "agreement", 2, 0.8),
    ("non-commercial", "(?:for )?non ?commercial use only", "commercial noncommercial", 3, 0.6),
)


@dataclass(frozen=True)
class Rule:
    rule: int
    label: str
    pattern: str
    keywords: tuple[str, ...]
    priority: int
    confidence: float
    base: bool


@cache
def rules() -> tuple[Rule, ...]:
    """All rules in their order. A bare name stands for a notice only where it is specific."""
    found = [(label, phrase, phrase.split()[0], 0, 0.9, True) for phrase, label in BASE]
    found += [(label, pattern, word, priority, confidence, False) for label, pattern, word, priority, confidence in TEXTS]
    for notice, priority, confidence in NOTICES:
        found += [(label, notice.format(name=name), word, priority, confidence, False) for label, name, word, _ in NAMES]
    found += [(label, f"spdx licen[cs]e identifier {short}", "spdx", 1, 1.0, False) for label, _, _, short in NAMES]
    return tuple(Rule(i, label, pattern, tuple(word.split()), *rest) for i, (label, pattern, word, *rest) in enumerate(found))


def rules_table(spark: SparkSession) -> DataFrame:
    """The rules as a table, a row for each keyword: its size is that of the rules, whatever the input."""
    values = ", ".join(
        f"({r.rule}, '{r.label}', r' (?:{r.pattern})(?= )', array({', '.join(map(repr, r.keywords))}), {word!r}, {r.priority}, {r.confidence}D, {str(r.base).lower()})"
        for r in rules() for word in r.keywords
    )
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(rule, label, pattern, keywords, keyword, priority, confidence, base)")


def _spaces(text):
    return F.length(text) - F.length(F.replace(text, F.lit(" ")))


# Every match of a rule on names holds one of these words; one on texts holds one of its keywords.
GATE = (
    "license licence licensed licenced unlicense unlicence license1 license2 license3 licence1 licence2 licence3 0bsd gpl agpl lgpl gfdl spdx cc cc0 creative attribution domain domains reserved proprietary hereby "
    "permission redistribution redistribute merchantability advertising waived unencumbered endorse clause notice compliance applicable liable identifier"
).split()
#: The letters beyond A-Z of whose lower case an ASCII letter is a part.
NOT_ASCII = "[\u0130\u212A]"


def word_forms(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: row_key, doc_id, n_words and, if any rule can match, its words as one string and the
    keywords among them. As rules hold ASCII alone, lower case of all letters gives what that of A-Z gives, but for
    the two letters that it would turn into ASCII ones."""
    keywords = sorted({word for r in rules() for word in r.keywords})
    t = F.coalesce(F.col(text), F.lit(""))
    lowered = F.when(t.rlike(NOT_ASCII), ascii_lower(t)).otherwise(F.lower(t))
    d = docs.select(
        row_key(F.col(id_col), F.col(text)).alias("row_key"), F.col(id_col).alias("doc_id"),
        F.array_remove(F.split(lowered, NOT_WORD), "").alias("words"),
    )
    gate = F.arrays_overlap("words", F.array(*map(F.lit, sorted({*GATE, *(w for _, _, words, *_ in TEXTS for w in words.split())}))))
    return d.select(
        "row_key", "doc_id", F.size("words").cast("bigint").alias("n_words"),
        F.when(gate, F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))).alias("norm"),
        F.when(gate, F.array_intersect(F.array(*map(F.lit, keywords)), "words")).alias("found"),
    )


def detect(forms: DataFrame) -> DataFrame:
    """Detections: row_key, rule, label, priority, confidence, base, first and last word."""
    d = forms.where(F.col("norm").isNotNull())
    hit = d.select("row_key", "norm", "found", F.explode("found").alias("keyword")).join(F.broadcast(rules_table(forms.sparkSession)), "keyword")
    # a text that holds several keywords of a rule tries it by the first of them
    hit = hit.where(F.get(F.array_intersect("keywords", "found"), F.lit(0)) == F.col("keyword"))
    hit = hit.withColumn("parts", F.split(F.regexp_replace("norm", F.col("pattern"), F.lit("\x01$0\x02")), "\x01")).where(F.size("parts") > 1)
    # each part but the first starts with a match; what stands before it tells at which word
    part = hit.select("row_key", "rule", "label", "priority", "confidence", "base", F.posexplode("parts").alias("at", "part"))
    part = part.select(
        "row_key", "rule", "label", "priority", "confidence", "base", "at",
        _spaces(F.replace("part", F.lit("\x02"))).alias("words"),
        _spaces(F.substring_index("part", "\x02", 1)).alias("matched"),
    )
    part = part.distinct()  # of repeated rows
    before = Window.partitionBy("row_key", "rule").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumn("first", F.sum("words").over(before)).where("at > 0")
    return part.select(
        "row_key", "rule", "label", "priority", "confidence", "base",
        F.col("first").cast("bigint").alias("first"), (F.col("first") + F.col("matched") - 1).cast("bigint").alias("last"),
    )


def resolve(detections: DataFrame) -> DataFrame:
    """Detections that stay. In order of (first, -last, priority, rule) whatever contains a detection comes
    before it; a running maximum of the ends, for each priority, tells whether any does."""
    order = Window.partitionBy("row_key").orderBy("first", F.desc("last"), "priority", "rule").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.lit(False)
    for p in sorted({r.priority for r in rules() if not r.base}):
        end = F.max(F.when(F.col("priority") == p, F.col("last"))).over(order)
        inside = inside | ((F.col("priority") >= p) & (end >= F.col("last")))
    own = detections.where(~F.col("base")).withColumn("suppressed", F.coalesce(inside, F.lit(False))).where(~F.col("suppressed"))
    return own.drop("suppressed").unionByName(detections.where("base"))


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: n_words, n_base, first_word, last_word, base_labels, labels, score."""
    forms = materialize(word_forms(docs, id_col, text), "license-words")
    kept = resolve(materialize(detect(forms), "license-detections"))
    per = kept.groupBy("row_key").agg(
        F.count_if("base").alias("n_base"),
        F.min(F.when(F.col("base"), F.col("first"))).alias("first_word"),
        F.max(F.when(F.col("base"), F.col("first"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("confidence").alias("score"),
    )
    return forms.select("row_key", "doc_id", "n_words").join(per, "row_key", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def plain_sql(table: str = "documents") -> str:
    """What `scan` gives, in DuckDB's SQL and without the prefilter: every rule is tried on every text. Letters beyond
    ASCII become Q, which no rule and no lower-cased text holds, so that an ASCII word boundary is one."""
    values = ",\n".join(f"({r.rule}, '{r.label}', ' (?:{r.pattern})\\b', {r.priority}, {r.confidence}e0, {str(r.base).lower()})" for r in rules())
    spaces = "(length({0}) - length(replace({0}, ' ', '')))".format
    return rf"""WITH rules(rule, label, pattern, priority, confidence, base) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {table}),
x AS (SELECT r, ' ' || regexp_replace(array_to_string(w, ' '), '[^\x00-\x7F]', 'Q', 'g') || ' ' AS x FROM d),
hit AS (SELECT r, rules.*, regexp_extract_all(x, pattern) AS m, string_split_regex(x, pattern) AS p FROM x JOIN rules ON regexp_matches(x, pattern)),
part AS (SELECT * EXCLUDE (m, p), unnest(range(1, len(m) + 1)) AS i, unnest(m) AS m, unnest(p[1:len(m)]) AS p FROM hit),
pos AS (SELECT *, sum({spaces("p")} + {spaces("m")}) OVER (PARTITION BY r, rule ORDER BY i) - {spaces("m")} AS first FROM part),
found AS (SELECT r, rule, label, priority, confidence, base, first::BIGINT AS first, (first + {spaces("m")} - 1)::BIGINT AS last FROM pos),
kept AS (SELECT * FROM found f WHERE base OR NOT EXISTS (FROM found o WHERE NOT o.base AND o.r = f.r AND o.first <= f.first AND o.last >= f.last AND o.priority <= f.priority
  AND (o.first < f.first OR o.last > f.last OR o.priority < f.priority OR o.rule < f.rule))),
per AS (SELECT r, count(*) FILTER (base) AS n_base, min(first) FILTER (base) AS first_word, max(first) FILTER (base) AS last_word,
  array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(confidence) AS score FROM kept GROUP BY ALL)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0e0) AS score
FROM d LEFT JOIN per USING (r)"""
