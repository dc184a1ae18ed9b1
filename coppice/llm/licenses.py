"""License scans (6): ordered signature rules behind a keyword prefilter.

Texts become words (A-Z lowered, ASCII punctuation dropped) joined by single
spaces, on which the signature rules stand: written ones for license texts and
hints, and one for each version of each license family.  A text that holds no
rule's keyword is done after that; of the rules only those are run whose
literals (keyword, version) all occur.  These filters follow from the rules and
hold no detection back.  A detection that lies within another one of the same or
a higher priority is suppressed.  Everything is one narrow pass: no shuffle.

Defined results: a null or empty text has no words, no labels and score 0;
repeated rows are scanned alike; an empty table gives an empty one; columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lowered, text_of
from .spans import let, match_spans, running

#: What stands between words, and words where A-Z are not lowered yet.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Base phrases with their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Priorities, first wins: a stated identifier or license text, a name with version, a name, a hint.
SCORES = {1: 1.0, 2: 0.9, 3: 0.7, 4: 0.3}


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: str
    priority: int
    #: A literal that every match holds beside the keyword.
    also: str = ""


# Families as (label, keyword, pattern of the name, versions).
FAMILIES = (
    ("gpl", "general public", r"(?:gnu )?general public licen[sc]e", ("1 0", "2 0", "3 0", "1", "2", "3")),
    ("gpl", "gpl", r"(?:gnu )?gpl(?: licen[sc]e)?", ("1 0", "2 0", "3 0", "1", "2", "3")),
    ("lgpl", "general public", r"(?:gnu )?(?:lesser|library) general public licen[sc]e", ("2 0", "2 1", "3 0", "2", "3")),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl(?: licen[sc]e)?", ("2 0", "2 1", "3 0", "2", "3")),
    ("agpl", "general public", r"(?:gnu )?affero general public licen[sc]e", ("1 0", "3 0", "1", "3")),
    ("agpl", "agpl", r"(?:gnu )?agpl(?: licen[sc]e)?", ("1 0", "3 0", "1", "3")),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation licen[sc]e", ("1 1", "1 2", "1 3")),
    ("apache", "apache", r"apache(?: software)?(?: licen[sc]e)?", ("1 0", "1 1", "2 0", "2")),
    ("mpl", "mozilla", r"mozilla public licen[sc]e", ("1 0", "1 1", "2 0")),
    ("mpl", "mpl", r"mpl", ("1 0", "1 1", "2 0")),
    ("epl", "eclipse", r"eclipse public licen[sc]e", ("1 0", "2 0")),
    ("epl", "epl", r"epl", ("1 0", "2 0")),
    ("cpl", "common public", r"common public licen[sc]e", ("1 0",)),
    ("cddl", "common development", r"common development and distribution licen[sc]e", ("1 0", "1 1")),
    ("cddl", "cddl", r"cddl", ("1 0", "1 1")),
    ("eupl", "european union", r"european union public licen[sc]e", ("1 0", "1 1", "1 2")),
    ("eupl", "eupl", r"eupl", ("1 0", "1 1", "1 2")),
    ("artistic", "artistic", r"(?:perl )?artistic licen[sc]e", ("1 0", "2 0")),
    ("afl", "academic free", r"academic free licen[sc]e", ("1 1", "1 2", "2 0", "2 1", "3 0")),
    ("osl", "open software", r"open software licen[sc]e", ("1 0", "2 0", "2 1", "3 0")),
    ("ofl", "open font", r"(?:sil )?open font licen[sc]e", ("1 0", "1 1")),
    ("bsl", "boost", r"boost software licen[sc]e", ("1 0",)),
    ("bsl", "business source", r"business source licen[sc]e", ("1 1",)),
    ("zpl", "zope", r"zope public licen[sc]e", ("1 1", "2 0", "2 1")),
    ("php", "php", r"php licen[sc]e", ("3 0", "3 01")),
    ("python", "python", r"python(?: software foundation)? licen[sc]e", ("2",)),
    ("lppl", "latex", r"latex project public licen[sc]e", ("1 0", "1 1", "1 2", "1 3")),
    ("qpl", "q public", r"q public licen[sc]e", ("1 0",)),
    ("ms-pl", "microsoft", r"microsoft public licen[sc]e", ()),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[sc]e", ()),
    ("apsl", "apple", r"apple public source licen[sc]e", ("1 0", "1 1", "1 2", "2 0")),
    ("cecill", "cecill", r"cecill(?: free software)?(?: licen[sc]e)?", ("1 0", "1 1", "2 0", "2 1")),
    ("sspl", "server side", r"server side public licen[sc]e", ("1", "1 0")),
    ("elastic", "elastic", r"elastic licen[sc]e", ("1 0", "2 0", "2")),
    ("ncsa", "illinois", r"university of illinois(?: ncsa)?(?: open source)? licen[sc]e", ()),
    ("mit", "mit", r"(?:the )?mit(?: x11)? licen[sc]e", ()),
    ("mit", "expat", r"expat licen[sc]e", ()),
    ("x11", "x11", r"x11 licen[sc]e", ()),
    ("isc", "isc", r"isc licen[sc]e", ()),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[sc]e", ()),
    ("postgresql", "postgresql", r"postgresql licen[sc]e", ()),
    ("openssl", "openssl", r"openssl licen[sc]e", ()),
    ("curl", "curl", r"curl licen[sc]e", ()),
    ("ruby", "ruby", r"ruby licen[sc]e", ()),
    ("vim", "vim", r"vim licen[sc]e", ()),
    ("unlicense", "unlicense", r"(?:the )?unlicense", ()),
    ("wtfpl", "wtfpl", r"wtfpl", ("1", "2")),
    ("wtfpl", "the fuck you want", r"do what the fuck you want to public licen[sc]e", ("1", "2")),
    ("bsd", "bsd", r"bsd(?: style)? licen[sc]e", ()),
    ("0bsd", "bsd", r"(?:zero clause bsd|bsd 0 clause)(?: licen[sc]e)?", ()),
    ("0bsd", "0bsd", r"0bsd(?: licen[sc]e)?", ()),
    ("bsd-2-clause", "freebsd", r"freebsd(?: licen[sc]e)?", ()),
    ("bsd-2-clause", "bsd", r"(?:simplified bsd|2 clause bsd|two clause bsd|bsd 2 clause)(?: licen[sc]e)?", ()),
    ("bsd-3-clause", "bsd", r"(?:new bsd|modified bsd|revised bsd|3 clause bsd|three clause bsd|bsd 3 clause)(?: licen[sc]e)?", ()),
    ("bsd-4-clause", "bsd", r"(?:original bsd|4 clause bsd|four clause bsd|bsd 4 clause)(?: licen[sc]e)?", ()),
    ("odbl", "open", r"open(?: data commons)? database licen[sc]e", ("1 0",)),
    ("odc-by", "open data commons", r"open data commons attribution licen[sc]e", ("1 0",)),
    ("cdla-permissive", "community data", r"community data licen[sc]e agreement permissive", ("1 0", "2 0")),
    ("cdla-sharing", "community data", r"community data licen[sc]e agreement sharing", ("1 0",)),
)

# Parts of license texts and hints.
TEXTS = (
    Rule("mit", "hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software", 1),
    Rule("isc", "permission to use", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 1),
    Rule("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted", 1),
    Rule("bsd-3-clause", "endorse or promote", r"neither the name of (?:\S+ ){1,12}nor the names of its contributors may be used to endorse or promote products", 1),
    Rule("gpl", "free software foundation", r"redistribute it and or modify it under the terms of the gnu general public licen[sc]e as published by the free software foundation", 1),
    Rule("lgpl", "free software foundation", r"redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[sc]e as published by the free software foundation", 1),
    Rule("agpl", "free software foundation", r"redistribute it and or modify it under the terms of the gnu affero general public licen[sc]e as published by the free software foundation", 1),
    Rule("apache-2.0", "apache org", r"(?:http|https) www apache org licenses license 2 0", 1),
    Rule("mpl-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0", 1),
    Rule("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", 1),
    Rule("zlib", "express or implied", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", 1),
    Rule("public-domain", "public domain", r"(?:released |placed |dedicated )?(?:in|into|to) the public domain", 2),
    Rule("public-domain", "public domain", r"public domain", 3),
    Rule("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?", 2),
    Rule("proprietary", "rights reserved", r"all rights reserved", 4),
    Rule("copyright", "copyright", r"copyright(?: c)?(?: [12][0-9]{3})*", 4),
    Rule("copyleft", "copyleft", r"copyleft", 4),
    Rule("licensed", "licensed under", r"licensed under(?: the)?(?: terms of)?(?: the)?", 4),
    Rule("licensed", "released under", r"released under(?: the)?(?: terms of)?(?: the)?", 4),
    Rule("licensed", "distributed under", r"distributed under(?: the)?(?: terms of)?(?: the)?", 4),
    Rule("licensed", "licence", r"(?:licenced|see the licence|this licence)", 4),
    Rule("no-warranty", "warrant", r"without warrant(?:y|ies)(?: or conditions)? of any kind", 4),
)
# Creative Commons parts and versions.
CC_PARTS = (("by", "attribution"), ("by sa", "attribution share ?alike"), ("by nc", "attribution non ?commercial"), ("by nd", "attribution no ?deriv(?:ative)?s(?: works)?"), ("by nc sa", "attribution non ?commercial share ?alike"), ("by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s(?: works)?"))
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")


def rules() -> tuple[Rule, ...]:
    """All rules in order: texts, then for each family its versions with and without `or later`, and its name."""
    out = list(TEXTS)
    for label, keyword, name, versions in FAMILIES:
        for v in versions:
            full = f"{label}-{v.replace(' ', '.')}"
            # version 3 0 contains version 3 0 or later's beginning: the longer interval suppresses it
            number = rf"(?: version| v)? (?:v)?{v}(?! [0-9])" if " " not in v else rf"(?: version| v)? (?:v)?{v}"
            out.append(Rule(full, keyword, name + number, 2, v))
            out.append(Rule(full + "-or-later", keyword, name + number + r" (?:or(?: at your option)?(?: any)? (?:later|newer)(?: version)?|and later)", 1, v))
            out.append(Rule(full, "spdx", rf"spdx license identifier {label.replace('-', ' ')} {v}(?: only)?", 1, v))
        out.append(Rule(label, keyword, name, 3))
    for short, long in CC_PARTS:
        label = "cc-" + short.replace(" ", "-")
        for v in CC_VERSIONS:
            full = f"{label}-{v.replace(' ', '.')}"
            out.append(Rule(full, "cc", rf"cc {short} {v}", 2, v))
            out.append(Rule(full, "creative commons", rf"creative commons {long}(?: international| unported| generic)?(?: licen[sc]e)? {v}", 2, v))
        out.append(Rule(label, "cc", rf"cc {short}", 3))
        out.append(Rule(label, "creative commons", rf"creative commons {long}", 3))
    # two families of one label share its identifiers
    return tuple(dict.fromkeys(out))


def _rule_array(chosen: tuple[Rule, ...]) -> Column:
    """A constant array; patterns stand on whole words."""
    return F.array(*(F.struct(F.lit(r.label).alias("label"), F.lit(f" {r.keyword}").alias("keyword"), F.lit(r.also).alias("also"), F.lit(rf"(?<= ){r.pattern}(?= )").alias("pattern"), F.lit(r.priority).alias("priority"), F.lit(k).alias("rule")) for k, r in enumerate(chosen)))


def _always(pattern: str) -> str:
    """A pattern without its groups: what every match holds."""
    while (less := re.sub(r"\((?:\?[:!])?[^()]*\)\??", "", pattern)) != pattern:
        pattern = less
    return pattern


def _able(line: Column, chosen: tuple[Rule, ...]) -> Column:
    """Whether a word string holds `licen`, as all base phrases do, or a keyword of a rule that matches without it."""
    bare: dict[str, set[str]] = {}
    for r in chosen:
        if "licen" not in _always(r.pattern):
            bare.setdefault(r.keyword[0], set()).add(r.keyword[1:])
    # the first letter is read once for all words that share it
    return F.contains(line, F.lit("licen")) | line.rlike(" (?:" + "|".join(f"{c}(?:{'|'.join(sorted(rest))})" for c, rest in sorted(bare.items())) + ")")


def _base(words: Column) -> list[Column]:
    """n_base, first_word, last_word and labels of the phrases; words are each between two blanks."""
    spaced = F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))
    n, first, last, labels = F.lit(0).cast("bigint"), [], [], []
    before = lambda prefix: F.char_length(prefix) - F.char_length(F.replace(prefix, F.lit(" "), F.lit("")))
    for phrase, label in BASE:
        mark = " " + phrase.replace(" ", "  ") + " "
        size = len(phrase.split())
        count = F.regexp_count(spaced, F.lit(mark)).cast("bigint")
        n = n + count
        # each word before stands between two blanks
        first.append(F.when(count > 0, (before(F.substring_index(spaced, mark, 1)) / 2).cast("bigint")))
        last.append(F.when(count > 0, F.size(words) - size - (before(F.substring_index(spaced, mark, -1)) / 2).cast("bigint")))
        labels.append(F.when(count > 0, F.lit(label)))
    return [n, F.least(*first), F.greatest(*last), F.array_compact(F.array(*labels))]


def detections(line: Column, chosen: tuple[Rule, ...]) -> Column:
    """Detections that no other suppresses: (label, start, end, priority) in the word string."""

    def of_rule(r: Column) -> Column:
        return F.transform(match_spans(line, r["pattern"]), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("neg_end"), r["priority"].alias("priority"), r["rule"].alias("rule"), r["label"].alias("label")))

    able = F.filter(_rule_array(chosen), lambda r: F.contains(line, r["keyword"]) & F.contains(line, r["also"]))

    def judged(ordered: Column) -> Column:
        # in this order whatever contains a detection came before it
        def reach_of(most: int) -> Column:
            return running(F.transform(ordered, lambda d: F.when(d["priority"] <= most, -d["neg_end"]).otherwise(F.lit(-1)).cast("bigint")), F.greatest, -1)

        covered = F.arrays_zip(*(reach_of(k).alias(f"m{k}") for k in sorted(SCORES)))

        def mark(d: Column, m: Column) -> Column:
            most = F.lit(-1).cast("bigint")
            for k in sorted(SCORES):
                most = F.when(d["priority"] == k, m[f"m{k}"]).otherwise(most)
            return F.struct(d["label"].alias("label"), d["start"].alias("start"), (-d["neg_end"]).alias("end"), d["priority"].alias("priority"), (most < -d["neg_end"]).alias("kept"))

        kept = F.filter(F.zip_with(ordered, covered, mark), lambda d: d["kept"])
        return F.transform(kept, lambda d: F.struct(d["label"].alias("label"), d["start"].alias("start"), d["end"].alias("end"), d["priority"].alias("priority")))

    return let(F.array_sort(F.flatten(F.transform(able, of_rule))), judged)


_KEPT = "array<struct<label:string,start:bigint,end:bigint,priority:int>>"


def scan(docs: DataFrame, chosen: tuple[Rule, ...] | None = None) -> DataFrame:
    """doc_id, n_words, the base columns, `detections`, labels and score."""
    chosen = chosen or rules()
    body = lowered(F.btrim(F.regexp_replace(text_of(), BREAK, " "), F.lit(" ")))
    texts = docs.select("doc_id", body.alias("body"))
    line = F.concat(F.lit(" "), F.col("body"), F.lit(" "))
    blanks = F.octet_length("body") - F.octet_length(F.replace("body", F.lit(" "), F.lit("")))
    n_words = F.when(F.col("body") == "", 0).otherwise(blanks + 1).cast("bigint")
    gated = texts.select("doc_id", n_words.alias("n_words"), F.when(_able(line, chosen), F.col("body")).alias("body"))
    has = F.col("body").isNotNull()
    n, first, last, base = _base(F.split("body", " ", -1))
    found = gated.select(
        "doc_id", "n_words", F.when(has, n).otherwise(F.lit(0)).cast("bigint").alias("n_base"), F.when(has, first).cast("bigint").alias("first_word"), F.when(has, last).cast("bigint").alias("last_word"),
        F.when(has, base).otherwise(F.array().cast("array<string>")).alias("base"), F.when(has, let(line, lambda x: detections(x, chosen))).otherwise(F.array().cast(_KEPT)).alias("detections"),
    )
    best = F.array_min(F.transform("detections", lambda d: d["priority"]))
    worth = F.lit(0.0)
    for k in sorted(SCORES, reverse=True):
        worth = F.when(best == k, SCORES[k]).otherwise(worth)
    score = F.greatest(F.coalesce(worth, F.lit(0.0)), F.when(F.col("n_base") > 0, SCORES[3]).otherwise(0.0))
    labels = F.array_sort(F.array_distinct(F.concat(F.col("base"), F.transform("detections", lambda d: d["label"]))))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.cast("double").alias("score"), "detections")
