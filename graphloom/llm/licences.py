"""Licence scan by ordered signature rules, in DataFrame code only.

A text is its words, lower case and without punctuation, so line breaks,
comment signs and brackets do not hide a licence.  A rule is a regular
expression over up to SPAN words; its keyword is the word it starts with.
Texts without any keyword are done after one look; in others each keyword's
place gives a window of SPAN words, and only that keyword's rules are tried
there, from the window's start.  So every place of every rule is found,
wherever it stands.

Overlapping detections are resolved by priority and containment: one falls if
another of the same or a higher priority covers its words (of equal ones the
earlier rule stays).  Sorted by their start that is one pass which remembers
how far the detections of each priority reach.

Places of the base phrases always count, whatever covers them.
"""

from __future__ import annotations

import json
from functools import cache
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates words, once A-Z are lower case; most words of a detection.
SEPARATORS, SPAN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", 24
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases whose places are counted, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

NAMED, VERSIONED, GRANTED, WORDED = 1, 2, 3, 4
#: How sure a detection of a priority is.
CONFIDENCE = {NAMED: 0.5, VERSIONED: 0.8, GRANTED: 0.9, WORDED: 1.0}

#: Licences by name: label, the words of the name as an expression, versions
#: (of which "" stands for a licence that has none).
NAMES = (
    ("gpl", "gnu (?:general public licen[cs]e|gpl)", "1 2 3"),
    ("lgpl", "gnu (?:lesser|library) (?:general public licen[cs]e|gpl)", "2 2.1 3"),
    ("agpl", "gnu affero (?:general public licen[cs]e|gpl)", "3"),
    ("gfdl", "gnu free documentation licen[cs]e", "1.1 1.2 1.3"),
    ("gpl", "gpl(?: licen[cs]e)?", "2 3"),
    ("lgpl", "lgpl(?: licen[cs]e)?", "2 2.1 3"),
    ("agpl", "agpl(?: licen[cs]e)?", "3"),
    ("apache", "apache (?:software )?licen[cs]e", "1.0 1.1 2.0 2"),
    ("mpl", "mozilla public licen[cs]e", "1.0 1.1 2.0"),
    ("epl", "eclipse public licen[cs]e", "1.0 2.0"),
    ("cddl", "common development and distribution licen[cs]e", "1.0 1.1"),
    ("cpl", "common public licen[cs]e", "1.0"),
    ("eupl", "european union public licen[cs]e", "1.0 1.1 1.2"),
    ("cecill", "cecill(?: free software)? licen[cs]e(?: agreement)?", "1 2 2.1"),
    ("osl", "open software licen[cs]e", "1.0 2.0 2.1 3.0"),
    ("afl", "academic free licen[cs]e", "1.2 2.0 2.1 3.0"),
    ("artistic", "artistic licen[cs]e", "1.0 2.0"),
    ("php", "php licen[cs]e", "3.0 3.01"),
    ("psf", "python software foundation licen[cs]e(?: agreement)?", "2"),
    ("zpl", "zope public licen[cs]e", "2.0 2.1"),
    ("lppl", "latex project public licen[cs]e", "1.0 1.3a 1.3c"),
    ("ofl", "(?:sil )?open font licen[cs]e", "1.0 1.1"),
    ("bsl", "boost software licen[cs]e", "1.0"),
    ("busl", "business source licen[cs]e", "1.1"),
    ("sspl", "server side public licen[cs]e", "1"),
    ("elastic", "elastic licen[cs]e", "2.0"),
    ("odbl", "open (?:data commons open )?database licen[cs]e", "1.0"),
    ("odc-by", "open data commons attribution licen[cs]e", "1.0"),
    ("pddl", "public domain dedication and licen[cs]e", "1.0"),
    ("apsl", "apple public source licen[cs]e", "1.0 2.0"),
    ("ms-pl", "microsoft public licen[cs]e", ""),
    ("ms-rl", "microsoft reciprocal licen[cs]e", ""),
    ("upl", "universal permissive licen[cs]e", "1.0"),
    ("mulan", "mulan (?:psl|permissive software licen[cs]e)", "1 2"),
    ("openssl", "openssl licen[cs]e", ""),
    ("openldap", "openldap public licen[cs]e", "2.8"),
    ("postgresql", "postgresql licen[cs]e", ""),
    ("ncsa", "university of illinois(?: ncsa)? open source licen[cs]e", ""),
    ("mit", "(?:mit|expat|x11|mit x11) licen[cs]e", ""),
    ("mit-0", "mit no attribution(?: licen[cs]e)?", ""),
    ("isc", "isc licen[cs]e", ""),
    ("zlib", "zlib(?: libpng)? licen[cs]e", ""),
    ("wtfpl", "do what the fuck you want to public licen[cs]e", "2"),
    ("unlicense", "unlicense", ""),
    ("0bsd", "(?:zero clause bsd|0bsd)(?: licen[cs]e)?", ""),
    ("bsd-2-clause", "(?:bsd 2 clause|two clause bsd|simplified bsd|freebsd)(?: simplified)?(?: licen[cs]e)?", ""),
    ("bsd-3-clause", "(?:bsd 3 clause|three clause bsd|new bsd|modified bsd|revised bsd)(?: new)?(?: licen[cs]e)?", ""),
    ("bsd-4-clause", "(?:bsd 4 clause|four clause bsd|original bsd)(?: licen[cs]e)?", ""),
    ("bsd", "(?:bsd|berkeley software distribution) licen[cs]e", ""),
    ("cc0", "(?:cc0|cc zero|creative commons(?: cc0| zero)(?: universal)?)(?: licen[cs]e)?", "1.0"),
    ("cc-by", "(?:cc by|creative commons attribution)(?: (?:international|unported))?(?: licen[cs]e)?", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-sa", "(?:cc by sa|creative commons attribution share ?alike)(?: (?:international|unported))?(?: licen[cs]e)?", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nd", "(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s?)(?: (?:international|unported))?(?: licen[cs]e)?", "2.0 3.0 4.0"),
    ("cc-by-nc", "(?:cc by nc|creative commons attribution non ?commercial)(?: (?:international|unported))?(?: licen[cs]e)?", "2.0 2.5 3.0 4.0"),
    ("cc-by-nc-sa", "(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: (?:international|unported))?(?: licen[cs]e)?", "2.0 2.5 3.0 4.0"),
    ("cc-by-nc-nd", "(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s?)(?: (?:international|unported))?(?: licen[cs]e)?", "2.0 2.5 3.0 4.0"),
)

#: Passages of licence texts and notices, from a word on that is not too common.
TEXTS = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "neither the name of (?:[^ ]+ ){1,8}nor the names of its contributors may be used"),
    ("bsd-4-clause", "advertising materials mentioning features or use of this software must display"),
    ("gpl", "free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
    ("lgpl", "free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e"),
    ("agpl", "free software you can redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e"),
    ("gpl", "received a copy of the gnu general public licen[cs]e"),
    ("lgpl", "received a copy of the gnu (?:lesser|library) general public licen[cs]e"),
    ("agpl", "received a copy of the gnu affero general public licen[cs]e"),
    ("gpl-or-later", "version [0-9]+ of the licen[cs]e or (?:at your option )?any later version"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e"),
    ("apache", "except in compliance with the licen[cs]e you may obtain a copy"),
    ("mpl", "source code form is subject to the terms of the mozilla public licen[cs]e"),
    ("mpl", "contents of this file are subject to the (?:mozilla|netscape) public licen[cs]e"),
    ("epl", "accompanying materials are made available under the terms of the eclipse public licen[cs]e"),
    ("zlib", "provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("bsl", "permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("unlicense", "free and unencumbered software released into the public domain"),
    ("public-domain", "(?:released|dedicated|placed) (?:in|in to|into|to) the public domain"),
    ("cc0", "extent possible under law (?:[^ ]+ ){1,10}waived all copyright"),
    ("proprietary", "rights reserved"),
    ("proprietary", "(?:unauthorised|unauthorized) (?:copying|reproduction|distribution|use) of this (?:file|software|document|material|work)"),
    ("proprietary", "(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", "part of this (?:publication|work|book|document) may be reproduced"),
    ("non-commercial", "(?:noncommercial|non commercial|personal) use only"),
)


class Rule(NamedTuple):
    """keyword: the word its matches start with.  base: a base phrase's rule."""

    keyword: str
    pattern: str
    label: str
    priority: int
    base: bool


def _first_words(expression: str) -> list[str]:
    """The words that an expression's matches start with: of each choice in
    front, without a character class there; an optional word in front and the
    one behind it."""
    if not expression.startswith("(?:"):
        return [expression.split(" ")[0].split("(")[0]]
    depth, end = 0, 0
    for i, c in enumerate(expression):
        depth += (c == "(") - (c == ")")
        if not depth:
            end = i
            break
    rest, out, level, part = expression[end + 1 :], [], 0, ""
    for c in expression[3:end] + "|":
        if c == "|" and not level:
            out += _first_words(part)
            part = ""
        else:
            level += (c == "(") - (c == ")")
            part += c
    return out + _first_words(rest[1:]) if rest.startswith("?") else out


@cache
def rules() -> tuple[Rule, ...]:
    """All rules in order: base phrases, passages, then for every licence its
    tag, its grants with and without a version, and its name."""
    out = [Rule(p.split(" ")[0], f"^{p}(?: |$)", label, NAMED, True) for p, label in BASE.items()]

    def add(expression: str, label: str, priority: int) -> None:
        out.extend(Rule(word, f"^{expression}(?: |$)", label, priority, False) for word in dict.fromkeys(_first_words(expression)))

    for label, sentence in TEXTS:
        add(sentence, label, WORDED)
    lead = "under (?:the |a )?(?:terms of (?:the )?)?"
    for label, name, versions in NAMES:
        for version in versions.split():
            dotted = version.replace(".", " ")
            exact = f"{label}-{version}"
            add(f"spdx licen[cs]e identifier {label.replace('-', ' ')} {dotted}(?: only| or later)?", exact, GRANTED)
            add(f"{lead}{name} (?:version )?v?{dotted}", exact, GRANTED)
            add(f"{name} (?:version )?v?{dotted}", exact, VERSIONED)
        add(f"spdx licen[cs]e identifier {label.replace('-', ' ')}", label, GRANTED)
        add(f"{lead}{name}", label, VERSIONED)
        add(name, label, NAMED)
    return tuple(out)


def _bound(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """array<string> of a text's words; empty for null and empty texts."""
    plain = F.trim(F.regexp_replace(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), SEPARATORS, " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def detections(w: Column) -> Column:
    """array<struct> of all matches of all rules in words w, sorted: start and
    negated last word, negated priority, number of the rule, label, base."""
    keys = list(dict.fromkeys(r.keyword for r in rules()))
    kind = "array<array<struct<pattern string, label string, priority int, number int, base boolean>>>"
    table = [[{"pattern": r.pattern, "label": r.label, "priority": r.priority, "number": i, "base": r.base} for i, r in enumerate(rules()) if r.keyword == k] for k in keys]
    names, by_key = F.array(*map(F.lit, keys)), F.from_json(F.lit(json.dumps(table)), kind)
    places = F.array_compact(F.transform(w, lambda x, i: F.when(F.array_contains(names, x), i)))

    def at(i: Column) -> Column:
        window = F.array_join(F.slice(w, i + 1, F.lit(SPAN)), " ")
        tried = _bound(window, lambda s: F.transform(F.get(by_key, F.array_position(names, F.get(w, i)).cast("int") - 1), lambda r: F.struct(F.regexp_substr(s, r["pattern"]).alias("m"), r.alias("r"))))
        last = lambda m: i + F.size(F.split(F.trim(m), " ")) - 1
        found = F.filter(tried, lambda t: t["m"].isNotNull())
        return F.transform(found, lambda t: F.struct(i.alias("start"), (-last(t["m"])).alias("back"), (-t["r"]["priority"]).alias("rank"), t["r"]["number"].alias("number"), t["r"]["label"].alias("label"), t["r"]["base"].alias("base")))

    none = F.array().cast("array<struct<start int, back int, rank int, number int, label string, base boolean>>")
    return F.when(F.arrays_overlap(w, names), F.array_sort(F.flatten(F.transform(places, at)))).otherwise(none)


def standing(found: Column) -> Column:
    """struct<labels, score> of the detections that no other one of the same or
    a higher priority covers; score is the highest confidence, 0 without any."""
    levels = sorted(CONFIDENCE)
    start = F.struct(*(F.lit(-1).alias(f"to{p}") for p in levels), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"))

    def step(state: Column, d: Column) -> Column:
        end, priority = -d["back"], -d["rank"]
        # all that came before start no later; -1 is before any word
        reach = F.greatest(F.lit(-1), *(F.when(priority <= p, state[f"to{p}"]).otherwise(-1) for p in levels))
        stays = end > reach
        sure = F.get(F.array(*(F.lit(CONFIDENCE[p]) for p in levels)), priority - 1)
        return F.struct(
            *(F.when(priority == p, F.greatest(state[f"to{p}"], end)).otherwise(state[f"to{p}"]).alias(f"to{p}") for p in levels),
            F.when(stays, F.array_union(state["labels"], F.array(d["label"]))).otherwise(state["labels"]).alias("labels"),
            F.when(stays, F.greatest(state["score"], sure)).otherwise(state["score"]).alias("score"),
        )

    return F.aggregate(found, start, step, lambda s: F.struct(s["labels"], s["score"]))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row.

    n_base: places of base phrases; first_word, last_word: their smallest and
    largest start, null without any.  base_labels: labels of those; labels:
    those of the detections that stand as well; both distinct, sorted, joined
    by commas, '' without any.  Null and empty texts have no words.  Repeated
    rows stay; other columns are left behind; an empty table gives an empty one.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), words(F.col(text)).alias("w"))
    rows = rows.select("doc_id", F.size("w").cast("long").alias("n_words"), detections(F.col("w")).alias("found"))
    rows = rows.withColumns({"base": F.filter("found", lambda d: d["base"]), "stand": standing(F.col("found"))})
    listed = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    starts, own = F.transform("base", lambda d: d["start"]), F.transform("base", lambda d: d["label"])
    return rows.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        listed(own).alias("base_labels"),
        listed(F.concat(own, F.col("stand.labels"))).alias("labels"),
        F.col("stand.score").alias("score"),
    )


def oracle() -> str:
    """The same rows in DuckDB's SQL: all matches of all rules, then the
    detections that no other one of the same or a higher priority covers."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({i}, {quoted(r.keyword)}, {quoted(r.pattern)}, {quoted(r.label)}, {r.priority}, {r.base}, {CONFIDENCE[r.priority]})" for i, r in enumerate(rules()))
    return rf"""
WITH t AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
r(number, keyword, pattern, label, priority, base, sure) AS (VALUES {values}),
p AS (SELECT row, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM t),
k AS (SELECT p.row, p.i, r.*, array_to_string(t.w[p.i + 1 : p.i + {SPAN}], ' ') AS s FROM p JOIN r ON p.word = r.keyword JOIN t ON t.row = p.row),
d AS (SELECT row, i AS first, i + len(string_split(trim(regexp_extract(s, pattern, 0)), ' ')) - 1 AS last, number, label, priority, base, sure FROM k WHERE regexp_matches(s, pattern)),
s AS (SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM d e WHERE e.row = d.row AND e.first <= d.first AND e.last >= d.last AND e.priority >= d.priority
  AND (e.first < d.first OR e.last > d.last OR e.priority > d.priority OR e.number < d.number))),
b AS (SELECT row, count(*) AS n, min(first) AS a, max(first) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM d WHERE base GROUP BY row),
a AS (SELECT row, string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM (SELECT row, label FROM s UNION SELECT row, label FROM d WHERE base) GROUP BY row),
c AS (SELECT row, max(sure) AS sure FROM s GROUP BY row)
SELECT t.doc_id, len(t.w)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.a::BIGINT AS first_word, b.z::BIGINT AS last_word, coalesce(b.l, '') AS base_labels,
  coalesce(a.l, '') AS labels, coalesce(c.sure, 0)::DOUBLE AS score FROM t LEFT JOIN b USING (row) LEFT JOIN a USING (row) LEFT JOIN c USING (row)
"""
