"""Licence scans with a positional index of rare words.

A word's IDF is taken over all texts. Every template is posted, with the word's place in it, under its rarest words only: so
many of the highest IDF that the others hold less than AGREE of the template's whole IDF; a text that agrees with AGREE of a
template therefore holds a posted word of it at the right place, and none is missed. A text's licence words are looked up
from the highest IDF down to that cut. Each posting says where the template would begin in the text; these beginnings are
intersected by template, and at each one the words that stand at their place are weighed. A template is found where they
reach AGREE of its IDF and all its key phrases stand in the text. All of it happens in a text's own row, by DataFrame
expressions; only the words' counts are shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonoframe.llm.common import let

# The base phrases and their labels
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Fixed values: (label, words of a notice or of a licence's telling passage, key phrases that must stand in the text)
TEMPLATES = [
    ("mit-notice", "released under the mit license", ("mit license",)),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted", "without restriction")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("for any purpose with or without fee",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2")),
    ("apache-2.0-text", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("except in compliance with the license", "apache org licenses")),
    ("gpl-3", "licensed under the gnu general public license version 3", ("general public license", "version 3")),
    ("gpl-2", "licensed under the gnu general public license version 2", ("general public license", "version 2")),
    ("gpl-or-later", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license", "free software foundation")),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
]
VOCABULARY = sorted({x for _, t, _ in TEMPLATES for x in t.split(" ")})
AGREE = 0.7  # share of a template's IDF that must agree on one beginning
SPLIT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STRIDE = 1 << 40  # a beginning is a number: template * STRIDE + HALF + place of its first word
HALF = 1 << 39


def words(text: Column) -> Column:
    """Runs of digits, ASCII letters and characters beyond ASCII, with A-Z lower-cased; empty for null."""
    return F.filter(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), SPLIT), lambda w: w != "")


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def starts(w: Column, phrase: str) -> Column:
    """Places where the phrase's words stand consecutively."""
    parts = phrase.split(" ")

    def here(x, i):
        test = x == parts[0]
        for k, p in enumerate(parts[1:], 1):
            test = test & (F.get(w, i + k) == p)
        return F.when(F.coalesce(test, F.lit(False)), i)

    return F.filter(F.transform(w, here), lambda i: i.isNotNull())


def base_places(w: Column) -> Column:
    """array<struct<at int, label string>>: every place of a base phrase."""
    none = F.array().cast("array<struct<at:int,label:string>>")
    first = _strings(p.split(" ")[0] for p in PHRASES)
    return F.when(F.arrays_overlap(w, first), F.concat(*[F.transform(starts(w, p), _labelled(label)) for p, label in PHRASES.items()]).cast("array<struct<at:int,label:string>>")).otherwise(none)


def _labelled(label: str):
    return lambda i: F.struct(i.alias("at"), F.lit(label).alias("label"))


def idf_of(rows: DataFrame, total: int) -> dict[str, float]:
    """IDF over all texts of every template word; words that no text holds have the highest. rows: (w array<string>)."""
    counts = rows.select(F.explode(F.array_intersect("w", _strings(VOCABULARY))).alias("x")).groupBy("x").count()
    held = {r["x"]: r["count"] for r in counts.collect()}  # at most as many rows as the templates have words
    return {x: math.log((total + 1.0) / (held.get(x, 0) + 0.5)) for x in VOCABULARY}


def index(idf: dict[str, float]) -> tuple[dict[str, list[int]], list[float]]:
    """(beginnings that a word at place 0 of a text points to, whole IDF of each template)."""
    posted: dict[str, list[int]] = {}
    whole = []
    for number, (_, text, _) in enumerate(TEMPLATES):
        places = list(enumerate(text.split(" ")))
        whole.append(sum(idf[x] for _, x in places))
        rest = whole[-1]
        for x in sorted({x for _, x in places}, key=lambda x: (-idf[x], x)):
            if rest < AGREE * whole[-1] * (1 - 1e-9):
                break
            for at, y in places:
                if x == y:
                    posted.setdefault(x, []).append(number * STRIDE + HALF - at)
                    rest -= idf[x]
    return posted, whole


def found_templates(w: Column, idf: dict[str, float]) -> Column:
    """array<struct<label string, share double>>: templates found in the words, with the highest share of their IDF that agrees."""
    posted, whole = index(idf)
    kind = "array<struct<label:string,share:double>>"
    if not posted:
        return F.array().cast(kind)
    rare = _strings(sorted(posted, key=lambda x: (-idf[x], x)))
    postings = F.create_map(*[c for x, ps in posted.items() for c in (F.lit(x), F.array(*[F.lit(p).cast("long") for p in ps]))])
    seen = F.filter(F.transform(w, lambda x, i: F.when(F.array_contains(rare, x), F.struct(x.alias("w"), i.cast("long").alias("at")))), lambda s: s.isNotNull())
    beginnings = F.array_distinct(F.flatten(F.transform(seen, lambda s: F.transform(F.element_at(postings, s["w"]), lambda p: p + s["at"]))))

    def judged(b: Column) -> Column:
        rows = [_weighed(w, b, number, label, text.split(" "), keys, idf, whole[number]) for number, (label, text, keys) in enumerate(TEMPLATES)]
        return F.filter(F.array(*rows), lambda r: r.isNotNull()).cast(kind)

    return F.when(F.arrays_overlap(w, rare), let(beginnings, judged)).otherwise(F.array().cast(kind))


def _weighed(w: Column, beginnings: Column, number: int, label: str, template: list[str], keys: tuple[str, ...], idf: dict[str, float], whole: float) -> Column:
    text, weights = _strings(template), F.array(*[F.lit(idf[x]) for x in template])
    at = F.transform(F.filter(beginnings, lambda b: F.floor(b / STRIDE) == number), lambda b: (b - (number * STRIDE + HALF)).cast("int"))

    def share(b: Column) -> Column:
        agrees = F.transform(text, lambda x, i: F.when(F.coalesce((b + i >= 0) & (F.get(w, b + i) == x), F.lit(False)), F.get(weights, i)).otherwise(0.0))
        return F.aggregate(agrees, F.lit(0.0), lambda s, x: s + x) / F.lit(whole)

    best = F.least(F.array_max(F.transform(at, share)), F.lit(1.0))
    held = F.lit(True)
    for k in keys:
        held = held & (F.size(starts(w, k)) > 0)
    return let(best, lambda s: F.when(F.coalesce(s >= AGREE - 1e-9, F.lit(False)) & held, F.struct(F.lit(label).alias("label"), s.alias("share"))))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, base, labels, score): a row per input row.

    base: array<struct<at int, label string>>, every place of a base phrase; labels: the method's; score: 1 where a base
    phrase stands, else the highest share of the IDF of a template found, 0 where there is none. Null and wordless texts have
    no words; repeated rows count in the IDF and are scanned alike; null ids are kept; other columns are ignored; an empty
    table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), words(F.col(text_col)).alias("w"))
    idf = idf_of(rows, docs.count())
    read = let(F.col("w"), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), base_places(w).alias("base"), found_templates(w, idf).alias("found")))
    rows = rows.select("doc_id", read.alias("r")).select("doc_id", "r.n_words", "r.base", "r.found")
    share = F.coalesce(F.array_max(F.transform("found", lambda s: s["share"])), F.lit(0.0))
    return rows.select("doc_id", "n_words", "base", F.transform("found", lambda s: s["label"]).alias("labels"), F.when(F.size("base") > 0, 1.0).otherwise(share).alias("score"))


def digest(found: DataFrame) -> DataFrame:
    """A row per row of scan's result, places and labels as numbers and text; without a base phrase first_word and last_word are null."""
    own = F.array_distinct(F.transform("base", lambda s: s["label"]))
    at = F.transform("base", lambda s: s["at"].cast("long"))
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"), F.array_join(F.sort_array(own), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_distinct(F.concat(own, "labels"))), ",").alias("labels"), "score",
    )
