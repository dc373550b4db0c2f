"""Operator 4: licence scan by a positional rare-token index. Native: DataFrame functions only.

The index holds the words of licence templates (function words left out) with their postings
(template, position). Document frequencies of these words are counted over the whole corpus. Each
place where such a word stands in a file votes for the templates that have it, at the relative position
place - posting, with the weight of its IDF, so that rare words decide and common ones alone can't. The
share of a template is the heaviest run of votes on one relative position (give or take `SLACK`) over
the weight of all of its words; from `LEAST` on, and only if its mandatory key phrases stand in the
file as well, the template's label is added to the base labels. Key phrases hold the words that tell a
licence from its kin: a notice of the lesser licence has no key phrase of the general one.

Score: the largest share of the added labels; a base label's is half, and half its templates' share.

Plan: one pass counts frequencies (an aggregation of one row per licence word and task), one pass
scans; a file skips the positional part of each template of whose key phrases a word is missing. The index and the
frequencies are constants of the query, about 150 words, at any corpus size. A text's work is its
words times the few templates that it can hold; very long ones are one task's row, as any.

Row by row: null text counts as empty (0 words, no labels, score 0), repeated rows stay. Templates that
tie don't exclude each other.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow
from .spans import empty, let, literal, with_settled

#: What parts words of the contract: words are digits, lower-case letters and all beyond ASCII.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases and labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Licence notices: label, text, mandatory key phrases.
TEMPLATES: list[tuple[str, str, list[str]]] = [
    ("apache", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license you may obtain a copy of the license", ["apache license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["person obtaining a copy of this software"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("gpl", "this work is licensed under the gnu general public license version 3 you can redistribute it and or modify it under the terms as published by the free software foundation", ["gnu general public license"]),
    ("lgpl", "gnu lesser general public license as published by the free software foundation", ["lesser general public license"]),
    ("agpl", "gnu affero general public license as published by the free software foundation", ["affero general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["source and binary forms"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("cc-by-nc", "licensed under cc by nc 4 0 creative commons attribution noncommercial", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0 creative commons attribution sharealike", ["cc by sa"]),
    ("cc0", "dedicated to the public domain under the cc0 1 0 universal public domain dedication", ["cc0 1 0"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["use copy modify and or distribute"]),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied", ["substantial portions of the software"]),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ["redistributions in binary form must reproduce"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ["gnu general public license"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications", ["permission is granted to anyone to use this software"]),
    ("bsl", "boost software license version 1 0 permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ["boost software license"]),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0", ["eclipse public license"]),
    ("eupl", "licensed under the eupl european union public licence version 1 2 you may not use this work except in compliance with the licence", ["european union public licence"]),
    ("wtfpl", "do what the fuck you want to public license terms and conditions for copying distribution and modification", ["do what the fuck you want"]),
    ("cc-by-nd", "licensed under cc by nd 4 0 creative commons attribution noderivatives", ["cc by nd"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software released into the public domain"]),
]
#: Labels and their identifiers in a file's licence tag; more templates, by a rule.
TAGS = {"apache": "apache 2 0", "mit": "mit", "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "bsd": "bsd", "mpl": "mpl 2 0", "isc": "isc", "zlib": "zlib", "bsl": "bsl 1 0", "epl": "epl", "eupl": "eupl", "cc0": "cc0 1 0", "wtfpl": "wtfpl", "unlicense": "unlicense"}
TEMPLATES += [(label, f"spdx license identifier {tag}", [f"spdx license identifier {tag}"]) for label, tag in TAGS.items()]
SHORT = {"cc-by-nc": "cc by nc", "cc-by-sa": "cc by sa", "cc-by-nd": "cc by nd"}
TEMPLATES += [(label, words, [words]) for label, words in SHORT.items()]
#: Words too common to index.
COMMON = set("a an and any are as by for in into is it of on or that the this to use with without you may can not no be been at from 0 1 2 3 4 v".split())
SLACK, LEAST = 2, 0.6


def index() -> dict[str, list[tuple[int, int]]]:
    """word -> (template, position) postings."""
    out: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for k, (_, text, _) in enumerate(TEMPLATES):
        for i, w in enumerate(text.split()):
            if w not in COMMON:
                out[w].append((k, i))
    return dict(sorted(out.items()))


def frequencies(docs: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Number of documents, and of those that hold each licence word."""
    words = F.array_intersect(F.split(F.lower("text"), BETWEEN, -1), F.array(*map(F.lit, vocabulary)))
    held = docs.select(F.explode_outer(F.concat(words, F.array(F.lit("")))).alias("w")).groupBy("w").count().collect()
    n = {r.w: r["count"] for r in held}
    return n.pop("", 0), n


def strings(words: Iterable[str]) -> str:
    """A constant array of plain words."""
    return "array(" + ", ".join(f"'{w}'" for w in words) + ")"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    docs = narrow(docs)
    post = index()
    total, df = frequencies(docs, list(post))
    idf = {w: math.log(1 + (total + 0.5) / (df.get(w, 0) + 0.5)) for w in post}
    # base phrases first, then the key phrases of every template
    phrases, of = list(BASE), []
    for _, _, keys in TEMPLATES:
        of.append(range(len(phrases), len(phrases) + len(keys)))
        phrases += keys
    texts = f"array({', '.join(strings(p.split()) for p in phrases)})"
    vocabulary = sorted({*post, *" ".join(phrases).split()})
    # beyond A-Z, lower() changes neither where words end nor any letter into one of a phrase
    seen = with_settled(docs, words=f"split(lower(text), {literal(BETWEEN)}, -1)").drop("text")
    # what stands before the first and behind the last separator may be empty
    lead, trail = "CAST(words[0] = '' AS int)", "CAST(size(words) > 1 AND words[size(words) - 1] = '' AS int)"
    seen = with_settled(seen, words=f"slice(words, {lead} + 1, size(words) - {lead} - {trail})")
    # a phrase can only stand where all of its words do: most texts end here
    seen = with_settled(seen, n_words="CAST(size(words) AS bigint)", held=f"array_intersect(words, {strings(vocabulary)})")
    start = "filter(transform(words, (w, i) -> CASE WHEN w = p[0] AND slice(words, i + 1, size(p)) = p THEN i END), i -> i IS NOT NULL)"
    starts = f"transform({texts}, p -> CASE WHEN forall(p, x -> array_contains(held, x)) THEN {start} ELSE {empty('int')} END)"
    nothing = f"array_repeat({empty('int')}, {len(phrases)})"
    seen = with_settled(seen, starts=f"CASE WHEN size(held) > 0 THEN {starts} ELSE {nothing} END")
    seen = with_settled(seen, found="exists(starts, s -> size(s) > 0)")
    # where licence words stand, if any phrase does
    place = f"filter(transform(words, (w, i) -> CASE WHEN array_contains({strings(post)}, w) THEN struct(w AS w, i AS i) END), x -> x IS NOT NULL)"
    seen = with_settled(seen, places=f"CASE WHEN found THEN {place} ELSE {empty('struct<w:string,i:int>')} END").drop("words", "held")
    # each template's postings with weights, their sum, and which phrases it needs
    templates = []
    for k in range(len(TEMPLATES)):
        mine = {w: [i for t, i in ps if t == k] for w, ps in post.items() if any(t == k for t, _ in ps)}
        table = ", ".join(f"'{w}', array({', '.join(f'struct({i} AS p, {idf[w]!r}D AS x)' for i in at)})" for w, at in mine.items())
        whole = sum(idf[w] * len(at) for w, at in mine.items())
        templates.append(f"struct(map({table}) AS postings, {whole!r}D AS whole, array({', '.join(map(str, of[k]))}) AS keys)")
    votes = "array_sort(flatten(transform(places, q -> coalesce(transform(try_element_at(t.postings, q.w), v -> struct(q.i - v.p AS s, v.x AS x)), array()))))"
    # the heaviest run of sorted shifts in which neighbours are within the slack
    step = let(f"CASE WHEN v.s - a.at <= {SLACK} THEN a.run ELSE 0D END + v.x", "r", "struct(v.s AS at, r AS run, greatest(a.best, r) AS best)")
    best = f"aggregate({votes}, struct(-1000000 AS at, 0D AS run, 0D AS best), (a, v) -> {step}, a -> a.best)"
    share = f"CASE WHEN forall(t.keys, k -> size(starts[k]) > 0) THEN least(1D, {best} / t.whole) ELSE 0D END"
    seen = with_settled(seen, shares=f"CASE WHEN found THEN transform(array({', '.join(templates)}), t -> {share}) ELSE array_repeat(0D, {len(TEMPLATES)}) END")
    names = strings(label for label, _, _ in TEMPLATES)
    base = f"filter(transform({strings(BASE.values())}, (b, k) -> CASE WHEN size(starts[k]) > 0 THEN b END), b -> b IS NOT NULL)"
    seen = with_settled(seen, base=base, more=f"filter(transform({names}, (n, k) -> CASE WHEN shares[k] >= {LEAST}D THEN n END), n -> n IS NOT NULL)", at=f"flatten(slice(starts, 1, {len(BASE)}))")
    stated = f"transform(base, b -> 0.5D + 0.5D * array_max(transform({names}, (n, k) -> CASE WHEN n = b THEN shares[k] ELSE 0D END)))"
    return seen.selectExpr(
        "doc_id",
        "n_words",
        "CAST(size(at) AS bigint) AS n_base",
        "CAST(array_min(at) AS bigint) AS first_word",
        "CAST(array_max(at) AS bigint) AS last_word",
        "array_join(sort_array(array_distinct(base)), ',') AS base_labels",
        "array_join(sort_array(array_distinct(concat(base, more))), ',') AS labels",
        f"array_max(concat(array(0D), filter(shares, s -> s >= {LEAST}D), {stated})) AS score",
    )
