"""Licence notices in texts, by the Dice coefficient over word bigrams. DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

THRESHOLD = 0.8

# Public licence notices, by name.
TEMPLATES = {
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "All-rights-reserved": "All rights reserved.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "BSD-style": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Proprietary": "All rights reserved. Unauthorized copying of this file, via any medium is strictly prohibited.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalized(text: Column) -> Column:
    """A-Z in lower case, runs of other characters than letters and digits as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), r"[^\p{L}\p{N}]+", " "))


def bigrams(words: Column) -> Column:
    """The distinct pairs of neighbouring words, space-joined; a single word stands for itself."""
    pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.when(F.size(words) > 1, pairs).otherwise(words))


def _template_bigrams(content: str) -> list[str]:
    words = "".join(c.lower() if c.isascii() and c.isalnum() else c if c.isalnum() else " " for c in content).split()
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:])] or words
    return list(dict.fromkeys(pairs))


def telling_words(grams: list[str], threshold: float) -> set[tuple[str, ...]]:
    """Words, or pairs of words, of a template of which every passage that reaches the threshold holds at least one.

    Such a passage shares at least a share t / (2 - t) of the template's bigrams. Words of four letters and
    more are taken, the longest first, until the bigrams without any of them are fewer than that;
    where they do not suffice, so are the longest of the bigrams that are left.
    """
    left, found = list(grams), set()
    least = len(grams) * threshold / (2 - threshold) - 1e-9
    while left and len(left) >= least:
        words = {w for g in left for w in g.split() if len(w) >= 4}
        term = (min(words, key=lambda w: (-len(w), w)),) if words else tuple(max(left, key=len).split())
        found.add(term)
        left = [g for g in left if not set(term) <= set(g.split())]
    return found


def passages(text: Column) -> Column:
    """The lines of a text and its paragraphs of several lines, as structs of kind, number (from 0) and content."""
    lines = F.transform(
        F.split(text, "\n"), lambda x, i: F.struct(F.lit("line").alias("kind"), i.alias("number"), x.alias("content"))
    )
    paragraphs = F.transform(
        F.split(text, r"\n[ \t\r]*\n"),
        lambda x, i: F.struct(F.lit("paragraph").alias("kind"), i.alias("number"), x.alias("content")),
    )
    return F.concat(lines, F.filter(paragraphs, lambda p: F.contains(p["content"], F.lit("\n"))))


def scan(
    docs: DataFrame, key: str = "doc_id", text: str = "text", templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD
) -> DataFrame:
    """``key, kind, number, license, dice`` of every line and paragraph that is a licence notice.

    A passage is compared with templates over the sets of their word bigrams, 2 |A and B| / (|A| + |B|). That
    can reach the threshold t only if the sizes a, b fulfil a <= b (2 - t) / t and the reverse, so
    a passage meets only the templates listed under its size, by an equi-join with a broadcast list that is
    bounded by the templates. Before that, texts and passages leave that hold none of the words of
    which a passage must have one to share enough bigrams with a template, then passages of
    no such size or without any bigram of a template. The best template is kept, ties go to the first name.

    Null and empty texts have no passages. Repeated rows give repeated results. The whole text is read; texts of
    one very long line are one passage, whose size excludes it. Other columns are not looked at.
    """
    spark = docs.sparkSession
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    ratio = (2 - threshold) / threshold
    by_size, known, words = [], {}, set()
    for name in sorted(templates):
        grams = _template_bigrams(templates[name])
        known |= dict.fromkeys(grams)
        words |= telling_words(grams, threshold)
        by_size += [(n, name, grams) for n in range(max(1, math.ceil(len(grams) / ratio - 1e-9)), math.floor(len(grams) * ratio + 1e-9) + 1)]
    sizes = sorted({n for n, _, _ in by_size})
    candidates = spark.createDataFrame(by_size, "size int, license string, template array<string>")

    def telling(content: Column) -> Column:
        """Whether a text holds one of the words at all; lower-casing other letters than A-Z hides none."""
        small = F.lower(content)
        holds = lambda term: reduce(lambda a, b: a & b, [F.contains(small, F.lit(w)) for w in term])
        return reduce(lambda a, b: a | b, map(holds, sorted(words)), F.lit(False))

    found = docs.filter(telling(F.col(text))).select(key, F.explode(passages(F.col(text))).alias("p"))
    found = found.filter(telling(F.col("p.content"))).select(key, "p.kind", "p.number", normalized(F.col("p.content")).alias("content"))
    # A passage of n distinct bigrams has more words than n, and no fewer characters.
    found = found.filter((F.col("content") != "") & (F.length("content") >= sizes[0])) if sizes else found.filter(F.lit(False))
    found = found.withColumn("bigrams", bigrams(F.split("content", " "))).drop("content")
    found = found.filter(
        F.size("bigrams").between(sizes[0] if sizes else 0, sizes[-1] if sizes else 0)
        & F.arrays_overlap("bigrams", F.array(*[F.lit(g) for g in known]) if known else F.array().cast("array<string>"))
    )
    # The row's place tells repeated rows apart.
    found = found.withColumn("_row", F.monotonically_increasing_id()).withColumn("size", F.size("bigrams"))
    dice = F.lit(2.0) * F.size(F.array_intersect("bigrams", "template")) / (F.size("bigrams") + F.size("template"))
    scored = found.join(F.broadcast(candidates), "size").withColumn("dice", dice).filter(F.col("dice") >= threshold)
    best = Window.partitionBy("_row").orderBy(F.desc("dice"), "license")
    return (
        scored.withColumn("_place", F.row_number().over(best)).filter("_place = 1")
        .select(key, "kind", "number", "license", "dice")
    )


def template_rows(templates: Mapping[str, str] = TEMPLATES) -> list[tuple[str, list[str]]]:
    """Names and bigrams of templates, as the scan uses them."""
    return [(name, _template_bigrams(templates[name])) for name in sorted(templates)]
