"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a window of as many consecutive words as the notice has, anywhere in the whole text (a shorter text is one block), as
the set of its words; so wrapped notices are found, and the words of a long line don't add up to a notice by chance.  A
template is the set of words of a notice.  A block matches if it holds at least ``THRESHOLD`` of the template's words and
more of them than any template of another label has.

1. Count the templates' words over all texts; this global order, rare words first, sorts each template.
2. A block with the needed overlap holds one of the first ``|template| - need + 1`` words (prefix filter); the words of the
   template from the first match on are enough (position filter); the words that any block around that word could have hold
   enough of the template (length filter).  Only then are the blocks around it compared.

Texts without any of the prefix words are set aside by one pattern before they are cut into words.  The templates are
fixed, so the prefix index has a proven bound and is broadcast; everything else streams through the scan.
Base phrases are found at their places in the whole text, across lines.
"""

from __future__ import annotations

import re
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textcols import WORD, az_lower, az_lower_all, keyed, with_found, words_of

#: Share of a template's words that a block must hold.
THRESHOLD = 0.9
# Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# License notices and their labels.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Released under the BSD 3-Clause License"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("proprietary", "Copyright. All rights reserved. No part of this publication may be reproduced"),
]


def template_words(text: str) -> list[str]:
    return sorted(set(re.findall(WORD, "".join(c.lower() if c.isascii() else c for c in text))))


def _word_counts(rows: DataFrame, words: list[str]) -> dict[str, int]:
    """How often each template word stands in all texts; as many rows as the templates have words reach the driver."""
    word = rows.select(F.explode(words_of(F.col("body"))).alias("w")).select(F.lower("w").alias("w"))
    return {r.w: r.n for r in word.where(F.col("w").isin(words)).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}


def _holding(body: Column, patterns: list[str]) -> Column:
    """A first look at the bytes: whether any of the patterns, letters in either case, stands in a text."""
    return body.rlike("(?i)" + "|".join(patterns))


def _places(rows: DataFrame, phrases: dict[str, str]) -> DataFrame:
    """(id, mark, at, label): where the words of a phrase stand consecutively."""
    gap = WORD.replace("[^", "[")
    some = rows.where(_holding(F.col("body"), [gap.join(p.split()) for p in phrases]))
    words = some.select("id", "mark", az_lower_all(words_of(F.col("body"))).alias("ws"))

    def at(words: list[str]):
        return lambda i: reduce(lambda a, b: a & b, (F.coalesce(F.get("ws", i + j) == w, F.lit(False)) for j, w in enumerate(words)))

    index = F.sequence(F.lit(0), F.size("ws"))

    def places(phrase: str, label: str) -> Column:
        return F.transform(F.filter(index, at(phrase.split())), lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))

    found = [places(p, label) for p, label in phrases.items()]
    return words.select("id", "mark", F.explode(F.concat(*found)).alias("p")).select("id", "mark", "p.at", "p.label")


def needed(templates: list[tuple[str, str]], threshold: float, apart: bool = True) -> list[tuple[str, list[str], int, int]]:
    """(label, words, need, length of the notice) of each template; with ``apart`` need exceeds what templates of other labels share."""
    sets = [(label, template_words(text), len(re.findall(WORD, text))) for label, text in templates]
    out = []
    for label, ws, n in sets:
        alike = max((len(set(ws) & set(other)) for name, other, _ in sets if name != label), default=0) if apart else 0
        out.append((label, ws, max(1, ceil(threshold * len(ws) - 1e-9), min(len(ws), alike + 1)), n))
    return out


def block_matches(rows: DataFrame, templates: list[tuple[str, str]], threshold: float, apart: bool = True) -> DataFrame:
    """(id, mark, label, containment) of every template that a block meets, with the largest containment in one block."""
    sets = needed(templates, threshold, apart)
    counts = _word_counts(rows, sorted({w for _, ws, _, _ in sets for w in ws}))
    index = []
    for label, ws, need, n_words in sets:
        order = sorted(ws, key=lambda w: (counts.get(w, 0), w))
        index += [(w, label, order, need, n_words) for i, w in enumerate(order[: len(order) - need + 1]) if len(order) - i >= need]
    table = rows.sparkSession.createDataFrame(index, "w string, label string, template array<string>, need int, words int")
    heads = sorted({w for w, *_ in index})
    span = max((n for *_, n in index), default=1)
    texts = rows.where(_holding(F.col("body"), heads)).select("id", "mark", az_lower_all(words_of(F.col("body"))).alias("ws"))
    at = F.filter(F.sequence(F.lit(0), F.size("ws")), lambda i: F.coalesce(F.get("ws", i).isin(heads), F.lit(False)))
    around = F.transform(at, lambda i: F.struct(F.get("ws", i).alias("w"), F.slice("ws", F.greatest(i - span + 2, F.lit(1)), F.least(i + 1, F.lit(span)) + span - 1).alias("near")))
    met = texts.select("id", "mark", F.explode(around).alias("p")).select("id", "mark", "p.w", "p.near").join(F.broadcast(table), "w")
    met = met.where(F.size(F.array_intersect("template", "near")) >= F.col("need"))
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.size("near")), lambda i: F.size(F.array_intersect("template", F.slice("near", i, F.col("words"))))))
    held = met.withColumn("held", best).where("held >= need")
    return held.select("id", "mark", "label", (F.col("held") / F.size("template")).alias("containment"))


def license_scan(
    docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, phrases: dict[str, str] = PHRASES,
    id_col: str = "doc_id", text_col: str = "text", apart: bool = True,
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``n_base`` counts all places of base phrases, ``first_word`` and ``last_word`` are their smallest and largest start
    (words from 0; null without one).  ``labels`` holds the base labels and those of matching templates, distinct, sorted
    and joined by commas.  ``score`` is 1 with a base phrase, else the largest containment of a matching template, else
    0.  ``apart`` keeps templates of different labels apart that differ in few words (GPL 2 and 3).  A null or empty text has
    no words and no labels.  Repeated rows are answered each; other columns are ignored.
    """
    rows = keyed(docs, id_col, text_col)
    base = _places(rows, phrases).select("id", "mark", "label", F.lit(1.0).alias("containment"), "at")
    both = base.unionByName(block_matches(rows, templates, threshold, apart), allowMissingColumns=True)
    # A text that repeats in several rows with one id counts its places once.
    once = both.groupBy("id", "mark", "label", "at").agg(F.max("containment").alias("containment"))
    placed = F.col("at").isNotNull()
    found = once.groupBy("id", "mark").agg(
        F.count("at").alias("n_base"), F.min("at").alias("first_word"), F.max("at").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(placed, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"), F.max("containment").alias("score"),
    )
    rows = rows.select("id", "mark", F.size(words_of(F.col("body"))).cast("long").alias("n_words"))
    return with_found(rows, found).select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long"),
        F.col("last_word").cast("long"), F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
