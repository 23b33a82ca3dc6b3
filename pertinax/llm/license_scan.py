"""License scan by diagonal voting (DataFrame functions only).

All rolling word 3-grams of a text are hashed and joined to the 3-grams of the templates (a
constant table of some thousand rows, broadcast).  A joined gram must also be equal word for
word, so a hash collision never counts.  A hit at word ``p`` of the text and word ``t`` of a
template lies on the diagonal ``p - t``: an unbroken copy puts all its hits on one diagonal, an
edited copy on a few neighbouring ones.

* votes: per (document, template, diagonal) a bit mask of the template grams that were hit, in as
  many longs as the longest template needs;
* merge: diagonals of a template at most ``SLACK`` apart form one span;
* verify: a span counts if the words its grams cover make up ``MIN_COVERAGE`` of the template
  and it is not stretched beyond ``MAX_STRETCH`` of its length.  A diagonal that alone covers
  that much counts too, whatever stands beside it.

A phrase (``exact``) counts only where one diagonal holds all its grams, that is, where all its
words stand consecutively.

One scan of the texts: each document also sends one row of its own, which carries its word count,
so documents without a hit come out of the same aggregation and texts are never shuffled.

Whole license texts (``licenses/``) are cut into parts of about PART words that share a label, so a
document that holds any stretch of a license gets its label.  A passage that two licenses share
gives both.

Defined results: a null text counts as empty; texts of fewer than three words have no grams and
no labels; repeated rows give one result row each; label strings are empty where nothing was
found; an empty table gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import and_
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pertinax.llm.common import col, lower_ascii

GRAM = 3
SLACK = 4
MIN_COVERAGE = 0.8
MAX_STRETCH = 1.5
#: Grams in one long of a mask.
BITS = 60
#: Words of the parts of a whole license text.
PART = 40
TEXTS = Path(__file__).with_name("licenses")
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    exact: bool = False
    #: A gram without which a span does not count (what tells two similar notices apart).
    key: str = ""


#: The phrases of the scan and their labels.
PHRASES = [
    Template("mit", "under the mit license", exact=True),
    Template("apache-2", "apache license version 2", exact=True),
    Template("cc-by-nc", "cc by nc", exact=True),
]

#: Notices of public licenses, and the parts of whole ones.
NOTICES = [
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of "
                    "this software and associated documentation files (the Software), to deal in the "
                    "Software without restriction"),
    Template("apache-2", "you may not use this file except in compliance with the License. You may "
                         "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, "
                    "are permitted provided that the following conditions are met"),
    Template("gpl-3", "licensed under the GNU General Public License, version 3",
             key="license version 3"),
    Template("gpl-2", "licensed under the GNU General Public License, version 2",
             key="license version 2"),
    Template("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public "
                    "License as published by the Free Software Foundation"),
    Template("lgpl", "under the terms of the GNU Lesser General Public License"),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("cc-by", "licensed under a Creative Commons Attribution 4.0 International License",
             key="commons attribution 4"),
    Template("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
             key="attribution sharealike 4"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
]


def parts(label: str, text: str) -> list[Template]:
    """A long text as templates of about PART words that follow one another."""
    ws = template_words(text)
    n = max(1, round(len(ws) / PART))
    cuts = [len(ws) * k // n for k in range(n + 1)]
    return [Template(label, " ".join(ws[a:b])) for a, b in zip(cuts, cuts[1:])]


def template_words(text: str) -> list[str]:
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return [w for w in re.split(SEPARATORS, lowered) if w]


NOTICES += [t for f in sorted(TEXTS.glob("*.txt")) for t in parts(f.stem, f.read_text("utf-8"))]


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _templates(spark: SparkSession, templates: list[Template]) -> tuple[DataFrame, DataFrame, int]:
    """The grams of the templates, their facts, and the longs of a mask."""
    split = [template_words(t.text) for t in templates]
    longs = max([1, *(-(-len(ws) // BITS) for ws in split)])
    grams, facts = [], []
    for i, (t, ws) in enumerate(zip(templates, split)):
        if len(ws) < GRAM:
            raise ValueError(f"template {t.label!r} has {len(ws)} words, not {GRAM} or more")
        own = [" ".join(ws[k:k + GRAM]) for k in range(len(ws) - GRAM + 1)]
        grams += [(i, k, gram) for k, gram in enumerate(own)]
        key = [0] * longs
        for at, gram in enumerate(own):
            if gram == t.key:
                key[at // BITS] |= 1 << at % BITS
        if t.key and not any(key):
            raise ValueError(f"the key of template {t.label!r} is not a gram of its text")
        facts.append((i, t.label, t.exact, len(ws), *key))
    # the gram of the row that every document sends for itself is empty
    positions = spark.createDataFrame([*grams, (-1, 0, "")], "template int, at int, template_gram string")
    positions = positions.withColumn("template_hash", F.xxhash64("template_gram"))
    keys = "".join(f", key{w} long" for w in range(longs))
    return positions, spark.createDataFrame(facts, f"template int, label string, exact boolean, n int{keys}"), longs


def _sum(columns: list[Column]) -> Column:
    return sum(columns[1:], columns[0])


def _covered(masks: list[Column]) -> Column:
    """Words that the grams of a mask cover."""
    out = []
    for w, mask in enumerate([*masks, F.lit(0).cast("long")] if len(masks) > 1 else masks):
        shifted = mask
        for k in range(1, GRAM):
            shifted = shifted.bitwiseOR(F.shiftleft(mask, k))
        if len(masks) > 1:   # what the shift carries from long to long
            shifted = shifted.bitwiseAND(F.lit((1 << BITS) - 1))
            for k in range(1, GRAM) if w else ():
                shifted = shifted.bitwiseOR(F.shiftright(masks[w - 1], BITS - k))
        out.append(F.bit_count(shifted))
    return _sum(out)


def scan(docs: DataFrame, templates: list[Template] | None = None, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score, spans`` (``spans``: the verified ones, ``label, first, last`` in words)."""
    positions, facts, longs = _templates(docs.sparkSession, PHRASES + NOTICES if templates is None else templates)
    text = col(text_col)
    doc = ["doc_id", "text_hash", "text_length", "n_words"]
    rows = docs.select(col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"),
                       F.length(text).alias("text_length"), words(text).alias("words"))
    starts = F.when(F.size("words") >= GRAM, F.sequence(F.lit(0), F.size("words") - GRAM)) \
        .otherwise(F.array().cast("array<int>"))
    rolling = F.transform(starts, lambda i: F.concat_ws(
        " ", *[F.get("words", i + k) for k in range(GRAM)]))
    grams = rows.select(*doc[:3], F.size("words").cast("long").alias("n_words"),
                        F.posexplode(F.concat(rolling, F.array(F.lit("")))).alias("pos", "gram"))
    hits = grams.join(F.broadcast(positions), (F.xxhash64("gram") == F.col("template_hash"))
                      & (F.col("gram") == F.col("template_gram")))
    names, keys = [f"mask{w}" for w in range(longs)], [f"key{w}" for w in range(longs)]
    masks = [F.col(m) for m in names]
    bit = F.expr(f"shiftleft(1L, at % {BITS})")
    votes = (hits.groupBy(*doc, "template", (F.col("pos") - F.col("at")).alias("diagonal"))
             .agg(*[F.bit_or(F.when(F.expr(f"at div {BITS}") == w, bit).otherwise(F.lit(0).cast("long"))).alias(m)
                    for w, m in enumerate(names)],
                  F.min("pos").alias("first"), (F.max("pos") + GRAM - 1).alias("last"),
                  F.count(F.lit(1)).alias("copies")))
    votes = votes.join(F.broadcast(facts), "template", "left")
    whole = _sum([F.bit_count(m) for m in masks]) == F.col("n") - GRAM + 1
    along = Window.partitionBy(*doc, "template").orderBy("diagonal")
    # an exact phrase is never merged: each of its diagonals is a span of its own
    apart = F.col("exact") | (F.col("diagonal") - F.lag("diagonal").over(along) > SLACK)
    spans = (votes.withColumn("start", F.when(F.coalesce(apart, F.lit(True)), 1).otherwise(0))
             .withColumn("span", F.sum("start").over(along))
             .groupBy(*doc, "template", "label", "exact", "n", *keys, "span")
             .agg(F.max(whole).alias("whole"), *[F.bit_or(m).alias(m) for m in names],
                  F.max(_covered(masks)).alias("alone"),
                  F.min("first").alias("first"), F.max("last").alias("last"),
                  F.max("copies").alias("copies")))
    merged = F.when(F.col("last") - F.col("first") + 1 <= F.col("n") * MAX_STRETCH,
                    _covered(masks)).otherwise(F.lit(0))
    coverage = F.greatest(F.col("alone"), merged) / F.col("n")
    base = F.col("exact") & F.col("whole")
    keyed = reduce(and_, [m.bitwiseAND(F.col(k)) == F.col(k) for m, k in zip(masks, keys)])
    verified = F.when(F.col("exact"), F.col("whole")).otherwise(keyed & (coverage >= MIN_COVERAGE))
    labels = lambda kept: F.array_join(F.array_sort(F.collect_set(F.when(kept, F.col("label")))), ",")
    return (spans.groupBy(*doc).agg(
        F.max(F.when(F.col("template") == -1, F.col("copies"))).alias("copies"),
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        labels(base).alias("base_labels"), labels(verified).alias("labels"),
        F.coalesce(F.max(F.when(verified, coverage)), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(verified, F.struct("label", "first", "last")))).alias("spans"))
        .withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
        .select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels",
                "score", "spans"))
