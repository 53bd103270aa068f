"""License scan: phrases by position, and an exact set-similarity join of text blocks with license templates.

The blocks that meet a template of n words are the windows of 2n consecutive words at every n-th word of the whole text,
so any n words, wrapped over lines or not, lie within one. Tokens of the templates are put in global order by the number
of texts of the whole corpus that hold them, rarest first. A block meets a template when it holds at least
``ceil(threshold * size)`` of the template's distinct tokens, the words that name the license among them. Candidates are
the blocks around the template's prefix (one of its ``size - needed + 1`` rarest tokens must occur), then come length (a
block needs ``needed`` tokens) and position (what follows the first common token on either side must suffice); the
survivors are counted exactly. Templates are a short list given by the caller; only their tokens' counts reach the
driver. Everything is DataFrame functions, row by row, without a shuffle of texts.

Null and empty texts have no words, labels or blocks and score 0. Repeated rows are repeated; an input column with the
name of an output is replaced.
"""

from __future__ import annotations

import math
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from chronocohort.llm.carried import ROW, packed, unpacked

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_GAP = re.compile(GAP)

# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}



class Template(NamedTuple):
    """A notice of a license. A block without one of ``names`` does not meet it."""

    label: str
    text: str
    names: tuple[str, ...] = ()


TEMPLATES = [
    Template("mit", "Released under the MIT License.", ("mit",)),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    Template("apache", "Licensed under the Apache License, Version 2.0.", ("apache",)),
    Template("gpl", "This work is licensed under the GNU General Public License, version 3.", ("gnu", "general")),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", ("gnu", "general")),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0.", ("cc", "nc")),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ("commons", "attribution")),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("mozilla",)),
    Template("all-rights-reserved", "Copyright. All rights reserved.", ("rights", "reserved")),
]


def words_of(text: str) -> list[str]:
    """Words of a template, by the rule for texts."""
    return [w for w in _GAP.sub(" ", text.translate(str.maketrans(UPPER, LOWER))).split(" ") if w]


def tokens_of(text: str) -> list[str]:
    """Distinct words of a template."""
    return sorted(set(words_of(text)))


def spaced(text: Column) -> Column:
    """A-Z lower-cased, words joined by single spaces."""
    return F.btrim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP, " "), F.lit(" "))


def phrase_starts(words: Column, phrase: str) -> Column:
    """Word positions from 0 where the phrase's words stand consecutively."""
    parts = phrase.split(" ")
    last = F.size(words) - len(parts)

    def here(i: Column) -> Column:
        met = F.get(words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            met = met & (F.get(words, i + k) == part)
        return met

    empty = F.array().cast("array<int>")
    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), here)).otherwise(empty)


def text_counts(df: DataFrame, text: str, tokens: list[str]) -> dict[str, int]:
    """Texts of the corpus that hold each template token. One row per token reaches the driver."""
    held = F.array_distinct(F.filter(F.split(spaced(F.col(f"`{text}`")), " "), lambda w: w.isin(tokens)))
    rows = df.select(F.explode(held).alias("token")).groupBy("token").count().collect()
    return {r["token"]: r["count"] for r in rows}


def _containment(own: list[int], need: int, names: list[int]):
    """Share of a template's tokens in a block of sorted ranks; 0 where a filter, a name or the exact count falls short."""
    template, prefix = F.array(*map(F.lit, own)), F.array(*map(F.lit, own[: len(own) - need + 1]))

    def share(block: Column) -> Column:
        first = F.array_min(F.array_intersect(block, prefix))
        after = F.least(len(own) - F.array_position(template, first), F.size(block) - F.array_position(block, first)) + 1
        common = F.size(F.array_intersect(block, template))
        named = F.lit(True)
        for name in names:
            named = named & F.array_contains(block, F.lit(name))
        short = (F.size(block) < need) | F.coalesce(after < need, F.lit(True))
        return F.when(short, 0.0).when((common >= need) & named, common / len(own)).otherwise(0.0)

    return share


class TemplateIndex:
    """Templates as sorted ranks in the corpus-wide order of tokens, rarest first, with the tokens each needs."""

    def __init__(self, templates: list[Template], counts: dict[str, int], threshold: float):
        tokens = sorted({w for t in templates for w in tokens_of(t.text)})
        self.words = sorted(tokens, key=lambda w: (counts.get(w, 0), w))
        order = {w: i for i, w in enumerate(self.words)}
        self.labels = [t.label for t in templates]
        self.lengths = [len(words_of(t.text)) for t in templates]
        self.ranks = [sorted(order[w] for w in tokens_of(t.text)) for t in templates]
        self.needs = [max(1, math.ceil(threshold * len(r) - 1e-9)) for r in self.ranks]
        self.names = [[order[w] for w in t.names] for t in templates]

    def prefix(self, i: int) -> list[str]:
        """The rarest tokens of a template, of which a block that meets it holds one."""
        return [self.words[r] for r in self.ranks[i][: len(self.ranks[i]) - self.needs[i] + 1]]

    def prefix_tokens(self) -> list[str]:
        return sorted({w for i in range(len(self.ranks)) for w in self.prefix(i)}, key=self.words.index)

    def marks(self, words: Column) -> Column:
        """Where a text holds a token of any prefix, with the token."""
        prefixes = self.prefix_tokens()
        return F.filter(F.transform(words, lambda w, i: F.when(w.isin(prefixes), F.struct(i.alias("at"), w.alias("word")))), lambda m: m.isNotNull())

    def blocks(self, i: int, words: Column, marks: Column) -> Column:
        """Blocks around a template's prefix tokens, as sorted ranks of tokens of all templates."""
        n, prefix, order = self.lengths[i], self.prefix(i), F.array(*map(F.lit, self.words))
        near = F.transform(F.filter(marks, lambda m: m["word"].isin(prefix)), lambda m: F.floor(m["at"] / n).cast("int"))
        # A word lies in the block that begins at or before it and in the one before.
        starts = F.array_distinct(F.flatten(F.transform(near, lambda k: F.array(k, F.greatest(k - 1, F.lit(0))))))

        def ranked(k: Column) -> Column:
            known = F.array_distinct(F.filter(F.slice(words, k * n + 1, F.lit(2 * n)), lambda w: w.isin(self.words)))
            return F.sort_array(F.transform(known, lambda w: F.array_position(order, w).cast("int") - 1))

        return F.transform(starts, ranked)

    def shares(self, words: Column, marks: Column) -> Column:
        """For each template, the largest containment that meets the threshold, else 0."""
        best = []
        for i, (own, need, names) in enumerate(zip(self.ranks, self.needs, self.names)):
            best.append(F.coalesce(F.array_max(F.transform(self.blocks(i, words, marks), _containment(own, need, names))), F.lit(0.0)))
        return F.array(*best)


def scan(
    df: DataFrame, text: str = "text", phrases: dict[str, str] | None = None, templates: list[Template] | None = None, threshold: float = 0.8
) -> DataFrame:
    """Add n_words, n_base, first_word, last_word, base_labels, labels and score (1 with a phrase, else containment)."""
    phrases, templates = phrases or PHRASES, templates or TEMPLATES
    outputs = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    kept = [c for c in df.columns if c.lower() not in outputs]
    counts = text_counts(df, text, sorted({w for t in templates for w in tokens_of(t.text)}))
    index = TemplateIndex(templates, counts, threshold)
    source = F.col(f"`{text}`")
    padded = F.col("__padded")
    hit, probe = F.lit(False), F.lit(False)
    for phrase in phrases:
        hit = hit | padded.contains(f" {phrase} ")
    for token in index.prefix_tokens():
        probe = probe | padded.contains(f" {token} ")
    row = df.select(packed(kept), F.concat(F.lit(" "), spaced(source), F.lit(" ")).alias("__padded"))
    # Columns of their own: inside a lambda the text would be split again for every word.
    row = row.select("*", F.when(hit, 1).alias("__hit"), F.when(probe, 1).alias("__probe"))
    row = row.withColumn("__words", F.when(F.col("__hit").isNotNull() | F.col("__probe").isNotNull(), F.split(F.btrim(padded, F.lit(" ")), " ")))
    row = row.withColumn("__marks", F.when(F.col("__probe").isNotNull(), index.marks(F.col("__words"))))
    row = row.withColumn("__shares", F.when(F.size("__marks") > 0, index.shares(F.col("__words"), F.col("__marks"))))
    starts = F.array(*(phrase_starts(F.col("__words"), p) for p in phrases))
    row = row.select(
        ROW, "__shares",
        F.when(F.length(padded) == 2, 0).otherwise(F.length(padded) - F.length(F.replace(padded, F.lit(" "), F.lit(""))) - 1).cast("bigint").alias("n_words"),
        F.when(F.col("__hit").isNotNull(), starts).alias("__starts"),
    )
    places = F.flatten("__starts")
    base = F.array_compact(F.array(*(F.when(F.size(F.get("__starts", F.lit(k))) > 0, label) for k, label in enumerate(phrases.values()))))
    base = F.array_sort(F.array_distinct(base))
    similar = F.array_compact(F.array(*(F.when(F.get("__shares", F.lit(k)) > 0, label) for k, label in enumerate(index.labels))))
    return row.select(
        *unpacked(kept), "n_words",
        F.when(F.col("__starts").isNull(), 0).otherwise(F.size(places)).cast("bigint").alias("n_base"),
        F.array_min(places).cast("bigint").alias("first_word"), F.array_max(places).cast("bigint").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, similar))), ",").alias("labels"),
        F.when(F.size(places) > 0, 1.0).otherwise(F.coalesce(F.array_max("__shares"), F.lit(0.0))).alias("score"),
    )
