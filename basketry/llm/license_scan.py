"""License scans by diagonal voting, in DataFrame functions only.

Every text's rolling word k-grams are joined by hash to the positions they
have in the license templates, and the words behind the hash are compared at
once; grams that hold no template's words are dropped before they become rows.
A hit at word ``pos`` of a text and ``place`` of a template votes for the
diagonal ``pos - place``.  The places hit are collected, as bits, per (text,
template, diagonal); neighbouring diagonals, a few inserted or missing words
apart, are merged into spans of at most ``SPREAD`` diagonals; a span that holds
enough of the template's different places, each compared word by word, is a
find, its share of them the score.  A fragment that a text repeats is one place
however often it stands there.

Short phrases have two-word grams and are found where a single diagonal has
every vote, that is where the phrase's words stand consecutively.  Notices
have three-word grams and may differ in some words.

Templates are parameters with a few hundred grams and are broadcast; texts are
never: a text's votes meet by a row number that its own task gave, in one
shuffle, and one marker gram per text keeps texts without hits.

Null text is empty: no words, no finds.  Texts are read whole; repeated rows
are scanned one by one; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Characters between words, after A-Z are lowered.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrase: bool = False  # found only where its words stand consecutively

    @property
    def words(self) -> list[str]:
        return "".join(c if c.isalnum() else " " for c in self.text.lower()).split()


PHRASES = (
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
)
# opening words of public license notices, as published
NOTICES = (
    Template("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit"),
)
TEMPLATES = PHRASES + NOTICES
#: Diagonals at most so far apart are merged; least share of a notice's grams in a find.
NEIGHBOURS, COVER = 4, 0.5
#: Diagonals of a span: words inserted or missing in all.  A find of up to half as many
#: lies whole in one of two overlapping rows of spans.
SPREAD = 16
#: Words are never empty, so this gram marks the text itself.
_MARKER = -1


def words_of(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, BREAKS), "")


def template_grams(spark: SparkSession, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(template, place, a, b, c, grams): c is null in the two-word grams of phrases."""
    rows = [(_MARKER, 0, "", "", None, 1)]
    for number, t in enumerate(templates):
        words, k = t.words, 2 if t.phrase else 3
        n = len(words) - k + 1
        if n > 62:
            raise ValueError(f"a template of more than 62 grams: {t.label}")  # its places are bits of a long
        rows += [(number, i, words[i], words[i + 1], None if t.phrase else words[i + 2], n) for i in range(n)]
    table = spark.createDataFrame(rows, "template int, place int, a2 string, b2 string, c2 string, grams int")
    return table.withColumn("gram", F.xxhash64("a2", "b2"))


def grams(df: DataFrame, templates: tuple[Template, ...] = TEMPLATES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rolling grams whose two first words stand first and second in some gram
    of a template, and one marker row per text: ``row, doc_id, n_words, at,
    gram, a, b, c``.  Any other gram meets no template, so it is left in its
    text; the rows carry three words each, never a text."""
    texts = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("doc_id"), words_of(F.col(text_column)).alias("words"))
    known = [(w[i], w[i + 1]) for t in templates for w in [t.words] for i in range(len(w) - (1 if t.phrase else 2))]
    firsts, seconds = (sorted(set(x)) for x in zip(*known, strict=True)) if known else ([], [])
    size, word = F.size("words"), lambda i: F.get("words", i)
    every = F.when(size > 1, F.sequence(F.lit(0), size - 2)).otherwise(F.array().cast("array<int>"))
    some = F.filter(every, lambda i: word(i).isin(firsts) & word(i + 1).isin(seconds))
    gram = lambda at, a, b, c: F.struct(at.alias("at"), F.xxhash64(a, b).alias("gram"), a.alias("a"), b.alias("b"), c.alias("c"))
    marker = gram(F.lit(0), F.lit(""), F.lit(""), F.lit(None).cast("string"))
    met = F.transform(some, lambda i: gram(i, word(i), word(i + 1), word(i + 2)))
    rolled = texts.select("row", "doc_id", size.cast("bigint").alias("n_words"), F.concat(F.array(marker), met).alias("met"))
    # never empty; inline() would have Spark make the grams once more to test for that
    return rolled.select("row", "doc_id", "n_words", F.inline_outer("met"))


def hits(df: DataFrame, templates: tuple[Template, ...] = TEMPLATES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per gram of a text that stands in a template, and one marker
    row per text: ``row, doc_id, n_words, template, diagonal, place, grams``."""
    known = F.broadcast(template_grams(df.sparkSession, templates).withColumnRenamed("gram", "gram2"))
    same = (F.col("gram") == F.col("gram2")) & (F.col("a") == F.col("a2")) & (F.col("b") == F.col("b2")) & (F.col("c2").isNull() | (F.col("c2") == F.col("c")))
    met = grams(df, templates, id_column, text_column).join(known, same)
    return met.select("row", "doc_id", "n_words", "template", (F.col("at") - F.col("place")).cast("bigint").alias("diagonal"), "place", "grams")


def spans(hits: DataFrame, templates: tuple[Template, ...] = TEMPLATES, neighbours: int = NEIGHBOURS) -> DataFrame:
    """Merged diagonals: ``row, doc_id, n_words, template, start, cover``; the
    markers' rows have template -1."""
    place = F.expr("shiftleft(1L, place)")
    # dealt by text once, which serves every grouping and window below
    voted = hits.repartition("row").groupBy("row", "doc_id", "n_words", "template", "diagonal", "grams").agg(F.bit_or(place).alias("places"))
    phrases = [i for i, t in enumerate(templates) if t.phrase] + [_MARKER]
    apart = F.col("template").isin(phrases)
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    # phrases stay apart; a notice's diagonals join the one before if near
    new = apart | (F.col("diagonal") - F.lag("diagonal", 1, None).over(along) > neighbours)
    group = F.sum(F.when(F.coalesce(new, F.lit(True)), 1).otherwise(0)).over(along)
    first = F.min("diagonal").over(Window.partitionBy("row", "template", "group"))
    grouped = voted.withColumn("group", group).withColumn("first", first)
    # two rows of spans, half a span apart
    shift = F.explode(F.when(apart, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(SPREAD // 2))))
    cut = grouped.withColumn("shift", shift).withColumn("part", F.floor((F.col("diagonal") - F.col("first") + F.col("shift")) / SPREAD))
    merged = cut.groupBy("row", "doc_id", "n_words", "template", "grams", "group", "shift", "part").agg(F.min("diagonal").alias("start"), F.bit_or("places").alias("places"))
    return merged.select("row", "doc_id", "n_words", "template", "start", (F.bit_count("places") / F.col("grams")).alias("cover"))


def scan(df: DataFrame, templates: tuple[Template, ...] = TEMPLATES, cover: float = COVER, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, words, base finds (places of phrases) with their first and
    last word, base labels, all labels, and the best cover as score."""
    found = spans(hits(df, templates, id_column, text_column), templates)
    phrase = F.col("template").isin([i for i, t in enumerate(templates) if t.phrase])
    notice = ~phrase & (F.col("template") != _MARKER)
    label = F.element_at(F.array(*(F.lit(t.label) for t in templates)), F.greatest(F.col("template"), F.lit(0)) + 1)
    base = phrase & (F.col("cover") == 1.0)
    labels = lambda which: F.array_join(F.array_sort(F.collect_set(F.when(which, label))), ",")
    known = base | (notice & (F.col("cover") >= cover))
    return found.groupBy("row", "doc_id", "n_words").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        labels(base).alias("base_labels"), labels(known).alias("labels"),
        F.coalesce(F.max(F.when(base | notice, F.col("cover"))), F.lit(0.0)).alias("score"),
    ).select(F.col("doc_id").alias(id_column), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
