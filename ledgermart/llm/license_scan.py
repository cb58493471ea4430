"""License scans by an exact set-similarity join (operator 3).

A template is a known license notice of m words; a text block is a window
of ``m / threshold`` words, at every start, across line ends.  A template
is reported where a block holds at least ``threshold`` of its distinct words
(containment), so a wrapped notice is found, and words scattered over a long
line are not.

Only words of the templates' vocabulary can add to an overlap, so a text is
reduced to these, with their places.  Windows are found through segments:
runs of twice as many such words as the longest window can have, one
beginning every longest window, so each window lies whole in one of them.
Segments and
templates are joined exactly, pruned by three filters on words in one global
order, rarest first: the word sets share a word of both prefixes, the
segment is long enough, and the places of the shared prefix word leave room
for the needed overlap.  In the few segments that hold enough of a template
the windows are then counted.  Word counts for the order come from all
segments; the vocabulary and the inverted index of template prefixes are bounded by the template list.

Base phrases (places, labels) are found beside it and always reported.

Defined cases: null text is empty; empty texts have no words and no labels;
null ids are kept; repeated rows each get a row; ties in word counts are
ordered by the word; an empty table gives an empty result; other columns
are ignored, so their names cannot clash.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermart.llm.common import col, letter_words, text_of
from ledgermart.session import materialize

#: Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: License notices: label and the words of the notice.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software "
            "and associated documentation files"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the "
            "gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
            "provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc0", "dedicated to the public domain under the creative commons cc0 waiver"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without "
            "fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
THRESHOLD = 0.9


def _array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def base_phrases(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 phrases: dict[str, str] = PHRASES) -> DataFrame:
    """Word count, places of the base phrases, and the words of each row."""
    places = "(?i) (" + "|".join(phrases) + ")(?= )"
    d = docs.select(col(id_col).alias("doc_id"), text_of(text_col).alias("body"))
    lowered = F.translate("body", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    d = d.select("doc_id", letter_words(lowered).alias("words"))
    d = d.select("doc_id", "words", F.size("words").cast("long").alias("n_words"),
                 F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")).alias("joined"))
    d = d.withColumn("found", F.transform(F.regexp_extract_all("joined", F.lit(places), F.lit(1)), F.lower))
    some = F.size("found") > 0

    def words_before(pattern):
        before = F.regexp_extract("joined", pattern, 1)
        return F.when(some, F.length(before) - F.length(F.replace(before, F.lit(" "), F.lit("")))).cast("long")
    labels = F.array()
    for phrase, label in phrases.items():
        labels = F.concat(labels, F.when(F.array_contains("found", phrase), F.array(F.lit(label))).otherwise(F.array()))
    return d.select("doc_id", "words", "n_words", F.size("found").cast("long").alias("n_base"),
                    words_before(f"(?s)^(.*?){places.replace('(?i)', '(?i:')})").alias("first_word"),
                    words_before(f"(?s)^(.*){places.replace('(?i)', '(?i:')})").alias("last_word"),
                    F.sort_array(F.array_distinct(labels.cast("array<string>"))).alias("base_labels"))


def vocabulary(templates) -> list[str]:
    return sorted({w for _, text in templates for w in text.split()})


def needed(n: int, threshold: float) -> int:
    return max(1, math.ceil(round(threshold * n, 9)))


def template_index(spark: SparkSession, templates, order: list[str], threshold: float) -> DataFrame:
    """Inverted index (token, place) of the template prefixes; as large as
    the template list, whatever the corpus."""
    rank = {w: i for i, w in enumerate(order)}
    entries = []
    for k, (label, text) in enumerate(templates):
        words = sorted(set(text.split()), key=rank.get)
        need = needed(len(words), threshold)
        for place, word in enumerate(words[:len(words) - need + 1]):
            entries.append(F.struct(F.lit(word).alias("token"), F.lit(k).alias("template"), F.lit(label).alias("label"),
                                    F.lit(place).alias("t_place"), F.lit(len(words)).alias("t_size"),
                                    F.lit(need).alias("need"), F.lit(window_words(text, threshold)).alias("window"),
                                    _array(words).alias("t_words")))
    return spark.range(1).select(F.inline(F.array(*entries)))


def _candidates(blocks: DataFrame, templates, threshold: float) -> DataFrame:
    """``blocks`` (``tokens``: distinct vocabulary words, and further columns)
    joined with the templates of which they hold enough words."""
    spark = blocks.sparkSession
    vocab = vocabulary(templates)
    least = min(needed(len(set(t.split())), threshold) for _, t in templates)
    # at most len(vocab) counts come to the driver
    counted = {r["token"]: r["n"] for r in blocks.select(F.explode("tokens").alias("token"))
               .groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = sorted(vocab, key=lambda w: (counted.get(w, 0), w))
    ranked = blocks.withColumn("b_words", F.array_intersect(_array(order), "tokens")).drop("tokens")
    ranked = ranked.withColumn("b_size", F.size("b_words"))
    prefix = ranked.select("*", F.posexplode(
        F.slice("b_words", F.lit(1), F.greatest(F.col("b_size") - least + 1, F.lit(0)))).alias("b_place", "token"))
    index = F.broadcast(template_index(spark, templates, order, threshold))  # bounded by the template list
    pairs = prefix.join(index, "token").filter(
        (F.col("b_size") >= F.col("need")) & (F.col("b_place") <= F.col("b_size") - F.col("need"))
        & (1 + F.least(F.col("b_size") - F.col("b_place") - 1, F.col("t_size") - F.col("t_place") - 1) >= F.col("need")))
    return pairs.withColumn("overlap", F.size(F.array_intersect("t_words", "b_words"))).filter(F.col("overlap") >= F.col("need"))


def contained_templates(blocks: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Join ``blocks(uid, tokens)`` (distinct vocabulary words of a block)
    with the templates: (uid, label, containment) of every block that
    holds enough of a template."""
    found = _candidates(blocks.select("uid", "tokens"), templates, threshold)
    return found.select("uid", "label", (F.col("overlap") / F.col("t_size")).alias("containment"))


def window_words(template: str, threshold: float) -> int:
    """The words of a block for a template."""
    return math.ceil(round(len(template.split()) / threshold, 9))


def vocabulary_places(words: Column, templates) -> Column:
    """The words of a text that some template has, with their places."""
    placed = F.transform(words, lambda w, i: F.struct(i.alias("at"), w.alias("word")))
    return F.filter(placed, lambda p: p["word"].isin(*vocabulary(templates)))


def segments(places: Column, templates, threshold: float) -> Column:
    """Runs of twice as many places as the longest window has words, one
    beginning every longest window; those with enough words for a template."""
    longest = max(window_words(t, threshold) for _, t in templates)
    least = min(needed(len(set(t.split())), threshold) for _, t in templates)
    starts = F.when(F.size(places) >= least, F.sequence(F.lit(0), F.floor((F.size(places) - 1) / longest).cast("int")))
    runs = F.transform(starts, lambda k: F.slice(places, k * longest + 1, 2 * longest))
    return F.filter(runs, lambda r: F.size(F.array_distinct(F.transform(r, lambda p: p["word"]))) >= least)


def _windows(places: Column, t_words: Column, window: Column) -> Column:
    """The most distinct words of a template in one window of a segment."""
    mine = F.filter(places, lambda p: F.array_contains(t_words, p["word"]))
    return F.array_max(F.transform(mine, lambda p: F.size(F.array_distinct(F.transform(
        F.filter(places, lambda q: (q["at"] >= p["at"]) & (q["at"] < p["at"] + window) & F.array_contains(t_words, q["word"])),
        lambda q: q["word"])))))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, templates=TEMPLATES,
                 threshold: float = THRESHOLD) -> DataFrame:
    """One row per document row: word and base counts, the sorted base
    labels and all labels as arrays, and the best containment (1 where a
    base phrase stands)."""
    rows = base_phrases(docs, id_col, text_col).withColumn("uid", F.monotonically_increasing_id())
    rows = rows.withColumn("places", vocabulary_places(F.col("words"), templates)).drop("words")
    rows = rows.withColumn("blocks", segments(F.col("places"), templates, threshold)).drop("places")
    rows = materialize(rows, "license-scan")
    blocks = rows.select("uid", F.explode("blocks").alias("places"))
    blocks = blocks.withColumn("tokens", F.array_distinct(F.transform("places", lambda p: p["word"])))
    near = _candidates(blocks, templates, threshold).withColumn("most", _windows(F.col("places"), F.col("t_words"), F.col("window")))
    found = near.filter(F.col("most") >= F.col("need")).select("uid", "label", (F.col("most") / F.col("t_size")).alias("containment"))
    per_row = found.groupBy("uid").agg(F.collect_set("label").alias("found"), F.max("containment").alias("best"))
    out = rows.drop("blocks").join(per_row, "uid", "left")
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels",
                      F.sort_array(F.array_union("base_labels", F.coalesce("found", F.array().cast("array<string>"))))
                      .alias("labels"),
                      F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))


def sql_templates() -> str:
    """The templates as SQL rows (number, label, distinct words, window), for a brute-force check."""
    return ", ".join(f"({i}, '{label}', {sorted(set(re.split(' ', text)))!r}, {window_words(text, THRESHOLD)})"
                     for i, (label, text) in enumerate(TEMPLATES))
