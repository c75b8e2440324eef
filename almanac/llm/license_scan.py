"""License scans: exact set-similarity join of text blocks with license notices, in DataFrame functions only.

A block is a window of twice a stride of words, every stride, so any notice of up to as many words lies whole in some
block. Notices are of classes by length, each with its stride: STRIDE words, or that doubled as often as needed, so a
notice may be a whole license. A block meets a notice when it contains at least THRESHOLD of the notice's distinct words. Words are ordered by how
often the corpus holds them, rarest first; a pair is verified only if it shares a word within both prefixes that this
order and the threshold leave (prefix filter), the block has enough of the notices' words (length filter), and the
places of the shared word leave enough words after it (positional filter). All three lose no pair.

Notices of kindred licenses differ in a word or two, which containment cannot tell apart, and a short one may lack just
the word that names its license. A notice may therefore have a mark, a pattern of what names its license, as "gnu
affero" or "mit license"; a pair that meets counts only if the block, with the MARGIN words around it, holds the mark.

Edge cases: null and empty texts have no words, no labels and score 0; a notice cut by a block's edge is found in the
next block; equal rows give equal results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases whose consecutive words count as places, with their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

_PLAIN_GNU = " gnu (?!affero |lesser |library )"

# The two parts of a license that is often given without its first sentence.
_MIT_GRANT = (
    "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
    "copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"
)
_MIT_TERMS = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
    "fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other "
    "liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
)

# Public license notices (first sentences or parts), with the labels that containment gives and, where other
# licenses' notices come near, what marks the license. Words of a text stand between single spaces.
NOTICES = [
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", " (?:gnu affero|affero general) "),
    ("apache-2.0", "licensed under the apache license version 2 0", " apache "),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at apache org", " apache "),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", " attribution (?!non|share|no )"),
    ("cc-by-nc", "licensed under cc by nc 4 0", " by nc (?!sa |nd )"),
    ("cc-by-sa", "licensed under cc by sa 4 0", " by sa "),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights to this work"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", _PLAIN_GNU + "(?!general public license (?:version |v )?v?[12] )"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", _PLAIN_GNU),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "licensed under the gnu lesser general public license", " (?:lesser|library) general "),
    ("mit", "released under the mit license", " mit licen[cs]e "),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", _MIT_GRANT),
    ("mit", _MIT_TERMS),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", " mozilla (?!public license (?:version |v )?v?1 )"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
#: Words between the blocks of the shortest class of notices; a block has twice as many.
STRIDE = 24
#: Words on each side of a block where the rest of a mark may stand.
MARGIN = 4
THRESHOLD = 0.8
#: Tasks that the copies of one text are dealt over.
SALTS = 32

#: What separates words, once letters are lower case.
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _joined(text: Column) -> Column:
    """The text's words with one space around each. Lower-casing letters beyond A-Z too changes no word's bounds."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _GAP, " ")), F.lit(" "))


def _words(joined: str = "joined") -> Column:
    return F.when(F.length(joined) > 2, F.split(F.trim(F.col(joined)), " ")).otherwise(F.array().cast("array<string>"))


def _places(phrase: str) -> Column:
    """Starts of ``phrase`` in the column ``words``; only texts that hold it are walked."""
    parts = phrase.split()
    same = " AND ".join(f"get(words, i + {k}) = '{p}'" for k, p in enumerate(parts))
    walk = F.expr(f"filter(transform(sequence(0, size(words) - 1), i -> IF({same}, i, -1)), x -> x >= 0)")
    return F.when(F.col("joined").contains(f" {phrase} "), walk).otherwise(F.array().cast("array<int>"))


def word_counts(docs: DataFrame, words: list[str]) -> dict[str, int]:
    """How often all of ``docs`` holds each of ``words``; the result is as long as ``words``."""
    each = docs.select(F.explode(F.split(_joined(F.col("text")), " ")).alias("word")).filter(F.col("word").isin(words))
    return {w: n for w, n in each.groupBy("word").count().collect()}


def stride_of(notice: str) -> int:
    """The stride of a notice's class."""
    stride = STRIDE
    while stride < len(notice.split()):
        stride *= 2
    return stride


def scan_licenses(docs: DataFrame, notices: list[tuple[str, ...]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score for each row of ``docs``.

    ``notices``: labels with texts and, where needed, marks.
    """
    notices = [(*x, "")[:3] for x in (notices if notices is not None else NOTICES)]
    if any(not t.split() for _, t, _ in notices):
        raise ValueError("a notice has words")
    docs = docs.select("doc_id", "text")
    spark = docs.sparkSession
    vocabulary = sorted({w for _, t, _ in notices for w in t.split()})
    seen = word_counts(docs, vocabulary)
    order = sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order, 1)}
    entries = []
    for k, (label, text, mark) in enumerate(notices):
        ranks = sorted(rank[w] for w in set(text.split()))
        need = max(1, math.ceil(threshold * len(ranks) - 1e-9))
        entries += [(stride_of(text), r, at, k, label, need, ranks, mark) for at, r in enumerate(ranks[: len(ranks) - need + 1])]
    prefixes = spark.createDataFrame(entries, "stride int, word_rank int, notice_at int, notice int, label string, need int, notice_ranks array<int>, mark string")
    first_words = sorted({order[r - 1] for _, r, *_ in entries})

    # texts that hold no prefix word of any notice can meet none
    held = F.col("joined").rlike(f" (?:{'|'.join(first_words)}) ")
    texts = docs.select("doc_id", "text", _joined(F.col("text")).alias("joined")).withColumns({"key": F.xxhash64("text"), "key2": F.xxhash64(F.lit(1), "text")})
    candidates = texts.filter(held).dropDuplicates(["key", "key2"]).select("key", "key2", _words().alias("words"))
    known = F.array(*[F.lit(w) for w in order])
    strides = F.array(*[F.lit(x) for x in sorted({stride_of(t) for _, t, _ in notices})])
    cut = candidates.select("key", "key2", "words", F.explode(strides).alias("stride"))
    cut = cut.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.col("stride"))).alias("start"))
    around = F.slice("words", F.greatest(F.col("start") + 1 - MARGIN, F.lit(1)), 2 * F.col("stride") + 2 * MARGIN)
    around = F.concat(F.lit(" "), F.array_join(around, " "), F.lit(" ")).alias("around")
    blocks = cut.select("key", "key2", "stride", F.slice("words", F.col("start") + 1, 2 * F.col("stride")).alias("words"), around)
    ranks = F.array_sort(F.array_distinct(F.transform(F.array_intersect("words", known), lambda w: F.array_position(known, w).cast("int"))))
    shared = blocks.select("key", "key2", "stride", ranks.alias("ranks"), "around").filter(F.size("ranks") > 0).select("key", "key2", "stride", "ranks", "around", F.posexplode("ranks").alias("at", "word_rank"))
    left = F.least(F.size("notice_ranks") - F.col("notice_at"), F.size("ranks") - F.col("at"))
    met = shared.join(F.broadcast(prefixes), ["stride", "word_rank"]).filter((F.size("ranks") >= F.col("need")) & (left >= F.col("need")))
    common = F.size(F.array_intersect("ranks", "notice_ranks"))
    met = met.filter(common >= F.col("need")).filter((F.col("mark") == "") | F.regexp_like("around", F.col("mark"))).groupBy("key", "key2").agg(F.collect_set("label").alias("found"), F.max(common / F.size("notice_ranks")).alias("best"))

    # copies of one text may be many: they are dealt over SALTS tasks, each with that text's labels
    met = met.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt")
    rows = texts.select("doc_id", "key", "key2", salt, "joined", _words().alias("words"))
    keys = ("doc_id", "key", "key2", "salt")
    rows = rows.select(*keys, F.size("words").alias("n_words"), *[_places(p).alias(f"p{i}") for i, p in enumerate(PHRASES)])
    every = F.concat(*[F.col(f"p{i}") for i in range(len(PHRASES))])
    labels = F.array_compact(F.array(*[F.when(F.size(f"p{i}") > 0, F.lit(v)) for i, v in enumerate(PHRASES.values())]))
    rows = rows.select(*keys, F.col("n_words").cast("long").alias("n_words"), every.alias("places"), labels.alias("base"))
    rows = rows.select(
        *keys,
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        "base",
    )
    join = lambda c: F.concat_ws(",", F.array_sort(F.array_distinct(c)))
    base_score = F.when(F.size("base") > 0, 1.0).otherwise(0.0)
    return rows.join(met, ["key", "key2", "salt"], "left").select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        join("base").alias("base_labels"),
        join(F.concat("base", F.coalesce("found", F.array().cast("array<string>")))).alias("labels"),
        F.greatest(F.coalesce("best", F.lit(0.0)), base_score).alias("score"),
    )
