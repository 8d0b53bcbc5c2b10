"""License scans by diagonal voting.

Texts are lower-cased (A-Z) and cut into words; every rolling word k-gram of every document
is joined by its hash to the places of the same k-gram in the license templates.  A match
votes for the diagonal (place in the document minus place in the template), and votes are
added up per document, template and diagonal.

* A **phrase** (the base rules: a few words that name a license) is found where one diagonal
  has the votes of all its k-grams, k = ``PHRASE_GRAM``: its words stand there consecutively.
* Of a **notice** (a license's own wording), diagonals at most ``SLACK`` apart are merged into
  one band, so words left out or put in do not part a copy.  A band begins anew where its
  diagonals leave a wider gap.  The band is verified on words: the share of the template's
  words that its matched k-grams cover.  From ``COVERAGE`` on, the notice's label is given.

A vote is one k-gram compared by its words, not by hash alone, so no collision can vote.
``score`` is the greatest share covered in the document: 1 where a phrase stands whole, 0 where
nothing matches.

Only DataFrame functions are used.  The templates are a table of the library (about 500
places) and are broadcast up to ``LIBRARY`` places; a larger library is joined by shuffle.
Votes of one document lie together at most; a frequent k-gram is spread with its documents.

Defined cases: null and empty texts have no words and score 0; a null doc_id is kept; rows
repeated in full get the same result; documents are judged alone, so ties do not arise; an empty table
gives an empty result; other columns are not read; texts may have any length.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fidelis.llm.common import materialise

PHRASE_GRAM = 2
NOTICE_GRAM = 4
SLACK = 3  # words put in or left out between neighbouring diagonals of a band
COVERAGE = 0.5
LIBRARY = 20_000  # template places that may be broadcast

BLANKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The phrases of the base rules and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Notices that licenses ask to be put into files, and their labels.
NOTICES = [
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
     associated documentation files (the "Software"), to deal in the Software without restriction, including without
     limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
     Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
     The above copyright notice and this permission notice shall be included in all copies or substantial portions of
     the Software."""),
    ("apache", """you may not use this file except in compliance with the License. You may obtain a copy of the License
     at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
     distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
     either express or implied. See the License for the specific language governing permissions and limitations under
     the License."""),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
     General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
     option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
     WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""),
    ("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU
     Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or
     (at your option) any later version."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided
     that the following conditions are met: Redistributions of source code must retain the above copyright notice, this
     list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright
     notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided
     with the distribution."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
     hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
     was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("cc-by", """This work is licensed under a Creative Commons Attribution 4.0 International License."""),
    ("cc-by-sa", """This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."""),
    ("cc-by-nc", """This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy,
     modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
     binary, for any purpose, commercial or non-commercial, and by any means."""),
]


def library(phrases: dict[str, str] = PHRASES, notices: list[tuple[str, str]] = NOTICES) -> list[tuple]:
    """Template places: (tid, label, k, size in words, tpos, gram)."""
    out = []
    texts = [(label, PHRASE_GRAM, phrase) for phrase, label in phrases.items()] + [(label, NOTICE_GRAM, text) for label, text in notices]
    for tid, (label, k, text) in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans(_UPPER, _LOWER)))
        if len(w) < k:
            raise ValueError(f"a template of fewer than {k} words: {text}")
        out += [(tid, label, k, len(w), i, " ".join(w[i:i + k])) for i in range(len(w) - k + 1)]
    return out


def license_words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), BLANKS), "")


def _joined(grams: str, step: int) -> Column:
    """Of an array of texts: each with the one ``step`` places on, joined by a space."""
    rest = F.greatest(F.size(grams) - step, F.lit(0))
    return F.zip_with(F.slice(grams, F.lit(1), rest), F.slice(grams, F.lit(step + 1), rest), lambda a, b: F.concat(a, F.lit(" "), b))


def votes(docs: DataFrame, places: list[tuple]) -> DataFrame:
    """Matches of the k-grams of ``docs`` with template places: doc_id, _th, tid, label, k, size, tpos, pos."""
    spark = docs.sparkSession
    templates = spark.createDataFrame(places, "tid int, label string, k int, size int, tpos int, _gram string")
    templates = templates.withColumn("_h", F.xxhash64("_gram"))
    if len(places) <= LIBRARY:
        templates = F.broadcast(templates)
    # each stage names a column that the next uses twice: the optimiser keeps them apart
    words = docs.select("doc_id", F.xxhash64("text").alias("_th"), license_words(F.col("text")).alias("_w"))
    two = words.select("doc_id", "_th", _joined("_w", 1).alias("_2"))
    both = two.select("doc_id", "_th", F.explode(F.array(F.col("_2"), _joined("_2", 2))).alias("_g"))
    grams = both.select("doc_id", "_th", F.posexplode("_g").alias("pos", "gram"))
    return grams.join(templates, (F.xxhash64("gram") == F.col("_h")) & (F.col("gram") == F.col("_gram"))).drop("_h", "gram", "_gram")


def phrases_found(hits: DataFrame) -> DataFrame:
    """Places of whole phrases: doc_id, _th, label, start."""
    diagonal = hits.filter(F.col("k") == PHRASE_GRAM).groupBy("doc_id", "_th", "tid", (F.col("pos") - F.col("tpos")).alias("start")).agg(
        F.count_distinct("tpos").alias("_n"), F.first("label").alias("label"), F.first("size").alias("size"))
    return diagonal.filter(F.col("_n") == F.col("size") - (PHRASE_GRAM - 1)).select("doc_id", "_th", "label", "start")


def notices_found(hits: DataFrame) -> DataFrame:
    """Bands of notices: doc_id, _th, tid, label, start, end (words of the document), covered (share of the template's words)."""
    key = ["doc_id", "_th", "tid"]
    diagonals = hits.filter(F.col("k") == NOTICE_GRAM).groupBy(*key, (F.col("pos") - F.col("tpos")).alias("_d")).agg(
        F.first("label").alias("label"), F.first("size").alias("size"), F.collect_set("tpos").alias("_t"))
    ordered = Window.partitionBy(*key).orderBy("_d")
    new = (F.col("_d") - F.lag("_d").over(ordered) > SLACK).cast("int")
    bands = diagonals.withColumn("_new", F.coalesce(new, F.lit(1))).withColumn("_band", F.sum("_new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    # the places of a template are at most its length, whatever the number of diagonals
    merged = bands.withColumn("tpos", F.explode("_t")).groupBy(*key, "_band", "tpos").agg(
        F.first("label").alias("label"), F.first("size").alias("size"), F.min(F.col("_d") + F.col("tpos")).alias("_lo"),
        F.max(F.col("_d") + F.col("tpos")).alias("_hi"))
    spans = merged.groupBy(*key, "_band").agg(
        F.first("label").alias("label"), F.first("size").alias("size"), F.array_sort(F.collect_list("tpos")).alias("_t"),
        F.min("_lo").alias("start"), (F.max("_hi") + NOTICE_GRAM).alias("end"))
    ahead = F.zip_with("_t", F.slice("_t", F.lit(2), F.size("_t")), lambda a, b: F.least(F.coalesce(b - a, F.lit(NOTICE_GRAM)), F.lit(NOTICE_GRAM)))
    covered = F.aggregate(ahead, F.lit(0), lambda s, x: s + x)
    return spans.select(*key, "label", "start", "end", (covered / F.col("size")).alias("covered"))


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: list[tuple[str, str]] = NOTICES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans
    (label, start, end, covered of every notice found)."""
    hits = materialise(votes(docs, library(phrases, notices)), "license-votes")
    key = ["doc_id", "_th"]
    base = phrases_found(hits).groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_base"), F.min("start").cast("long").alias("first_word"), F.max("start").cast("long").alias("last_word"),
        F.collect_set("label").alias("_base"))
    bands = notices_found(hits)
    span = F.struct("start", "end", "label", "covered")
    more = bands.groupBy(*key).agg(
        F.max("covered").alias("_best"), F.collect_set(F.when(F.col("covered") >= COVERAGE, F.col("label"))).alias("_more"),
        F.array_sort(F.collect_list(F.when(F.col("covered") >= COVERAGE, span))).alias("spans"))
    none = F.array().cast("array<string>")
    merged = base.select(*key, "n_base", "first_word", "last_word", "_base", F.lit(None).cast("double").alias("_best"), none.alias("_more"),
                         F.lit(None).cast("array<struct<start:int,end:int,label:string,covered:double>>").alias("spans"))
    found = merged.unionByName(more.select(
        *key, F.lit(None).cast("long").alias("n_base"), F.lit(None).cast("long").alias("first_word"), F.lit(None).cast("long").alias("last_word"),
        none.alias("_base"), "_best", "_more", "spans")).groupBy(F.col("doc_id").alias("_id"), F.col("_th").alias("_h")).agg(
        *[F.max(c).alias(c) for c in ("n_base", "first_word", "last_word", "_best")],
        F.flatten(F.collect_list("_base")).alias("_base"), F.flatten(F.collect_list("_more")).alias("_more"),
        F.flatten(F.collect_list("spans")).alias("spans"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("_th"), F.size(license_words(F.col("text"))).cast("long").alias("n_words"))
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_th") == F.col("_h")), "left")
    listed = lambda a: F.array_join(F.array_sort(F.array_distinct(F.coalesce(a, none))), ",")
    n = F.coalesce(F.col("n_base"), F.lit(0))
    best = F.least(F.coalesce(F.col("_best"), F.lit(0.0)), F.lit(1.0))
    return joined.select(
        "doc_id", "n_words", n.cast("long").alias("n_base"), "first_word", "last_word", listed(F.col("_base")).alias("base_labels"),
        listed(F.concat(F.coalesce(F.col("_base"), none), F.coalesce(F.col("_more"), none))).alias("labels"),
        F.when(n > 0, 1.0).otherwise(best).alias("score"), "spans")


def license_report(docs: DataFrame) -> DataFrame:
    return scan(docs).drop("spans")
