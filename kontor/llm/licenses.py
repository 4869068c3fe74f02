"""License scans by an exact set-similarity join.

Blocks of a text are windows of words: for templates of up to 2^k words, every
2^k words a window of 2^(k+1) words begins, so that any passage as long as the
template lies whole in one of them. Blocks and templates are sets of words. A
block meets a template if it holds at least ``threshold`` of its words. The
join finds all such pairs: words are ordered by their frequency in the blocks,
rarest first; a template's prefix and a block's prefix must share a word
(prefix filter), a block must be large enough (length filter), and the words
behind the shared one must suffice (positional filter). Candidates are then
verified word by word. Words of no template take no part, which changes no
overlap; the number of templates and their words are parameters, so the
templates' side of the join is bounded and broadcast.

Beside it the fixed phrases of ``PHRASES`` are found word by word; their labels
always stay, and the join adds the labels of the templates met. A passage that
holds most words of two templates has both labels.

Defined results
---------------
* null text counts as empty: no words, ``first_word`` and ``last_word`` null,
  labels '', score 0.
* score: 1 with a phrase, else the largest share of a template's words in a
  block that meets it, else 0. A share equal to the threshold meets it.
* repeated rows, also rows that share an id, are judged one by one.
* empty table: empty result. Further columns are not read.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontor.llm.common import map_rows, saved

THRESHOLD = 0.8

# Phrases and labels.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

# Opening sentences of well-known licenses.
TEMPLATES = [
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
             "Affero General Public License as published by the Free Software Foundation, either version 3 of the "
             "License, or (at your option) any later version."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
               "in compliance with the License. You may obtain a copy of the License at"),
    ("boost", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt "
              "or copy at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met"),
    ("cc-by", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International "
                 "License."),
    ("cc-by-sa", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International "
                 "License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring "
            "rights to this work."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
            "General Public License as published by the Free Software Foundation, either version 3 of the License, "
            "or (at your option) any later version."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
            "is hereby granted, provided that the above copyright notice and this permission notice appear in all "
            "copies."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
             "Lesser General Public License as published by the Free Software Foundation; either version 2.1 of "
             "the License, or (at your option) any later version."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
            "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
            "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
            "subject to the following conditions"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
            "MPL was not distributed with this file, You can obtain one at"),
    ("rights-reserved", "All rights reserved. No part of this publication may be reproduced, distributed, or "
                        "transmitted in any form or by any means without the prior written permission of the "
                        "publisher."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, "
                  "modify, publish, use, compile, sell, or distribute this software"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the "
             "authors be held liable for any damages arising from the use of this software."),
]

# Lower-cases A-Z; every other ASCII character but letters and digits becomes a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32
              for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Templates:
    """The templates as sets of word numbers, by size class."""

    def __init__(self, templates, threshold: float):
        names = sorted({w for _, text in templates for w in words_of(text)})
        self.number = {w: i for i, w in enumerate(names)}
        self.labels, self.sets, self.classes, self.least = [], [], [], []
        share = Fraction(str(threshold))
        for label, text in templates:
            words = words_of(text)
            if not words:
                raise ValueError(f"template {label!r} has no words")
            distinct = sorted({self.number[w] for w in words})
            self.labels.append(label)
            self.sets.append(distinct)
            self.classes.append((len(words) - 1).bit_length())
            self.least.append(max(-(-share * len(distinct) // 1), 1))
        # of each class: the words of its templates, and the fewest words a block must hold
        self.used, self.fewest = {}, {}
        for k, words, least in zip(self.classes, self.sets, self.least):
            used = self.used.setdefault(k, np.zeros(len(names), bool))
            used[words] = True
            self.fewest[k] = min(self.fewest.get(k, least), least)

    def blocks(self, numbers: np.ndarray):
        """(class, window, word numbers) of the blocks that hold enough words for some template of their class.

        ``numbers`` has the template word number of each word of the text, -1 for the others.
        """
        at = np.flatnonzero(numbers >= 0)
        for k, used in self.used.items():
            own = at[used[numbers[at]]]
            if len(own) < self.fewest[k]:
                continue
            window = own >> k
            # a word lies in the window that begins before it and in the one before that
            keys = np.concatenate([window, window[window > 0] - 1]) * len(used)
            keys += np.concatenate([numbers[own], numbers[own[window > 0]]])
            keys = np.unique(keys)
            window, words = keys // len(used), keys % len(used)
            starts = np.flatnonzero(np.concatenate(([True], window[1:] != window[:-1])))
            sizes = np.diff(np.append(starts, len(window)))
            for s, n in zip(starts[sizes >= self.fewest[k]].tolist(), sizes[sizes >= self.fewest[k]].tolist()):
                yield k, int(window[s]), words[s:s + n].tolist()


def phrase_places(words: list[bytes], phrases) -> list[tuple[int, str]]:
    """(first word, label) of every place where the words of a phrase stand consecutively."""
    line = b" " + b" ".join(words) + b" "
    found = []
    for phrase, label in phrases:
        wanted = b" " + b" ".join(words_of(phrase)) + b" "
        at, word, seen = line.find(wanted), 0, 0
        while at >= 0:
            word += line.count(b" ", seen, at)
            seen = at
            found.append((word, label))
            at = line.find(wanted, at + 1)
    return found


SCANNED = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
           "blocks array<struct<size_class: int, window: long, words: array<int>>>")


def scanned(docs: DataFrame, own: Templates, phrases) -> DataFrame:
    """Phrases and blocks of every document; ``row`` is a number of its own."""
    def judge(batch):
        out = [[] for _ in range(6)]
        for text in batch["text"]:
            words = words_of(text.as_py())
            places = phrase_places(words, phrases)
            numbers = np.fromiter(map(lambda w: own.number.get(w, -1), words), np.int64, len(words))
            starts = [at for at, _ in places]
            for column, value in zip(out, (
                    len(words), len(places), min(starts, default=None), max(starts, default=None),
                    sorted({label for _, label in places}),
                    [{"size_class": k, "window": w, "words": b} for k, w, b in own.blocks(numbers)])):
                column.append(value)
        return batch["doc_id"], *out

    return map_rows(docs.select("doc_id", "text"), SCANNED, judge).withColumn("row", F.monotonically_increasing_id())


def contained(blocks: DataFrame, own: Templates) -> DataFrame:
    """(row, size_class, window, template, share) of every block and template that meet the threshold.

    ``blocks`` has row, size_class, window and the array ``words`` of template word numbers.
    """
    spark = blocks.sparkSession
    frequency = {r["word"]: r["n"] for r in blocks.select(F.explode("words").alias("word"))
                 .groupBy("word").agg(F.count("*").alias("n")).collect()}  # one row a template word at most
    order = sorted(range(len(own.number)), key=lambda w: (frequency.get(w, 0), w))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))

    names = F.array(*[F.lit(int(r)) for r in rank])
    sorted_blocks = blocks.select("row", "size_class", "window",
                                  F.array_sort(F.transform("words", lambda w: F.get(names, w))).alias("ranks"))
    rows = [(i, k, sorted(int(rank[w]) for w in words), int(least))
            for i, (k, words, least) in enumerate(zip(own.classes, own.sets, own.least))]
    templates = spark.createDataFrame(rows, "template int, size_class int, set array<int>, needed int")
    heads = templates.select(
        "template", "size_class", "needed", F.size("set").alias("length"),
        F.posexplode(F.expr("slice(set, 1, size(set) - needed + 1)")).alias("place", "word"))
    fewest = spark.createDataFrame([(k, int(n)) for k, n in own.fewest.items()], "size_class int, fewest int")
    prefixes = sorted_blocks.join(F.broadcast(fewest), "size_class").select(
        "row", "size_class", "window", "ranks", F.size("ranks").alias("size"),
        F.posexplode(F.expr("slice(ranks, 1, size(ranks) - fewest + 1)")).alias("at", "word"))
    candidates = prefixes.join(F.broadcast(heads), ["size_class", "word"]).where(
        "size >= needed AND at <= size - needed AND 1 + least(length - place - 1, size - at - 1) >= needed")
    # a pair may share several prefix words: its first one decides
    pairs = candidates.groupBy("row", "size_class", "window", "template").agg(
        F.first("ranks").alias("ranks"), F.first("needed").alias("needed"))
    met = pairs.join(F.broadcast(templates.select("template", "set")), "template").withColumn(
        "overlap", F.size(F.array_intersect("ranks", "set"))).where("overlap >= needed")
    return met.select("row", "size_class", "window", "template",
                      (F.col("overlap").cast("double") / F.size("set").cast("double")).alias("share"))


def license_scan(docs: DataFrame, templates=None, phrases=None, threshold: float = THRESHOLD) -> DataFrame:
    """Words, phrases, labels and score of every document."""
    own = Templates(TEMPLATES if templates is None else templates, threshold)
    phrases = PHRASES if phrases is None else phrases
    rows = saved(scanned(docs, own, phrases), "license-rows")
    met = contained(rows.select("row", F.explode("blocks").alias("b")).select("row", "b.*"), own)
    labels = F.array(*[F.lit(x) for x in own.labels])
    found = met.groupBy("row").agg(F.collect_set(F.get(labels, "template")).alias("met"),
                                   F.max("share").alias("share"))
    both = F.array_sort(F.array_union("base_labels", F.coalesce("met", F.array().cast("array<string>"))))
    return rows.drop("blocks").join(found, "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(both, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


def oracle() -> str:
    """The query in DuckDB SQL, straight from the definitions: no order of words, no filters."""
    own = Templates(TEMPLATES, THRESHOLD)
    names = sorted(own.number)
    words = [(i, k, int(n), len(s), names[w].decode()) for i, (k, n, s) in
             enumerate(zip(own.classes, own.least, own.sets)) for w in s]
    phrases = [(label, i, w.decode(), len(words_of(p))) for p, label in PHRASES for i, w in enumerate(words_of(p))]
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
       translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
w AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM docs),
phrases(label, i, word, size) AS (VALUES {_values(phrases)}),
places AS (SELECT r, label, pos - i AS start FROM w JOIN phrases USING (word)
           GROUP BY r, label, pos - i HAVING count(*) = any_value(size)),
base AS (SELECT r, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word FROM places GROUP BY r),
templates(template, k, least, size, word) AS (VALUES {_values(words)}),
labels(template, label) AS (VALUES {_values(enumerate(own.labels))}),
hits AS (SELECT r, template, least, size, word, (pos >> k) - b.back AS block
         FROM w JOIN templates USING (word), (VALUES (0), (1)) AS b(back) WHERE (pos >> k) >= b.back),
met AS (SELECT r, template, count(DISTINCT word) / any_value(size)::DOUBLE AS share FROM hits
        GROUP BY r, template, block HAVING count(DISTINCT word) >= any_value(least)),
named AS (SELECT r, label, true AS base FROM places UNION ALL
          SELECT r, label, false FROM met JOIN labels USING (template)),
lists AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
          string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels FROM named GROUP BY r),
top AS (SELECT r, max(share) AS share FROM met GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
FROM docs LEFT JOIN base USING (r) LEFT JOIN lists USING (r) LEFT JOIN top USING (r)
"""
