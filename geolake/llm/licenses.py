"""License scan through a positional index of rare words.

Templates are whole notices and licence texts. The inverse document frequency of their words is counted over all documents,
and each template is entered in the index under its rarest words, every place of these with its offset (`postings`). A file's
words that the index holds, its licence words of the highest IDF, are looked up; a posting (template, offset) of the word at
place i proposes the start i - offset. The proposals are sorted and intersected: a start remains if enough of the template's
postings agree on it. What remains is verified: the mandatory key phrases must stand at their places, and the IDF-weighted
share of the template's words that match there is its score. Everything is a chain of array functions on a row: no shuffle of
texts, no group by file, and no cap on words, proposals or places.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Characters between words; base phrases with their labels; templates with label, text and mandatory key phrases.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
_FREE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation,
either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
TEMPLATES = (
    ("mit", "Released under the MIT License", ("mit license",)),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included
in all copies or substantial portions of the Software.""", ("permission is hereby granted", "free of charge")),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license",)),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of
the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations
under the License.""", ("apache license", "in compliance with the license")),
    ("bsd", _BSD, ("source and binary forms",)),
    ("bsd-3-clause", _BSD + """ 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this
software without specific prior written permission.""", ("source and binary forms", "endorse or promote products")),
    ("gpl", "This work is licensed under the GNU General Public License, version 3", ("general public license",)),
    ("gpl", _FREE.format("General Public License", 3), ("free software", "gnu general public license")),
    ("lgpl", "GNU Lesser General Public License", ("lesser general public license",)),
    ("lgpl", _FREE.format("Lesser General Public License", 3), ("free software", "gnu lesser general public license")),
    ("agpl", "GNU Affero General Public License", ("affero general public license",)),
    ("agpl", _FREE.format("Affero General Public License", 3), ("free software", "gnu affero general public license")),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file,
You can obtain one at https://mozilla.org/MPL/2.0/.""", ("mozilla public license",)),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa",)),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution",)),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software,
either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""", ("unencumbered software",)),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice
and this permission notice appear in all copies.""", ("permission to use copy modify",)),
)

#: Of the template's IDF weight that must match at a start, besides all its key phrases.
LEAST_SCORE = 0.3
#: A template is entered under a third of its distinct words, the rarest, but not more than so many; half of these must agree.
INDEXED = 6


def words_of(text: str) -> list[str]:
    return [w for w in re.split(GAP, text.lower()) if w]


class Pattern:
    """words in order, label, must: the key phrases' words by offset, base: whether it is one of the contract's phrases."""

    def __init__(self, label: str, text: str, keys: tuple[str, ...], base: bool = False):
        self.label, self.words, self.base, self.must = label, words_of(text), base, {}
        for k in map(words_of, keys):
            at = next(i for i in range(len(self.words)) if self.words[i : i + len(k)] == k)
            self.must |= dict(enumerate(k, at))

    def indexed(self, idf: dict[str, float]) -> tuple[list[int], int]:
        """The offsets of the template's rarest words (ties: by the word), and how many postings must agree."""
        own = sorted(set(self.words), key=lambda w: (-idf[w], w))
        own = own[: min(INDEXED, -(-len(own) // 3))]
        return [i for i, w in enumerate(self.words) if w in own], -(-len(own) // 2)


def patterns(templates=TEMPLATES, base=BASE) -> list[Pattern]:
    return [Pattern(label, p, (p,), True) for p, label in base] + [Pattern(*t) for t in templates]


def _words(text: Column) -> Column:
    """A-Z to a-z and nothing else, then words; a null text has none."""
    folded = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(folded, GAP), "")


def word_idf(docs: DataFrame, known: list[Pattern]) -> dict[str, float]:
    """1 + log((1 + documents) / (1 + documents with the word)) of every word of the templates, over all documents.

    One row for each word of the templates comes to the driver, however many documents there are.
    """
    vocabulary = sorted({w for p in known for w in p.words})
    held = F.array_intersect(_words(F.col("text")), F.split(F.lit(" ".join(vocabulary)), " "))
    got = {r["w"]: r["n"] for r in docs.select(F.explode(F.array_append(held, F.lit(""))).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    n = got.get("", 0)  # every document adds the empty word once
    return {w: 1 + math.log((1 + n) / (1 + got.get(w, 0))) for w in vocabulary}


def _literal(value, kind: str) -> Column:
    """A constant of any type; the optimizer evaluates it once."""
    return F.from_json(F.lit(json.dumps({"v": value})), f"v {kind}")["v"]


def scan(docs: DataFrame, templates=TEMPLATES, base=BASE, least_score: float = LEAST_SCORE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and matches for every row.

    matches: the places found, structs (start, label, score, base) in ascending order. n_base counts the places of base phrases,
    overlapping ones too; first_word and last_word are their smallest and largest start (words from 0), null without any;
    labels are distinct, sorted and comma-joined, empty strings without any; score is the best match's, 0 without any. A null or
    empty text has no words. Repeated rows give repeated results; other columns are not read. An empty table gives no rows.
    A very long text is one row's array of words, and its work grows with its words.
    """
    known = patterns(templates, base)
    idf = word_idf(docs, known)
    index: dict[str, list] = {}
    table_ = []
    for t, p in enumerate(known):
        offsets, need = p.indexed(idf)
        for i in offsets:
            index.setdefault(p.words[i], []).append({"t": t, "o": i})
        weight = [idf[w] for w in p.words]
        table_.append({"label": p.label, "base": p.base, "need": need, "words": p.words, "weight": weight, "whole": sum(weight), "at": list(p.must), "must": list(p.must.values())})
    rare = sorted(index)
    all_postings = _literal([index[w] for w in rare], "array<array<struct<t:int,o:int>>>")
    all_templates = _literal(table_, "array<struct<label:string,base:boolean,need:int,words:array<string>,weight:array<double>,whole:double,at:array<int>,must:array<string>>>")
    names = F.split(F.lit(" ".join(rare)), " ")

    d = docs.select("doc_id", _words(F.col("text")).alias("words"))
    # the file's licence words, and their places
    d = d.withColumn("held", F.array_intersect("words", names))
    place = F.filter(F.transform("words", lambda w, i: F.when(F.array_contains("held", w), i)), lambda i: i.isNotNull())
    d = d.withColumn("hits", F.when(F.size("held") > 0, place).otherwise(F.array().cast("array<int>")))

    def proposals(hit: Column) -> Column:
        own = F.get(all_postings, F.array_position(names, F.get("words", hit)).cast("int") - 1)
        return F.transform(own, lambda p: F.struct(p["t"].alias("t"), (hit - p["o"]).alias("s")))

    d = d.withColumn("proposed", F.sort_array(F.flatten(F.transform("hits", proposals))))

    def agreed(x: Column, i: Column) -> Column:
        """The first of equal proposals, if the last one of as many as are needed is equal too."""
        need = F.get(all_templates, x["t"])["need"]
        first = (i == 0) | (F.get("proposed", F.greatest(i - 1, F.lit(0))) != x)
        return F.when(first & F.get("proposed", i + need - 1).eqNullSafe(x), x)

    d = d.withColumn("agreed", F.filter(F.transform("proposed", agreed), lambda x: x.isNotNull()))

    def word(i: Column) -> Column:
        return F.when(i >= 0, F.get("words", i))

    def matched(x: Column) -> Column:
        p, start = F.get(all_templates, x["t"]), x["s"]
        keys = F.forall(F.zip_with(p["at"], p["must"], lambda o, w: word(start + o).eqNullSafe(w)), lambda ok: ok)
        got = F.aggregate(F.zip_with(F.transform(p["words"], lambda w, i: word(start + i).eqNullSafe(w)), p["weight"], lambda ok, v: F.when(ok, v).otherwise(0.0)), F.lit(0.0), lambda a, v: a + v)
        score = F.round(F.when(p["base"], 1.0).otherwise(F.least(got / p["whole"], F.lit(1.0))), 6)
        return F.when(keys & (p["base"] | (score >= least_score)), F.struct(start.cast("long").alias("start"), p["label"].alias("label"), score.alias("score"), p["base"].alias("base")))

    d = d.withColumn("matches", F.sort_array(F.filter(F.transform("agreed", matched), lambda m: m.isNotNull())))
    own = F.transform(F.filter("matches", lambda m: m["base"]), lambda m: m["start"])
    d = d.select("doc_id", F.size("words").cast("long").alias("n_words"), "matches", own.alias("own"))
    labels = lambda m: F.array_join(F.array_sort(F.array_distinct(F.transform(m, lambda x: x["label"]))), ",")
    return d.select(
        "doc_id", "n_words", F.size("own").cast("long").alias("n_base"), F.array_min("own").alias("first_word"), F.array_max("own").alias("last_word"),
        labels(F.filter("matches", lambda m: m["base"])).alias("base_labels"), labels(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0)).alias("score"), "matches",
    )


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("matches")
