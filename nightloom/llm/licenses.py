"""License scans by a positional index of rare words.

Templates are notices and mandatory sections of licences, as runs of words; several may have one label. A corpus pass finds in how many files each template word occurs; a template
is looked up by its own highest-IDF words, however frequent they are. Each place of the rarest word of its key phrase gives
a start (place in the file - place in the template); where enough of the looked-up words stand at the same relative
position as in the template, it is held against the file there, word by word; a label needs enough of its words and the
mandatory key phrase. As that phrase must stand, no match is missed. Everything after the corpus pass is local to a row: no
shuffle, no Python.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Label, template words, mandatory key phrase.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "source and binary forms"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "www apache org licenses license 2 0"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "redistributions in binary form must reproduce"),
    ("bsl-1.0", "boost software license version 1 0 permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use reproduce display distribute execute and transmit the software", "boost software license"),
    ("cc0-1.0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law", "dedicated the work to the public domain"),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gnu general public license as published by"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "permission notice appear in all copies"),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "sublicense and or sell copies"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "mozilla public license"),
    ("proprietary", "unauthorized copying of this file via any medium is strictly prohibited proprietary and confidential", "strictly prohibited"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "free and unencumbered software"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or altered from any source distribution", "altered source versions must be plainly marked"),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Separators of lower-cased text: ASCII but digits and a-z.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text):
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS), lambda w: w != "")


def _texts(words: list[str]):
    return F.array(*[F.lit(w) for w in words])


def _row(words: list[str]):
    """The words as one constant array."""
    return F.split(F.lit(" ".join(words)), " ")


LONGEST = max(len(t.split()) for _, t, _ in TEMPLATES)


def _at(start, many: int):
    """So many words of the file from a place on, which may lie before its begin or run past its end ("" there)."""
    return F.slice("padded", start + (LONGEST + 1), F.lit(many))


def _equal(start, words: list[str]):
    """How many words of a run the file has at their places if the run begins at start."""
    return F.size(F.filter(F.zip_with(_at(start, len(words)), _row(words), lambda a, b: a == b), lambda x: x))


def _place(words: list[str], needed: list[str]) -> int:
    """Where the key phrase begins in a template."""
    return next(i for i in range(len(words)) if words[i : i + len(needed)] == needed)


def _best_share(anchor: int, places: list[int], words: list[str], needed: list[str], agree: int):
    """The best share of a template's words in place, over starts that enough looked-up words agree on and whose key phrase stands; else null.

    anchor: place in the template of the word whose hits give the starts. places: those of the looked-up words.
    """
    starts = F.transform(F.filter("hits", lambda h: h["w"] == words[anchor]), lambda h: h["i"] - F.lit(anchor))
    at = _place(words, needed)
    looked = [w if i in places else "-" for i, w in enumerate(words)]  # "-" is no word
    ready = F.filter(starts, lambda s: (_at(s + at, len(needed)) == _row(needed)) & (_equal(s, looked) >= agree))
    shares = F.transform(ready, lambda s: _equal(s, words) / F.lit(float(len(words))))
    return F.when(F.size("hits") > 0, F.array_max(shares))


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[int, dict[str, int]]:
    """Over all files: how many there are, and in how many each template word stands. Bounded by the template words."""
    vocabulary = sorted({w for _, t, _ in TEMPLATES for w in t.split()})
    found = docs.select(F.explode(F.array_union(F.array(F.lit("")), F.array_distinct(F.filter(_words(F.col(text)), lambda w: w.isin(vocabulary))))).alias("w"))
    rows = {r["w"]: r["n"] for r in found.groupBy("w").agg(F.count("*").alias("n")).collect()}
    return rows.pop("", 0), rows


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", top: int = 6, votes: int = 2, cover: float = 0.8) -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels, score.

    top: how many words of each template are looked up. votes: how many of their places must agree on a template's
    start (fewer, where cover lets so many of them be missing, so that nothing that cover admits is lost).
    cover: least share of template words that must stand in place; score is the best share of a verified template,
    and at least 0.5 where a base phrase stands. Null and empty texts have no words, no labels, empty strings and score 0.
    Repeated rows are each scanned; other columns are not carried. An empty table gives an empty one.
    """
    n, df = document_frequencies(docs, text)
    rarity = lambda w: (-math.log((n + 1) / (df.get(w, 0) + 1)), w)
    looked = []  # of each template: place of the rarest word of its key phrase, places of its looked-up words
    for _, template, phrase in TEMPLATES:
        words, needed = template.split(), phrase.split()
        chosen = sorted(set(words), key=rarity)[:top]
        looked.append((_place(words, needed) + needed.index(min(needed, key=rarity)), [i for i, w in enumerate(words) if w in chosen]))
    d = docs.select(F.col(key).alias("k"), _words(F.col(text)).alias("w")).withColumn("n", F.size("w"))
    watched = sorted({p.split()[0] for p in BASE} | {t.split()[anchor] for (_, t, _), (anchor, _) in zip(TEMPLATES, looked, strict=True)})
    hits = F.filter(F.transform("w", lambda w, i: F.when(w.isin(watched), F.struct(w.alias("w"), i.cast("int").alias("i")))), lambda h: h.isNotNull())
    d = d.withColumn("hits", F.when(F.arrays_overlap("w", _texts(watched)), hits).otherwise(F.slice(hits, 1, 0)))
    blank = F.array_repeat(F.lit(""), LONGEST)
    d = d.withColumn("padded", F.when(F.size("hits") > 0, F.concat(blank, "w", blank)))

    def stands(phrase: str):
        """Places where the phrase's words stand one after another."""
        first, *rest = phrase.split()
        test = lambda h: F.reduce(
            F.array(*[F.get(F.col("w"), h["i"] + k) == F.lit(x) for k, x in enumerate(rest, 1)]), F.lit(True), lambda a, b: a & F.coalesce(b, F.lit(False))
        )
        return F.transform(F.filter("hits", lambda h: (h["w"] == first) & test(h)), lambda h: h["i"])

    base = {label: stands(p) for p, label in BASE.items()}
    d = d.select("k", "n", "w", "hits", "padded", *[v.alias(f"b{j}") for j, v in enumerate(base.values())])
    d = d.withColumn("places", F.concat(*[f"b{j}" for j in range(len(base))]))
    d = d.withColumn("base", F.filter(F.array(*[F.when(F.size(f"b{j}") > 0, F.lit(label)) for j, label in enumerate(base)]), lambda x: x.isNotNull()))

    found, proven = [], []
    for j, (label, template, phrase) in enumerate(TEMPLATES):
        words, needed = template.split(), phrase.split()
        anchor, places = looked[j]
        missing = len(words) - math.ceil(cover * len(words))
        d = d.withColumn(f"s{j}", _best_share(anchor, places, words, needed, min(votes, len(places) - missing)))
        found.append(F.when(F.col(f"s{j}") >= cover, F.lit(label)))
        proven.append(F.when(F.col(f"s{j}") >= cover, F.col(f"s{j}")).otherwise(0.0))
    found = F.filter(F.array(*found), lambda x: x.isNotNull())
    labels = F.array_sort(F.array_union("base", found))
    return d.select(
        F.col("k").alias(key),
        F.col("n").cast("long").alias("n_words"),
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.greatest(F.when(F.size("places") > 0, 0.5).otherwise(0.0), F.lit(0.0), *proven).alias("score"),
    )
