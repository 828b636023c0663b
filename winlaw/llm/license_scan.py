"""Licence scan by a positional index of rare words, with DataFrame functions only.

One pass over the texts takes the places of the licence words (those of the templates
and phrases) and the places of the base phrases. Document frequencies over all texts
give each licence word its IDF. Each template is indexed by its anchors: of its words that
must stand, the `min_votes` with highest IDF. Every word of a text that is an anchor is
looked up; a posting at place t for a word at place p votes for the template standing at
p - t. Where all votes agree that the template can't be without, its words are compared
place by place, and it is found if its mandatory phrases stand there and enough of its
words do. So no template is lost, however common its words are and whatever else a text holds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .decontam import let, words_of

# Base phrases and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Label, words of a notice, and phrases that must stand in it.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ["permission is hereby granted"]),
    ("mit", "released under the mit license", ["the mit license"]),
    ("apache-2", "licensed under the apache license version 2 0", ["apache license version 2"]),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
    ("gpl-2", "under the terms of the gnu general public license version 2", ["gnu general public license", "version 2"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by", "creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["redistribution and use in source and binary forms"]),
    ("all-rights-reserved", "copyright all rights reserved", ["all rights reserved"]),
    # whole notices
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished "
        "to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        ["permission is hereby granted", "without restriction"],
    ),
    (
        "bsd-3-clause",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright "
        "notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution neither the name of the copyright holder nor the names "
        "of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        ["redistributions of source code must retain", "endorse or promote products"],
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        ["with or without fee is hereby granted"],
    ),
    (
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied",
        ["apache license version 2", "in compliance with the license"],
    ),
    (
        "gpl-3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license "
        "or at your option any later version this program is distributed in the hope that it will be useful but without any warranty",
        ["gnu general public license as published", "version 3 of the license"],
    ),
    (
        "lgpl",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
        ["gnu lesser general public license"],
    ),
    (
        "agpl-3",
        "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license",
        ["gnu affero general public license"],
    ),
    (
        "mpl-2",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
        ["mozilla public license v 2"],
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary "
        "for any purpose commercial or non commercial and by any means",
        ["free and unencumbered software", "public domain"],
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
        ["alter it and redistribute it freely"],
    ),
]


@dataclass(frozen=True)
class LicenseSpec:
    """min_votes: anchors of a template. coverage: of a template's words that must stand at their places."""

    min_votes: int = 2
    coverage: float = 0.7
    base: dict = field(default_factory=lambda: dict(BASE))
    templates: list = field(default_factory=lambda: list(TEMPLATES))


def vocabulary(spec: LicenseSpec) -> list[str]:
    return sorted({w for t in [*spec.base, *(t for _, t, _ in spec.templates)] for w in t.split()})


def _key_places(words: list[str], phrases: list[str]) -> set[int]:
    out: set[int] = set()
    for p in phrases:
        want = p.split()
        at = next(i for i in range(len(words)) if words[i : i + len(want)] == want)
        out |= set(range(at, at + len(want)))
    return out


def anchors(words: list[str], keys: set[int], idf: dict[str, float], spec: LicenseSpec) -> tuple[list[int], int]:
    """Places of a template's anchors, and how many of them stand wherever the template is found.

    Rarest words of the mandatory phrases first; where these are too few, others, and as many
    more of them as words may be missing.
    """
    missing = max((n for n in range(len(words) + 1) if len(words) - n >= spec.coverage * len(words)), default=0)
    order = sorted(range(len(words)), key=lambda i: (i not in keys, -idf[words[i]], i))
    sure = min(len(keys), spec.min_votes)
    short = spec.min_votes - sure
    more = order[len(keys) :][: missing + short] if short else []
    return order[:sure] + more, max(1, sure + max(0, len(more) - missing))


def _base_places(words: Column, hits: Column, spec: LicenseSpec) -> Column:
    """struct(pos, label) of every place where a base phrase's words stand consecutively."""
    def of(want: list[str], label: str) -> Column:
        def here(h: Column) -> Column:
            ok = h["w"] == want[0]
            for j, w in enumerate(want[1:], 1):
                ok = ok & (F.get(words, h["pos"] + j) == w)
            return F.coalesce(ok, F.lit(False))

        return F.transform(F.filter(hits, here), lambda h: F.struct(h["pos"].alias("pos"), F.lit(label).alias("label")))

    return F.concat(*(of(phrase.split(), label) for phrase, label in spec.base.items()))


def scan(docs: DataFrame, spec: LicenseSpec, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score: 1 with a base phrase, else the largest share of a found template's words, else 0.
    Null or empty text: no words, empty labels, null places. A long text is one row, all of
    it. Repeated rows get equal results; an empty table gives none; other columns are not read.
    """
    vocab = vocabulary(spec)

    def places(words: Column) -> Column:
        marked = F.transform(words, lambda w, i: F.when(w.isin(vocab), F.struct(i.alias("pos"), w.alias("w"))))
        return F.filter(marked, lambda x: x.isNotNull())

    def of(words: Column) -> Column:
        return let(places(words), lambda hits: F.struct(F.size(words).cast("long").alias("n_words"), hits.alias("hits"), _base_places(words, hits, spec).alias("base")))

    seen = docs.select(docs[id_col].cast("long").alias("doc_id"), let(words_of(docs[text_col]), of).alias("s"))
    seen = scratch.keep(seen.select("doc_id", "s.*", F.monotonically_increasing_id().alias("rid")))

    total = max(1, seen.count())
    df = seen.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h["w"]))).alias("w")).groupBy("w").count()
    df = {r["w"]: r["count"] for r in df.collect()}  # at most one row for each word of the vocabulary
    idf = {w: math.log((total + 1) / (df.get(w, 0) + 1)) for w in vocab}

    found = _found(seen, idf, spec)
    out = seen.drop("hits").join(found, "rid", "left")
    base_labels = F.array_sort(F.array_distinct(F.transform("base", lambda b: b["label"])))
    none = F.array().cast("array<string>")
    return out.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda b: b["pos"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda b: b["pos"])).cast("long").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.coalesce("found_labels", none))), ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("found_score", F.lit(0.0))).alias("score"),
    )


def _found(seen: DataFrame, idf: dict[str, float], spec: LicenseSpec) -> DataFrame:
    """rid, found_labels, found_score of the texts in which a template stands."""
    spark = seen.sparkSession
    postings, rows = [], []
    for t, (label, text, phrases) in enumerate(spec.templates):
        words = text.split()
        keys = _key_places(words, phrases)
        own, need = anchors(words, keys, idf, spec)
        rows.append((t, label, len(words), need, [(i, w, i in keys) for i, w in enumerate(words)]))
        postings += [(words[i], t, i) for i in own]
    templates = spark.createDataFrame(rows, "t int, label string, len int, need int, words array<struct<i:int,w:string,key:boolean>>")
    index = spark.createDataFrame(postings, "w string, t int, i int")
    own = sorted({w for w, _, _ in postings})
    looked = seen.select("rid", F.inline(F.filter("hits", lambda h: h["w"].isin(own))))
    votes = looked.join(F.broadcast(index), "w").groupBy("rid", "t", (F.col("pos") - F.col("i")).alias("at")).agg(F.countDistinct("i").alias("votes"))
    votes = votes.filter(F.col("at") >= 0).join(F.broadcast(templates), "t").filter(F.col("votes") >= F.col("need"))
    placed = votes.select("rid", "t", "label", "len", "at", F.inline("words"))
    there = seen.join(votes.select("rid").distinct(), "rid", "left_semi").select("rid", F.inline("hits"))
    there = there.withColumn("here", F.lit(True))
    wanted = placed.withColumn("pos", F.col("at") + F.col("i"))
    hold = wanted.join(there, ["rid", "pos", "w"], "left").withColumn("here", F.coalesce("here", F.lit(False)))
    judged = hold.groupBy("rid", "t", "label", "len", "at").agg(F.sum(F.col("here").cast("int")).alias("n"), F.bool_and(~F.col("key") | F.col("here")).alias("keys"))
    judged = judged.filter(F.col("keys") & (F.col("n") >= spec.coverage * F.col("len")))
    return judged.groupBy("rid").agg(F.collect_set("label").alias("found_labels"), F.max(F.col("n") / F.col("len")).alias("found_score"))
