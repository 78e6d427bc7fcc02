"""Licence scans: a trained paragraph classifier over sparse word n-grams, applied in DataFrame operations alone.

The model is a multinomial logistic regression over word n-grams (one to three words) of paragraphs, one
class a family and one for anything else. It is fitted on the driver
from TEMPLATES: whole notices, their parts, with words dropped and with other text around them; the
class of other texts gets DISTRACTORS and shuffled notices. A temperature fitted on variants that the
weights never saw calibrates the probabilities; a paragraph is of no known family unless its best one
reaches ``least``. A prediction stands only if the paragraph shares enough word trigrams with one of the
family's templates. A paragraph without a trigram of any template can't be confirmed, so it is left out before n-grams are made.

A paragraph is a line, or lines wrapped at a width of 50 to 100 characters: one of that length that ends in
no full stop, colon or the like goes on in the next.

Defined results: null and empty texts have no paragraphs and no family; equal paragraphs each count;
rows that repeat a doc_id and its text are one document; rows without a doc_id are left out; an empty
table gives no rows.
"""

from __future__ import annotations

import math
import random
import re
from functools import lru_cache

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Notices as the licences' publishers word them.
TEMPLATES = {
    "agpl-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0", "This project is released under the Apache 2.0 license."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Licensed under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "SPDX-License-Identifier: BSD-3-Clause", "Released under the BSD 2-Clause License."],
    "cc-by-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "cc0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Released under the CC0 1.0 Universal public domain dedication license.", "SPDX-License-Identifier: CC0-1.0"],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "SPDX-License-Identifier: GPL-3.0-or-later", "Released under the GPL version 3 license."],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.", "Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-or-later"],
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.", "Licensed under the MIT license.", "SPDX-License-Identifier: MIT"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."],
    "proprietary": ["All rights reserved.", "Copyright. All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher.", "Proprietary and confidential. Unauthorized copying of this file is prohibited without permission of the copyright holder."],
}
#: Texts with words of licences that grant nothing.
DISTRACTORS = ["His driving licence was taken away after the accident.", "You need a fishing license to fish in this lake.", "The license plate of the car was not readable.", "She asked for permission to leave the room.", "Poetic license lets the author change history.", "The rights of the people were reserved to the court.", "The warranty of the machine ends after two years.", "The copyright of the song was sold by the band.", "The mozilla was a nickname of the project.", "A gnu is an antelope of the savanna.", "Public houses need a license to sell spirits.", "The village was licensed to hold a market."]
#: Stems that texts shuffled from notices go without.
GATES = ["licen", "copyright", "permi", "redistribut", "reserved", "spdx", "proprietary"]
UNKNOWN = "unknown"
_WORD = re.compile(r"[a-z0-9]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def ngrams(words: list[str], most: int = 3) -> set[str]:
    """All n-grams of a paragraph."""
    return {" ".join(words[i : i + k]) for k in range(1, most + 1) for i in range(len(words) - k + 1)}


def _anchors() -> list[str]:
    """Words of which each trigram of the templates holds one: its longest."""
    grams = [w[i : i + 3] for ts in TEMPLATES.values() for t in ts for w in [words_of(t)] for i in range(max(1, len(w) - 2))]
    return sorted({max(g, key=lambda w: (len(w), w)) for g in grams})


ANCHORS = _anchors()
TRIGRAMS = sorted({" ".join(w[i : i + 3]) for ts in TEMPLATES.values() for t in ts for w in [words_of(t)] for i in range(max(1, len(w) - 2))})


def _hash(words: list[str]) -> int:
    """Spark's xxhash64 of words as columns."""
    seed = 42
    for w in words:
        seed = xxhash.xxh64_intdigest(w.encode(), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def _variants(rng: random.Random, words: list[str], times: int) -> list[list[str]]:
    syllables = ["er", "tion", "an", "re", "st", "in", "ou", "le", "ba", "ch"]
    other = lambda n: ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    out = [words]
    for _ in range(times):
        w = [x for x in words if rng.random() > 0.06]
        out.append(other(rng.choice([0, 0, 2, 8])) + w + other(rng.choice([0, 0, 3, 12])))
    return out


class LicenseModel:
    """Weights by n-gram and class, biases, and a temperature."""

    def __init__(self, seed: int = 5, epochs: int = 30, rate: float = 0.5, decay: float = 1e-4):
        self.classes = [*sorted(TEMPLATES), UNKNOWN]
        rng = random.Random(seed)
        fit, check = [], []
        for c, family in enumerate(self.classes[:-1]):
            for text in TEMPLATES[family]:
                variants = _variants(rng, words_of(text), 8)
                fit += [(ngrams(w), c) for w in variants[:7]]
                check += [(ngrams(w), c) for w in variants[7:]]
        none = len(self.classes) - 1
        others = [v for t in DISTRACTORS for v in _variants(rng, words_of(t), 5)]
        for texts in TEMPLATES.values():
            for text in texts:
                mixed = [w for w in words_of(text) if not any(g in w for g in GATES)] + ["license"]
                rng.shuffle(mixed)
                others.append(mixed[:8])
        others += [["license"], ["licensed"], ["copyright"], ["permission"], ["reserved"], ["permitted"], ["licence"]] * 4
        rng.shuffle(others)
        known = set().union(*(ngrams(words_of(t)) for texts in (*TEMPLATES.values(), DISTRACTORS) for t in texts))
        fit += [(ngrams(w), none) for w in others[: len(others) * 4 // 5]]
        check += [(ngrams(w), none) for w in others[len(others) * 4 // 5 :]]
        fit, check = ([(g & known, c) for g, c in rows] for rows in (fit, check))
        self.weights: dict[str, list[float]] = {}
        self.bias = [0.0] * len(self.classes)
        self.temperature = 1.0
        for epoch in range(epochs):
            rng.shuffle(fit)
            step = rate / (1 + epoch / 5)
            for grams, c in fit:
                p = self.probabilities(grams)
                size = math.sqrt(max(1, len(grams)))
                for k in range(len(self.classes)):
                    g = p[k] - (k == c)
                    self.bias[k] -= step * g * 0.1
                    for x in grams:
                        w = self.weights.setdefault(x, [0.0] * len(self.classes))
                        w[k] -= step * (g / size + decay * w[k])
        self.temperature = min((0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=lambda t: self._loss(check, t))
        self.accuracy = sum(max(range(len(self.classes)), key=self.probabilities(g).__getitem__) == c for g, c in check) / len(check)

    def _loss(self, rows: list, temperature: float) -> float:
        return -sum(math.log(max(self.probabilities(g, temperature)[c], 1e-12)) for g, c in rows)

    def probabilities(self, grams: set[str], temperature: float | None = None) -> list[float]:
        """Logits are summed over the known n-grams and divided by the root of their number."""
        known = [self.weights[x] for x in grams if x in self.weights]
        size = math.sqrt(max(1, len(known)))
        logits = [(self.bias[k] + sum(w[k] for w in known) / size) / (temperature or self.temperature) for k in range(len(self.classes))]
        top = max(logits)
        e = [math.exp(x - top) for x in logits]
        return [x / sum(e) for x in e]


@lru_cache(maxsize=1)
def model() -> LicenseModel:
    return LicenseModel()


def _weights(spark, m: LicenseModel) -> DataFrame:
    """One row a known n-gram: as many as the templates have, whatever the corpus."""
    return spark.createDataFrame([(g, [round(x, 9) for x in w]) for g, w in sorted(m.weights.items())], "gram string, w array<double>")


def _trigrams(spark) -> DataFrame:
    rows = []
    for family, texts in TEMPLATES.items():
        for t, text in enumerate(texts):
            w = words_of(text)
            n = min(3, len(w))
            grams = {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}
            rows += [(family, t, len(grams), g) for g in sorted(grams)]
    return spark.createDataFrame(rows, "family string, template int, size int, tri string")


def _grams(words: str, n: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))


def unwrapped(text: Column) -> Column:
    """The text with wrapped lines joined, one line a paragraph."""
    return F.regexp_replace(text, r"(?:^|(?<=\n))([^\n]{49,99}[^\n.!?:;])\n(?=[^\n])", "$1 ")


def license_paragraphs(docs: DataFrame, least: float = 0.6, shared: float = 0.5) -> DataFrame:
    """Per paragraph with a trigram of a template and a likely family: doc_id, copy, paragraph, family, probability, overlap, confirmed."""
    spark, m = docs.sparkSession, model()
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("copy"), F.lower(unwrapped(F.col("text"))).alias("low"))
    para = rows.select("doc_id", "copy", F.posexplode(F.split("low", r"\n")).alias("paragraph", "low"))
    para = para.select("doc_id", "copy", "paragraph", F.array_remove(F.split(F.regexp_replace("low", "[^a-z0-9]+", " "), " "), "").alias("words"))
    # no paragraph without a trigram of a template can be confirmed; words are looked up first, as that is cheap
    para = para.where(F.arrays_overlap("words", F.array(*map(F.lit, ANCHORS))))
    # words are bound to a variable of the outer transform: as a column, the optimizer would put what makes
    # them into the inner one, to be done again for each word
    three = lambda w: F.transform(F.sequence(F.lit(2), F.greatest(F.size(w) - 1, F.lit(2))), lambda i: F.xxhash64(F.get(w, i - 2), F.get(w, i - 1), F.get(w, i)))
    tri = F.get(F.transform(F.array("words"), three), F.lit(0))
    para = para.where(F.arrays_overlap(tri, F.array(*[F.lit(_hash(t.split(" "))) for t in TRIGRAMS]))).distinct()
    # equal paragraphs, however many, are read once
    para = para.withColumn("name", F.xxhash64("words"))
    texts = para.groupBy("name").agg(F.first("words").alias("words"))
    grams = F.array_distinct(F.flatten(F.array(*[F.when(F.size("words") >= k, _grams("words", F.lit(k))).otherwise(F.array().cast("array<string>")) for k in (1, 2, 3)])))
    hits = texts.select("name", F.explode(grams).alias("gram")).join(F.broadcast(_weights(spark, m)), "gram")
    n = len(m.classes)
    sums = hits.groupBy("name").agg(F.count("*").alias("known"), *[F.sum(F.col("w")[k]).alias(f"s{k}") for k in range(n)])
    logits = F.array(*[(F.lit(m.bias[k]) + F.col(f"s{k}") / F.sqrt("known")) / m.temperature for k in range(n)])
    scored = sums.select("name", logits.alias("z"))
    top = F.array_max("z")
    scored = scored.select("name", (F.lit(1.0) / F.aggregate("z", F.lit(0.0), lambda acc, x: acc + F.exp(x - top))).alias("probability"), F.get(F.array(*map(F.lit, m.classes)), F.array_position("z", top).cast("int") - 1).alias("family"))
    likely = scored.where((F.col("family") != UNKNOWN) & (F.col("probability") >= least))
    tri = texts.join(likely.select("name", "family"), "name")
    size = F.least(F.size("words"), F.lit(3))
    tri = tri.withColumn("tris", F.array_distinct(_grams("words", size))).select("name", "family", F.size("tris").alias("own"), F.explode("tris").alias("tri"))
    overlap = tri.join(F.broadcast(_trigrams(spark)), ["family", "tri"]).groupBy("name", "template").agg((F.count("*") / F.least(F.first("own"), F.first("size"))).alias("overlap")).groupBy("name").agg(F.max("overlap").alias("overlap"))
    judged = likely.join(overlap, "name", "left").withColumn("overlap", F.coalesce("overlap", F.lit(0.0)))
    out = para.select("doc_id", "copy", "paragraph", "name").join(judged, "name")
    return out.select("doc_id", "copy", "paragraph", "family", F.round("probability", 6).alias("probability"), F.round("overlap", 6).alias("overlap"), (F.col("overlap") >= shared).alias("confirmed"))


def license_scan(docs: DataFrame, least: float = 0.6, shared: float = 0.5) -> DataFrame:
    """Per document: doc_id, n_paragraphs (not blank), n_licensed, families (confirmed, comma-joined),
    probability (the highest of a confirmed paragraph, null without one)."""
    rows = docs.where(F.col("doc_id").isNotNull())
    found = license_paragraphs(rows, least, shared).where("confirmed")
    per = found.groupBy("doc_id", "copy").agg(F.count("*").alias("n_licensed"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"), F.max("probability").alias("probability"))
    text = F.col("text").cast("string")
    # the count of paragraphs is made before the join, so that no text is shuffled
    slim = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("copy"), F.when(text.isNull(), 0).otherwise(F.size(F.filter(F.split(unwrapped(text), "\n"), lambda x: F.trim(x) != ""))).cast("long").alias("n_paragraphs"))
    return slim.join(per, ["doc_id", "copy"], "left").select("doc_id", "n_paragraphs", F.coalesce("n_licensed", F.lit(0)).cast("long").alias("n_licensed"), F.coalesce("families", F.lit("")).alias("families"), "probability")
