"""Licence families of text paragraphs: a trained classifier, an unknown class, and template comparison.

A paragraph is a line, or a notice that was wrapped over up to ``SPAN`` lines: those are judged joined, too, and count
when the joined text is confirmed and the line alone is not. A multinomial logistic regression over word n-grams (n = 1, 2, 3) is trained from licence
templates and cuttings of them against ordinary paragraphs of the corpus, which make the ``unknown`` class. Its
weights are kept sparse: an n-gram counts only when its weight for some family stands out, so a paragraph with none of
them is unknown by its bias alone, and a quick test for the words that all those n-grams need leaves such texts out
without changing a result. Scores are scaled by a temperature, fitted on variants of the notices and on ordinary lines
that are not among the training texts; below ``least`` probability a paragraph is unknown. A prediction is confirmed when enough of the paragraph's word trigrams
stand in a template of the family.

Everything on the main path is a DataFrame function; one scan, no shuffle. Null and empty texts have no paragraph and
an empty list. Rows are judged one by one, repeated or not; of equally probable families the first of the template list
is told. Texts of any length are judged whole. Other columns are not looked at. An empty table gives no row.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Notices that name a licence, by family.
TEMPLATES = {
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license.",
        "Released under the 3-Clause BSD License.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Content is available under the Creative Commons Attribution License unless otherwise noted.",
    ],
    "cc-by-sa": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "proprietary": [
        "All rights reserved.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form without the prior written permission of the publisher.",
        "Copyright, all rights reserved. Unauthorized copying is strictly prohibited.",
    ],
}
UNKNOWN = "unknown"
_WORD = r"[^\p{L}\p{N}]+"


def _words(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def _grams(words: list[str]) -> list[str]:
    return [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


#: Lines that a wrapped notice is looked for in.
SPAN = 4


def variants() -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(family, text) to train with and to fit the temperature on, no text in both.

    Training has the templates (four times), two of three surroundings and every other longer cutting of them; the
    temperature is fitted on the third surroundings and the other cuttings.
    """
    train, rest = [], []
    for family, texts in TEMPLATES.items():
        for text in texts:
            words = text.split()
            train += [(family, text)] * 4
            train += [(family, f"{text} See the file for details"), (family, f"Note {text}")]
            rest.append((family, f"The text of this page is {text} and its authors"))
            for n in range(max(4, len(words) * 2 // 3), len(words)):
                (train if n % 2 else rest).append((family, " ".join(words[:n])))
    seen = {t for _, t in train}
    return train, [(f, t) for f, t in rest if t not in seen]


def train(spark: SparkSession, ordinary: list[str], buckets: int = 1 << 14) -> dict:
    """Sparse weights {gram: {family: weight}}, bias by family and temperature, from templates and ordinary paragraphs."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizer

    families = [UNKNOWN, *TEMPLATES]
    known = [t for ts in TEMPLATES.values() for t in ts]
    vocabulary = {g for t in known for g in _grams(_words(t))}
    # sampled lines that hold notices are no everyday text, or their words would count as everyday ones below
    ordinary = [t for t in ordinary if not any(g in vocabulary for g in _grams(_words(t)) if g.count(" ") == 2)]
    common = {w for t in ordinary for w in _words(t)}
    vocabulary = {g for g in vocabulary if set(g.split(" ")) - common}  # an n-gram of everyday words alone tells nothing
    everyday = ["The license of the driver was valid", "Version 2 of the work is out", "General use of the software is free to the public", "He was licensed to practise", "Terms and conditions of the common good", "By the creative work of many", "", "the", "copyright law in general", "this work is under the terms of the contract"]
    ordinary = list(dict.fromkeys(ordinary))
    mine, others = variants()
    rows = [(families.index(f), t) for f, t in mine] + [(0, t) for t in [*ordinary[::2], *everyday * 8]]
    unseen = [(families.index(f), t) for f, t in others] + [(0, t) for t in ordinary[1::2]]
    features = lambda t: sorted(set(_grams(_words(t))) & vocabulary)
    data = spark.createDataFrame([(float(y), features(t)) for y, t in rows], "label double, grams array<string>").coalesce(1)
    fitted = CountVectorizer(inputCol="grams", outputCol="features", vocabSize=buckets, binary=True).fit(data)
    model = LogisticRegression(maxIter=60, regParam=2e-3, family="multinomial", standardization=False).fit(fitted.transform(data))
    matrix, bias = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    weights = {}
    for j, gram in enumerate(fitted.vocabulary):
        column = matrix[:, j] - matrix[0, j]  # against the unknown class
        if (column[1:].max(initial=0)) > 0.05:
            weights[gram] = {families[c]: round(float(column[c]), 4) for c in range(1, len(column)) if abs(column[c]) > 1e-3}
    bias = {families[c]: float(bias[c] - bias[0]) for c in range(1, matrix.shape[0])}
    held = [(y, features(t)) for y, t in unseen]

    def loss(t: float) -> float:
        total = 0.0
        for label, grams in held:
            scores = [0.0] + [(bias[f] + sum(weights[g].get(f, 0.0) for g in grams if g in weights)) / t for f in families[1:]]
            top = max(scores)
            total += top + math.log(sum(math.exp(s - top) for s in scores)) - scores[label]
        return total

    return {"weights": weights, "bias": bias, "temperature": min((x / 20 for x in range(4, 61)), key=loss), "families": families[1:], "ordinary": sorted(common & {w for t in known for w in _words(t)})}


def sample_paragraphs(docs: DataFrame, text_col: str = "text", n: int = 400) -> list[str]:
    """A bounded sample of ordinary lines for training: of the ``n`` texts of smallest hash the first line's first 400 characters."""
    line = F.substring(F.split_part(F.col(text_col).cast("string"), F.lit("\n"), F.lit(1)), 1, 400)
    return [r.line for r in docs.where(F.col(text_col).isNotNull()).select(F.xxhash64(text_col).alias("h"), line.alias("line")).orderBy("h").limit(n).collect()]


def needed_words(model: dict) -> list[str]:
    """Words of which a paragraph must hold one to be anything but unknown.

    Without them, even all other weighted n-grams together would leave every family's score below the unknown class's.
    """
    weights, bias = model["weights"], model["bias"]
    chosen: list[str] = []
    while True:
        left = {g: w for g, w in weights.items() if not set(g.split(" ")) & set(chosen)}
        excess = {f: b + sum(max(0.0, w.get(f, 0.0)) for w in left.values()) for f, b in bias.items()}
        if not left or max(excess.values()) < 0:
            return sorted(chosen)
        gain: dict[str, float] = {}
        for g, w in left.items():
            for word in set(g.split(" ")) - set(model["ordinary"]) or set(g.split(" ")):
                gain[word] = gain.get(word, 0.0) + sum(max(0.0, w.get(f, 0.0)) for f, x in excess.items() if x >= 0)
        chosen.append(max(gain, key=lambda w: (gain[w], w)))


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, inside lambdas too."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def scan(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, confirm: float = 0.5) -> DataFrame:
    """One row per document: id, ``n_licenses`` and ``licenses``: array<struct<line, lines, family, probability, similarity, confirmed>>.

    Lines count from 0; ``lines`` is how many of them the notice was found in. ``family`` of the most probable licence
    stands in ``family`` (null without one).
    """
    text = F.col(f"`{text_col}`").cast("string")
    weights, families = model["weights"], model["families"]
    table = F.from_json(F.lit(json.dumps({g: [w.get(f, 0.0) / model["temperature"] for f in families] for g, w in weights.items()})), "map<string,array<double>>")
    bias = F.array(*(F.lit(model["bias"][f] / model["temperature"]) for f in families))
    needed = r"(?i)(?:\b|_)(?:" + "|".join(needed_words(model)) + ")" if weights else "(?!)"
    trigrams = F.from_json(F.lit(json.dumps({f: sorted({g for t in TEMPLATES[f] for g in _grams(_words(t)) if g.count(" ") == 2}) for f in families})), "map<string,array<string>>")

    def words(line: Column) -> Column:
        return F.filter(F.split(F.lower(line), _WORD), lambda w: w != "")

    def grams(w: Column, n: int) -> Column:
        spots = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(spots, lambda i: F.array_join(F.slice(w, i, n), " "))

    def judged(line: Column, at: Column, n: Column) -> Column:
        def of(w: Column) -> Column:
            hit = F.array_distinct(F.concat(grams(w, 1), grams(w, 2), grams(w, 3)))
            rows = F.filter(F.transform(hit, lambda g: F.try_element_at(table, g)), lambda x: x.isNotNull())
            scores = F.aggregate(rows, bias, lambda acc, x: F.zip_with(acc, x, lambda a, b: a + b))
            return F.struct(at.cast("int").alias("line"), n.cast("int").alias("lines"), scores.alias("scores"), grams(w, 3).alias("trigrams"))

        return _let(words(line), of)

    lines = F.split(text, "\n")
    spots = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: s["x"].rlike(needed))
    joined = lambda s: F.array_join(F.slice(F.col("_lines"), s["i"] + 1, SPAN), " ")
    rows = docs.select(F.col(f"`{id_col}`").alias(id_col), F.when(text.rlike(needed), spots).alias("_spots"), F.when(text.rlike(needed), lines).alias("_lines"))
    single = F.transform("_spots", lambda s: judged(s["x"], s["i"], F.lit(1)))
    behind = F.filter("_spots", lambda s: s["i"] + 1 < F.size("_lines"))
    wrapped = F.transform(behind, lambda s: judged(joined(s), s["i"], F.least(F.lit(SPAN), F.size("_lines") - s["i"])))
    rows = rows.withColumn("_single", single).withColumn("_wrapped", wrapped)

    def verdict(j: Column) -> Column:
        total = F.aggregate(j["scores"], F.lit(1.0), lambda a, s: a + F.exp(s))
        best = F.array_max(j["scores"])
        family = F.element_at(F.array(*map(F.lit, families)), F.array_position(j["scores"], best).cast("int"))
        same = _let(F.element_at(trigrams, family), lambda template: F.size(F.filter(j["trigrams"], lambda g: F.array_contains(template, g))))
        similarity = F.round(same / F.greatest(F.size(j["trigrams"]), F.lit(1)), 4)
        probability = F.exp(best) / total
        return F.struct(j["line"].alias("line"), j["lines"].alias("lines"), F.when(probability >= least, family).otherwise(UNKNOWN).alias("family"), F.round(probability, 6).alias("probability"), similarity.alias("similarity"), (similarity >= confirm).alias("confirmed"))

    known = lambda c: F.filter(F.transform(c, verdict), lambda v: v["family"] != UNKNOWN)
    none = F.expr("cast(array() as array<struct<line:int,lines:int,family:string,probability:double,similarity:double,confirmed:boolean>>)")
    rows = rows.withColumn("_own", F.coalesce(known("_single"), none)).withColumn("_joined", F.coalesce(F.filter(known("_wrapped"), lambda v: v["confirmed"]), none))
    # joined lines stand back behind a line in them that is a notice by itself, and behind an earlier start of the same notice
    own = lambda v: F.exists("_own", lambda o: o["confirmed"] & (o["line"] >= v["line"]) & (o["line"] < v["line"] + v["lines"]))
    early = lambda v: F.exists("_joined", lambda o: (o["family"] == v["family"]) & (o["line"] < v["line"]) & (o["line"] + o["lines"] > v["line"]))
    rows = rows.withColumn("_joined", F.filter("_joined", lambda v: ~own(v) & ~early(v)))
    covered = lambda o: F.exists("_joined", lambda v: (o["line"] >= v["line"]) & (o["line"] < v["line"] + v["lines"]))
    rows = rows.withColumn("licenses", F.array_sort(F.concat(F.filter("_own", lambda o: ~covered(o)), "_joined")))
    best = F.array_max(F.transform("licenses", lambda v: F.struct(v["confirmed"], v["probability"], v["family"])))
    return rows.select(id_col, F.size("licenses").alias("n_licenses"), best["family"].alias("family"), best["confirmed"].alias("confirmed"), "licenses")
