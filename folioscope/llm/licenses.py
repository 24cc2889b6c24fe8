"""Licence scans: a trained paragraph classifier, with DataFrame operations alone where data is read.

A paragraph is a line, or all lines up to the next blank one together where that is surer. Its
features are its distinct words and word pairs, as far as they stand in the
statements below and are not common in the sampled lines. A softmax regression with an L1 penalty
over them has one class per licence family, one of unlisted licences and one for everything else;
it is fitted on the driver on variants of the statements, on statements of other licences and the
listed ones without the words that tell their family, on sentences that only sound like licences,
and on at most NEGATIVES lines of SAMPLE_DOCS documents (those of least hash). A temperature
fitted on statements held out as a whole calibrates the probabilities.

A prediction is confirmed by comparing the paragraph with the family's statements: the weight of
the common features over that of the lighter of the two, a feature weighing more the fewer kinds
of licences have it (those in no statement weigh most). A paragraph is of a family where that
reaches THRESHOLD and the comparison CONFIRM; other paragraphs that are likeliest a licence are
unknown.

Only paragraphs that hold a telling word are scored. Telling are the features without which, all
others taken together, no family can pass the class of everything else; so nothing is lost.

Results for odd input: null and empty texts and blank lines give no rows; every repeated document
gives the rows of one; rows without a doc_id give rows with a null one; ties between families go
to the first by name; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.llm.common import cut, whole_text

NEGATIVES, SAMPLE_DOCS = 2_000, 200
#: Share of the sampled lines from which on a word is too common to be a feature by itself.
COMMON = 0.02
THRESHOLD, CONFIRM = 0.5, 0.6
OTHER, UNKNOWN = "~other", "unknown"
TEMPERATURES = [0.25 * 1.15**i for i in range(30)]

#: Statements of public licences, by family.
STATEMENTS: dict[str, list[str]] = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
        "This project is available under the Apache 2.0 license.",
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Distributed under the MIT licence, see the LICENSE file.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY.",
        "SPDX-License-Identifier: MIT",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Licensed under the GPL, version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License, version 2.1.",
        "Licensed under the GNU Lesser General Public License.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Licensed under the BSD 3-Clause License.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "Available under the Creative Commons Attribution-ShareAlike license.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "For non-commercial use only under CC BY-NC.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright 2020. All rights reserved.",
        "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited.",
        "No part of this publication may be reproduced without prior written permission of the publisher.",
    ],
}

#: Sentences of other matters that share words with licences.
OTHERS = [
    "The driver renewed a license at the general office.",
    "A fishing license is needed for this public lake.",
    "The new version was released on Friday under the bridge.",
    "Students at MIT released a report on software last year.",
    "The Apache helicopter flew under the clouds.",
    "He reserved all seats and all rights were read to him.",
    "The work is free of charge and open to any person.",
    "Version 2.0 of the report is the general one, version 3 is for the public.",
    "The terms of the contract were agreed in writing.",
    "Creative people in common rooms work on attribution of paintings.",
    "The foundation of the house is free software for the mind.",
    "A copy of the file is in the library with the source code.",
    "The conditions of the road and the name of the holder.",
    "Permission to land was granted to the pilot.",
    "Mozilla and other browsers are subject to updates.",
    "The public may use this general entrance, any later one is closed.",
]


#: Statements of licences that have no family here.
UNLISTED: dict[str, list[str]] = {
    "eclipse": ["Licensed under the Eclipse Public License 2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution."],
    "artistic": ["Licensed under the Artistic License 2.0", "You may redistribute this package under the same terms as Perl itself, under the Artistic License."],
    "isc": ["Released under the ISC license.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "boost": ["Distributed under the Boost Software License, Version 1.0.", "See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt"],
    "zlib": ["Licensed under the zlib license.", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."],
    "agpl": ["Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"],
    "eupl": ["Licensed under the European Union Public Licence, version 1.2."],
    "cc0": ["To the extent possible under law, the author has waived all copyright under CC0 1.0 Universal Public Domain Dedication."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
}


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def features(text: str) -> set[str]:
    """Distinct words and word pairs, as the DataFrame path makes them."""
    w = [x for x in re.split(r"[\W_]+", text.lower()) if x]
    return {*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))}


@dataclass
class Model:
    classes: list[str]
    grams: list[str]
    weights: np.ndarray  # classes x grams
    bias: np.ndarray
    temperature: float
    common: frozenset[str] = frozenset()
    unlisted: tuple[str, ...] = ()

    def kinds(self) -> list[set[str]]:
        """The features of each kind of licence, listed or not."""
        texts = [*STATEMENTS.values(), *(UNLISTED[k] for k in self.unlisted)]
        return [set().union(*map(features, x)) for x in texts]

    def telling(self) -> list[str]:
        """Words one of which any paragraph of a family must hold."""
        other = self.classes.index(OTHER)
        words: set[str] = set()
        for c in range(len(self.classes)):
            if c == other:
                continue
            gain = self.weights[c] - self.weights[other]
            lead, rest = self.bias[other] - self.bias[c], 0.0
            if lead <= 0:
                raise ValueError("the class of everything else must lead on nothing")
            for i in np.argsort(gain):
                if gain[i] <= 0:
                    continue
                rest += gain[i]
                if rest >= 0.999 * lead:
                    parts = self.grams[i].split(" ")
                    if not words & set(parts):
                        words.add(max(parts, key=lambda x: (x not in self.common, len(x))))
        return sorted(words)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _examples(negatives: list[str], unlisted: dict[str, list[str]]) -> tuple[list[set[str]], list[str], list[int]]:
    """Statements whole, in parts and next to other text, and all else; and which statement each comes from."""
    sets, names, sources = [], [], []
    filler = [features(x) for x in OTHERS[:4]] + [set()]

    def add(words: set[str], name: str, source: int):
        sets.append(words)
        names.append(name)
        sources.append(source)

    listed = [(family, t) for family, texts in STATEMENTS.items() for t in texts]
    unknown = [(UNKNOWN, t) for texts in unlisted.values() for t in texts]
    telling = {f: set().union(*(features(t) for t in texts)) - set().union(*(features(t) for g, more in STATEMENTS.items() if g != f for t in more)) for f, texts in STATEMENTS.items()}
    for source, (family, t) in enumerate([*listed, *unknown]):
        words = t.split()
        parts = [t] + ([" ".join(words[: len(words) * 2 // 3]), " ".join(words[len(words) // 3 :])] if len(words) > 11 else [])
        for p in parts:
            for extra in filler:
                add(features(p) | extra, family, source)
        if family != UNKNOWN and len(bare := features(t) - telling[family]) > 4:  # what all licences say
            for extra in filler:
                add(bare | extra, UNKNOWN, source)
    known = [features(t) for _, t in [*listed, *unknown]]
    for source, t in enumerate([*OTHERS * 5, *negatives, ""], len(known)):
        f = features(t)
        if t in OTHERS or not any(len(k & f) >= 0.6 * len(k) for k in known):  # a licence among the sampled lines
            add(f, OTHER, source)
    return sets, names, sources


def fit(negatives: list[str], penalty: float = 2e-3, rounds: int = 400, unlisted: dict[str, list[str]] = UNLISTED) -> Model:
    """Proximal gradient descent for the L1-penalised softmax regression, then the temperature."""
    sets, names, sources = _examples(negatives, unlisted)
    classes = sorted({*STATEMENTS, UNKNOWN, OTHER})
    seen = Counter(g for t in negatives for g in features(t))
    common = frozenset(g for g, c in seen.items() if c > COMMON * max(len(negatives), 100))
    statements = [t for texts in (*STATEMENTS.values(), *unlisted.values()) for t in texts]
    grams = sorted({g for t in (*OTHERS, *statements) for g in features(t) if not common.issuperset(g.split(" "))})
    at = {g: i for i, g in enumerate(grams)}
    # Examples of one fold that are the same to the model are one, with a count.
    alike = Counter((frozenset(at[g] for g in s if g in at), n, source % 4) for s, n, source in zip(sets, names, sources, strict=True))
    order = sorted(alike, key=lambda k: (k[1], sorted(k[0]), k[2]))
    x, y = np.zeros((len(order), len(grams))), np.zeros((len(order), len(classes)))
    for i, (s, n, _) in enumerate(order):
        x[i, list(s)] = 1
        y[i, classes.index(n)] = 1
    fold = np.array([k[2] for k in order])
    times = np.array([alike[k] for k in order], float)[:, None]
    each = 1 / np.maximum(1, (y * times).sum(0))
    each[classes.index(OTHER)] *= 4
    share = times * (y * each).sum(1, keepdims=True)
    share /= share.sum()
    other = classes.index(OTHER)

    def train(x, y, share):
        w, b = np.zeros((len(classes), x.shape[1])), np.zeros(len(classes))
        mean_w, mean_b, t = w, b, 1.0
        step = 4.0 / max(1.0, (share * x**2).sum())
        for _ in range(rounds):
            off = share * (_softmax(x @ mean_w.T + mean_b) - y)
            new = mean_w - step * (off.T @ x)
            new = np.sign(new) * np.maximum(0, np.abs(new) - step * penalty)
            new_b = mean_b - step * off.sum(0)
            t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
            mean_w, mean_b = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b)
            w, b, t = new, new_b, t2
        return w, b

    def fitted(pick):
        """Weights, and biases by which the class of everything else leads on a paragraph without features."""
        w, b = train(x[pick], y[pick], share[pick] / share[pick].sum())
        b = b - b[other]
        return w, np.minimum(b, np.where(np.arange(len(b)) == other, 0.0, -0.5))

    # Each fold of statements is scored by a model that never saw them.
    z = np.zeros_like(y)
    for k in range(4):
        w, b = fitted(fold != k)
        z[fold == k] = x[fold == k] @ w.T + b
    loss = lambda k: -float((share * y * np.log(_softmax(z / k) + 1e-12)).sum())
    w, b = fitted(np.ones(len(order), bool))
    return Model(classes, grams, w, b, min(TEMPERATURES, key=loss), common, tuple(unlisted))


def sample_negatives(docs: DataFrame, lines: int = NEGATIVES, from_docs: int = SAMPLE_DOCS) -> list[str]:
    """At most `lines` lines of at most `from_docs` documents, those of least hash."""
    ids = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(from_docs)
    found = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(ids), "doc_id").select(F.explode(F.split("text", "\n")).alias("line"))
    found = found.where(F.length("line").between(1, 2000)).distinct().orderBy(F.xxhash64("line"), "line").limit(lines)
    return sorted(r.line for r in found.collect())


def _quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def scan(docs: DataFrame, model: Model, threshold: float = THRESHOLD, confirm: float = CONFIRM) -> DataFrame:
    """Rows (doc_id, line, family, probability, similarity, confirmed) of all paragraphs that name a licence."""
    spark = docs.sparkSession
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("t"), F.split(whole_text(), "\n").alias("lines"))
    marked = lines.withColumn("full", F.transform("lines", lambda x: x.rlike(r"\S")))
    spots = F.sequence(F.lit(0), F.size("lines") - 1)
    at = lambda i: F.get(F.col("full"), i)
    first = F.filter(spots, lambda i: at(i) & ~F.coalesce(at(i - 1), F.lit(False)))
    last = F.filter(spots, lambda i: at(i) & ~F.coalesce(at(i + 1), F.lit(False)))
    block = marked.select("doc_id", "t", "lines", F.explode(F.arrays_zip(first.alias("first"), last.alias("last"))).alias("b"))
    block = block.select("doc_id", "t", F.col("b.first").alias("start"), F.slice("lines", F.col("b.first") + 1, F.col("b.last") - F.col("b.first") + 1).alias("part"))
    # Each line, and all lines up to the next blank one together.
    one = F.transform("part", lambda x, i: F.struct(i.alias("i"), F.lit(False).alias("whole"), x.alias("text")))
    whole = F.when(F.size("part") > 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(True).alias("whole"), F.array_join("part", " ").alias("text")))).otherwise(F.slice(one, 1, 0))
    pieces = block.select("doc_id", "t", "start", F.explode(F.concat(one, whole)).alias("x"))
    worded = pieces.select("doc_id", "t", "start", (F.col("start") + F.col("x.i")).alias("line"), "x.whole", _words(F.col("x.text")).alias("words"))
    telling = F.expr(f"array({', '.join(map(_quoted, model.telling()))})")
    held = cut(worded.where(F.arrays_overlap("words", telling)).distinct(), "paragraphs")
    keys = ["doc_id", "t", "start", "line", "whole", "h"]
    pairs = F.expr("CASE WHEN size(words) > 1 THEN transform(sequence(0, size(words) - 2), i -> concat(get(words, i), ' ', get(words, i + 1))) ELSE array() END")
    keyed = held.select(*keys[:-1], F.xxhash64("words").alias("h"), F.array_distinct(F.concat("words", pairs)).alias("grams"))
    used = [i for i in range(len(model.grams)) if np.abs(model.weights[:, i]).max() > 0]
    rows = ", ".join(f"({_quoted(model.grams[i])}, {', '.join(f'{w!r}D' for w in model.weights[:, i].tolist())})" for i in used)
    columns = [f"w{c}" for c in range(len(model.classes))]
    weights = spark.sql(f"SELECT * FROM VALUES {rows} AS t(gram, {', '.join(columns)})")  # bounded by the statements
    each = keyed.select(*keys, F.explode_outer("grams").alias("gram")).join(F.broadcast(weights), "gram", "left")
    sums = each.groupBy(*keys).agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in columns))
    z = {name: (F.col(c) + float(b)) / model.temperature for c, name, b in zip(columns, model.classes, model.bias, strict=True)}
    top = F.greatest(*z.values())
    total = sum((F.exp(v - top) for v in z.values()), F.lit(0.0))
    best = F.coalesce(*(F.when(v == top, F.lit(name)) for name, v in z.items() if name != OTHER), F.lit(OTHER))
    named = sums.select(*keys, best.alias("best"), (1 / total).alias("probability")).where(F.col("best") != OTHER)
    # Compared with the statements of its family, by the weights of features.
    kinds = model.kinds()
    weight = lambda g: float(np.log((len(kinds) + 1) / (1 + sum(g in k for k in kinds))))
    heaviest = float(np.log((len(kinds) + 1) / 2))
    listed = [(f, sorted(features(t))) for f, texts in STATEMENTS.items() for t in texts]
    shown = ", ".join(f"({_quoted(f)}, array({', '.join(map(_quoted, g))}), map({', '.join(f'{_quoted(x)}, {weight(x)!r}D' for x in g)}), {sum(map(weight, g))!r}D)" for f, g in listed)
    statements = spark.sql(f"SELECT * FROM VALUES {shown} AS t(best, statement, weights, heavy)")
    known = ", ".join(f"({_quoted(g)}, {weight(g)!r}D)" for g in sorted(set().union(*kinds)))
    heavy = keyed.join(named.select(*(F.col(k).alias(f"__{k}") for k in keys)), F.expr(" and ".join(f"{k} <=> __{k}" for k in keys)), "left_semi")
    heavy = heavy.select(*keys, F.explode("grams").alias("gram")).join(F.broadcast(spark.sql(f"SELECT * FROM VALUES {known} AS t(gram, w)")), "gram", "left")
    heavy = heavy.groupBy(*keys).agg(F.sum(F.coalesce("w", F.lit(heaviest))).alias("own"))
    same = lambda a, b: F.expr(" and ".join(f"{a}.{k} <=> {b}.{k}" for k in keys))
    met = named.alias("a").join(keyed.alias("b"), same("a", "b")).join(heavy.alias("c"), same("a", "c")).select("a.*", "b.grams", "c.own")
    both = F.expr("aggregate(array_intersect(grams, statement), 0D, (total, g) -> total + weights[g])")
    alike = both / F.greatest(F.least("own", "heavy"), F.lit(0.1))
    near = met.join(F.broadcast(statements), "best", "left").groupBy(*keys, "best", "probability").agg(F.coalesce(F.max(alike), F.lit(0.0)).alias("similarity"))
    sure = (F.col("probability") >= threshold) & (F.col("similarity") >= confirm) & (F.col("best") != UNKNOWN)
    near = near.withColumn("family", F.when(sure, F.col("best")).otherwise(UNKNOWN))
    # Of a paragraph's readings the surest kind: lines of a family, the whole with one, unknown lines, the unknown whole.
    kind = F.when(F.col("family") != UNKNOWN, 2).otherwise(0) + F.when(F.col("whole"), 0).otherwise(1)
    near = near.withColumn("kind", kind).withColumn("most", F.max("kind").over(W.partitionBy("doc_id", "t", "start"))).where("kind = most")
    near = near.dropDuplicates(["doc_id", "line", "whole", "h"])
    return near.select("doc_id", "line", "family", "probability", "similarity", (F.col("family") != UNKNOWN).alias("confirmed"))
