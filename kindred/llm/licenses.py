"""License scans: a paragraph classifier over hashed word n-grams, confirmed against templates (native scan).

A paragraph is a line, with the lines that it goes on in: a line of 40
characters or more that does not end like a sentence is taken for hard-wrapped.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

# Notices, headers and paragraphs by which public licence families are known.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.", "Licensed under the MIT license.", "This project is available under the terms of the MIT License", "Released under MIT", "SPDX-License-Identifier: MIT", "License: MIT", "MIT licensed",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.", "Released under Apache-2.0", "Apache 2.0", "Apache License 2.0", "Apache License, Version 2.0, January 2004", "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.", "GNU General Public License version 2 or later", "Distributed under the GNU GPL v3", "GPL-2.0-or-later", "GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later", "Licensed under GPLv3", "Licensed under the GPL", "released under GPL v2", "the GNU GPL",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-2.1-only", "LGPL-3.0-or-later", "Licensed under the GNU LGPL", "GNU Library General Public License", "Lesser GPL",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ],
    "AGPL": [
        "Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only", "AGPL-3.0-or-later", "GNU AGPL v3", "Affero GPL", "Licensed under AGPLv3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "BSD": [
        "Released under the BSD 3-Clause License.", "Licensed under the BSD license", "BSD 2-Clause", "BSD 3-Clause", "BSD-style license", "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ],
    "ISC": [
        "Released under the ISC License.", "ISC license", "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ],
    "MPL-2.0": [
        "Licensed under the Mozilla Public License, version 2.0.", "Released under MPL 2.0", "MPL-2.0", "Mozilla Public License", "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "EPL": [
        "Licensed under the Eclipse Public License", "Eclipse Public License v2.0", "EPL-2.0", "SPDX-License-Identifier: EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which accompanies this distribution, and is available at https://www.eclipse.org/legal/epl-2.0/",
    ],
    "Boost": [
        "Distributed under the Boost Software License, Version 1.0.", "Boost Software License", "SPDX-License-Identifier: BSL-1.0", "See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software",
    ],
    "Unlicense": [
        "Released under the Unlicense", "SPDX-License-Identifier: Unlicense", "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.",
    ],
    "CC0": [
        "Released under CC0", "CC0 1.0 Universal", "SPDX-License-Identifier: CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal.", "Creative Commons Zero",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Available under the CC BY-NC-SA 4.0 license", "CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 3.0"],
    "CC-BY": ["Licensed under CC BY 4.0.", "This text is under CC BY-SA 4.0", "CC BY-SA 3.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License, CC BY-SA", "Creative Commons Attribution 4.0"],
    "proprietary": ["Copyright the authors. All rights reserved.", "All rights reserved.", "All rights reserved. No part of this work may be reproduced without written permission of the publisher", "No part of this publication may be reproduced, stored in a retrieval system, or transmitted, in any form or by any means"],
}
# Sentences that share words with notices and license nothing.
OTHER = [
    "The license plate of the car was stolen last night", "You need a driving licence to rent a car here", "Under the terms of the treaty the version was rejected",
    "He asked for permission to leave and it was granted", "The general public was not admitted to the work", "A free copy of the software came with the magazine",
    "The apache helicopter flew over the creative commons of the village", "The foundation published a new version of its software terms", "She studied at MIT and released an album",
    "The restaurant lost its license under the new rules", "Copyright law is a subject of the second year", "No warranty is given for the weather", "The publisher reserved all the rooms of the hotel",
    "the license", "licensed under", "the License at", "under the terms of the", "Permission was granted by the council to build a school", "Read the license before you open the box", "See the license for more details",
    "The copy of the notice in the hall was out of date", "All the rights of the workers were defended", "The software is provided with the machine and the manual", "This file is part of the archive of the town",
    "The purpose of the file is to list the conditions of the road", "either the first or the second version of the story", "it can be used for any purpose in the kitchen", "The source of the river and the form of the hill",
    "The public domain of the king was sold", "The boost of the engine was measured", "The eclipse of the sun was seen by the public", "The contributors of the journal met in the library", "in no event shall the guests be late for the dinner",
    "The licence of the fisherman was renewed in the spring", "Anyone is free to come to the meeting of the club", "Source code and binary forms are explained in the second chapter", "The distribution of rain over the year is even",
]
#: Unknown paragraphs are listed if they have one of these (lower case); what is named is listed with or without.
ANCHORS = r"licen[sc]e|copyright|permission is hereby|redistribut|all rights reserved|public license|creative commons"
BITS, EPOCHS, RATE, PENALTY = 15, 250, 1.0, 5e-5
#: log2 of the buckets of hashed word pairs for the first look at a paragraph.
GATE_BITS = 14
#: Made examples of a family at most: the bound of the labelled sample that the classifier is fitted on.
EXAMPLES = 160
#: A family is named from this calibrated probability on, and confirmed by this share of a template's weight of word
#: pairs, or this much weight of them; a pair weighs 1 if it is its family's alone, and little where others have it.
LEAST_PROBABILITY, LEAST_SHARE, LEAST_WEIGHT, ENOUGH_WEIGHT = 0.1, 0.5, 1.0, 2.0
COMMON_WEIGHT, SHARED_WEIGHT = 0.1, 0.4
UNKNOWN = "unknown"
_WORD = r"[a-z0-9]+"


def grams(words: list[str]) -> list[str]:
    return words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def _bucket(gram: str, bits: int = BITS) -> int:
    import xxhash

    return xxhash.xxh64(gram.encode(), seed=42).intdigest() % (1 << bits)  # as Spark's pmod of its signed xxhash64


def _pair_bucket(a: str, b: str) -> int:
    import xxhash

    return xxhash.xxh64(b.encode(), seed=xxhash.xxh64(a.encode(), seed=42).intdigest()).intdigest() % (1 << GATE_BITS)  # as Spark's xxhash64 of two strings


def _words(text: str) -> list[str]:
    return re.findall(_WORD, text.lower())


def _pairs(text: str) -> set[str]:
    return {g for g in grams(_words(text)) if " " in g}


def _vectors(texts: list[str], known: set[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) of each text's grams in known buckets (all of them by default), a row of length 1 together,
    so words that no example has dilute nothing."""
    rows, columns, values = [], [], []
    for i, t in enumerate(texts):
        found = [b for b in map(_bucket, dict.fromkeys(grams(_words(t)))) if known is None or b in known]
        rows += [i] * len(found)
        columns += found
        values += [1 / max(1.0, np.sqrt(len(found)))] * len(found)
    return np.array(rows, np.int64), np.array(columns, np.int64), np.array(values, float)


def _product(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, dense: np.ndarray, n: int) -> np.ndarray:
    """The sparse matrix (n rows) times a dense one, column by column."""
    return np.stack([np.bincount(rows, values * dense[columns, k], n) for k in range(dense.shape[1])], 1)


def _examples(seed: int = 7) -> tuple[list[str], list[int], list[str]]:
    """Templates, cut and padded at random, and paragraphs of no family: the labelled training sample."""
    rng = np.random.default_rng(seed)
    families = [*TEMPLATES, UNKNOWN]
    noise = "the a of project file code work author data see more about page in and this for with is to you can which at his her was by from it on as".split()
    texts, labels = [], []
    for k, family in enumerate(families):
        sources = TEMPLATES.get(family, OTHER)
        for i in range(EXAMPLES * (1 if family in TEMPLATES else 2)):
            words = sources[i % len(sources)].split()
            if i >= len(sources) and len(words) > 8 and rng.random() < 0.5:
                a = int(rng.integers(0, 1 + len(words) // 3))
                words = words[a : len(words) - int(rng.integers(0, 1 + len(words) // 3))]
            if i >= len(sources):
                pad = lambda: list(rng.choice(noise, rng.integers(0, 12)))
                words = [*pad(), *words, *pad()] if family in TEMPLATES or rng.random() < 0.7 else list(rng.choice(noise, rng.integers(1, 40)))
            texts.append(" ".join(words))
            labels.append(k)
    return texts, labels, families


@functools.cache
def model() -> tuple[list[str], np.ndarray, np.ndarray, float]:
    """(families, sparse weights, biases, temperature): multinomial logistic regression by proximal gradient
    descent (the penalty leaves most weights 0), its probabilities calibrated on every third example."""
    texts, labels, families = _examples()
    rows, columns, values = _vectors(texts)
    y, held = np.eye(len(families))[labels], np.arange(len(texts)) % 3 == 2
    used, columns = np.unique(columns, return_inverse=True)
    fit = ~held[rows]
    r, c, v = rows[fit], columns[fit], values[fit]
    ws, b = np.zeros((len(used), len(families))), np.zeros(len(families))

    def soft(z):
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    for _ in range(EPOCHS):
        d = np.where(held[:, None], 0.0, soft(_product(r, c, v, ws, len(texts)) + b) - y) / (~held).sum()
        ws = ws - RATE * 10 * _product(c, r, v, d, len(used))
        ws = np.sign(ws) * np.maximum(np.abs(ws) - RATE * 10 * PENALTY, 0)
        b = b - RATE * 10 * d.sum(0)
    # a known bucket keeps its row, even one of zeros: it counts in a paragraph's length
    ws = np.round(ws, 4)
    z = (_product(rows, columns, values, ws, len(texts)) + b)[held]
    loss = lambda t: -np.log(soft(z / t)[y[held] > 0] + 1e-12).mean()
    temperature = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0), key=loss)
    weights = np.full((1 << BITS, len(families)), np.nan)
    weights[used] = ws
    return families, weights, np.round(b, 6), temperature


@functools.cache
def templates() -> list[tuple[str, dict[str, float], float]]:
    """(family, weight by word pair, the weight that confirms) of every template."""
    owners: dict[str, set[str]] = {}
    for family, texts in TEMPLATES.items():
        for t in texts:
            for p in _pairs(t):
                owners.setdefault(p, set()).add(family)
    common = {p for t in OTHER for p in _pairs(t)}
    out = []
    for family, texts in TEMPLATES.items():
        for t in texts:
            weights = {p: COMMON_WEIGHT if p in common or len(owners[p]) > 2 else SHARED_WEIGHT if len(owners[p]) == 2 else 1.0 for p in sorted(_pairs(t))}
            if weights:
                out.append((family, weights, max(min(LEAST_WEIGHT, sum(weights.values())), min(LEAST_SHARE * sum(weights.values()), ENOUGH_WEIGHT))))
    return out


@functools.cache
def gate() -> list[float]:
    """Weights by bucket of a hashed word pair, for the first look at a paragraph.

    A pair weighs the greatest part of what confirms a template that has it.
    What can be confirmed has pairs of one template that come to 1 or more, so
    to drop paragraphs whose pairs don't come to 1 loses nothing; buckets that
    several pairs share only let more through.
    """
    weights = [0.0] * (1 << GATE_BITS)
    for _, pairs, enough in templates():
        for p, w in pairs.items():
            k = _pair_bucket(*p.split(" "))
            weights[k] = max(weights[k], w / enough)
    return weights


#: Where a hard-wrapped line goes on in the next one; the line feed is looked for first, what is around it then.
WRAPPED = r"\r?\n(?<=[^\n]{40}\n)(?<![.!?:;]\n)(?<![.!?:;]\r\n)(?=[ \t]*[^\s])"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, paragraph, family, probability, confirmed) of each paragraph that is named or has an anchor.

    paragraph is its number in the text.  family is the most probable one of
    those with a template that the word pairs confirm (the first of equal ones),
    or unknown: where none is confirmed (``confirmed`` is false), or below the
    least probability.  ``probability`` is the family's next to all others and the unknown class.  Every paragraph that can be
    confirmed is classified, whatever its words and its length; unknown ones
    without an anchor are not listed.  Texts that are null or empty have no
    paragraphs; repeated rows each give theirs; other columns are ignored.
    """
    families, weights, bias, temperature = model()
    sparse = [None if np.isnan(row[0]) else [float(v) for v in row] for row in weights]
    table_of = F.from_json(F.lit(json.dumps(sparse)), "array<array<double>>")
    # by bucket, the word pairs of templates with the template's number and their weight in it
    owners: list[list | None] = [None] * (1 << GATE_BITS)
    for i, (_, own, _) in enumerate(templates()):
        for g, w in own.items():
            k = _bucket(g, GATE_BITS)
            owners[k] = [*(owners[k] or []), {"g": g, "t": i, "w": w}]
    owners_of = F.from_json(F.lit(json.dumps(owners)), "array<array<struct<g:string,t:int,w:double>>>")
    family_of, enough_of = F.array(*(F.lit(families.index(f)) for f, _, _ in templates())), F.array(*(F.lit(float(n)) for _, _, n in templates()))
    gate_of = F.from_json(F.lit(json.dumps(gate())), "array<double>")
    text = F.regexp_replace(F.lower(F.col(text_col)), WRAPPED, " ")
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text, "\n")).alias("paragraph", "t"))
    lines = lines.select("doc_id", "paragraph", F.col("t").rlike(ANCHORS).alias("anchor"), F.trim(F.regexp_replace("t", "[^a-z0-9]+", " ")).alias("t"))
    # a generator keeps the optimizer from evaluating the arrays again for each use
    lines = lines.filter("t <> ''").select("doc_id", "paragraph", "anchor", F.split("t", " ").alias("words")).select("doc_id", "paragraph", "anchor", F.explode(F.array("words")).alias("words"))
    bucket = lambda w, i: F.xxhash64(w, F.get("words", i + 1)).bitwiseAND(F.lit((1 << GATE_BITS) - 1)).cast("int")
    # a bucket counts once, however often its pairs come
    lines = lines.withColumn("hits", F.explode(F.array(F.array_distinct(F.filter(F.transform("words", bucket), lambda b: F.get(gate_of, b) > 0)))))
    enough = F.aggregate("hits", F.lit(0.0), lambda a, b: a + F.get(gate_of, b)) >= 1 - 1e-6
    rows = lines.filter(F.col("anchor") | enough).drop("hits")
    pairs = F.when(F.size("words") > 1, F.transform(F.sequence(F.lit(0), F.greatest(F.size("words") - 2, F.lit(0))), lambda i: F.concat_ws(" ", F.get("words", i), F.get("words", i + 1)))).otherwise(F.array().cast("array<string>"))
    # a generator keeps the optimizer from evaluating the arrays again inside the lambdas
    rows = rows.select("doc_id", "paragraph", "anchor", F.explode(F.array(F.struct(F.array_distinct("words").alias("singles"), F.array_distinct(pairs).alias("pairs")))).alias("g"))
    rows = rows.select("doc_id", "paragraph", "anchor", F.col("g.pairs").alias("pairs"), F.concat("g.singles", "g.pairs").alias("grams"))
    rows = rows.select("doc_id", "paragraph", "anchor", "pairs", F.explode(F.array(F.filter(F.transform("grams", lambda g: F.get(table_of, F.pmod(F.xxhash64(g), F.lit(1 << BITS)).cast("int"))), lambda r: r.isNotNull()))).alias("rows"))
    size = F.greatest(F.lit(1.0), F.sqrt(F.size("rows")))
    sums = F.aggregate("rows", F.array_repeat(F.lit(0.0), len(families)), lambda a, r: F.zip_with(a, r, lambda x, y: x + y))
    scored = rows.select("doc_id", "paragraph", "anchor", "pairs", F.zip_with(sums, F.array(*(F.lit(float(b)) for b in bias)), lambda s, b: (s / size + b) / temperature).alias("z"))
    scored = scored.select("doc_id", "paragraph", "anchor", "pairs", F.explode(F.array("z")).alias("z"))
    # the word pairs that templates have, few as a rule, with their templates: those whose weights come to enough are confirmed
    place = lambda p: F.pmod(F.xxhash64(p), F.lit(1 << GATE_BITS)).cast("int")
    shared = F.flatten(F.transform(F.filter("pairs", lambda p: F.get(owners_of, place(p)).isNotNull()), lambda p: F.filter(F.get(owners_of, place(p)), lambda x: x["g"] == p)))
    scored = scored.select("doc_id", "paragraph", "anchor", "z", F.explode(F.array(shared)).alias("shared"))
    weight = lambda t: F.aggregate(F.filter("shared", lambda x: x["t"] == t), F.lit(0.0), lambda a, x: a + x["w"])
    confirmed = F.filter(F.array_distinct(F.transform("shared", lambda x: x["t"])), lambda t: weight(t) >= F.get(enough_of, t) - 1e-6)
    # families with a confirmed template; the best of them, or of all families where there is none (the last class is the unknown one)
    scored = scored.select("doc_id", "paragraph", "anchor", "z", F.explode(F.array(F.array_distinct(F.transform(confirmed, lambda t: F.get(family_of, t))))).alias("sure"))
    scored = scored.withColumn("confirmed", F.size("sure") > 0)
    among = F.when(F.col("confirmed"), F.col("sure")).otherwise(F.sequence(F.lit(0), F.lit(len(families) - 2)))
    best = F.array_max(F.transform(among, lambda k: F.struct(F.get("z", k).alias("z"), (-k).alias("k"))))
    top = F.array_max("z")
    total = F.aggregate("z", F.lit(0.0), lambda a, v: a + F.exp(v - top))
    scored = scored.withColumn("probability", F.round(F.exp(best["z"] - top) / total, 6)).withColumn("guess", F.element_at(F.array(*map(F.lit, families)), 1 - best["k"]))
    named = (F.col("probability") >= LEAST_PROBABILITY) & F.col("confirmed")
    return scored.filter(F.col("anchor") | named).select("doc_id", "paragraph", F.when(named, F.col("guess")).otherwise(UNKNOWN).alias("family"), "probability", "confirmed")


def classify(texts: list[str]) -> list[tuple[str, float, bool]]:
    """(family, probability, confirmed) of paragraphs in plain Python: what ``scan`` must agree with."""
    families, weights, bias, temperature = model()
    known = set(np.flatnonzero(~np.isnan(weights[:, 0])).tolist())
    z = (_product(*_vectors(texts, known), np.nan_to_num(weights), len(texts)) + bias) / temperature
    out = []
    for t, row in zip(texts, z, strict=True):
        pairs = _pairs(t)
        sure = {families.index(f) for f, own, n in templates() if sum(w for g, w in own.items() if g in pairs) >= n - 1e-6}
        k = max(sure or range(len(families) - 1), key=lambda k: (row[k], -k))
        p = float(np.exp(row[k] - row.max()) / np.exp(row - row.max()).sum())
        out.append((families[k] if round(p, 6) >= LEAST_PROBABILITY and sure else UNKNOWN, p, bool(sure)))
    return out


def query(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))
