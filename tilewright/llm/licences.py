"""Licence scans by a trained paragraph classifier, in DataFrame functions alone.

A paragraph is what stands between blank lines: line breaks are folded, and marks of comments and indents before lines are taken off. Its features are the
words and pairs of neighbouring words that the classifier knows, each counted once; a multinomial logistic regression over them scores each licence family and
"unknown", with a temperature fitted on held-out paragraphs. A family is confirmed by comparison with its templates: the share of a template's
word pairs that the paragraph holds. Of the families that pass, the likeliest is found; what its templates hold is taken out, and the rest is judged again,
so that a paragraph which states several licences has them all. Long paragraphs are judged in parts that overlap.

The classifier is trained on the templates below, whole and with words lost, mixed with invented prose by a fixed seed, once for each process; no table is
needed. Paragraphs that hold no word of `gate` cannot hold enough of any template, and end early: this follows from the templates, and loses nothing.

Every text gives a row: `licences` is the sorted list of confirmed families, `hits` the paragraphs behind them. Null and empty
texts have none; null ids are kept; repeated rows each have their own result; an empty table gives no rows. Other columns
do not take part. Texts of any length are read whole; long ones are taken apart into paragraphs, so no row grows with its text.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import numbered, saved

#: Statements and notices by which well-known licences are given, by family: a paragraph each.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": (
        "This program is licensed under the GNU Affero General Public License, version 3.", "GNU Affero General Public License v3.0 or later", "SPDX-License-Identifier: AGPL-3.0-only",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", "Distributed under the Apache 2.0 license.", "This project is distributed under the terms of the Apache License 2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "BSD-2-Clause": (
        "Released under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause", "Licensed under the Simplified BSD License",
    ),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause", "Use of this source code is governed by a BSD-style license",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "CDDL-1.0": (
        "SPDX-License-Identifier: CDDL-1.0", "Licensed under the Common Development and Distribution License, version 1.0.",
        "The contents of this file are subject to the terms of the Common Development and Distribution License (the License). You may not use this file except in compliance with the License.",
    ),
    "EPL-2.0": (
        "Released under the Eclipse Public License 2.0.", "SPDX-License-Identifier: EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.", "GNU General Public License v2.0 only", "SPDX-License-Identifier: GPL-2.0-only",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3", "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "ISC": (
        "Released under the ISC License.", "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "LGPL-3.0": (
        "This library is licensed under the GNU Lesser General Public License, version 3.", "GNU Lesser General Public License v3.0 or later", "SPDX-License-Identifier: LGPL-3.0-only",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    ),
    "MIT": (
        "Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Released under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "proprietary": ("All rights reserved.", "Copyright. All rights reserved. Unauthorized copying is strictly prohibited.", "Proprietary and confidential. All rights reserved."),
    "public-domain": ("This work is dedicated to the public domain under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0"),
    "Unlicense": (
        "SPDX-License-Identifier: Unlicense", "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
}
#: Words too common to speak for a licence. They are features only in pairs.
COMMON = frozenset("a all and any are be by can following for free from in into is it may met no not of on or person that the this to under use used v version with without work you 0 1 2 3 4".split())
#: Lines about licences that state none, and plain lines, for the unknown class.
OTHERS = (
    "The license of the driver was renewed last week.", "Please read the terms before you copy this file.", "The general public was invited to the source of the river.", "A copy of the letter was released to the public.",
    "Fishing is permitted with a license from the office.", "The creative work of the commons was used for free.", "Version 3 of the form is used from May.", "The rights of all persons are reserved to the assembly.", "The code of conduct is distributed on paper.",
    "Two conditions are met and the third is not.", "The apache people lived in the south.", "She studied at a school in Massachusetts known as MIT.", "Software and documentation are sold by the company.", "The international library is open to any person.", "The program was modified in 2004.",
)
UNKNOWN, SURE, SHARE, WIDE = "unknown", 0.5, 0.6, 128
#: Words of any prose, which the gate takes last.
PLAIN = COMMON | frozenset("above agreed an appear as at available basis but code common conditions contents copies copy copying deal derived distribute distributed do either file form forms general holder its later modify notice program public released rights".split())
#: What may stand before a line: marks of comments, quotes and lists.
MARKS = r"(?m)^[ \t]*(?:/\*+|\*+/?|//+|#+|;+|--+|<!--|%+|>+|\||dnl\b|REM\b)?[ \t]*"
BLANK_LINES = r"(?:\r?\n[ \t]*){2,}"


def words_of(text: str) -> list[str]:
    out, word = [], ""
    for c in text.lower() + " ":
        if c.isascii() and c.isalnum():
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def grams_of(words: list[str]) -> set[str]:
    """Words that are not common, and pairs of neighbours."""
    return {*(w for w in words if w not in COMMON), *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))}


@cache
def template_list() -> list[tuple[str, str]]:
    return [(f, t) for f in sorted(TEMPLATES) for t in TEMPLATES[f]]


@cache
def gate() -> list[str]:
    """Words of which every passage holds one at least that holds SHARE of a template's pairs: for each template enough words that more than the rest of its pairs hold one of them."""
    chosen: set[str] = set()
    for _, t in template_list():
        pairs = [p.split() for p in template_pairs(t)]
        count = lambda w: sum(w in p for p in pairs)  # noqa: B023, E731
        mine: set[str] = set()
        while sum(not mine.isdisjoint(p) for p in pairs) <= (1 - SHARE) * len(pairs):
            free = sorted({w for p in pairs for w in p} - mine, key=lambda w: (w in COMMON, w in PLAIN, w not in chosen, -count(w), w))
            mine.add(free[0])
        chosen |= mine
    return sorted(chosen)


@cache
def model() -> dict:
    """Weights (gram x family), constants and temperature."""
    rng = np.random.default_rng(17)
    families = [*sorted(TEMPLATES), UNKNOWN]
    filler = sorted({w for t in OTHERS for w in words_of(t)} | {"lorem", "ipsum", "dolor", "sit", "amet", "town", "water", "house", "light"})
    rows: list[tuple[set[str], int]] = []
    vocabulary = {g: None for _, t in template_list() for g in sorted(grams_of(words_of(t)))}
    telling = sorted({g for g in vocabulary if " " not in g})

    def prose(n: int) -> list[str]:
        return [filler[i] for i in rng.integers(0, len(filler), n)]

    for f, t in template_list():
        w = words_of(t)
        for k in range(8):
            # Whole, or with some words lost at an end.
            part = w if k < 4 else w[: max(2, int(len(w) * rng.uniform(0.75, 1)))] if k < 6 else w[int(len(w) * rng.uniform(0, 0.25)) :]
            rows.append((grams_of(prose(int(rng.integers(0, 6))) + part + prose(int(rng.integers(0, 12)))), families.index(f)))
    for t in OTHERS:
        rows += [(grams_of(prose(int(rng.integers(0, 4))) + words_of(t)), len(families) - 1) for _ in range(8)]
    # Loose telling words, alone and in no order of a licence, are unknown too.
    for _ in range(400):
        w = prose(int(rng.integers(4, 14)))
        for _ in range(int(rng.integers(1, 3))):
            w.insert(int(rng.integers(0, len(w) + 1)), telling[int(rng.integers(0, len(telling)))])
        rows.append((grams_of(w), len(families) - 1))
    rows += [(set(), len(families) - 1)] * 40
    grams = list(vocabulary)
    at = {g: i for i, g in enumerate(grams)}
    x = np.zeros((len(rows), len(grams) + 1), np.float32)
    x[:, -1] = 1
    for i, (g, _) in enumerate(rows):
        x[i, [at[k] for k in g if k in at]] = 1
    y = np.eye(len(families), dtype=np.float32)[[k for _, k in rows]]
    held = rng.random(len(rows)) < 0.2
    w = np.zeros((x.shape[1], len(families)), np.float32)
    move = np.zeros_like(w)
    seen, told = x[~held], y[~held]
    for _ in range(150):
        move = 0.9 * move - 0.5 * (seen.T @ (soft(seen @ w) - told) / len(seen) + 1e-5 * w)
        w = w + move
    scores = (x[held] @ w).astype(float)
    temperature = min(np.arange(0.3, 3.01, 0.1), key=lambda t: -np.log(np.maximum((soft(scores / t) * y[held]).sum(axis=1), 1e-12)).mean())
    w = np.round(w.astype(float) / temperature, 6)
    return {"families": families, "grams": grams, "weights": w[:-1], "constant": w[-1]}


def soft(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def template_pairs(text: str) -> list[str]:
    """The neighbouring words of a template, by which it is compared (its one word, if there is but one)."""
    w = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)} or set(w))


def words_in(text: Column) -> Column:
    return F.split(F.lower(text), "[^a-z0-9]+")


def telling(words: Column) -> Column:
    """Whether one of the words is one of the gate."""
    return F.arrays_overlap(words, F.array(*[F.lit(w) for w in gate()]))


def passages(docs: DataFrame, text: str) -> DataFrame:
    """(_row, paragraph, part, words) of paragraphs that hold a word of the gate: their words, in parts of 2 * WIDE that overlap by half, so that any WIDE words lie in one."""
    # Whole texts first: most hold none of these words, and end here.
    held = docs.filter(telling(words_in(F.col(f"`{text}`"))))
    plain = F.regexp_replace(F.col(f"`{text}`"), MARKS, "")
    lines = held.select("_row", F.posexplode(F.split(plain, BLANK_LINES)).alias("paragraph", "_p")).select("_row", "paragraph", words_in(F.col("_p")).alias("_w")).filter(telling(F.col("_w")))
    words = lines.select("_row", "paragraph", F.filter("_w", lambda w: w != "").alias("_w"))
    last = F.greatest(F.lit(0), F.ceil(F.size("_w") / WIDE).cast("int") - 2)
    return words.withColumn("part", F.explode(F.sequence(F.lit(0), last))).select("_row", "paragraph", "part", F.slice("_w", F.col("part") * WIDE + 1, F.lit(2 * WIDE)).alias("words"))


KEY = ["_row", "paragraph", "part"]


def known_grams(docs: DataFrame) -> DataFrame:
    """(gram, w: a weight for each family, templates: those whose pair it is, families: those of these templates). A few thousand rows, fixed by the templates above."""
    m = model()
    at = {g: i for i, g in enumerate(m["grams"])}
    share: dict[str, list[int]] = {}
    for k, (_, t) in enumerate(template_list()):
        for g in template_pairs(t):
            share.setdefault(g, []).append(k)
    none = [0.0] * len(m["families"])
    rows = [(g, [float(v) for v in m["weights"][at[g]]] if g in at else none, share.get(g, []), sorted({m["families"].index(template_list()[k][0]) for k in share.get(g, [])})) for g in sorted({*at, *share})]
    return docs.sparkSession.createDataFrame(rows, "gram string, w array<double>, templates array<int>, families array<int>")


def winners(matched: DataFrame, gone: DataFrame | None, sure: float, share: float) -> DataFrame:
    """(KEY, family: its number, probability, p_unknown, template_share) of passages with a family that passes: of those of which the passage holds `share` of a template's pairs the
    likeliest one, if it is so against "unknown" too. gone (KEY, removed: numbers of families): families that were found already: what belongs to their templates counts no more."""
    m = model()
    n = len(m["families"])
    grams = matched if gone is None else matched.join(gone.hint("merge"), KEY).filter(~F.arrays_overlap("families", "removed"))
    removed = F.array().cast("array<int>") if gone is None else F.first("removed")
    held = [F.count(F.when(F.array_contains("templates", k), 1)).alias(f"t{k}") for k in range(len(template_list()))]
    by = grams.groupBy(*KEY).agg(*[F.sum(F.col("w")[i]).alias(f"s{i}") for i in range(n)], *held, removed.alias("removed"))
    # Sums of doubles are rounded, so that their order cannot show.
    z = F.array(*[F.round(F.col(f"s{i}"), 6) + F.lit(float(m["constant"][i])) for i in range(n)])
    owners: dict[str, set[int]] = {}
    for f, t in template_list():
        for g in template_pairs(t):
            owners.setdefault(g, set()).add(m["families"].index(f))
    shares = [[] for _ in range(n - 1)]
    for k, (f, t) in enumerate(template_list()):
        y = m["families"].index(f)
        pairs = template_pairs(t)
        # Of a template's pairs those that found families have too are left out on both sides.
        common = [sorted(owners[g] - {y}) for g in pairs if len(owners[g]) > 1]
        left = F.lit(float(len(pairs)))
        if gone is not None and common:
            left = left - F.size(F.filter(F.array(*[F.array(*[F.lit(v) for v in c]) for c in common]), lambda c: F.arrays_overlap(c, F.col("removed"))))
        shares[y].append(F.when(~F.array_contains("removed", y) & (left > 0), F.col(f"t{k}") / left).otherwise(0.0))
    by = by.select(*KEY, z.alias("z"), F.array(*[F.greatest(*v) if len(v) > 1 else v[0] for v in shares]).alias("shares"))
    # The likeliest of the families whose share suffices.
    able = F.zip_with(F.slice("z", 1, n - 1), "shares", lambda a, b: F.when(b >= share, a))
    best = F.array_position(able, F.array_max(able)).cast("int")
    by = by.withColumn("family", best).filter("family > 0")
    one, other = F.element_at("z", F.col("family")), F.element_at("z", n)
    return by.select(*KEY, (F.col("family") - 1).alias("family"), (1 / (1 + F.exp(other - one))).alias("probability"), (1 / (1 + F.exp(one - other))).alias("p_unknown"), F.element_at("shares", F.col("family")).alias("template_share")).filter(F.col("probability") >= sure)


def found(docs: DataFrame, *, text: str = "text", sure: float = SURE, share: float = SHARE) -> DataFrame:
    """(_row, paragraph, family, probability, p_unknown, template_share): every family of each paragraph of docs (_row, text). After a family is found, what its templates hold is taken
    out, and the rest is judged again, until nothing more is found: a paragraph may state several licences."""
    parts = passages(docs, text)
    pairs = F.when(F.size("words") > 1, F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda i: F.concat_ws(" ", F.col("words")[i - 1], F.col("words")[i]))).otherwise(F.array().cast("array<string>"))
    grams = parts.select(*KEY, F.explode(F.array_distinct(F.concat("words", pairs))).alias("gram"))
    matched = saved(grams.join(F.broadcast(known_grams(docs)), "gram").drop("gram"), "grams")
    fresh, out, gone = saved(winners(matched, None, sure, share), "licences"), None, None
    while not fresh.isEmpty():
        out = fresh if out is None else out.unionByName(fresh)
        gone = out.groupBy(*KEY).agg(F.collect_set("family").alias("removed"))
        # Only passages with a new family can have another one.
        gone = saved(gone.join(fresh.select(*KEY).hint("merge"), KEY, "left_semi"), "removed")
        fresh = saved(winners(matched, gone, sure, share), "licences")
    rows = fresh if out is None else out
    named = F.array(*[F.lit(f) for f in model()["families"]])
    by = rows.groupBy("_row", "paragraph", F.element_at(named, F.col("family") + 1).alias("family")).agg(F.max(F.struct("probability", "p_unknown", "template_share")).alias("_m"))
    return by.select("_row", "paragraph", "family", "_m.*")


def scan(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", sure: float = SURE, share: float = SHARE) -> DataFrame:
    """(id, licences, n_hits, hits) of every row; hits: array<struct<paragraph, family, probability, p_unknown, template_share>>, by paragraph and family."""
    # Rows are numbered as they are written, with the texts that hold a word of the gate: few.
    own = F.col(f"`{text}`")
    own = numbered(docs.select(F.col(f"`{id_col}`").alias("_id"), F.when(telling(words_in(own)), own).alias("_text")), "_row", "licence-rows")
    hits = found(own.filter("_text IS NOT NULL").select("_row", "_text"), text="_text", sure=sure, share=share)
    fields = ["paragraph", "family", "probability", "p_unknown", "template_share"]
    by = hits.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("hits"))
    none = F.array().cast("array<struct<paragraph:int,family:string,probability:double,p_unknown:double,template_share:double>>")
    return own.select("_row", "_id").join(by, "_row", "left").select(
        F.col("_id").alias(id_col), F.array_sort(F.array_distinct(F.transform(F.coalesce("hits", none), lambda h: h["family"]))).alias("licences"), F.size(F.coalesce("hits", none)).cast("long").alias("n_hits"), F.coalesce("hits", none).alias("hits")
    )
