"""Licence scans: a trained paragraph classifier confirmed by template comparison.

Sparse word n-grams of a paragraph meet the weights of a multinomial logistic regression in a
join; the class of largest probability is the licence family. Temperature and least probability
of a family are calibrated on notices and prose that the model never saw. A family is confirmed
where the paragraph holds most of the word pairs of one of its templates. DataFrame operations
only: the driver fits the weights on the fixed paragraphs below and nothing else."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import table
from marlstone.operators.stages import settled

UNKNOWN = "unknown"
#: Share of a template's word pairs that a paragraph must hold.
LEAST_SHARED = 0.6
#: Templates with fewer pairs must also make up this share of the pairs of a sentence.
SHORT = 4
LEAST_COVER = 0.25

# Names of licences, from which short notices are made.
NAMES = {
    "MIT": ("MIT",), "Apache-2.0": ("Apache 2.0", "Apache License 2.0", "Apache-2.0"), "GPL": ("GPL", "GPL v3", "GPLv3", "GPLv2", "GNU GPL"),
    "LGPL": ("LGPL", "LGPL v2.1", "GNU LGPL"), "AGPL": ("AGPL", "AGPL v3", "GNU AGPL"), "BSD": ("BSD", "3-clause BSD", "BSD-3-Clause", "Modified BSD", "New BSD", "Simplified BSD"),
    "ISC": ("ISC",), "MPL-2.0": ("MPL 2.0", "Mozilla Public License 2.0"), "CC-BY": ("CC BY 4.0", "CC-BY-4.0"), "CC-BY-SA": ("CC BY-SA 4.0",),
    "CC-BY-NC": ("CC BY-NC 4.0",), "CC0": ("CC0 1.0", "CC0"),
}
NOTICES = ("{} license", "License: {}", "Licensed under the {} license", "Released under the {} license", "Distributed under the {}", "Licensed under {}", "terms of the {} license")
# Typical paragraphs of each licence family, beside those made from its names.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Released under the Apache 2.0 license.", "SPDX-License-Identifier: Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 2.", "Released under the GPL v3 license.", "SPDX-License-Identifier: GPL-3.0-or-later",
        "Distributed under the GPLv3.", "Distributed under the GPLv2.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.", "Released under the LGPL license.", "SPDX-License-Identifier: LGPL-3.0-only",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    ),
    "AGPL": (
        "This work is licensed under the GNU Affero General Public License, version 3.", "Released under the AGPL v3 license.", "SPDX-License-Identifier: AGPL-3.0-only",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ),
    "BSD": (
        "Released under the BSD License.", "Licensed under the 3-clause BSD license.", "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "ISC": (
        "Released under the ISC License.", "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "MPL-2.0": (
        "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "CC0": (
        "Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0",
    ),
    "Public-Domain": (
        "This work is in the public domain.", "Dieses Werk ist gemeinfrei.", "Cette oeuvre est dans le domaine public.", "Esta obra es de dominio público.", "Released into the public domain.",
        "This is free and unencumbered software released into the public domain.",
    ),
    "Proprietary": (
        "All rights reserved.", "Tous droits réservés.", "Tous droits reserves.", "Alle Rechte vorbehalten.", "Todos los derechos reservados.",
        "Copyright (c) 2020 Example Ltd. All rights reserved.",
        "No part of this publication may be reproduced or transmitted in any form without the prior written permission of the publisher.",
    ),
}
# Paragraphs that speak of licences, rights or copies but grant no known licence.
OTHERS = (
    "The driver had lost his licence and had to take the test again.", "You need a fishing licence to fish in this river.", "The council granted the pub a late licence.",
    "The software license fee is due every year.", "The bank asked for permission to call back.", "A search warrant was issued on Monday.",
    "The warranty covers parts for two years.", "He took poetic license with the story.", "Copyright law is taught in the second year.",
    "The committee will redistribute the funds.", "Students need written permission to leave.", "She studies licensing in the media trade.",
    "This product is licensed under a separate agreement.", "Contact us about licensing.", "The television licence costs more this year.", "Human rights reserved for citizens were discussed in public.",
    "The book is no longer under copyright.", "He said all rights were reserved to the village hall.", "The terms of the agreement were read out by the clerk.",
    "The software was provided by the school and paid for by the parents.", "No part of the house may be used as a shop.", "Version 2.0 of the plan was released on Monday.", "See the licence for details.", "The museum has a licence to sell drinks.", "A public domain of the king was the forest.",
)


# Notices and prose that are not fitted, for calibration alone.
CALIBRATION: tuple[tuple[str, str], ...] = (
    ("This package is made available under the MIT license, see the file COPYING.", "MIT"), ("Code in this folder: MIT license.", "MIT"),
    ("You may use this program under the Apache License 2.0.", "Apache-2.0"), ("Sources are subject to the Apache License, Version 2.0.", "Apache-2.0"),
    ("The program is covered by the GNU General Public License.", "GPL"), ("GPL v3 or any later version.", "GPL"),
    ("The library may be used under the GNU Lesser General Public License.", "LGPL"), ("Covered by the GNU Affero General Public License.", "AGPL"),
    ("Use of this source code is governed by a BSD-style license.", "BSD"), ("Our tools carry the 3-clause BSD license.", "BSD"),
    ("This is ISC licensed code under the ISC License.", "ISC"), ("Files are under the Mozilla Public License 2.0.", "MPL-2.0"),
    ("Text is available under CC BY 4.0.", "CC-BY"), ("Text is available under the Creative Commons Attribution-ShareAlike License.", "CC-BY-SA"),
    ("Images: CC BY-NC 4.0.", "CC-BY-NC"), ("The data are under CC0 1.0.", "CC0"), ("The text has been placed in the public domain.", "Public-Domain"),
    ("Copyright 2011 by the publisher, all rights reserved.", "Proprietary"),
    ("He said all rights reserved to nobody in the village hall would be given to the school.", UNKNOWN), ("The driving licence was renewed in the new year.", UNKNOWN),
    ("The permission of the owner was never asked for.", UNKNOWN), ("They sold the software to a bank in the city.", UNKNOWN),
    ("The public was let into the garden after the general meeting.", UNKNOWN), ("Any version of the story will do for this purpose.", UNKNOWN),
    ("The conditions were met and the work was provided without delay.", UNKNOWN), ("The creative team and the commons of the town.", UNKNOWN),
    ("The name of the holder may be used by the office.", UNKNOWN), ("Source and binary stars were seen in the form of a list.", UNKNOWN),
    ("A copy of the notice hung in the hall.", UNKNOWN), ("Apache is the name of a people.", UNKNOWN),
)

# Names of licences outside the families, close to one of them.
FOREIGN = (
    "CC BY-ND 4.0", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0", "Creative Commons Attribution-NoDerivatives", "Attribution-NonCommercial-ShareAlike", "Attribution-NonCommercial-NoDerivatives",
    "MIT-0", "MIT No Attribution", "0BSD", "Eclipse Public License", "Boost Software License", "Union Public License", "Microsoft Public License", "Common Public License",
    "IBM Public License", "Nokia Public License", "Sun Public License", "Artistic License", "Zlib License", "Open Font License", "Server Side Public License", "Business Source License", "Python Software Foundation License", "Academic Free License",
)
#: A sentence that denies what it names.
DENIAL = (
    r"\b(?:not|never|neither|no longer|nicht|pas|jamais|no est[aá]|no es)\s+(?:[a-z]+\s+){0,3}?"
    r"(?:under|in the public domain|unter|gemeinfrei|sous|dans le domaine public|bajo|de dominio p)"
)

#: Words too common to tell a notice.
COMMON = frozenset("a all an and any are as at be by for from if in into is it may not of on or that the this to under was with you your".split())

TOKEN = "[a-z0-9]+(?:\\.[0-9]+)*"
#: A line that ends in the middle of a sentence goes on in the next, unless that is blank.
WRAPPED = r"([^\s.:;!?|])[ \t]*\r?\n([ \t]*[^\s])"


def templates() -> dict[str, tuple[str, ...]]:
    """The typical paragraphs of each family and the short notices made from its names."""
    return {f: (*ts, *(n.format(name) for name in NAMES.get(f, ()) for n in NOTICES), *NAMES.get(f, ())) for f, ts in TEMPLATES.items()}


def own_pairs() -> dict[str, set[str]]:
    """Of each family the word pairs that no other family's templates hold."""
    held = {f: set().union(*(grams(t, (2,)) for t in ts)) for f, ts in templates().items()}
    return {f: g - set().union(*(h for o, h in held.items() if o != f)) for f, g in held.items()}


def foreign_pairs() -> list[str]:
    """Word pairs of :data:`FOREIGN` that no template holds: a sentence with one speaks of another
    licence."""
    held = set().union(*(grams(t, (2,)) for ts in templates().values() for t in ts))
    return sorted(set().union(*(grams(n, (2,)) for n in FOREIGN)) - held)


def tokens(text: str) -> list[str]:
    return re.findall(TOKEN, text.lower())


def grams(text: str, sizes: tuple[int, ...] = (1, 2, 3)) -> set[str]:
    """Distinct runs of so many words, as the columns below make them."""
    w = tokens(text)
    return {" ".join(w[i : i + n]) for n in sizes for i in range(len(w) - n + 1)}


class Model:
    """Softmax regression over in-vocabulary n-grams, each paragraph scaled to unit length. A
    family needs ``least`` probability; otherwise the class is unknown."""

    def __init__(self):
        base = [(t, f) for f, ts in templates().items() for t in ts] + [(t, UNKNOWN) for t in OTHERS]
        around = ("{}", "Note: {}", "{} See the notice file for details.", "Copyright (c) 2019 the authors. {}", "The authors say: {} Thank you.")
        plain = [(grams(a.format(t)), f) for t, f in base for a in (around if f != UNKNOWN else ("{}", "{} It was late.", "And so, {}"))]
        # running text that holds the wrappings and nothing else
        rows = plain + [(grams(a.format("")), UNKNOWN) for a in around[1:]]
        self.families = [*sorted(TEMPLATES), UNKNOWN]
        self.vocabulary = sorted(set().union(*(g for g, _ in rows)))
        self.at = {g: i for i, g in enumerate(self.vocabulary)}
        x, y = self._matrix([g for g, _ in rows]), self._targets([f for _, f in rows])
        w, b = self._fit(x, y)
        seen, truth = self._matrix([grams(t) for t, _ in CALIBRATION]), self._targets([f for _, f in CALIBRATION])
        heat = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0), key=lambda t: self._loss((seen @ w + b) / t, truth))
        self.weights, self.bias = np.round(w / heat, 6), b / heat
        p, target, unknown = self._soft(seen @ self.weights + self.bias), truth.argmax(1), len(self.families) - 1

        def right(least: float) -> int:
            guess = np.where(p.max(1) >= least, p.argmax(1), unknown)
            return int((guess == target).sum() + ((guess == unknown) & (target == unknown)).sum())

        self.least = max((0.3, 0.4, 0.5, 0.6, 0.7), key=lambda t: (right(t), -t))

    def _matrix(self, rows: list[set[str]]) -> np.ndarray:
        x = np.zeros((len(rows), len(self.at)))
        for i, g in enumerate(rows):
            known = [self.at[k] for k in g if k in self.at]
            x[i, known] = 1 / np.sqrt(max(1, len(known)))
        return x

    def _targets(self, families: list[str]) -> np.ndarray:
        return np.eye(len(self.families))[[self.families.index(f) for f in families]]

    @staticmethod
    def _soft(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def _loss(self, z: np.ndarray, y: np.ndarray) -> float:
        return float(-np.log((self._soft(z) * y).sum(1) + 1e-12).mean())

    def _fit(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w, b = np.zeros((x.shape[1], y.shape[1])), np.zeros(y.shape[1])
        row = 1 / np.sqrt(y.sum(0))[y.argmax(1)]
        row = (row / row.sum())[:, None]
        for _ in range(300):
            g = row * (self._soft(x @ w + b) - y)
            w -= 30 * (x.T @ g + 2e-5 * w)
            b -= 3 * g.sum(0)
        return w, b


@lru_cache(1)
def model() -> Model:
    return Model()


def needed_pairs() -> list[str]:
    """Word pairs of which a paragraph holds one at least where it holds LEAST_SHARED of some
    template: of each template the rarest ones, one more than it may lack. So this gate drops
    nothing that a template could confirm."""
    out = set()
    for ts in templates().values():
        for t in ts:
            pairs = sorted(grams(t, (2,)), key=lambda g: (sum(w in COMMON for w in g.split()), g))
            out.update(pairs[: len(pairs) - int(np.ceil(LEAST_SHARED * len(pairs))) + 1])
    return sorted(out)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def _run_at(w: Column, n: int) -> Callable[[Column], Column]:
    return lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(n)])


def word_runs(text: Column, sizes: tuple[int, ...]) -> Column:
    """Distinct runs of so many words. The words are a variable of the lambda, so the pattern is
    applied once for a text, not once for a run."""

    def runs(w: Column) -> Column:
        none = F.array().cast("array<string>")
        made = [F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), _run_at(w, n))).otherwise(none) for n in sizes]
        return F.array_distinct(F.concat(*made))

    return F.get(F.transform(F.array(words(text)), runs), F.lit(0))


def fixed_rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small fixed table as a literal of the plan."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def paragraphs(text: Column) -> Column:
    """Lines of a text, each with those that go on from it."""
    joined = F.regexp_replace(F.regexp_replace(text, WRAPPED, "$1 $2"), WRAPPED, "$1 $2")
    return F.split(joined, "\n", -1)


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_shared: float = LEAST_SHARED) -> DataFrame:
    """One row per paragraph that could hold a template: id, ``para`` (0-based among the text's
    paragraphs), ``family``, ``families``, ``probability``, ``shared``, ``confirmed``, ``paragraph``.

    A paragraph is a line with the lines that go on from it (:data:`WRAPPED`). Every paragraph is
    tested against :func:`needed_pairs`, which no confirmable one fails. ``family`` is ``unknown``
    where no template confirms a family, or those that are confirmed are together not likely
    enough. A template confirms a family that is likelier than unknown where enough of its pairs
    are there, one of which no other family has (:func:`own_pairs`); sentences that deny
    (:data:`DENIAL`) or name a neighbouring licence (:data:`FOREIGN`) count for nothing.
    ``families`` are all that are confirmed, by name, so a notice of two licences gives both;
    ``family`` is the likeliest, of equals the first by name. Null and empty texts
    have no paragraphs. Repeated rows are scanned once for each id and text; rows without an id
    are scanned like others. An empty table gives no rows; other columns are ignored. Both joined
    tables are the fixed model and are broadcast. The texts are scanned once."""
    spark, fitted, own = docs.sparkSession, model(), own_pairs()
    weights = fixed_rows(
        spark, [{"gram": g, "w": [float(v) for v in row]} for g, row in zip(fitted.vocabulary, fitted.weights, strict=True)], "gram: string, w: array<double>"
    )
    pairs = fixed_rows(
        spark,
        [{"family": f, "template": f"{f}{i}", "size": len(p), "gram": g, "own": g in own[f]}
         for f, ts in templates().items() for i, t in enumerate(ts) for p in [sorted(grams(t, (2,)))] for g in p],
        "family: string, template: string, size: int, gram: string, own: boolean",
    )
    needed = F.array(*map(F.lit, needed_pairs()))
    found = settled(
        docs.select(F.col(id_col).alias("id"), F.posexplode(paragraphs(F.col(text_col))).alias("para", "paragraph"))
        .filter(F.arrays_overlap(word_runs(F.col("paragraph"), (2,)), needed)).distinct()
        .withColumn("row", F.monotonically_increasing_id())
    )
    classes = range(len(fitted.families))
    scored = (
        found.select("row", F.explode_outer(word_runs(F.col("paragraph"), (1, 2, 3))).alias("gram"))
        .join(F.broadcast(weights), "gram", "left").groupBy("row")
        .agg(F.count("w").alias("m"), *[F.coalesce(F.sum(F.col("w")[i]), F.lit(0.0)).alias(f"z{i}") for i in classes])
    )
    odds = F.array(*[F.col(f"z{i}") / F.sqrt(F.greatest(F.col("m"), F.lit(1))) + F.lit(float(fitted.bias[i])) for i in classes])
    likelihood = F.transform("odds", lambda z: F.exp(z - F.array_max("odds")))
    guessed = scored.select("row", odds.alias("odds")).select(
        "row", "odds", F.transform(likelihood, lambda e: e / F.aggregate(likelihood, F.lit(0.0), lambda a, x: a + x)).alias("p")
    )
    foreign = F.array(*map(F.lit, foreign_pairs()))
    sentences = found.select("row", F.posexplode(F.split("paragraph", r"[.!?;](?:\s|$)")).alias("at", "sentence"))
    matched = (
        sentences.filter(~F.lower("sentence").rlike(DENIAL)).select("row", "at", word_runs(F.col("sentence"), (2,)).alias("own_runs"))
        .filter(~F.arrays_overlap("own_runs", foreign)).select("row", "at", F.size("own_runs").alias("n"), F.explode("own_runs").alias("gram"))
        .join(F.broadcast(pairs), "gram")
        .groupBy("row", "family", "template", "size", "at", "n").agg(F.collect_set("gram").alias("g"), F.max("own").alias("own"))
        .groupBy("row", "family", "template", "size").agg(
            (F.size(F.array_distinct(F.flatten(F.collect_list("g")))) / F.col("size")).alias("share"), F.max(F.size("g") / F.col("n")).alias("cover"),
            F.max("own").alias("own"),
        )
    )
    likeness = (
        matched.filter(F.col("own") & (F.col("share") >= least_shared) & ((F.col("size") >= SHORT) | (F.col("cover") >= LEAST_COVER)))
        .groupBy("row", "family").agg(F.max("share").alias("shared"))
    )
    place = F.array_position(F.array(*map(F.lit, fitted.families)), F.col("family")).cast("int")
    unknown_at = F.lit(fitted.families.index(UNKNOWN) + 1)
    likely = F.element_at("odds", place) > F.element_at("odds", unknown_at)
    best = F.sort_array(F.collect_list(F.struct((-F.element_at("p", place)).alias("p"), "family", "shared")))
    said = (
        likeness.join(guessed, "row").filter(likely).groupBy("row").agg(best.alias("best"))
        .filter(-F.aggregate("best", F.lit(0.0), lambda a, x: a + x["p"]) >= fitted.least)
    )
    first, none = F.get("best", F.lit(0)), F.array().cast("array<string>")
    return found.join(guessed, "row").join(said, "row", "left").select(
        F.col("id").alias(id_col), "para", F.coalesce(first["family"], F.lit(UNKNOWN)).alias("family"),
        F.coalesce(F.array_sort(F.transform("best", lambda x: x["family"])), none).alias("families"),
        F.coalesce(-first["p"], F.array_max("p")).alias("probability"), F.coalesce(first["shared"], F.lit(0.0)).alias("shared"),
        F.col("best").isNotNull().alias("confirmed"), "paragraph",
    )


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents")).select("doc_id", "para", "family", F.array_join("families", ",").alias("families"), "confirmed")


def oracle() -> dict[str, str]:
    """The scan in SQL over the same fitted weights and the same templates."""
    fitted, own = model(), own_pairs()
    foreign = ", ".join(f"'{g}'" for g in foreign_pairs())
    quoted = lambda rows: json.dumps(rows).replace("'", "''")
    weights = quoted([{"g": g, "w": [float(v) for v in row]} for g, row in zip(fitted.vocabulary, fitted.weights, strict=True)])
    pairs = quoted([
        {"family": f, "template": f"{f}{i}", "size": len(p), "g": g, "own": g in own[f]}
        for f, ts in templates().items() for i, t in enumerate(ts) for p in [sorted(grams(t, (2,)))] for g in p
    ])
    runs = lambda n: f"list_transform(range(1, len(k) - {n - 2}), lambda i: {chr(32).join(f'k[i + {a}]' + (' || chr(32) ||' if a < n - 1 else '') for a in range(n))})"
    split = lambda c: f"regexp_extract_all(lower({c}), '{TOKEN}')"
    wrapped = WRAPPED.replace("'", "''")
    families = ", ".join(f"'{f}'" for f in fitted.families)
    bias = ", ".join(repr(float(b)) for b in fitted.bias)
    needed = ", ".join("'" + g + "'" for g in needed_pairs())
    sql = f"""
WITH w AS (SELECT unnest(from_json('{weights}', '[{{"g": "VARCHAR", "w": ["DOUBLE"]}}]'), recursive := true)),
p AS (SELECT unnest(from_json('{pairs}', '[{{"family": "VARCHAR", "template": "VARCHAR", "size": "INTEGER", "g": "VARCHAR", "own": "BOOLEAN"}}]'), recursive := true)),
j AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '{wrapped}', '\\1 \\2', 'g'), '{wrapped}', '\\1 \\2', 'g'), chr(10)) AS l FROM documents WHERE text IS NOT NULL),
l AS (SELECT DISTINCT * FROM (SELECT doc_id, unnest(l) AS paragraph, unnest(range(len(l)))::INT AS para FROM j)),
k AS (SELECT *, {split('paragraph')} AS k FROM l),
f AS (SELECT doc_id, para, paragraph, k, row_number() OVER () AS r FROM k WHERE list_has_any({runs(2)}, [{needed}])),
s AS (SELECT r, unnest(list_distinct(list_concat(k, list_concat({runs(2)}, {runs(3)})))) AS g FROM f),
c AS (SELECT r, unnest(w) AS v, unnest(range(len(w))) AS i FROM s JOIN w USING (g)),
z AS (SELECT r, i, sum(v) / sqrt(count(*)) + ([{bias}])[i + 1] AS o FROM c GROUP BY r, i),
b AS (SELECT r, arg_min(i, (-o, i)) AS i, max(o) AS top FROM z GROUP BY r),
e AS (SELECT z.r, z.i, z.o, exp(z.o - b.top) / sum(exp(z.o - b.top)) OVER (PARTITION BY z.r) AS p FROM z JOIN b USING (r)),
q AS (SELECT e.r, ([{families}])[e.i + 1] AS family, e.p FROM e JOIN e AS n ON n.r = e.r AND n.i = {fitted.families.index(UNKNOWN)} WHERE e.o > n.o),
t AS (SELECT r, unnest(regexp_split_to_array(paragraph, '[.!?;](?:\\s|$)')) AS sentence, unnest(range(len(regexp_split_to_array(paragraph, '[.!?;](?:\\s|$)')))) AS sn FROM f),
u AS (SELECT r, sn, {split('sentence')} AS k FROM t WHERE NOT regexp_matches(lower(sentence), '{DENIAL}')),
v AS (SELECT r, sn, list_distinct({runs(2)}) AS o FROM u),
x AS (SELECT r, sn, len(o) AS n, unnest(o) AS g FROM v WHERE NOT list_has_any(o, [{foreign}])),
y AS (SELECT r, family, template, size, sn, n, count(DISTINCT x.g) AS m FROM x JOIN p ON x.g = p.g GROUP BY ALL),
d AS (SELECT r, family, template, size, count(DISTINCT x.g) / size AS share, bool_or(own) AS own FROM x JOIN p ON x.g = p.g GROUP BY r, family, template, size),
h AS (SELECT DISTINCT d.r, d.family FROM d JOIN (SELECT r, template, max(m / n) AS cover FROM y GROUP BY ALL) y USING (r, template)
      WHERE own AND share >= {LEAST_SHARED} AND (size >= {SHORT} OR cover >= {LEAST_COVER})),
a AS (SELECT r, arg_min(family, (-p, family)) AS family, string_agg(family, ',' ORDER BY family) AS families FROM h JOIN q USING (r, family) GROUP BY r HAVING sum(p) >= {fitted.least})
SELECT doc_id, para, coalesce(family, '{UNKNOWN}') AS family, coalesce(families, '') AS families, family IS NOT NULL AS confirmed FROM f LEFT JOIN a USING (r)"""
    return {"op10_licences": sql}


ORACLE = oracle
