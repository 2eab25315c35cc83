"""The licence scan against a brute-force version, its gate, and notices that were never fitted."""

import re

import numpy as np

from marlstone.llm import licences as L

BARE = {
    "Distributed under the GPLv3.": "GPL", "BSD-3-Clause": "BSD", "MPL 2.0": "MPL-2.0", "AGPL v3": "AGPL", "Apache 2.0": "Apache-2.0",
    "Tous droits réservés.": "Proprietary", "Alle Rechte vorbehalten.": "Proprietary", "Todos los derechos reservados.": "Proprietary",
    "Modified BSD License": "BSD", "license: mit": "MIT", "Dieses Werk ist gemeinfrei.": "Public-Domain",
}
PROSE = ("of the", "free software", "Under the same sky we met", "Wir kommen mit der Bahn", "the apache", "")
#: Notices and prose that are neither fitted nor calibrated on: family, text.
UNSEEN = (
    ("MIT", "The code in this repository is licensed under the MIT License."), ("MIT", "This work is released under the terms of the MIT license by its authors."),
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES\nOF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 by the project team."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0 OR custom"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed\nunder the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES\nOR CONDITIONS OF ANY KIND."),
    ("GPL", "It is licensed under the GNU General Public License, version 3 or later."), ("GPL", "This is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."),
    ("LGPL", "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."),
    ("AGPL", "The server is licensed under the GNU Affero General Public License, version 3."), ("BSD", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that these conditions are met:"),
    ("BSD", "Neither the name of Example Inc. nor the names of its contributors may be used to endorse or promote products derived from this software."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("MPL-2.0", "The files are subject to the terms of the Mozilla Public License, v. 2.0."), ("CC-BY", "Photos are licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA", "This article is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."), ("CC-BY-NC", "Maps are licensed under CC BY-NC 4.0."),
    ("CC0", "To the extent possible under law, the person who made it has waived all copyright and related rights to this work."), ("Public-Domain", "These pictures were released into the public domain."),
    ("Proprietary", "Copyright (c) 1998 Example Press. All rights reserved."), ("Proprietary", "No part of this book may be reproduced or transmitted in any form without the prior written permission of the author."),
    ("unknown", "He said all rights reserved to nobody in the village hall would go to the school."), ("unknown", "The driver lost the license of the firm and the right to drive."),
    ("unknown", "The public domain of the village lies behind the hall."), ("unknown", "It was distributed under the table to all of the guests of the house."),
    ("unknown", "We met under the terms of the old agreement."), ("unknown", "The software foundation was laid in May."), ("unknown", "A version 2.0 of the bridge is planned."),
    ("unknown", "Free of charge, to any person who asks, the museum opens its doors."), ("unknown", "The warranty of the car is limited to two years."),
)

#: Licences outside the families and sentences that deny one: nothing is confirmed.
NEIGHBOURS = (
    "CC BY-NC-SA", "CC BY-ND", "Licensed under CC BY-NC-SA 4.0.", "Licensed under CC BY-ND 4.0.", "Eclipse Public License 2.0", "Boost Software License, Version 1.0",
    "MIT-0", "SPDX-License-Identifier: MIT-0", "This file is not licensed under the MIT License.", "This work is not in the public domain.",
    "The data were never released under the Apache 2.0 license.", "The text is no longer distributed under the GPL.", "Dieses Werk ist nicht gemeinfrei.",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
)
DUAL = {
    "Licensed under the MIT License or the Apache License, Version 2.0.": ["Apache-2.0", "MIT"],
    "Released under the GPL v3 license. Also released under the MIT License.": ["GPL", "MIT"],
}


def test_neighbours_denials_and_dual_notices(spark):
    docs = spark.createDataFrame(list(enumerate([*NEIGHBOURS, *DUAL])), "doc_id long, text string")
    got = {r.paragraph: r.families for r in L.scan_licences(docs).collect() if r.confirmed}
    assert got == DUAL


def test_notices_in_few_words(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*BARE, *PROSE])], "doc_id long, text string")
    got = {r.paragraph: r.family for r in L.scan_licences(docs).collect() if r.confirmed}
    assert got == BARE


def brute(text):
    """Confirmed families of each paragraph of a text, the likeliest first, without Spark and without the gate."""
    model, own, foreign, out = L.model(), L.own_pairs(), set(L.foreign_pairs()), []
    joined = text
    for _ in range(2):
        joined = re.sub(L.WRAPPED, r"\1 \2", joined)
    for line in joined.split("\n"):
        known = [model.at[g] for g in L.grams(line) if g in model.at]
        z = model.weights[known].sum(0) / np.sqrt(max(len(known), 1)) + model.bias
        p = dict(zip(model.families, model._soft(z[None])[0], strict=True))
        sentences = [L.grams(s, (2,)) for s in re.split(r"[.!?;](?:\s|$)", line) if not re.search(L.DENIAL, s.lower())]
        sentences = [s for s in sentences if not s & foreign]
        good = []
        for family, ts in L.templates().items():
            for t in ts:
                want, have = L.grams(t, (2,)), set().union(*sentences)
                cover = max((len(s & want) / len(s) for s in sentences if s), default=0)
                fits = want and (len(want) >= L.SHORT or cover >= L.LEAST_COVER) and len(have & want) / len(want) >= L.LEAST_SHARED
                if fits and have & want & own[family] and p[family] > p[L.UNKNOWN]:
                    good.append((-p[family], family))
        good = sorted(set(good))
        out.append([f for _, f in good] if -sum(x for x, _ in good) >= model.least else [])
    return out


def test_all_families_equal_brute_force(spark):
    """The gate loses nothing: the brute force has none."""
    lines = [f"{a}{t}" for ts in L.templates().values() for t in ts for a in ("", "Please note: ")] + list(L.OTHERS) + [t for _, t in UNSEEN] + [*NEIGHBOURS, *DUAL]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {(r.doc_id, r.para): (r.family, r.families) for r in L.scan_licences(docs).collect()}
    want = {(i, k): (f[0] if f else L.UNKNOWN, sorted(f)) for i, t in enumerate(lines) for k, f in enumerate(brute(t))}
    assert {k: got.get(k, (L.UNKNOWN, [])) for k in want} == want and set(got) <= set(want)
    assert {f for f, _ in want.values()} == {*L.TEMPLATES, L.UNKNOWN}


def test_precision_and_recall_on_unseen_text():
    fitted = {t for ts in L.templates().values() for t in ts} | set(L.OTHERS) | {t for t, _ in L.CALIBRATION}
    assert not fitted & {t for _, t in UNSEEN}
    found = [(want, next((f[0] for f in brute(t) if f), L.UNKNOWN), t) for want, t in UNSEEN]
    said = [(w, g) for w, g, _ in found if g != L.UNKNOWN]
    precision = sum(w == g for w, g in said) / len(said)
    recall = sum(w == g for w, g in said) / sum(w != L.UNKNOWN for w, _, _ in found)
    print("precision", precision, "recall", recall, [x for x in found if x[0] != x[1]])
    assert precision >= 0.95 and recall >= 0.85
