"""License scans by a trained paragraph classifier (operator 4), DataFrame functions only on the main path.

Paragraphs are lines, cut again at sentence ends. A paragraph is a candidate if it holds a licence stem (`STEMS`), which plain
`contains` tests decide for the whole text first, so texts without one are never cut. Features of a candidate are its distinct
word 1- to 3-grams. A multinomial logistic regression over these sparse features, trained on the driver from the fixed
templates below (whole notices and windows of them; windows that several families share, and the fixed other lines, are the unknown
class), gives each family's probability at a temperature fitted on paragraphs of templates that the model in question did not see, whole
templates being held out in turn. The top family stands if its probability reaches
`MIN_PROBABILITY` and template comparison confirms it: at least `MIN_OVERLAP` of the paragraph's features occur in that
family's templates, and one of them in no other family's. A candidate where it does not stand, as a notice within a longer
sentence, takes the family of a phrase that it holds whole: a sentence of the templates of `PHRASE_WORDS` words or more that is one
family's alone, or a name of `PHRASES` beside a word that grants (`GRANTS`). Otherwise the candidate is unknown.

The plan is one scan, an explode of features, a broadcast join with the weights (as many rows as the templates have features: fixed
in size), and two partial aggregations by row number: no text is shuffled, no group grows with a licence's popularity.

Cases: null or empty text: no candidate. Rows are told apart by position, so repeated ids and null ids keep a result each.
"""

from __future__ import annotations

import json
import re
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEMS = ("licen", "copyright", "copyleft", "permission", "warrant", "redistribut", "unencumbered", "public domain", "rights reserved", "creative commons", "gnu ", "mozilla public", "unauthorized copying", "spdx", "gpl", "apache", "bsd", "cc0", "cc by", "cc-by")
UNKNOWN = "unknown"
MIN_PROBABILITY, MIN_OVERLAP = 0.6, 0.6

#: Fixed texts: usual notices by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License. This project is licensed under the terms of the MIT license. See the LICENSE file for the MIT license text.",
        "The MIT License (MIT). SPDX-License-Identifier: MIT. License: MIT. MIT licensed. Distributed under the MIT License. Available under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The Software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0. License: Apache 2.0. Apache License 2.0. Released under the Apache License. Distributed under the Apache License, Version 2.0. This project is licensed under the Apache License 2.0.",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "SPDX-License-Identifier: GPL-3.0-or-later. License: GPL. Released under the GNU General Public License, version 2. Licensed under the GPL. Licensed under the GNU GPL. Distributed under the GNU General Public License. GNU General Public License v3. GPL licensed.",
    ),
    "LGPL": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "Licensed under the GNU Lesser General Public License, version 3. Licensed under the LGPL. SPDX-License-Identifier: LGPL-2.1-or-later. Released under the GNU Lesser General Public License. License: LGPL.",
    ),
    "AGPL": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License.",
        "Licensed under the GNU Affero General Public License, version 3. Licensed under the AGPL. SPDX-License-Identifier: AGPL-3.0-only. Released under the GNU Affero General Public License. License: AGPL.",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Released under the BSD License. Licensed under the BSD 3-Clause License. SPDX-License-Identifier: BSD-3-Clause. BSD 2-Clause License. Licensed under the BSD license. Use of this source code is governed by a BSD-style license that can be found in the LICENSE file. License: BSD.",
    ),
    "MPL": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0. Released under the Mozilla Public License. SPDX-License-Identifier: MPL-2.0. License: MPL. Mozilla Public License 2.0.",
    ),
    "EPL": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "Licensed under the Eclipse Public License, version 2.0. Released under the Eclipse Public License. SPDX-License-Identifier: EPL-2.0. Eclipse Public License v1.0.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Licensed under the ISC License. Released under the ISC License. SPDX-License-Identifier: ISC. ISC licensed. License: ISC.",
    ),
    "Public-Domain": (
        "This is free and unencumbered software released into the public domain.",
        "Released into the public domain. Dedicated to the public domain. This work is in the public domain. Licensed under the Unlicense. SPDX-License-Identifier: Unlicense.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. Licensed under CC0 1.0 Universal. Released under CC0. Creative Commons Zero. License: CC0. CC0 1.0 Universal Public Domain Dedication.",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0. Licensed under CC-BY-4.0. License: CC BY. SPDX-License-Identifier: CC-BY-4.0. Released under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License. Licensed under the Creative Commons Attribution license. Creative Commons Attribution 4.0.",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0. Licensed under CC-BY-SA-4.0. License: CC BY-SA. Released under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License. Text is available under the Creative Commons Attribution-ShareAlike License.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0. Licensed under CC-BY-NC-4.0. License: CC BY-NC. Released under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License. Creative Commons Attribution-NonCommercial license.",
    ),
    "CC-BY-ND": (
        "Licensed under CC BY-ND 4.0. Licensed under CC-BY-ND-4.0. License: CC BY-ND. Released under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License. Creative Commons Attribution-NoDerivatives license.",
    ),
    "Proprietary": (
        "All rights reserved. Copyright. All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher.",
        "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited without the permission of the copyright owner. All rights reserved worldwide.",
    ),
}

#: Fixed texts of no known family that hold stems.
OTHERS = (
    "I got my driving license last year. The driver's license office was closed. She renewed her fishing license. The pilot lost his license. A license plate was found.",
    "With permission from the teacher we left. He asked for permission to leave. The committee gave permission for the event. File permissions were wrong. Permission denied.",
    "The police had a search warrant. The evidence does not warrant a trial. The product has a two year warranty. Your warranty has expired. Extended warranty offer.",
    "They redistributed the wealth. Redistribution of income is debated. Land redistribution began in the spring.",
    "Copyright law is complex. The court ruled on copyright infringement. A copyright dispute arose. Copyleft is an idea.",
    "The house was sold as is. It works as is the custom. As is often the case, it rained. As is well known, this holds.",
    "A book about the public domain. Public domain films are rare. Creative commons is an organisation.",
    "Licensed under the Zeta License, Version 2.0. Licensed under the Acme Community License, version 1. Released under the Example Source License. This work is licensed under the Foo Public License. Licensed under other terms. License: see vendor. Licensed under the Sample General License, version 9.",
    "The bar has a liquor license. Licensed to serve food. A licensed electrician did the work. License fees rose. The licensing board met.",
    "She holds a licence to practise medicine. The council will license street vendors. He was licensed as a teacher in the north. Their television licence was never paid.",
    "The museum asked for permission to copy the letters. No permission is needed to walk here. Permission slips are due on Friday.",
    "The song's copyright belongs to the widow. Copyright notices were printed in small type. The copyright expired long ago and nobody renewed it.",
    "A warrant officer met us at the gate. Nothing could warrant such behaviour. The dealer honoured the warranty without a word.",
)

#: Usual wordings around a licence's name, and names by family; names of no family make the unknown side of each wording.
FORMS = (
    "Released under the {}.", "Licensed under the {}.", "This project is licensed under the terms of the {}.", "Distributed under the {}. See LICENSE for more information.", "This work is licensed under the {}.",
    "The source code is available under the {}.", "You may use this file under the terms of the {}.", "All code in this repository is covered by the {}.", "Published under the {}, see the file COPYING.",
    "Copyright (c) the authors. Licensed under the {}.", "This software is made available to you under the {}.", "License: {}", "We chose the {} as the license of this package.", "The documentation is licensed under the {} as well.",
)
FORM_NAMES: dict[str, tuple[str, ...]] = {
    "MIT": ("MIT License", "MIT license (MIT)"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 license"),
    "GPL": ("GNU General Public License, version 3", "GNU General Public License v2.0", "GNU GPL v3", "GPL-3.0"),
    "LGPL": ("GNU Lesser General Public License, version 2.1", "GNU LGPL", "LGPL-3.0"),
    "AGPL": ("GNU Affero General Public License, version 3", "GNU AGPL", "AGPL-3.0"),
    "BSD": ("BSD License", "BSD 3-Clause License", "BSD-2-Clause license"),
    "MPL": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL-2.0"),
    "EPL": ("Eclipse Public License, version 2.0", "Eclipse Public License v1.0", "EPL-2.0"),
    "ISC": ("ISC License", "ISC license (ISC)"),
    "Public-Domain": ("Unlicense", "CC0 1.0 Universal Public Domain Dedication", "Creative Commons Zero license"),
    "CC-BY": ("Creative Commons Attribution 4.0 International License", "CC BY 4.0", "Creative Commons Attribution license"),
    "CC-BY-SA": ("Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike license"),
    "CC-BY-NC": ("Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial license"),
    "CC-BY-ND": ("Creative Commons Attribution-NoDerivatives 4.0 International License", "CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives license"),
    UNKNOWN: ("Zeta License, Version 2.0", "Acme Community License, version 1", "Example Source License", "Foo Public License", "Sample General License, version 9", "Northwind Commercial License 4.0", "Vendor Agreement", "house rules", "state law", "Orchid Attribution License v3", "Quux Lesser License", "terms of sale"),
}

#: Words of a template sentence that is a phrase by itself.
PHRASE_WORDS = 5
#: Names by family, in plain words.
PHRASES: dict[str, tuple[str, ...]] = {
    "MIT": ("mit license", "mit licensed", "license mit", "identifier mit"),
    "Apache-2.0": ("apache license", "apache 2 0", "identifier apache", "license apache"),
    "GPL": ("gnu general public license", "gnu gpl", "the gpl", "license gpl", "identifier gpl", "gpl 2 0", "gpl 3 0", "gplv2", "gplv3", "gpl v2", "gpl v3", "gpl version 2", "gpl version 3"),
    "LGPL": ("gnu lesser general public license", "gnu lgpl", "the lgpl", "license lgpl", "identifier lgpl", "lgplv2", "lgplv3", "lgpl v3"),
    "AGPL": ("gnu affero general public license", "gnu agpl", "the agpl", "license agpl", "identifier agpl", "agplv3", "agpl v3"),
    "BSD": ("bsd license", "bsd 2 clause", "bsd 3 clause", "bsd style license", "license bsd", "identifier bsd"),
    "MPL": ("mozilla public license", "the mpl", "license mpl", "identifier mpl", "mpl 2 0"),
    "EPL": ("eclipse public license", "identifier epl", "epl 2 0"),
    "ISC": ("isc license", "isc licensed", "license isc", "identifier isc"),
    "Public-Domain": ("cc0", "creative commons zero", "the unlicense", "identifier unlicense"),
    "CC-BY": ("cc by", "creative commons attribution"),
    "CC-BY-SA": ("cc by sa", "creative commons attribution sharealike", "creative commons attribution share alike"),
    "CC-BY-NC": ("cc by nc", "creative commons attribution noncommercial", "creative commons attribution non commercial"),
    "CC-BY-ND": ("cc by nd", "creative commons attribution noderivatives", "creative commons attribution no derivatives"),
}
GRANTS = ("under", "copyright", "spdx", "terms", "license mit", "license apache", "license gpl", "license lgpl", "license agpl", "license bsd", "license mpl", "license isc", "cc0", "photo", "image", "by 2 0", "by 3 0", "by 4 0", "sa 2 0", "sa 3 0", "sa 4 0", "nc 4 0", "nd 4 0")

#: Other spellings are brought to one before features are cut.
_SPELLING = (("licence", "license"), ("licencing", "licensing"))


#: Paragraph ends.
CUT = r"\n|(?<=[.;:!?])\s+"


def words_of(paragraph: str) -> list[str]:
    for a, b in _SPELLING:
        paragraph = paragraph.replace(a, b)
    return re.findall(r"[^\W_]+", paragraph)


def features(paragraph: str) -> set[str]:
    """The plain form of the feature rule, for training and tests: a lower-cased paragraph's n-grams, none without a stem."""
    if not any(s in paragraph for s in STEMS):
        return set()
    w = words_of(paragraph)
    return {" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)}


def texts() -> list[tuple[str, int, str]]:
    """(family, number, text) of the templates, then of the wordings, whose numbers follow."""
    out = []
    for family, some in [*TEMPLATES.items(), (UNKNOWN, OTHERS)]:
        out += [(family, n, t) for n, t in enumerate(some)]
        out += [(family, len(some) + n, form.format(name)) for n, form in enumerate(FORMS) for name in FORM_NAMES.get(family, ())]
    return out


def samples() -> list[tuple[frozenset[str], str, frozenset[tuple[str, int]]]]:
    """(features, family, templates it is cut from) of training paragraphs."""
    cases: dict[frozenset[str], set[tuple[str, int]]] = {}
    for family, number, text in texts():
        parts = {text.lower(), *re.split(CUT, text.lower())}
        if number < len(TEMPLATES.get(family, OTHERS)):  # long notices in windows too
            for part in list(parts):
                w = part.split()
                parts |= {" ".join(w[i : i + n]) for n in (5, 9, 14) for i in range(0, max(1, len(w) - n + 1), 3)}
        for part in parts:
            if f := features(part):
                cases.setdefault(frozenset(f), set()).add((family, number))
    told = [(f, next(iter(families)) if len(families := {name for name, _ in k}) == 1 else UNKNOWN, frozenset(k)) for f, k in cases.items()]
    return sorted(told, key=lambda c: (sorted(c[0]), c[1]))


class Rows:
    """Sparse rows: each paragraph's features with a weight of 1 / sqrt(their number), and a last column of 1 for the bias."""

    def __init__(self, rows: list[list[int]], columns: int):
        self.row = np.repeat(np.arange(len(rows)), [len(r) + 1 for r in rows])
        self.column = np.array([c for r in rows for c in (*r, columns)])
        self.value = np.array([v for r in rows for v in (*[1 / np.sqrt(max(len(r), 1))] * len(r), 1.0)])[:, None]
        self.starts = np.searchsorted(self.row, np.arange(len(rows)))
        self.by_column = np.argsort(self.column, kind="stable")
        self.columns, self.column_starts = np.unique(self.column[self.by_column], return_index=True)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.add.reduceat(w[self.column] * self.value, self.starts, axis=0)

    def turned_times(self, e: np.ndarray, out: np.ndarray) -> np.ndarray:
        out[self.columns] += np.add.reduceat((e[self.row] * self.value)[self.by_column], self.column_starts, axis=0)
        return out


def solve(rows: Rows, y: np.ndarray, columns: int, classes: int, steps: int = 150, rate: float = 4.0, momentum: float = 0.9, decay: float = 1e-4) -> np.ndarray:
    """Weights of a multinomial logistic regression, the bias in the last row."""
    hot = np.eye(classes)[y]
    w = np.zeros((columns + 1, classes))
    v = np.zeros_like(w)
    for _ in range(steps):
        look = w + momentum * v
        z = rows.times(look)
        p = np.exp(z - z.max(1, keepdims=True))
        error = (p / p.sum(1, keepdims=True) - hot) / len(y)
        shrink = decay * look
        shrink[-1] = 0
        v = momentum * v - rate * rows.turned_times(error, shrink)
        w = w + v
    return w


#: Whole templates held out in turn: number k of a family in fold k modulo this. Candidates without a known feature in training.
FOLDS, BLANKS = 3, 60


def probabilities(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


@cache
def held_out() -> tuple[np.ndarray, np.ndarray]:
    """(scores by family, family numbers) of paragraphs by models that saw none of the templates that they are cut from."""
    cases = samples()
    names = [UNKNOWN, *TEMPLATES]
    scores, truth = [], []
    for fold in range(FOLDS):
        seen = [c for c in cases if any(n % FOLDS != fold for _, n in c[2])]
        spared = [c for c in cases if all(n % FOLDS == fold for _, n in c[2])]
        column = {f: i for i, f in enumerate(sorted(set().union(*(c[0] for c in seen))))}
        y = np.array([names.index(c[1]) for c in seen] + [0] * BLANKS)
        w = solve(Rows([sorted(column[g] for g in c[0]) for c in seen] + [[]] * BLANKS, len(column)), y, len(column), len(names))
        # a feature without a weight still counts in the number of features, as it does in a scan
        for f, family, _ in spared:
            z = sum((w[column[g]] for g in f if g in column), np.zeros(len(names)))
            scores.append(z / np.sqrt(len(f)) + w[-1])
            truth.append(names.index(family))
    return np.array(scores), np.array(truth)


@cache
def train() -> tuple[list[str], np.ndarray, dict[str, np.ndarray], dict[str, set[str]], float]:
    """(families with unknown first, biases, weights a feature, families whose templates hold a feature, temperature)."""
    cases = samples()
    names = [UNKNOWN, *TEMPLATES]
    vocabulary = sorted(set().union(*(c[0] for c in cases)))
    column = {f: i for i, f in enumerate(vocabulary)}
    y = np.array([names.index(c[1]) for c in cases] + [0] * BLANKS)
    w = solve(Rows([sorted(column[g] for g in c[0]) for c in cases] + [[]] * BLANKS, len(column)), y, len(column), len(names))
    z, truth = held_out()
    temperature = min(np.arange(0.3, 3.01, 0.1), key=lambda t: -np.log(probabilities(z / t)[np.arange(len(z)), truth] + 1e-12).mean())
    own: dict[str, set[str]] = {f: set() for f in vocabulary}
    for family, _, text in texts():
        if family != UNKNOWN:
            for part in (text.lower(), *re.split(CUT, text.lower())):
                for f in features(part):
                    own[f].add(family)
    return names, w[-1], {f: w[i].round(6) for f, i in column.items()}, own, float(temperature)


@cache
def phrases() -> dict[str, tuple[tuple[str, ...], tuple[str, ...]]]:
    """Template sentences and names of a family, in plain words."""
    by: dict[str, set[str]] = {}
    for family, some in TEMPLATES.items():
        for text in some:
            for part in re.split(CUT, text.lower()):
                w = words_of(part)
                if len(w) >= PHRASE_WORDS and features(part):
                    by.setdefault(" ".join(w), set()).add(family)
    held = {p: next(iter(k)) for p, k in by.items() if len(k) == 1}
    # a sentence that another family's sentence or an other text holds says nothing by itself
    whole = [(family, " ".join(words_of(t.lower()))) for family, some in [*TEMPLATES.items(), (UNKNOWN, OTHERS)] for t in some]
    held = {p: family for p, family in held.items() if not any(f"{p} " in f"{t} " and f != family for f, t in whole)}
    return {family: (tuple(sorted(p for p, f in held.items() if f == family)), PHRASES.get(family, ())) for family in TEMPLATES}


def phrase_families(words):
    """Column of flags by family (unknown first), of a column of a candidate's words."""
    rows = [{"sentences": [], "names": [], "longer": []}]
    for family, (sentences, names) in phrases().items():
        # longer names of other families are taken out before a family's names are looked for
        longer = {q for other, (_, qs) in phrases().items() if other != family for q in qs if any(f" {p} " in f" {q} " for p in names)}
        rows.append({k: [f" {p} " for p in some] for k, some in (("sentences", sentences), ("names", names), ("longer", sorted(longer, key=lambda q: (-len(q), q))))})
    known = F.from_json(F.lit(json.dumps(rows)), "array<struct<sentences: array<string>, names: array<string>, longer: array<string>>>")
    text = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    grants = F.exists(F.array(*[F.lit(f" {g} ") for g in GRANTS]), lambda g: F.contains(text, g))

    def flag(k):
        left = F.aggregate(k["longer"], text, lambda t, q: F.replace(t, q, F.lit(" # ")))
        return (F.exists(k["sentences"], lambda p: F.contains(text, p)) | (grants & F.exists(k["names"], lambda p: F.contains(left, p)))).cast("int")

    return F.transform(known, flag)


def has_stem(text):
    out = F.contains(text, F.lit(STEMS[0]))
    for stem in STEMS[1:]:
        out = out | F.contains(text, F.lit(stem))
    return out


def paragraphs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sums of weights a candidate; a text without candidates has one row with null `at`."""
    names, _, weights, own, _ = train()
    rows = [{"term": f, "w": w.tolist(), "t": [int(n in own[f]) for n in names], "e": [int(own[f] == {n}) for n in names]} for f, w in weights.items()]
    literal = F.from_json(F.lit(json.dumps(rows)), "array<struct<term: string, w: array<double>, t: array<int>, e: array<int>>>")
    known = F.broadcast(df.sparkSession.range(1).select(F.explode(literal).alias("k")).select("k.*"))
    low = F.lower(F.col(text_col))
    src = df.select(F.col(id_col).alias("id"), F.when(has_stem(low), F.split(low, CUT)).alias("parts")).withColumn("row", F.monotonically_increasing_id())
    held = " or ".join(f"contains(p, '{stem}')" for stem in STEMS)
    cut = src.select("row", "id", F.posexplode_outer(F.expr(f"filter(parts, p -> {held})")).alias("at", "part"))
    spelled = F.col("part")
    for a, b in _SPELLING:
        spelled = F.replace(spelled, F.lit(a), F.lit(b))
    words = F.split(F.trim(F.regexp_replace(spelled, r"[^\p{L}\p{N}]+", " ")), " ")
    grams = ", ".join(f"transform(sequence(1, size(words) - {n - 1}), i -> array_join(slice(words, i, {n}), ' '))" if n == 1 else f"if(size(words) < {n}, array(), transform(sequence(1, greatest(size(words) - {n - 1}, 1)), i -> array_join(slice(words, i, {n}), ' ')))" for n in (1, 2, 3))
    told = cut.withColumn("words", words).withColumn("held", F.when(F.col("at").isNotNull(), phrase_families(F.col("words"))))
    terms = told.select("row", "id", "at", "held", F.explode_outer(F.expr(f"if(words is null, null, array_distinct(flatten(array({grams}))))")).alias("term"))
    k = range(len(names))
    sums = [F.coalesce(F.sum(F.col(c)[i].cast("double")), F.lit(0.0)).alias(f"{c}{i}") for c in "wte" for i in k]
    return terms.join(known, "term", "left").groupBy("row", "id", "at").agg(F.count("term").alias("n"), F.first("held").alias("held"), *sums)


def verdicts(sums: DataFrame) -> DataFrame:
    """A candidate's family (unknown if none stands), its probability and its overlap with the family's templates."""
    names, bias, _, _, temperature = train()
    k = range(len(names))
    n = F.greatest(F.col("n"), F.lit(1))
    z = F.array(*[(F.col(f"w{i}") / F.sqrt(n) + F.lit(float(bias[i]))) / F.lit(temperature) for i in k])
    out = sums.select("row", "id", "at", "held", z.alias("z"), F.array(*[F.col(f"t{i}") / n for i in k]).alias("t"), F.array(*[F.col(f"e{i}") for i in k]).alias("e")).withColumn("top", F.array_max("z"))
    out = out.withColumn("first", F.array_position("z", F.col("top")).cast("int")).withColumn("total", F.aggregate("z", F.lit(0.0), lambda total, v: total + F.exp(v - F.col("top"))))
    stands = (F.col("first") > 1) & (1 / F.col("total") >= MIN_PROBABILITY) & (F.element_at("t", F.col("first")) >= MIN_OVERLAP) & (F.element_at("e", F.col("first")) > 0)
    told = F.array_max(F.zip_with("z", "held", lambda v, h: F.when(h > 0, v)))  # of the families of phrases the likeliest
    out = out.withColumn("stands", stands).withColumn("best", F.when(F.col("stands"), F.col("first")).otherwise(F.coalesce(F.array_position("z", told).cast("int"), F.col("first"))))
    out = out.withColumn("probability", F.exp(F.element_at("z", F.col("best")) - F.col("top")) / F.col("total")).withColumn("overlap", F.element_at("t", F.col("best")))
    label = F.when(F.col("stands") | told.isNotNull(), F.element_at(F.array(*map(F.lit, names)), F.col("best"))).otherwise(UNKNOWN)
    return out.select("row", "id", "at", F.when(F.col("at").isNotNull(), label).alias("family"), "probability", "overlap")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, n_candidates, n_license (candidates of a known family), n_unknown, families (sorted, comma-joined), best_probability (6 digits; 0 if none)."""
    named = F.col("family") != UNKNOWN
    out = verdicts(paragraphs(df, id_col, text_col)).groupBy("row", "id").agg(
        F.count("at").alias("n_candidates"),
        F.count_if(named).alias("n_license"),
        F.count_if(F.col("family") == UNKNOWN).alias("n_unknown"),
        F.array_join(F.array_sort(F.collect_set(F.when(named, F.col("family")))), ",").alias("families"),
        F.round(F.coalesce(F.max(F.when(named, F.col("probability"))), F.lit(0.0)), 6).alias("best_probability"),
    )
    return out.select(F.col("id").alias(id_col), "n_candidates", "n_license", "n_unknown", "families", "best_probability")
