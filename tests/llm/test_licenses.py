import re

import numpy as np

from placeloom.llm import licenses as lic

NAMES, BIAS, WEIGHTS, OWN, HEAT = lic.train()


def brute(text):
    """(candidates, known families, best probability) by the plain rules."""
    found, best, n = [], 0.0, 0
    for part in re.split(lic.CUT, (text or "").lower()):
        f = lic.features(part)
        if not any(s in part for s in lic.STEMS):
            continue
        n += 1
        z = (sum((WEIGHTS[g] for g in f if g in WEIGHTS), np.zeros(len(NAMES))) / np.sqrt(max(len(f), 1)) + BIAS) / HEAT
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(z.argmax())
        overlap = sum(NAMES[k] in OWN.get(g, ()) for g in f) / max(len(f), 1)
        if k and p[k] >= lic.MIN_PROBABILITY and overlap >= lic.MIN_OVERLAP and any(OWN.get(g) == {NAMES[k]} for g in f):
            found.append(NAMES[k])
            best = max(best, p[k])
    return n, found, round(float(best), 6)


TEXTS = [
    None, "", "no such thing here", "Prose here.\nReleased under the MIT License.\nmore prose", "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0.", "I lost my driver's license. The warranty ended.", "Licensed under the Zork License version 2.0",
    "LICENCE: MIT", "licen licen 2 3", "copyright\n\n\nCOPYRIGHT ÉÀ ß", "Redistributions of source code must retain the above copyright notice, this list of conditions\nand the following disclaimer.",
    *[t for ts in lic.TEMPLATES.values() for t in ts], *lic.OTHERS, "word " * 20000 + "license " + "word " * 20000,
]


def test_against_brute_force(spark):
    df = spark.createDataFrame([(i, t, "w", 1.0) for i, t in enumerate(TEXTS)] + [(None, TEXTS[3], "w", 1.0), (3, TEXTS[3], "w", 1.0)], "doc_id long, text string, term string, n double").repartition(4)
    rows = lic.scan(df).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        n, found, best = brute(TEXTS[3 if r.doc_id is None else r.doc_id])
        assert (r.n_candidates, r.n_license, r.n_unknown, r.families) == (n, len(found), n - len(found), ",".join(sorted(set(found)))), r
        assert abs(r.best_probability - best) < 1e-5
    assert lic.scan(df.limit(0)).count() == 0


def test_families_and_unknown():
    for family, texts in lic.TEMPLATES.items():
        assert set(brute(texts[-1])[1]) == {family}
    for text in lic.OTHERS:
        assert brute(text)[1] == []
    assert brute("Released under the MIT License.")[1] == ["MIT"]
    assert brute("Licensed under CC BY-NC 4.0.")[1] == ["CC-BY-NC"]
    assert brute("the vendor may license this to you under terms of use")[1] == []


def test_plan_is_native(spark, sf_small, capsys):
    lic.scan(spark.read.parquet(f"{sf_small}/documents.parquet")).explain("formatted")
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan and not re.search("Python|Pandas|Arrow", plan)


def test_planted_lines_of_the_test_tables(spark, sf_small):
    df = spark.read.parquet(f"{sf_small}/documents.parquet")
    got = {r.doc_id: r for r in lic.scan(df).collect()}
    line = re.compile("^(Licensed|Released|This work is licensed) under |^All rights reserved", re.M)
    for r in df.collect():
        assert (got[r.doc_id].n_license > 0) == bool(line.search(r.text or ""))


LONGER = {
    "The code in this repository is released under the MIT License and may be reused freely by anyone": "MIT",
    "All of the files here are licensed under the Apache License, Version 2.0 unless a file header says otherwise": "Apache-2.0",
    "for the record we all agree that it is Licensed under the Apache License, Version 2.0": "Apache-2.0",
    "Please note that this work is licensed under the GNU General Public License, version 3": "GPL",
    "Please note that the tool is distributed under the GNU Affero General Public License": "AGPL",
    "Photo by Jane Doe of the river at dawn, CC BY 4.0": "CC-BY",
    "Photo by Jane Doe of the river at dawn, CC BY-SA 4.0": "CC-BY-SA",
    "Copyright (c) 2019 the project team and contributors, MIT License": "MIT",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.': "MIT",
    "// SPDX-License-Identifier: BSD-3-Clause": "BSD",
    "To the public these data are given under CC0": "Public-Domain",
    "The apache helicopter landed": "", "He is licensed under the state law of Ohio": "", "Everything here is released under the Zork License and may be reused freely": "",
    "The bsd daemon and the copyright of its picture are discussed": "",
}


def test_notices_within_longer_sentences(spark):
    got = {r.doc_id: r for r in lic.scan(spark.createDataFrame([(i, t) for i, t in enumerate(LONGER)], "doc_id long, text string")).collect()}
    assert {t: got[i].families for i, t in enumerate(LONGER)} == LONGER


def test_calibration_on_templates_that_the_models_did_not_see():
    z, truth = lic.held_out()
    p = lic.probabilities(z / HEAT)
    top, sure = p.argmax(1), p.max(1)
    right = top == truth
    assert len(z) > 1000 and right.mean() > 0.78 and right[truth == 0].mean() > 0.95
    for low in (0.6, 0.7, 0.8, 0.9):
        some = (sure >= low) & (sure < low + 0.1 + (low == 0.9))
        assert some.sum() > 100 and abs(sure[some].mean() - right[some].mean()) < 0.1
    taken = (sure >= lic.MIN_PROBABILITY) & (top > 0)
    assert right[taken].mean() > 0.95 and (taken & (truth == 0)).sum() <= 0.02 * (truth == 0).sum()


#: Lines that are in no template and no wording.
FRESH = {
    "This repo is MIT licensed.": "MIT", "Code: MIT License, docs: see site": "MIT", "jQuery plugin, licensed under MIT license, 2011": "MIT",
    "The crate is dual-licensed; this copy falls under the Apache License, Version 2.0": "Apache-2.0", "Dieses Programm steht unter der GNU General Public License, version 3": "GPL",
    "You can redistribute it under the GNU General Public License as published by the Free Software Foundation": "GPL", "bindings licensed under the LGPL": "LGPL",
    "The server is licensed under the GNU Affero General Public License v3": "AGPL", "Distributed under a BSD 3-Clause License by the lab": "BSD",
    "Redistributions of source code must keep the above copyright notice, this list of conditions and the following disclaimer": "BSD",
    "file subject to the terms of the Mozilla Public License, v. 2.0": "MPL", "made available under the Eclipse Public License 2.0": "EPL", "Available under the ISC license": "ISC",
    "the author has dedicated the work to the public domain under CC0": "Public-Domain", "Texts under a Creative Commons Attribution-ShareAlike 4.0 International License": "CC-BY-SA",
    "Images: Creative Commons Attribution-NonCommercial 4.0 International License": "CC-BY-NC", "Map tiles, CC BY 4.0": "CC-BY",
    "Your licence to fish ends in May.": "", "This agreement may be amended with the written permission of both sides.": "", "The warranty covers parts for one year.": "", "He redistributed the food parcels at dawn.": "",
    "Licensed under the Umbrella Terms, version 12.": "", "A copyright lawyer explained the case.": "", "The pub is licensed until two in the morning.": "", "Released under the moonlight, the birds flew; no licence was asked.": "",
    "Apache pilots had permission to land.": "", "A licence plate from the public sector": "", "Permission to speak, please?": "", "gpl is not a word in this dictionary": "", "The bsd club met on Monday under the bridge": "",
}


def test_fresh_lines(spark):
    got = {r.doc_id: r.families for r in lic.scan(spark.createDataFrame(list(enumerate(FRESH)), "doc_id long, text string")).collect()}
    wrong = {t: got[i] for i, (t, want) in enumerate(FRESH.items()) if got[i] != want}
    known = sum(map(bool, FRESH.values()))
    print(wrong)
    assert sum(FRESH[t] == "" for t in wrong) == 0
    assert sum(FRESH[t] != "" for t in wrong) <= 0.2 * known
