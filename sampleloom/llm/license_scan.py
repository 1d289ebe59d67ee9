"""Licence scan of paragraphs.

Each paragraph is classified by logistic regression over its word n-grams (1 to 3 words): a family, `unknown` (reads
like a licence, but not one of the families) or none. The features are the n-grams of the training notices; a paragraph's
weights are summed over those that it has, so most paragraphs, which have none, cost one set test. A family is believed
only above a threshold and only if the words of one of its templates are found in the paragraph (CONFIRM of a template's
n-grams); else the answer is `unknown`.

The threshold is calibrated on licences that the fit has not seen: the notices of whole families, and made-up names in frames, none of
which are trained on. It is the probability that all but FALSE_RATE of them stay under.

A paragraph is a line, and also a run of lines up to an empty one, from the first to the last line with a licence word: a
notice may be wrapped. A run is reported, under its first line's number, if none of its lines is of a family by itself.

The classifier is fitted on the driver from the fixed notices below, from notices put together of the licences' names, versions and common
SAYINGS (and of made-up names, which are unknown), from EVERYDAY sentences on other licences, and on at most SAMPLE different
paragraphs of the corpus as examples of no licence, those with the least hashes; this bounds the fit. A name by itself is a template, so
that short forms can be confirmed. Of two families that are equally likely the first by name is taken.

Defined results: null and empty texts have no paragraphs; one row for each paragraph that is a licence
or reads like one; repeated rows and paragraphs give repeated results; all paragraphs of a text are
read, whole; columns of the documents with clashing names do no harm.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sampleloom.llm.common import slices, small_batches, table

SAMPLE = 4000
CONFIRM = 0.6
FALSE_RATE = 0.02
STEPS = 300

# Short notices of licence families, as public licence texts and stewards' notices give them.
NOTICES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Apache License Version 2.0, January 2004",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "apache-1.1": [
        "The Apache Software License, Version 1.1",
        "Licensed under the Apache Software License, Version 1.1.",
        "This product includes software developed by the Apache Software Foundation (http://www.apache.org/). The names Apache and Apache Software Foundation must not be used to endorse or promote products",
        "SPDX-License-Identifier: Apache-1.1",
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The MIT License (MIT)",
        "SPDX-License-Identifier: MIT",
    ],
    "isc": [
        "ISC License",
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Licensed under the BSD 3-Clause License.",
        "BSD 2-Clause License",
        "BSD 3-Clause License",
        "Licensed under the Simplified BSD License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "GNU General Public License version 2 or later",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Licensed under the GPL, version 2.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "GNU Lesser General Public License version 2.1 or later",
        "GNU Library General Public License",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "agpl": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "GNU Affero General Public License version 3",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Mozilla Public License Version 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Creative Commons Attribution-NonCommercial 4.0 International",
        "Creative Commons Attribution NonCommercial",
        "CC BY-NC 4.0",
        "Licensed under CC BY-NC-SA 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Creative Commons Attribution-ShareAlike 4.0 International",
        "Text is available under the Creative Commons Attribution-ShareAlike License",
        "CC BY-SA 3.0",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "cc-by-nd": [
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "Creative Commons Attribution-NoDerivatives 4.0 International",
        "CC BY-ND 4.0",
        "SPDX-License-Identifier: CC-BY-ND-4.0",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Creative Commons Attribution 4.0 International",
        "Text is available under the Creative Commons Attribution License",
        "CC BY 4.0",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "public-domain": [
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "all-rights-reserved": [
        "All rights reserved.",
        "Copyright (c) 2020 The Authors. All rights reserved.",
        "No part of this publication may be reproduced without prior written permission of the publisher.",
        "Confidential and proprietary. All rights reserved.",
    ],
}
# Notices of further licences. They are no classes: those of STRANGERS are trained as unknown, those of HELD_OUT set the threshold.
STRANGERS = {
    "epl": ["This program is made available under the terms of the Eclipse Public License 2.0", "SPDX-License-Identifier: EPL-2.0"],
    "artistic": ["You may redistribute it under the terms of the Artistic License.", "SPDX-License-Identifier: Artistic-2.0"],
    "zlib": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely", "Licensed under the zlib License."],
    "ofl": ["This Font Software is licensed under the SIL Open Font License, Version 1.1.", "SPDX-License-Identifier: OFL-1.1"],
    "ms-pl": ["This source is subject to the Microsoft Public License.", "Licensed under the Microsoft Public License (Ms-PL)."],
    "odbl": ["This database is made available under the Open Database License.", "Any rights in individual contents of the database are licensed under the Database Contents License"],
    "llama": ["Use of this model is governed by the community license agreement that came with it", "Licensed under the terms of the model's community licence agreement"],
}
HELD_OUT = {
    "cddl": ["The contents of this file are subject to the terms of the Common Development and Distribution License.", "SPDX-License-Identifier: CDDL-1.0"],
    "eupl": ["Licensed under the European Union Public Licence, version 1.2.", "SPDX-License-Identifier: EUPL-1.2"],
    "boost": ["Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"],
    "psf": ["Licensed under the Python Software Foundation License, version 2.", "SPDX-License-Identifier: PSF-2.0"],
    "qpl": ["This file may be distributed under the terms of the Q Public License", "SPDX-License-Identifier: QPL-1.0"],
    "openrail": ["This model is released under the OpenRAIL-M license with use restrictions", "SPDX-License-Identifier: OpenRAIL"],
    "wtfpl": ["Released under the Do What You Want To Public License, Version 2.", "SPDX-License-Identifier: WTFPL"],
}
# What the families' licences are called, and their versions.
CALLED = {
    "apache-2.0": (["Apache License", "Apache Software License", "Apache Public License", "Apache"], ["2.0", "v2.0", "2", "v2"]),
    "mit": (["MIT License", "MIT", "MIT/X11 License", "Expat License"], []),
    "isc": (["ISC License", "ISC"], []),
    "bsd": (["BSD License", "BSD", "New BSD License", "Modified BSD License", "Simplified BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "3-Clause BSD License", "2-Clause BSD License", "BSD-3-Clause", "BSD-2-Clause"], []),
    "gpl": (["GNU General Public License", "GNU GPL", "GPL", "GPLv2", "GPLv3", "GPL-2.0", "GPL-3.0"], ["2", "3", "v2", "v3", "2.0", "3.0"]),
    "lgpl": (["GNU Lesser General Public License", "GNU Library General Public License", "GNU LGPL", "LGPL", "LGPLv3", "LGPLv2.1", "LGPL-2.1", "LGPL-3.0"], ["2.1", "3", "v2.1", "v3", "3.0"]),
    "agpl": (["GNU Affero General Public License", "GNU AGPL", "AGPL", "AGPLv3", "AGPL-3.0"], ["3", "v3", "3.0"]),
    "mpl": (["Mozilla Public License", "MPL", "MPL-2.0"], ["1.1", "2.0", "v2.0", "v. 2.0"]),
    "cc-by-nc": (["CC BY-NC", "CC-BY-NC", "CC-BY-NC-SA", "Creative Commons Attribution-NonCommercial"], ["3.0", "4.0"]),
    "cc-by-sa": (["CC BY-SA", "CC-BY-SA", "Creative Commons Attribution-ShareAlike"], ["3.0", "4.0"]),
    "cc-by-nd": (["CC BY-ND", "CC-BY-ND", "Creative Commons Attribution-NoDerivatives"], ["3.0", "4.0"]),
    "cc-by": (["CC BY", "CC-BY", "Creative Commons Attribution"], ["3.0", "4.0"]),
    "public-domain": (["CC0", "CC0 1.0", "Unlicense", "public domain"], []),
}
#: What is said with a name: notices of all families, and of made-up licences, are put together from these.
SAYINGS = [
    "Licensed under the {}.", "Licensed under {}", "{} licensed", "Released under the {} license.", "Released under {}.", "This project is licensed under the {}", "Distributed under the terms of the {}.", "License: {}",
    "This software is available under the {}.", "The code is under {}.", "Images are {}", "Published under the {}, see LICENSE", "This file is made available under the {}.", "Its license is the {}.", "{}, see COPYING", "Content is {}.",
]
# Sentences with words of licences that are none.
EVERYDAY = [
    "A driving license is renewed every ten years.", "The officer asked for a licence and a registration.", "She is a licensed therapist in the city.", "A fishing license costs ten dollars.", "He lost his driver's license at the station.", "They need permission to enter the building.",
    "The pub has a licence to sell beer until midnight.", "Her medical license was suspended in May.", "The plate and the licence number were copied.", "The council granted a license for the market.", "Poetic license is allowed in songs.", "All of the software was sold to the public.",
    "The general said that the public was free to go.", "The library opens at nine and is free of charge.", "Copies of the notice were distributed in the town.", "An apache helicopter landed near the domain.", "Students at MIT built a robot.", "The project was released in the spring.",
]
#: Frames and names by which more notices of unknown licences are made; each half of both is trained on or calibrates, never both.
FRAMES = [
    "Licensed under the {} License.", "Released under the {} License.", "This project is licensed under the terms of the {} license.", "SPDX-License-Identifier: {}-{}", "See the file LICENSE for the terms of the {} agreement",
    "Licensed under the {} License, Version {}.", "This work is licensed under the {} Public License, version {}.", "Distributed under the terms of the {} License", "Licensed under {} {}.", "Use of this software is subject to the {} licence",
]
NAMES = "Zephyr Quokka Northwind Orchard Lumen Basalt Cobalt Juniper Meridian Saffron Harbor Willow".split()
FILLER = "of and by for text page see the".split()

_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")


def grams(words: list[str]) -> list[str]:
    return [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def words_of(paragraph: str) -> list[str]:
    return _WORD.findall(paragraph.lower())


def made_notices(rng: random.Random, half: int, n: int) -> list[str]:
    """Notices with made-up names; the halves share neither a frame nor a name."""
    frames, names = FRAMES[half * len(FRAMES) // 2 :][: len(FRAMES) // 2], NAMES[half * len(NAMES) // 2 :][: len(NAMES) // 2]
    return [rng.choice(frames).format(rng.choice(names), rng.choice(["1.0", "2.1", "3", "4.0"])) for _ in range(n)]


def called(rng: random.Random, name: str, versions: list[str]) -> str:
    """A name as it is written somewhere, mostly with a version if it has any."""
    if versions and not name[-1].isdigit() and rng.random() < 0.75:
        return f"{name}{rng.choice([', version ', ' version ', ' ', ' ', '-'])}{rng.choice(versions)}"
    return name


def said(rng: random.Random, families: dict[str, list[str]], n: int = 80) -> list[tuple[str, str]]:
    """(notice, class): n notices of each family that has a name, put together from names, versions and sayings, and of made-up licences."""
    out = [(rng.choice(SAYINGS).format(called(rng, rng.choice(names), versions)), family) for family, (names, versions) in sorted(CALLED.items()) if family in families for _ in range(n)]
    strange = [f"{name}{kind}" for name in NAMES[: len(NAMES) // 2] for kind in (" License", " Public License", "", " Software License")]
    return out + [(rng.choice(SAYINGS).format(called(rng, rng.choice(strange), ["1.0", "2.0", "3", "v4"])), "unknown") for _ in range(2 * n)]


def varied(rng: random.Random, notice: str) -> str:
    """The notice with ordinary words before or after it."""
    extra = " ".join(rng.choice(FILLER) for _ in range(rng.randint(1, 6)))
    return f"{extra} {notice}" if rng.random() < 0.5 else f"{notice} {extra}"


def examples(rng: random.Random, families: dict[str, list[str]], strangers: dict[str, list[str]]) -> list[tuple[str, str]]:
    """(notice, class): each notice as it is and varied."""
    out = [(n, family) for family, notices in families.items() for n in notices] + [(n, "unknown") for notices in strangers.values() for n in notices]
    out += [(varied(rng, n), kind) for n, kind in out for _ in range(4)]
    return out + [(n, "unknown") for n in made_notices(rng, 0, 120)] + said(rng, families)


@dataclass
class Scanner:
    classes: list[str]  # families, then unknown, then none
    feature: dict[str, int]
    vocabulary: frozenset
    weight: np.ndarray  # (features + 1, classes); the last row is the bias
    threshold: float
    templates: dict[str, list[frozenset]]

    def probabilities(self, words: list[str]) -> np.ndarray:
        at = sorted({self.feature[g] for g in grams(words) if g in self.feature})
        z = self.weight[at].sum(0) + self.weight[-1]
        e = np.exp(z - z.max())
        return e / e.sum()

    def confirmed(self, family: str, words: list[str]) -> float:
        """The greatest share of a template's words, pairs and triples that the paragraph has."""
        own = set(grams(words))
        return max(len(t & own) / len(t) for t in self.templates[family])

    def classify(self, paragraph: str) -> tuple | None:
        """(family or unknown, probability, template share), or None."""
        words = words_of(paragraph)
        if self.vocabulary.isdisjoint(words):
            return None
        p = self.probabilities(words)
        if p[-1] >= 0.5:
            return None
        best = int(p[:-2].argmax())
        family, share = self.classes[best], self.confirmed(self.classes[best], words)
        if p[best] >= self.threshold and share >= CONFIRM:
            return family, float(p[best]), share
        return "unknown", float(1 - p[-1]), share

    def paragraphs(self, text: str) -> Iterator[tuple]:
        """(line number, family, probability, template share, text) of each licence paragraph, in order of lines."""
        run: list[tuple[int, str, tuple | None]] = []
        for i, line in enumerate([*text.split("\n"), ""]):
            if line.strip():
                if run or not self.vocabulary.isdisjoint(words_of(line)):
                    run.append((i, line, self.classify(line)))
            elif run:
                yield from self._of_run(run)
                run = []

    def _of_run(self, run: list[tuple[int, str, tuple | None]]) -> Iterator[tuple]:
        while run[-1][2] is None and self.vocabulary.isdisjoint(words_of(run[-1][1])):
            run.pop()
        if len(run) > 1 and not any(got and got[0] != "unknown" for *_, got in run):
            whole = " ".join(line for _, line, _ in run)
            got = self.classify(whole)
            if got and got[0] != "unknown":
                yield run[0][0], *got, whole
                return
        for i, line, got in run:
            if got:
                yield i, *got, line


def fit(plain: list[str], families: dict[str, list[str]] | None = None, seed: int = 7) -> Scanner:
    rng, families = random.Random(seed), families or NOTICES
    classes = [*sorted(families), "unknown", "none"]
    train = examples(rng, families, STRANGERS)
    feature: dict[str, int] = {}
    names = [n for family, (forms, versions) in CALLED.items() if family in families for name in forms for n in (name, *[f"{name} {v}" for v in versions])]
    for notices in [*families.values(), *STRANGERS.values(), [f.replace("{}", " ") for f in [*FRAMES[: len(FRAMES) // 2], *SAYINGS]], names]:
        for n in notices:
            for g in grams(words_of(n)):
                feature.setdefault(g, len(feature))
    common: dict[str, int] = {}
    for p in plain:
        for w in set(words_of(p)):
            common[w] = common.get(w, 0) + 1
    # words of notices that ordinary paragraphs have too don't tell them apart
    telling = frozenset(g for g in feature if " " not in g and common.get(g, 0) <= 0.002 * max(500, len(plain)))
    for p in EVERYDAY:  # what is said of other licences counts, but marks no paragraph
        for g in grams(words_of(p)):
            feature.setdefault(g, len(feature))
    none = {frozenset(feature[g] for g in grams(words_of(p)) if g in feature) for p in [*plain, *EVERYDAY, *[varied(rng, p) for p in EVERYDAY for _ in range(4)]]} | {frozenset()}
    data = [([feature[g] for g in grams(words_of(text)) if g in feature], kind) for text, kind in train] + [(sorted(x), "none") for x in sorted(none, key=sorted)]
    x = np.zeros((len(data), len(feature) + 1), np.float32)
    y = np.zeros((len(data), len(classes)), np.float32)
    for i, (at, kind) in enumerate(data):
        x[i, at] = 1
        y[i, classes.index(kind)] = 1
    x[:, -1] = 1
    w = np.zeros((x.shape[1], len(classes)), np.float32)
    rows = 1.0 / np.maximum(1, y.sum(0))  # classes weigh alike
    scale = (y @ rows)[:, None] / len(classes)
    step = np.zeros_like(w)
    for _ in range(STEPS):  # gradient descent with momentum and a small penalty
        z = x @ w
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        step = 0.9 * step - 2.0 * (x.T @ ((p - y) * scale) + 2e-5 * w)
        w += step
    templates = {f: [frozenset(grams(words_of(n))) for n in [*ns, *CALLED.get(f, ([], []))[0]]] for f, ns in families.items()}
    scanner = Scanner(classes, feature, telling, w, 0.0, templates)
    unseen = [n for notices in HELD_OUT.values() for n in notices]
    unseen += [varied(rng, n) for n in unseen] + made_notices(rng, 1, 120)
    top = sorted(float(scanner.probabilities(words_of(t))[:-2].max()) for t in unseen)
    scanner.threshold = top[min(len(top) - 1, int(len(top) * (1 - FALSE_RATE)))]
    return scanner


def plain_sample(docs: DataFrame, most: int = SAMPLE) -> list[str]:
    """About `most` different paragraphs without licence words, from the documents with the least hashes."""
    mark = r"(?i)licen[cs]e|copyright|rights reserved|spdx|permission|creative commons|\bcc by"
    n = max(1, docs.count())
    few = docs.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(min(1.0, most / 4 / n) * (1 << 30)))
    lines = few.select(F.explode(F.split("text", "\n")).alias("p")).filter(~F.col("p").rlike(mark)).filter(F.length("p") > 0).distinct()
    return [r[0] for r in lines.orderBy(F.xxhash64("p"), "p").limit(most).collect()]


def scan(docs: DataFrame, scanner: Scanner, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, paragraph (its number among all lines), family, probability, template_share, text of each licence paragraph."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([source.schema["doc_id"], *T.StructType.fromDDL("paragraph int, family string, probability double, template_share double, text string").fields])
    held = docs.sparkSession.sparkContext.broadcast(scanner)

    def run(batches):
        own = held.value
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for d, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    out += [(d, *found) for found in own.paragraphs(text)] if text else []
                if out:
                    kinds = [part.schema.field(0).type, pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=schema.names)

    return source.mapInArrow(run, schema)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scan(docs, fit(plain_sample(docs)))
    return found.select("doc_id", "paragraph", "family", F.round("probability", 6).alias("probability"), F.round("template_share", 6).alias("template_share"))
