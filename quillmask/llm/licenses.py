"""License scans by a trained paragraph classifier.

A logistic regression over sparse word n-grams (1 to 3 words, of the training notices' vocabulary, and how much of a paragraph lies outside of it) names a paragraph's licence family or none. It is trained on the names and
notices below (names in the usual phrases, notices whole and in parts, with words dropped and noise around them) against paragraphs that are no licence. Its probabilities are scaled (one temperature) on notices and prose
that training doesn't use in any form, phrases included, and a family counts only above the threshold at which that prose stays unknown. A prediction is confirmed by comparison with the family's templates: enough of a
template's word pairs must stand in the paragraph, and short templates must be a good part of it, so that a licence that is only mentioned isn't reported.

A paragraph is a line of the text. A notice may also be wrapped: consecutive lines with words (comment signs are none) are read as one, and where enough of a template's word pairs stand together over several lines, those words are
classified and confirmed like a line; the finding's paragraph is its first line. As confirmation needs that share of a template's pairs, one of a few of each template's words must be there (see ``signs``); texts and lines without
any are passed over, which loses nothing.

Null and empty texts have one empty paragraph and no findings, as have those of null identifiers, which come back with a null one; of templates that are equally alike the first counts, of families equally likely the first listed;
repeated rows are answered each; very long texts and lines are read whole; an empty table gives no rows; other columns are not looked at and not returned.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import raw, table

#: The names of the families, as they stand in phrases and after a licence tag.
NAMES = {
    "Apache-2.0": ["Apache License 2.0", "Apache License, Version 2.0", "Apache 2.0 license", "Apache-2.0"],
    "MIT": ["MIT License", "MIT"],
    "GPL-3.0": ["GNU General Public License version 3", "GNU General Public License v3.0", "GNU GPL v3", "GPLv3", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"],
    "GPL-2.0": ["GNU General Public License version 2", "GNU General Public License v2.0", "GNU GPL v2", "GPLv2", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"],
    "AGPL-3.0": ["GNU Affero General Public License version 3", "GNU Affero General Public License v3.0", "GNU AGPL v3", "AGPLv3", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"],
    "LGPL": ["GNU Lesser General Public License", "GNU Lesser General Public License version 3", "GNU LGPL", "LGPL", "LGPLv3", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-or-later"],
    "BSD": ["BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "Simplified BSD License", "BSD-3-Clause", "BSD-2-Clause"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "MPL 2.0", "MPL-2.0"],
    "ISC": ["ISC License", "ISC"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License v2.0", "EPL 2.0", "EPL-2.0"],
    "CC-BY-NC-SA": ["Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "Creative Commons Attribution-NonCommercial-ShareAlike License", "CC BY-NC-SA 4.0", "CC-BY-NC-SA-4.0", "CC BY-NC-SA"],
    "CC-BY-NC-ND": ["Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "Creative Commons Attribution-NonCommercial-NoDerivs License", "CC BY-NC-ND 4.0", "CC-BY-NC-ND-4.0", "CC BY-NC-ND"],
    "CC-BY-NC": ["Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial License", "CC BY-NC 4.0", "CC-BY-NC-4.0", "CC BY-NC"],
    "CC-BY-SA": ["Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike License", "CC BY-SA 4.0", "CC-BY-SA-4.0", "CC BY-SA"],
    "CC-BY-ND": ["Creative Commons Attribution-NoDerivatives 4.0 International License", "Creative Commons Attribution-NoDerivs License", "CC BY-ND 4.0", "CC-BY-ND-4.0", "CC BY-ND"],
    "CC-BY": ["Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License", "CC BY 4.0", "CC-BY-4.0", "CC BY"],
    "public-domain": ["CC0 1.0 Universal", "CC0 1.0", "CC0", "Unlicense", "CC0-1.0"],
    "proprietary": [],
}
#: Phrases around a name: those of training, which are templates too, and those of calibration only.
PHRASES = ("{}", "License: {}", "SPDX-License-Identifier: {}", "Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "Released under {}.", "This work is licensed under a {}.", "This project is licensed under the terms of the {}.", "Text is available under the {}.")
OTHER_PHRASES = ("Distributed under the {}; see the LICENSE file for details.", "All code in this repository is covered by the {}.", "Copyright 2021 Jane Roe, published under {}.", "You may use these files under the {}.")
#: Notices by which the families are known.
NOTICES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "LGPL": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.", "The person who associated a work with this deed has dedicated the work to the public domain under CC0 1.0.", "This work is in the public domain.", "Dedicated to the public domain.",
    ],
    "proprietary": [
        "All rights reserved.", "Copyright (c) the authors. All rights reserved.", "Copyright 2020 the company. All rights reserved.", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited.",
        "No part of this publication may be reproduced, stored or transmitted in any form without the prior written permission of the publisher.",
    ],
}
#: Paragraphs that share words with notices and are none.
OTHERS = [
    "The version of the software that we use in this work is described in the next section and may not be the latest one.",
    "He lost his driver's license and had to obtain a copy from the public office, free of charge.",
    "The terms of the general agreement were published by the foundation in a later version of this file.",
    "All people have rights, and the public is free to use the library in any form.",
    "The mission was to deal with software without restriction of the source of its parts.",
    "You can see the following conditions in the general public on the commons.",
    "The license fee for the hall is due at the end of the month under the old agreement.",
    "This program of the university is free for any person at the age of eighteen.",
    "Copies of the original paintings are shown in the public library with permission of the holder.",
    "The weather was fine and the work in the garden went on without any kind of trouble.",
    "In this file you find the names of all contributors to the creative writing course.",
    "Version 3 of the plan was released in the spring and version 2 was dropped.",
    "All rights reserved for members of the club end with the season and seats reserved for guests may be given away.",
    "The organisers have all rights reserved to move the date of the concert.",
    "A table was reserved under her name, and all the others were free.",
    "The group released its first album under a new name and the song became a hit in the public charts.",
    "He studied at MIT and worked on software for the public library before he joined the foundation.",
    "The Apache helicopter landed near the village while the general gave an interview to the press.",
    "The mozilla of the story is a creature that eats gnu and antelope on the open plain.",
    "An eclipse will be visible to the public in the northern parts of the country in version of the almanac.",
    "A fishing license is required by law for any person above the age of fourteen.",
    "The creative team at the agency was granted permission to use the old factory as a studio.",
    "The attribution of the painting to the master is still in dispute among the experts.",
    "International trade under the new terms grew by four percent, and the commons was divided.",
    "Redistribution of income was the main subject of the debate in the house of commons.",
    "The house stands on a public domain at the edge of the forest and may be visited on Sundays.",
    "Unless the weather changes, the match will be played in writing distance of the old station.",
    "She asked for written permission of the publisher before the interview was printed.",
    "The notice on the door said that the shop would be closed without any warranty of a return.",
    "The lawyer compared the licence of the software with the one of the library and found no conflict of terms.",
    "Several companies have moved from one open source license to another in the last years, and their users complain.",
    "Most projects on the platform choose the MIT License or the Apache License because they are short and permissive.",
    "The difference between the GNU General Public License and the BSD licenses is what makes the debate so long.",
    "Creative Commons was founded in 2001 and has published several licenses since then.",
]
#: Prose for calibration, of which training sees nothing.
OTHER_PROSE = [
    "The children were free to play in the yard until the bell rang for the general assembly.", "Permission slips for the trip must be returned to the office by Friday, signed by a parent.",
    "The museum holds the rights to the photographs and lends copies to other institutions for a fee.", "Her book was published in a revised version and is available in every library of the town.",
    "The committee agreed to the terms in writing and will meet again under a new chair.", "They built the software for the bank from its own source code and tested it on every form.",
    "Public transport is free of charge for pupils with a valid copy of their card.", "The source of the river lies in a wide plain, and its conditions change with the season.",
    "Any person who saw the accident is asked to call the number in the notice.", "The general had his name removed from the list of contributors to the memorial.",
    "A driver without a license was stopped on the main road and fined by the police.", "The foundation gives grants to young artists whose work is shown to the public.",
    "All seats are reserved and no tickets are sold at the door on the evening of the show.", "The company is required by law to keep its files for ten years in a safe place.",
    "We compared three licenses for open source projects and asked developers which of them they understand.", "The team behind the program moved to a new office and released a short film about it.",
    "Conditions on the mountain were bad, and the climbers went back without the rest of their gear.", "The deed of the house was found in the attic together with letters of the former owner.",
    "He holds a degree from MIT, but he never used it in any form.", "The bird is known under several names and is common in all parts of the island.",
    "The film is subject to a later cut and may be distributed in spring.", "The minister granted an interview and spoke of the restriction of trade without naming any country.",
]
WORD = re.compile(rb"[a-z0-9]+(?:[.-][a-z0-9]+)*")
#: Longest n-gram; a template's word pairs that confirm it; the paragraph's pairs that a template of fewer than WHOLE pairs must make up.
GRAMS, CONFIRMED, WHOLE, PART = 3, 0.6, 6, 0.25
_LOW = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_PARTS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def words_of(line: bytes) -> list[bytes]:
    """Lower-case words; a year is any year."""
    return [b"2020" if len(w) == 4 and w.isdigit() and b"1900" <= w <= b"2099" else w for w in WORD.findall(line.translate(_LOW))]


def grams_of(words: list[bytes]) -> set[bytes]:
    return {b" ".join(words[i : i + n]) for n in range(1, GRAMS + 1) for i in range(len(words) - n + 1)}


def templates(phrases: tuple[str, ...], notices: bool = True) -> dict[str, list[list[bytes]]]:
    """The words of each family's names in phrases, and of its notices. A name of one word is no notice by itself."""
    out = {}
    for family, names in NAMES.items():
        texts = [p.format(n) for n in names for p in phrases if p != "{}" or " " in n]
        out[family] = [words_of(t.encode()) for t in texts + (NOTICES.get(family, []) if notices else [])]
    return out


def signs(template: list[bytes], pairs: set) -> set[bytes]:
    """Words, the longest first, of which one at least stands in any CONFIRMED share of the pairs."""
    out: set[bytes] = set()
    for w in sorted(set(template), key=lambda w: (-len(w), w)):
        if sum(out.isdisjoint(p) for p in pairs) < CONFIRMED * len(pairs):
            break
        out.add(w)
    return out


#: Words of a paragraph that may name several licences, and what stands between them.
CHOICE, _JOINTS = 24, frozenset({b"or", b"and", b"/"})


class Classifier:
    """Families with the unknown class at 0, one row of weights for each n-gram, and for the shares of unknown words."""

    SHARES = (0.2, 0.4, 0.6, 0.8)

    def __init__(self, seed: int = 3, variants: int = 6):
        rng = np.random.default_rng(seed)
        self.families = ["unknown", *NAMES]
        whole = templates(PHRASES)
        self.pairs = {f: [self.pairs_of(w) for w in lines] for f, lines in whole.items()}
        self.held_by: dict[tuple, list[tuple[str, int]]] = defaultdict(list)
        for f, own in self.pairs.items():
            for i, t in enumerate(own):
                for x in t:
                    self.held_by[x].append((f, i))
        self.signs = set().union(*(signs(w, t) for f in whole for w, t in zip(whole[f], self.pairs[f], strict=True)))
        self.parts = {max(re.split(rb"[.-]", w), key=len) for w in self.signs}
        grams = sorted({g for lines in whole.values() for w in lines for g in grams_of(w)})
        self.number = {g: i for i, g in enumerate(grams)}
        self.words = {g for g in grams if b" " not in g}
        others, prose = ([words_of(t.encode()) for t in texts] for texts in (OTHERS, OTHER_PROSE))
        noise = sorted({w for t in others for w in t}) + [bytes(rng.integers(97, 123, rng.integers(2, 9), np.uint8)) for _ in range(200)]
        some = lambda n: [noise[i] for i in rng.integers(0, len(noise), n)]
        every = sorted(self.words)
        rows: list[tuple[list[bytes], int]] = []
        for k, f in enumerate(NAMES, 1):
            for words in whole[f]:
                # long notices are rare among the templates, and met in parts
                for v in range(variants * (4 if len(words) > 12 else 1)):
                    kept = [w for w in words if v == 0 or len(words) < 6 or rng.random() > 0.08] or words
                    kept = kept[: int(rng.integers(len(kept) * 2 // 3, len(kept) + 1))] if len(words) > 12 and v % 4 == 3 else kept
                    rows.append((some(int(rng.integers(0, 6)) * (v > 0)) + kept + some(int(rng.integers(0, 6)) * (v > 1)), k))
        for v in range(400 * variants):
            other = others[v % len(others)]
            mixed = [every[i] for i in rng.integers(0, len(every), rng.integers(0, 5))]
            rows.append(([other, some(30) + mixed, [other[i] for i in rng.permutation(len(other))] + mixed, other[: int(rng.integers(3, len(other)))]][v % 4], 0))
        at, y = [self.features(words) for words, _ in rows], np.array([k for _, k in rows])
        w = self.train(at, y, len(grams) + len(self.SHARES) + 1)
        held = [(words, k) for k, f in enumerate(NAMES, 1) for words in templates(OTHER_PHRASES, False)[f]] + [(words, 0) for t in prose for words in (t, t[: len(t) // 2], t[len(t) // 2 :])]
        logits, truth = np.stack([self.value(w, words) for words, _ in held]), np.array([k for _, k in held])
        # each class counts alike
        share = np.where(truth > 0, 0.5 / (truth > 0).sum(), 0.5 / (truth == 0).sum())
        loss = lambda t: (-np.log(self.soft(logits / t)[np.arange(len(logits)), truth] + 1e-9) * share).sum()
        self.temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0), key=loss)
        self.weights = w / self.temperature
        p = self.soft(logits / self.temperature)
        self.threshold = float(np.clip(p[truth == 0, 1:].max(), 0.5, 0.9))
        self.held_out_accuracy = float((np.where(p[:, 1:].max(1) >= self.threshold, 1 + p[:, 1:].argmax(1), 0) == truth).mean())

    def features(self, words: list[bytes]) -> tuple[list[int], float]:
        """(columns, the value that the n-grams' columns have); the last columns are the shares of unknown words and the constant."""
        at = [self.number[g] for g in grams_of(words) if g in self.number]
        strange = sum(w not in self.words for w in words) / max(1, len(words))
        return at + [len(self.number) + i for i, s in enumerate(self.SHARES) if strange >= s], 1 / math.sqrt(max(1, len(at)))

    def value(self, w: np.ndarray, words: list[bytes]) -> np.ndarray:
        at, x = self.features(words)
        n = len(self.number)
        return w[[i for i in at if i < n]].sum(0) * x + w[[i for i in at if i >= n]].sum(0) + w[-1]

    def train(self, rows: list[tuple[list[int], float]], y: np.ndarray, columns: int) -> np.ndarray:
        """Multinomial logistic regression by gradient steps with momentum; every family weighs alike."""
        x = np.zeros((len(rows), columns), np.float32)
        for i, (at, value) in enumerate(rows):
            x[i, at] = [value if j < len(self.number) else 1.0 for j in at]
        x[:, -1] = 1
        share = (1 / np.bincount(y, minlength=len(self.families))[y]).astype(np.float32)
        share[y == 0] *= len(NAMES)
        share /= share.sum()
        target, w = np.eye(len(self.families), dtype=np.float32)[y], np.zeros((columns, len(self.families)), np.float32)
        speed = np.zeros_like(w)
        for _ in range(500):
            speed = 0.9 * speed - 4.0 * (x.T @ ((self.soft(x @ w) - target) * share[:, None]) + 1e-5 * w)
            w += speed
        return w

    @staticmethod
    def soft(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    @staticmethod
    def pairs_of(words: list[bytes]) -> set:
        return set(zip(words, words[1:], strict=False)) or {(w,) for w in words}

    def classify(self, line: bytes) -> tuple[str, float, float] | None:
        """(family, probability, share of the best template's word pairs), None if unknown or not confirmed."""
        return self.classify_words(words_of(line))

    def classify_words(self, words: list[bytes]) -> tuple[str, float, float] | None:
        if self.signs.isdisjoint(words):
            return None
        p = self.soft(self.value(self.weights, words)[None, :])[0]
        k = 1 + int(p[1:].argmax())
        if p[k] < self.threshold:
            return None
        family, own = self.families[k], self.pairs_of(words)
        alike = max((n / len(t) for t in self.pairs[family] if (n := len(t & own)) and (len(t) >= WHOLE or n >= PART * len(own))), default=0.0)
        return (family, float(p[k]), alike) if alike >= CONFIRMED else None

    def others(self, words: list[bytes], first: str) -> list[tuple[str, float, float]]:
        """Families that a short paragraph names beside the first one: between "or", "and" or "/" each part is classified and confirmed by itself, as what something is licensed under."""
        if len(words) > CHOICE or _JOINTS.isdisjoint(words):
            return []
        out, begin = {}, 0
        for i in range(len(words) + 1):
            if i == len(words) or words[i] in _JOINTS:
                if i > begin and (x := self.classify_words([b"licensed", b"under", *words[begin:i]])) and x[0] != first:
                    out.setdefault(x[0], x)
                begin = i + 1
        return list(out.values())

    def wrapped(self, lines: list[list[bytes]], found: dict[int, tuple[str, float, float]]) -> list[tuple[int, tuple[str, float, float]]]:
        """(line of the first word, finding) of notices that run over several of the lines, which are words, and that none of their lines has in found."""
        words = [w for line in lines for w in line]
        near = [(i, x) for i, x in enumerate(zip(words, words[1:], strict=False)) if x in self.held_by]
        of: dict[tuple[str, int], list[tuple[int, tuple]]] = defaultdict(list)
        for i, x in near:
            for t in self.held_by[x]:
                of[t].append((i, x))
        number = [n for n, line in enumerate(lines) for _ in line] if of else []
        out: list[tuple[int, int, tuple[str, float, float]]] = []
        for (family, k), at in of.items():
            pairs = self.pairs[family][k]
            if len({x for _, x in at}) < CONFIRMED * len(pairs):
                continue
            most, first, end = 2 * len(pairs) + 8, 0, -1
            while first < len(at):
                last = first
                while last + 1 < len(at) and at[last + 1][0] - at[first][0] < most:
                    last += 1
                a, b = at[first][0], at[last][0] + 1
                if a > end and len({x for _, x in at[first : last + 1]}) >= CONFIRMED * len(pairs) and number[b] > number[a] and (x := self.classify_words(words[a : b + 1])):
                    if not any(n in found and found[n][0] == x[0] for n in range(number[a], number[b] + 1)):
                        out.append((a, b, x))
                    end = b
                first += 1
        kept: list[tuple[int, int, tuple[str, float, float]]] = []
        for a, b, x in sorted(out, key=lambda o: (-o[2][2], o[0] - o[1], o[0])):  # of those that overlap, the most alike and longest
            if not any(a <= d and c <= b for c, d, _ in kept):
                kept.append((a, b, x))
        return sorted((number[a], x) for a, _, x in kept)

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, tuple[str, float, float]]]]:
        """The number of lines, and (line, finding) of those that are a notice by themselves or begin one that is wrapped; lines without words part blocks."""
        if self.parts.isdisjoint(text.translate(_PARTS).split()):
            return text.count(b"\n") + 1, []
        lines = [words_of(line) for line in text.split(b"\n")]
        found = {i: x for i, words in enumerate(lines) if (x := self.classify_words(words))}
        out, begin = [(i, x) for i, one in found.items() for x in (one, *self.others(lines[i], one[0]))], 0
        for i in range(len(lines) + 1):
            if i == len(lines) or not lines[i]:
                if i - begin > 1 and any(not self.signs.isdisjoint(x) for x in lines[begin:i]):
                    out += [(begin + n, x) for n, x in self.wrapped(lines[begin:i], {n - begin: x for n, x in found.items() if begin <= n < i} if found else {})]
                begin = i + 1
        return len(lines), sorted(out)


@lru_cache(maxsize=1)
def classifier() -> Classifier:
    return Classifier()


def find_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_paragraphs, findings): for each row the paragraphs that are a known licence's notice, in order."""
    df = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(classifier())

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("paragraph", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64())]))
        for batch in batches:
            counts, findings = [], []
            for text in raw(batch.column(1)):
                n, scanned = held.value.scan(text or b"")
                counts.append(n)
                findings.append([{"paragraph": i, "family": x[0], "probability": x[1], "similarity": x[2]} for i, x in scanned])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(findings, kind)], ["id", "n_paragraphs", "findings"])

    kind = df.schema["id"].dataType.simpleString()
    return df.mapInArrow(found, f"id {kind}, n_paragraphs bigint, findings array<struct<paragraph:bigint,family:string,probability:double,similarity:double>>").withColumnRenamed("id", id_col)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_licenses(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_paragraphs", F.size("findings").cast("long").alias("n_licenses"), F.array_join(F.array_sort(F.array_distinct(F.col("findings.family"))), ",").alias("families"), F.round(F.array_max(F.col("findings.probability")), 6).alias("best")
    )
