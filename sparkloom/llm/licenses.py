"""Licence scans with DataFrame functions only.

A trained paragraph classifier, a multinomial logistic regression over word 1- to 3-grams,
names the licence family of every paragraph, or none ("unknown"). It is trained here on
variations of customary notices and licence texts, on ordinary prose, on prose that uses
the same words, and on notices' words in disorder. Its temperature is calibrated on a fold
of short notices and prose by a classifier that saw none of them. A family counts as confirmed if the paragraph
shares enough words with one of the family's templates.

Scoring is one narrow pass, no shuffle, no Python: n-grams are hashed, a hash finds its
slot in a literal table, and the slot finds the weights. Before that, a text's words bound
what any family can gain on "unknown" in it (:func:`word_bounds`). Where even that sum falls
short of the unknown class's lead, the classifier's answer is known to be "unknown" and the
sums aren't made. The bound is exact: it changes no answer.
"""

from __future__ import annotations

import random
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import common

UNKNOWN = "unknown"

# Customary notices, short forms and licence texts of each family, a
# paragraph each.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Licensed under the MIT license. See the LICENSE file for details.",
        "License: MIT",
        "MIT License",
        "The MIT License (MIT)",
        "SPDX-License-Identifier: MIT",
        "Released under MIT.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "Apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Apache License, Version 2.0",
        "Apache License Version 2.0, January 2004",
        "License: Apache 2.0",
        "Released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "GNU General Public License, version 2",
        "Licensed under GPL-2.0-or-later.",
        "Released under the GPL.",
        "License: GPL 3.0",
        "License: GPLv3",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "LGPL": (
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "GNU Lesser General Public License v3.0",
        "License: LGPL 2.1",
        "Licensed under LGPL-3.0-or-later.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ),
    "AGPL": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "GNU Affero General Public License v3.0",
        "License: AGPL 3.0",
        "Licensed under AGPL-3.0-only.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ),
    "BSD": (
        "Licensed under the BSD 3-Clause License.",
        "BSD 2-Clause License",
        "Released under a BSD-style license.",
        "License: BSD",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ),
    "ISC": (
        "ISC License",
        "Licensed under the ISC license.",
        "License: ISC",
        "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ),
    "MPL": (
        "Licensed under the Mozilla Public License 2.0.",
        "Mozilla Public License Version 2.0",
        "License: MPL 2.0",
        "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one.",
    ),
    "EPL": (
        "Licensed under the Eclipse Public License 2.0.",
        "Eclipse Public License - v 2.0",
        "License: EPL 2.0",
        "SPDX-License-Identifier: EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which accompanies this distribution.",
    ),
    "Zlib": (
        "zlib License",
        "Licensed under the zlib license.",
        "License: Zlib",
        "SPDX-License-Identifier: Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such.",
    ),
    "Boost": (
        "Boost Software License - Version 1.0",
        "Distributed under the Boost Software License, Version 1.0.",
        "License: BSL 1.0",
        "SPDX-License-Identifier: BSL-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software.",
    ),
    "CC": (
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Except where otherwise noted, content is available under a Creative Commons license.",
        "License: CC BY 4.0",
        "SPDX-License-Identifier: CC-BY-4.0",
        "CC BY-SA 4.0",
        "CC BY-NC-ND 4.0",
        "CC0",
        "CC0 1.0 Universal",
        "Creative Commons",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    ),
    "Unlicense": (
        "Dedicated to the public domain under the Unlicense.",
        "The Unlicense",
        "License: Unlicense",
        "SPDX-License-Identifier: Unlicense",
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "WTFPL": (
        "Do What The Fuck You Want To Public License",
        "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
        "You just DO WHAT THE FUCK YOU WANT TO.",
    ),
    "Proprietary": (
        "All rights reserved.",
        "Proprietary and confidential. No license is granted.",
        "All rights reserved. Unauthorized copying of this file is strictly prohibited.",
        "This software is the confidential and proprietary information of the company. You shall not disclose such confidential information.",
        "No part of this publication may be reproduced or transmitted in any form without the prior written permission of the publisher.",
    ),
}
# How licences are called in short notices.
NAMES = {
    "MIT": ("MIT", "MIT License"),
    "Apache": ("Apache 2.0", "Apache-2.0", "Apache License 2.0", "Apache License, Version 2.0"),
    "GPL": ("GPL", "GPLv3", "GPLv2", "GPL 3.0", "GPL-2.0-only", "GPL-3.0-or-later", "GNU GPL", "GNU General Public License", "GNU General Public License, version 3"),
    "LGPL": ("LGPL", "LGPLv3", "LGPL 2.1", "LGPL-2.1-or-later", "GNU LGPL", "GNU Lesser General Public License"),
    "AGPL": ("AGPL", "AGPLv3", "AGPL 3.0", "AGPL-3.0-only", "GNU AGPL", "GNU Affero General Public License"),
    "BSD": ("BSD", "BSD-3-Clause", "BSD 2-Clause", "simplified BSD", "new BSD"),
    "ISC": ("ISC", "ISC License"),
    "MPL": ("MPL", "MPL 2.0", "MPL-2.0", "Mozilla Public License 2.0", "Mozilla Public License"),
    "EPL": ("EPL", "EPL 2.0", "EPL-2.0", "Eclipse Public License 2.0", "Eclipse Public License"),
    "Zlib": ("Zlib", "zlib License", "zlib/libpng"),
    "Boost": ("BSL-1.0", "Boost Software License 1.0", "Boost Software License"),
    "CC": ("CC BY 4.0", "CC BY-SA 4.0", "CC BY-NC 4.0", "CC-BY-4.0", "CC BY-NC-ND 4.0", "CC0", "CC0 1.0", "Creative Commons", "Creative Commons Attribution 4.0"),
    "Unlicense": ("Unlicense", "The Unlicense"),
    "WTFPL": ("WTFPL", "WTFPL 2.0"),
}
# Short notices in four languages.
FRAMES = (
    "{}",
    "License: {}",
    "SPDX-License-Identifier: {}",
    "Licensed under {}.",
    "Licensed under the {} license.",
    "Released under {}.",
    "Released under the {} license.",
    "This project is licensed under the terms of the {} license.",
    "Licensed under the {} license. See the LICENSE file for details.",
    "Distributed under the {} license.",
    "This software is available under the {} license.",
    "The code is published under {}.",
    "You may use this file under the terms of the {} license.",
    "Use of this source code is governed by the {} license.",
    "@license {}",
    "All content is provided under {}, unless noted otherwise.",
    "Made available under the {}.",
    "Covered by the {} license, see COPYING.",
    "Open source, {} licensed.",
    "Lizenz: {}",
    "Lizenziert unter {}.",
    "Lizenziert unter der {}-Lizenz.",
    "Veröffentlicht unter der Lizenz {}.",
    "Dieses Werk steht unter der {}-Lizenz.",
    "Dieses Projekt steht unter {}.",
    "Der Quelltext ist unter der {}-Lizenz verfügbar.",
    "Licence : {}",
    "Licence {}",
    "Sous licence {}.",
    "Publié sous licence {}.",
    "Ce projet est sous licence {}.",
    "Distribué selon les termes de la licence {}.",
    "Licencia: {}",
    "Licencia {}",
    "Bajo licencia {}.",
    "Publicado bajo la licencia {}.",
    "Este proyecto está bajo la licencia {}.",
    "Distribuido según los términos de la licencia {}.",
)
# Ordinary prose, most of it with the notices' words.
OTHER = (
    "The driver lost his license after the accident and had to take the test again.",
    "The public was free to use the software in the library without any restriction on time.",
    "General terms and conditions apply to every order placed in this shop.",
    "The commons voted on the new version of the law with permission of the speaker.",
    "Source and binary stars are permitted to form pairs under certain conditions.",
    "Apache helicopters and their crews arrived at the base in the morning.",
    "Students at MIT built a robot that can copy any movement of a person.",
    "Copyright law protects authors and their work in most countries.",
    "Please read the documentation files before you file a report.",
    "A warranty covers defects of the product for two years after the purchase.",
    "The mozilla was an old browser and the file was public.",
    "He reserved all rooms under the name of the attribution committee.",
    "A license to drive was granted to him by the court.",
    "The rights reserved for members of the club are listed on the board.",
    "Fishing here needs a license that is sold at the harbour office.",
    "The bar was licensed to sell spirits until midnight.",
    "Permission denied, said the guard, and the visitors turned back.",
    "Her passport had expired and the permission to travel was withdrawn.",
    "The broadcast rights were licensed to the highest offer from abroad.",
    "The contract was granted to another company in the end.",
    "Creative people gathered in the commons of the old village.",
    "The eclipse could be seen from the public square in the evening.",
    "The boost in sales was larger than expected this year.",
    "Free software meetings are held in this room every month.",
    "The general gave the public a speech about freedom and duty.",
    "Conditions on the road were bad and the bus was late.",
    "The author of the book was not present at the event.",
    "We moved the tables to the garden because the weather was fine.",
    "In no event did the players give up before the end of the game.",
    "She bought bread, cheese and two bottles of milk at the market.",
    "The river rose by two metres during the night and flooded the fields.",
    "Version 2.0 of the program was released in spring with many changes.",
    "Use the following form to tell us about problems with the file.",
    "It is hoped that the new line will be useful to people in the north.",
    "A copy of the letter was sent to the mayor and to the press.",
    "The distribution of seats in parliament changed after the vote.",
    "Without doubt this was the best concert of the season.",
    "The museum is open to any person with a valid ticket.",
    "All copies of the map were sold within a week.",
    "The holder of the record was beaten by a younger runner.",
    "Der Hund ging mit dem Kind nach Hause und bellte.",
    "Le marché est ouvert tous les jours sauf le dimanche.",
    "El perro duerme en la casa y el gato en el jardín.",
    "Die Lizenz zum Fahren wurde ihm entzogen.",
    "Meeting at 10:30 in room 4.2, bring the report and 3 copies.",
    "Call 555 0199 or write to the office for more information.",
    "for x in range(10): print(x) # see the file for details",
    "The domain was sold to a public company for a large sum.",
    "Materials for the course are provided in the reading room.",
    "Any claim for damages must be made within thirty days of the flight.",
    "Das Kind spielt mit dem Ball unter der alten Brücke.",
    "Er fuhr mit der Bahn und las unter dem Licht der Lampe.",
    "Das Buch wurde unter seinem Namen veröffentlicht und ist überall verfügbar.",
    "Dieses Projekt steht vor dem Ende, dieses Werk auch.",
    "Das Haus steht unter Wasser, und die Quelle ist verdeckt.",
    "Mit freundlichen Grüßen aus der Stadt, mit der Bitte um Antwort.",
    "Der Führerschein ist eine Lizenz, die man verlieren kann.",
    "Le chat dort sous la table de la cuisine.",
    "Ce projet est publié selon les termes du contrat avec la ville.",
    "La licence de pêche coûte cher et la saison est courte.",
    "Il marche sous la pluie et le boost des ventes est passé.",
    "Le livre est distribué dans toutes les écoles du pays.",
    "El gato duerme bajo la mesa de la cocina.",
    "Este proyecto está bajo la dirección de mi hermana.",
    "La licencia de conducir se renueva cada diez años.",
    "El libro fue publicado según los términos del contrato.",
    "Los periódicos se distribuyen bajo la lluvia en toda la ciudad.",
    "The licence fee is due in March and covers the whole household.",
    "Licence plates were published in the list of the new owners.",
    "This file is not available under the address that you use.",
    "The content is provided by readers unless noted otherwise on the page.",
    "Open source of light, open doors, open questions about the terms.",
    "The new simplified version of the form was released under pressure.",
    "Use of this entrance is governed by the rules of the house.",
    "Available under the counter, made by hand and sold for cash.",
    "See the list for details, see the file for the code of the room.",
    "The project was published under a pen name and covered by the press.",
)
# Words that most texts have.
COMMON = "0 a the of and to in is that for be with by was as an it on or are not at from you this have has had but all any can will if no so do its may must other which their these they we he she s".split()
COMMON_SET = frozenset(COMMON)
VARIATIONS = 24
#: Parts that frames and lines are dealt into, to calibrate and judge on those not trained on.
FOLDS = 5
#: N-grams of fewer training paragraphs are chance neighbours; of smaller weights no matter.
GRAM_ROWS_MIN, WEIGHT_MIN = 3, 0.02
ORDERS = (1, 2, 3)
WORD = r"[a-z0-9]+"
MIN_CONFIDENCE = 0.5
CONFIRM_SHARE = 0.5
#: Slots of the literal table, two n-grams in each at most.
SLOTS = 1 << 17
#: A line break inside a wrapped paragraph, and what stands for it.
WRAPPED = r"\n(?<=[^\r\n]{39}[^\s.!?:;][ \t]{0,3}\r?\n)(?=[ \t]*[^\s])"
WRAP = "\ue000"


def words_of(text: str) -> list[str]:
    """Lower-case ASCII words and numbers; every number is ``0``."""
    out, word = [], []
    for c in text.lower() + " ":
        if c.isascii() and c.isalnum():
            word.append(c)
        elif word:
            w = "".join(word)
            out.append("0" if w.isdigit() else w)
            word = []
    return out


def grams_of(words: list[str]) -> set[str]:
    """All 1- to 3-grams but those of common words and numbers alone."""
    parts = (words[i : i + n] for n in ORDERS for i in range(len(words) - n + 1))
    return {" ".join(p) for p in parts if not COMMON_SET.issuperset(p)}


def gram_hash(gram: str) -> int:
    """As Spark's xxhash64 of a string, a signed long."""
    h = xxhash.xxh64_intdigest(gram.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


@dataclass(frozen=True)
class Classifier:
    families: list[str]  # with UNKNOWN last
    weights: dict[str, list[float]]  # per n-gram, one per family
    bias: list[float]
    temperature: float

    def probabilities(self, text: str) -> dict[str, float]:
        """The plain form of what :func:`classify` computes."""
        z = np.array(self.bias) + sum((np.array(self.weights[g]) for g in grams_of(words_of(text)) if g in self.weights), np.zeros(len(self.bias)))
        e = np.exp((z - z.max()) / self.temperature)
        return dict(zip(self.families, (e / e.sum()).tolist(), strict=True))


def varied(rng: random.Random, notice: str, k: int) -> str:
    """A notice as it may be met: words lost, a part of a longer one, things around it."""
    fill = "the a of this project library code data text corpus example see file below 2019 2024 v1 copyright by name".split()
    words = notice.split()
    if k % 4 == 3 and len(words) > 16:  # a line of a wrapped paragraph
        at = rng.randrange(len(words) - 9)
        words = words[at : at + rng.randint(9, 16)]
    elif k and len(words) > 4:
        words = [w for w in words if rng.random() > 0.06]
    if k % 4 == 1:
        words = rng.choices(fill, k=rng.randint(1, 5)) + words
    if k % 4 == 2:
        words = words + rng.choices(fill, k=rng.randint(1, 5))
    return " ".join(words)


@dataclass(frozen=True)
class Example:
    text: str
    family: str
    source: str | None  # the notice or line of prose that it was made from
    fold: int


def examples(seed: int) -> list[Example]:
    """Short notices of every name in every frame, variations and parts of longer notices and
    of prose, words in disorder, and nothing at all.

    All rows of a frame are in one fold, as are those of a line of prose. The wording of a
    licence's own text doesn't follow from anything else, so it is in no fold: it is always
    trained on and never judged by.
    """
    rng = random.Random(seed)
    out: list[Example] = []
    loose = [w for notices in TEMPLATES.values() for n in notices for w in n.split()]
    for i, frame in enumerate(FRAMES):
        for family, names in NAMES.items():
            for name in names:
                text = frame.format(name).replace("License license", "license").replace("License-Lizenz", "Lizenz")
                out.append(Example(varied(rng, text, rng.choice((0, 0, 1, 2))), family, text, i % FOLDS))
    for family, notices in [*TEMPLATES.items(), (UNKNOWN, OTHER)]:
        for i, notice in enumerate(notices):
            made = [varied(rng, notice, k) for k in range(VARIATIONS)]
            words = notice.split()
            for at in range(0, len(words) - 8 if len(words) > 16 else 0, 3):  # lines of a wrapped text
                made.append(" ".join(words[at : at + rng.randint(8, 16)]))
            out += [Example(t, family, notice, i % FOLDS if family == UNKNOWN else -1) for t in made]
    prose = [w for n in OTHER for w in n.split()]
    for k in range(40 * VARIATIONS):  # words in disorder say little
        bag = prose if k % 3 == 0 else loose if k % 3 == 1 else prose + rng.sample(loose, 100)
        out.append(Example(" ".join(rng.choices(bag, k=rng.randint(1, 25))), UNKNOWN, None, -1))
    out += [Example("", UNKNOWN, None, -1)] * (25 * VARIATIONS)  # most paragraphs have no feature at all
    return out


def fitted(rows: list[Example], rounds: int = 200, ridge: float = 2e-5) -> Classifier:
    """Fit by accelerated gradients and keep the weights that matter."""
    families = [*TEMPLATES, UNKNOWN]
    sets = [grams_of(words_of(x.text)) for x in rows]
    rows_of = Counter(g for s in sets for g in s)
    vocabulary = {g: k for k, g in enumerate(sorted(g for g, n in rows_of.items() if n >= GRAM_ROWS_MIN))}

    def summed(values: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
        """Sums of rows of values by sorted keys."""
        out = np.zeros((n, values.shape[1]), np.float32)
        if keys.size:
            own, at = np.unique(keys, return_index=True)
            out[own] = np.add.reduceat(values, at, axis=0)
        return out

    def soft(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    found = [sorted(vocabulary[g] for g in s if g in vocabulary) for s in sets]
    r, c = np.repeat(np.arange(len(sets)), [len(f) for f in found]), np.array([k for f in found for k in f], np.int64)
    order = np.argsort(c, kind="stable")
    y = np.eye(len(families), dtype=np.float32)[[families.index(x.family) for x in rows]]
    width = np.array([len(s) for s in sets]) + 1.0
    step = np.float32(len(rows) ** 0.5 / (0.5 * width.mean() / 4 + ridge))
    w = ahead = np.zeros((len(vocabulary) + 1, len(families)), np.float32)
    for k in range(rounds):
        gap = (soft(summed(ahead[c], r, len(rows)) + ahead[-1]) - y) / np.float32(len(rows))
        slope = np.vstack([summed(gap[r[order]], c[order], len(vocabulary)), gap.sum(axis=0)]) + np.float32(ridge) * ahead
        now = ahead - step * slope
        ahead, w = now + np.float32(k / (k + 3)) * (now - w), now
    w -= w.mean(axis=1, keepdims=True)  # only differences count
    keep = [g for g, k in vocabulary.items() if np.abs(w[k]).max() >= WEIGHT_MIN]
    return Classifier(families, {g: np.round(w[vocabulary[g]].astype(float), 3).tolist() for g in keep}, np.round(w[-1].astype(float), 3).tolist(), 1.0)


def held_out(seed: int = 42, fold: int = 0, rounds: int = 120) -> tuple[Classifier, list[Example], list[Example]]:
    """A classifier, the rows it was trained on, and the rows of the fold's notices and
    lines, of which it has seen none."""
    rows = examples(seed)
    plain = lambda text: " ".join(words_of(text))
    own = {plain(x.source) for x in rows if x.fold == fold}
    seen = [x for x in rows if x.fold != fold and plain(x.text) not in own and plain(x.source or "") not in own]
    return fitted(seen, rounds), seen, [x for x in rows if x.fold == fold]


def logits(model: Classifier, texts: list[str]) -> np.ndarray:
    return np.array([np.log(np.maximum(list(model.probabilities(t).values()), 1e-300)) for t in texts])


@lru_cache(maxsize=4)
def train(seed: int = 42) -> Classifier:
    """The classifier of all rows. Its temperature is the one that suits the rows of fold 0
    best, under a classifier that has seen nothing of that fold's notices and lines."""
    model, _, held = held_out(seed, 0)
    z, target = logits(model, [x.text for x in held]), [model.families.index(x.family) for x in held]
    heat = np.geomspace(0.3, 5, 40)
    e = [np.exp(z / t - (z / t).max(axis=1, keepdims=True)) for t in heat]
    loss = [-np.log((p / p.sum(axis=1, keepdims=True))[np.arange(len(target)), target] + 1e-12).sum() for p in e]
    whole = fitted(examples(seed))
    return Classifier(whole.families, whole.weights, whole.bias, float(heat[int(np.argmin(loss))]))


def word_bounds(model: Classifier) -> tuple[dict[str, list[float]], list[float]]:
    """What a word adds at most to each family's lead over unknown, and the leads to make up.

    Each n-gram's gains are booked on one of its words, the one that prose uses least; a
    text has an n-gram only if it has that word, so the sum over its words is a bound.
    """
    n = len(model.families) - 1
    usual = Counter(w for t in OTHER for w in words_of(t))
    often = Counter(w for g in model.weights for w in g.split())
    bound: dict[str, np.ndarray] = {}
    for g, w in model.weights.items():
        gain = np.maximum(np.array(w[:n]) - w[n], 0)
        if gain.any():
            own = min((x for x in g.split() if x not in COMMON_SET), key=lambda x: (usual[x], often[x], x))
            bound[own] = bound.get(own, 0) + gain
    return {w: np.round(v + 5e-4, 3).tolist() for w, v in bound.items()}, [model.bias[n] - b for b in model.bias[:n]]


def tokens(paragraph: Column) -> Column:
    """As :func:`words_of`."""
    found = F.regexp_extract_all(F.lower(paragraph), F.lit(WORD), F.lit(0))
    return F.transform(found, lambda w: F.when(w.rlike("^[0-9]+$"), F.lit("0")).otherwise(w))


def _literal(values: list, kind: str) -> Column:
    """An array constant, folded once by the optimizer."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def slots_of(hashes: list[int]) -> tuple[int, list[list[int]], list[list[int]]]:
    """Shift, and two layers of hashes and of their places by slot: the first bits of the
    hashes that put no three into one slot."""
    for shift in range(48):
        layers, place = [[0] * SLOTS, [0] * SLOTS], [[0] * SLOTS, [0] * SLOTS]
        for k, h in enumerate(hashes):
            slot = (h >> shift) % SLOTS
            layer = 1 if layers[0][slot] else 0
            if layers[layer][slot]:
                break
            layers[layer][slot], place[layer][slot] = h, k
        else:
            return shift, layers, place
    raise ValueError("too many n-grams for SLOTS")


def classify(paragraph: Column, model: Classifier) -> Column:
    """struct(family, score, confirmed) of a paragraph; null for a null one."""
    shift, layers, place = slots_of([gram_hash(g) for g in model.weights])
    rows = list(model.weights.values())
    n = len(model.families)
    first, second, one, two = (_literal(x, k) for x, k in ((layers[0], "bigint"), (layers[1], "bigint"), (place[0], "int"), (place[1], "int")))
    table = _literal([v for w in rows for v in w], "double")
    bias = F.array(*[F.lit(v) for v in model.bias])
    templates = {f: F.array(*[F.array(*map(F.lit, sorted(set(words_of(t))))) for t in notices]) for f, notices in TEMPLATES.items()}

    def hashes(words: Column) -> Column:
        rest = lambda k: F.concat(F.slice(words, k + 1, F.greatest(F.size(words) - k, F.lit(0))), F.array_repeat(F.lit(None).cast("string"), k))
        pairs = F.zip_with(words, rest(1), lambda a, b: F.when(b.isNotNull(), F.concat(a, F.lit(" "), b)))
        triples = F.zip_with(pairs, rest(2), lambda a, b: F.when(b.isNotNull(), F.concat(a, F.lit(" "), b)))
        return F.transform(F.concat(words, pairs, triples), lambda g: F.xxhash64(g))

    def known(found: Column) -> Column:
        """Rows of the weights of the n-grams that have some, each once."""
        slot = lambda h: F.pmod(F.shiftright(h, shift), F.lit(SLOTS)).cast("int")
        row = lambda h: F.when(F.get(first, slot(h)) == h, F.get(one, slot(h))).when(F.get(second, slot(h)) == h, F.get(two, slot(h)))
        return F.array_distinct(F.filter(F.transform(found, row), lambda x: x.isNotNull()))

    def summed(words: Column) -> Column:
        add = lambda acc, x: F.zip_with(acc, F.slice(table, x * n + 1, n), lambda a, b: a + b)
        return F.aggregate(known(hashes(words)), bias, add)

    def best(z: Column) -> Column:
        top = F.array_max(z)
        total = F.aggregate(z, F.lit(0.0), lambda acc, v: acc + F.exp((v - top) / model.temperature))
        return F.struct(F.element_at(F.array(*map(F.lit, model.families)), F.array_position(z, top).cast("int")).alias("family"), (F.lit(1.0) / total).alias("score"))

    def confirm(words: Column, found: Column) -> Column:
        own = F.array_distinct(words)
        shared = lambda t: F.size(F.array_intersect(own, t))
        near = lambda t: (shared(t) >= F.least(F.lit(3), F.size(t))) & (shared(t) / F.greatest(F.least(F.size(own), F.size(t)), F.lit(1)) >= CONFIRM_SHARE)
        cases = F.lit(False)
        for family, notices in templates.items():
            cases = cases | ((found["family"] == family) & F.exists(notices, near))
        return F.struct(found["family"].alias("family"), found["score"].alias("score"), cases.alias("confirmed"))

    # each step's value is an element of a one-element array, so it is computed once
    with_words = F.transform(F.array(tokens(paragraph)), lambda w: F.struct(w.alias("words"), F.transform(F.array(summed(w)), best)[0].alias("found")))
    return F.transform(with_words, lambda x: confirm(x["words"], x["found"]))[0]


def paragraphs(text: Column) -> Column:
    """array of struct(place, paragraph): lines, those of a wrapped paragraph as one. A line
    is wrapped if it is long, doesn't end a sentence and isn't followed by a blank one.
    ``place`` is the number of the first line, from 0."""
    joined = F.regexp_replace(F.translate(text, WRAP, " "), WRAPPED, WRAP)

    def of(units: Column) -> Column:
        marks = lambda i: F.length(F.regexp_replace(F.array_join(F.slice(units, 1, i), ""), f"[^{WRAP}]", ""))
        some = F.exists(units, lambda u: u.contains(WRAP))
        return F.transform(F.array(some), lambda w: F.transform(units, lambda p, i: F.struct(F.when(w, i + marks(i)).otherwise(i).cast("int").alias("place"), F.translate(p, WRAP, " ").alias("paragraph"))))[0]

    # the lines are an element of a one-element array, so they are cut once
    rows = F.transform(F.array(F.split(joined, r"\r?\n")), of)[0]
    return F.filter(rows, lambda x: x["paragraph"] != "")


def scan(docs: DataFrame, model: Classifier | None = None, text: str = "text", into: str = "licences") -> DataFrame:
    """``docs`` with an array of the licence paragraphs: place (number of the first line,
    from 0), family, score, confirmed, in text order.

    Every paragraph of every text is classified (:func:`paragraphs`). Null and empty texts
    have none; every row is kept, repeated ones too; a column of that name is replaced.
    """
    model = model or train()
    bound, leads = word_bounds(model)
    words, n = sorted(bound), len(leads)
    known, gains = F.split(F.lit(",".join(words)), ","), _literal([v for w in words for v in bound[w]], "double")
    t = F.coalesce(F.col(text), F.lit(""))
    split = lambda c: F.split(F.lower(c), "[^a-z0-9]+")

    def in_doubt(own: Column) -> Column:
        """Can a paragraph with these words be other than unknown?"""
        gain = lambda w: F.slice(gains, F.array_position(known, w).cast("int") * n - n + 1, n)
        sums = F.aggregate(own, F.array_repeat(F.lit(0.0), n), lambda s, w: F.zip_with(s, gain(w), lambda a, b: a + b))
        return (F.size(own) > 0) & F.exists(F.zip_with(sums, _literal(leads, "double"), lambda s, l: s >= l), lambda x: x)

    def judged(x: Column) -> Column:
        return F.struct(x["place"].alias("place"), classify(x["paragraph"], model).alias("c"))

    def of(own: Column) -> Column:
        """All paragraphs of a text with these words that are in doubt."""
        left = F.filter(paragraphs(t), lambda x: in_doubt(F.array_intersect(split(x["paragraph"]), own)))
        return F.when(in_doubt(own), F.transform(left, judged))

    # a text's words are an element of a one-element array, so they are made once
    found = F.transform(F.array(F.array_intersect(split(t), known)), of)[0]
    kept = F.filter(found, lambda x: (x["c"]["family"] != UNKNOWN) & (x["c"]["score"] >= MIN_CONFIDENCE))
    flat = F.transform(kept, lambda x: F.struct(x["place"].alias("place"), x["c"]["family"].alias("family"), x["c"]["score"].alias("score"), x["c"]["confirmed"].alias("confirmed")))
    empty = F.expr("cast(array() as array<struct<place:int,family:string,score:double,confirmed:boolean>>)")
    return docs.withColumn(into, F.coalesce(flat, empty))


def op4_licenses(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_licences, the confirmed families (sorted, comma-joined),
    the best family (highest score, ties by text order; null if none) and its score."""
    found = scan(common.documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")).drop("text")
    sure = F.filter("licences", lambda x: x["confirmed"])
    best = F.element_at(F.filter("licences", lambda x: x["score"] == F.array_max(F.transform("licences", lambda y: y["score"]))), 1)
    return found.select(
        "doc_id",
        F.size("licences").cast("long").alias("n_licences"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("confirmed"),
        F.when(F.size("licences") > 0, best["family"]).alias("family"),
        F.when(F.size("licences") > 0, best["score"]).alias("score"),
    )
