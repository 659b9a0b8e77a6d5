"""License scans: parts of a text against licence templates by Dice's coefficient.

A text is cut into units at line ends, after sentences and at commas, brackets and dashes; any run of units is a part.
Parts and templates are lower-cased words, and their similarity is Dice's coefficient
over the multisets of word bigrams. A Dice of t bounds the part's size by the template's
(t / (2 - t) to (2 - t) / t times it) and needs that many common bigrams, so running
counts of a template's bigrams leave only few parts to compare exactly, and most
templates none. For every template that some part reaches, the best part is returned:
the highest Dice, then the earliest and shortest.

Defined cases: a null text is an empty one; texts and templates of one word have no
bigrams and match nothing; texts of any length are compared whole; rows with equal ids
are scanned each by itself; an empty table gives an empty result; other columns of the
input are never looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from .common import map_arrow
from .licence_texts import TEXTS

THRESHOLD = 0.8
KEEP_WORDS = 1_000_000
WORD = re.compile(r"\w+")
#: Ends of units: line ends, blanks after a sentence, comma or closing bracket, blanks before an
#: opening bracket, dashes between blanks.
UNIT_END = re.compile(r"\n|\s[-\u2013\u2014]+\s|\u2014|(?<=[.!?:;,)\]}])\s|\s(?=[(\[{])")

#: Public licence notices and short statements of a licence.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."""),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"""),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("LicenseRef-proprietary", "All rights reserved."),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-2-Clause", """Licensed under the BSD 2-Clause License."""),
    ("BSD-3-Clause", """Licensed under the BSD 3-Clause License."""),
    ("GPL-2.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."""),
    ("LGPL-2.1", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."""),
    ("LGPL-3.0", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library; if not, see https://www.gnu.org/licenses/."""),
    ("AGPL-3.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program; if not, see https://www.gnu.org/licenses/."""),
    ("LGPL-2.1", """Licensed under the GNU Lesser General Public License, version 2.1."""),
    ("LGPL-3.0", """Licensed under the GNU Lesser General Public License, version 3."""),
    ("AGPL-3.0", """Licensed under the GNU Affero General Public License, version 3."""),
    ("BSL-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("BSL-1.0", """Distributed under the Boost Software License, Version 1.0."""),
    ("EPL-1.0", """All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"""),
    ("EPL-2.0", """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"""),
    ("ISC", """Licensed under the ISC License."""),
    ("MPL-2.0", """Licensed under the Mozilla Public License, version 2.0."""),
    *TEXTS,
]

FOUND = "array<struct<template:int,license:string,dice:double,start:int,end:int>>"


class Numbers(dict):
    """Word to a number; words of no template share one."""

    def __missing__(self, word: str) -> int:
        return 0


class Matcher:
    """Templates as numbered bigrams."""

    def __init__(self, templates: list[tuple[str, str]], threshold: float):
        self.threshold = threshold
        texts = [WORD.findall(t.lower()) for _, t in templates]
        self.numbers = Numbers({w: i + 1 for i, w in enumerate(sorted({w for t in texts for w in t}))})
        self.base = len(self.numbers) + 1
        self.names = [n for n, _ in templates]
        self.grams = [Counter(self.numbers[a] * self.base + self.numbers[b] for a, b in zip(t, t[1:], strict=False)) for t in texts]
        self.sizes = [sum(g.values()) for g in self.grams]
        self.known = np.unique([g for c in self.grams for g in c])
        self.member = np.array([[g in c for g in self.known.tolist()] for c in self.grams])

    def find(self, text: str) -> list[tuple[int, str, float, int, int]]:
        """Template number, licence, Dice and character span of the best part per template."""
        units, at = [], 0
        for end in UNIT_END.finditer(text):
            units.append((at, end.start()))
            at = end.end()
        units.append((at, len(text)))
        words, first = [], [0]
        for start, end in units:
            words += WORD.findall(text[start:end].lower())
            first.append(len(words))
        codes = np.array([self.numbers[w] for w in words], dtype=np.int64)
        grams = codes[:-1] * self.base + codes[1:]
        place = np.minimum(np.searchsorted(self.known, grams), len(self.known) - 1)
        hit = np.flatnonzero(self.known[place] == grams)
        if not len(hit):
            return []
        found, edges = [], np.array(first)
        per_template = self.member[:, place[hit]]
        need = [self.threshold / (2 - self.threshold) * s for s in self.sizes]
        for t in np.flatnonzero(per_template.sum(1) >= np.maximum(np.ceil(np.array(need) - 1e-9), 1)):
            own = np.zeros(len(grams) + 1, dtype=np.int64)
            own[hit[per_template[t]] + 1] = 1
            best = self._best(t, grams, np.cumsum(own), edges)
            if best:
                found.append((int(t), self.names[t], best[0], units[best[1]][0], units[best[2]][1]))
        return found

    def _best(self, t: int, grams: np.ndarray, hits: np.ndarray, edges: np.ndarray) -> tuple[float, int, int] | None:
        """Dice, first and last unit of the best run of units."""
        size, least, best = self.sizes[t], self.threshold, None
        low, high = least / (2 - least) * size, (2 - least) / least * size
        starts = edges[:-1]
        # units that hold words and have a hit no farther than the largest part
        upto = np.minimum(starts + int(high) + 1, len(hits) - 1)
        near = hits[upto] - hits[np.minimum(starts, len(hits) - 1)] >= max(low - 1e-9, 1)
        for i in np.flatnonzero(near & (np.diff(edges) > 0)):
            a = int(starts[i])
            j = int(np.searchsorted(edges[1:], a + low + 1 - 1e-9))
            while j < len(starts) and edges[j + 1] - 1 - a <= high + 1e-9:
                b = int(edges[j + 1]) - 1
                n = b - a
                # no part whose bound is below the best so far can be better
                if edges[j + 1] > edges[j] and 2 * (hits[b] - hits[a]) >= max(least, best[0] if best else 0) * (n + size) - 1e-9:
                    common = sum((Counter(grams[a:b].tolist()) & self.grams[t]).values())
                    dice = 2 * common / (n + size)
                    if dice >= max(least, best[0] if best else 0) and (best is None or dice > best[0]):
                        best = (dice, int(i), j)
                j += 1
        return best


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Every row as the struct `row` with `found`: template number, licence, Dice and the
    part's span in characters, for each template that a part of the text reaches."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates, threshold)
        kind = pa.list_(pa.struct([("template", pa.int32()), ("license", pa.string()), ("dice", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))
        keys = ("template", "license", "dice", "start", "end")
        for batch in batches:
            found = [[dict(zip(keys, f, strict=True)) for f in matcher.find(t or "")] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["row", "found"])

    keep = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"))
    return map_arrow(keep, work, StructType([keep.schema["row"], StructField("found", DataType.fromDDL(FOUND))]))
