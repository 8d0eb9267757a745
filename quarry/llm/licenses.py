"""License scans by patience alignment of whole texts with templates.

Words that stand once in the text and once in a template are anchors; the longest run of anchors in the same order in both
is kept, and the gaps between them are aligned the same way, until a gap has no anchor. A template's coverage is the part of
its words that are matched, however far apart they stand. Where a text holds a template more than once, its words are no
anchors; so the text is also parted at each word that the template has once and the text several times, and each stretch
that has one of these is aligned as a whole. Few words say something only together: of a short template those matches count
that make up most of the stretch they span.

A template is aligned with a text that holds enough of its words to reach the coverage asked for, and with no other.
"""

from __future__ import annotations

import bisect
import functools
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Coverage from which a license is reported.
COVERAGE = 0.8
#: Templates of fewer words are short; the part of their stretch that the matches of a short one are, at least.
SHORT, DENSE = 20, 0.6

# Public license texts and notices; headers where the whole text is thousands of words. They are fixed values.
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_WARRANTY = (
    ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, '
    "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH "
    "THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE '
    "ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY "
    "OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)


def _gnu(thing: str, name: str, version: str, short: str) -> str:
    """The header that the GNU licenses ask for."""
    return (
        f"{thing} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. "
        f"{thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details. "
        f"You should have received a copy of the {name} along with {short}. If not, see https://www.gnu.org/licenses/."
    )


TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT-licensed": "Licensed under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0-notice": "Released under CC0 1.0 Universal.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "MIT": _MIT,
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies." + _ISC_WARRANTY,
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted." + _ISC_WARRANTY,
    "BSD-2-Clause": _BSD + _BSD_WARRANTY,
    "BSD-3-Clause": _BSD + _BSD_THIRD + _BSD_WARRANTY,
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this "
        "dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software "
        'under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
        "IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software "
        "for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the "
        "original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be "
        "misrepresented as being the original software. This notice may not be removed or altered from any source distribution."
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, "
        "and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire "
        "statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or "
        "derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
        "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by '
        'applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language '
        "governing permissions and limitations under the License."
    ),
    "GPL-2.0-or-later": _gnu("This program", "GNU General Public License", "2", "this program"),
    "GPL-3.0-or-later": _gnu("This program", "GNU General Public License", "3", "this program"),
    "LGPL-2.1-or-later": _gnu("This library", "GNU Lesser General Public License", "2.1", "this library"),
    "LGPL-3.0-or-later": _gnu("This library", "GNU Lesser General Public License", "3", "this library"),
    "AGPL-3.0-or-later": _gnu("This program", "GNU Affero General Public License", "3", "this program"),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
}

_WORD = re.compile(r"[a-z0-9]+(?:[.+-][a-z0-9]+)*")
def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def longest_increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest part of pairs, which rise in their first numbers, that rises in the second too (patience sorting)."""
    tops: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        k = bisect.bisect_left(tops, b)
        tops[k : k + 1], ends[k : k + 1] = [b], [i]
        back[i] = ends[k - 1] if k else -1
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Matched places (in text, in template), rising in both."""
    out, todo = [], [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        in_text, in_template = Counter(text[a:b]), Counter(template[c:d])
        once = {w: j for j, w in enumerate(template[c:d], c) if in_template[w] == 1 and in_text[w] == 1}
        anchors = longest_increasing([(i, once[w]) for i, w in enumerate(text[a:b], a) if w in once])
        out += anchors
        edges = [(a - 1, c - 1), *anchors, (b, d)]
        todo += [(i + 1, j, k + 1, m) for (i, k), (j, m) in zip(edges, edges[1:], strict=False)] if anchors else []
    return sorted(out)


@functools.lru_cache(1)
def templates() -> dict[str, list[str]]:
    return {name: words(text) for name, text in TEMPLATES.items()}


@functools.lru_cache(4)
def telling(least: float) -> dict[str, set[str]]:
    """By word, the templates that a text may hold if it has the word.

    A template that reaches `least` misses no more than the rest of its words; of one word more than that, the longest ones
    are taken, the text has one."""
    out: dict[str, set[str]] = {}
    for name, template in templates().items():
        spare = len(template) - math.ceil(least * len(template) - 1e-9)
        for w in sorted(template, key=lambda w: (w.isalpha(), -len(w)))[: spare + 1]:
            out.setdefault(w, set()).add(name)
    return out


@functools.lru_cache(1)
def counts() -> dict[str, Counter]:
    return {name: Counter(t) for name, t in templates().items()}


def dense(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The most pairs that follow each other and make up DENSE of the stretch of text that they span."""
    spans = ((b - a, a, b) for a in range(len(pairs)) for b in range(a + 1, len(pairs) + 1) if b - a >= DENSE * (pairs[b - 1][0] - pairs[a][0] + 1))
    _, a, b = max(spans, key=lambda x: (x[0], -x[1]), default=(0, 0, 0))
    return pairs[a:b]


def matched(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """The most matches of a template with the text, or with a stretch of it that holds one of the words it has several of."""
    keep = dense if len(template) < SHORT else list
    best = keep(align(text, template))
    in_template, places = Counter(template), {}
    for i, w in enumerate(text):
        if in_template.get(w) == 1:
            places.setdefault(w, []).append(i)
    parted = set()
    for at in sorted((tuple(x) for x in places.values() if len(x) > 1), key=lambda x: (len(x), x)):
        edges = (-1, *at, len(text))
        for before, after in zip(edges, edges[2:], strict=False):
            if len(best) == len(template):
                return best
            if (before, after) not in parted:
                parted.add((before, after))
                found = keep([(i + before + 1, j) for i, j in align(text[before + 1 : after], template)])
                best = max(best, found, key=len)
    return best


def scan(text: str, least: float = COVERAGE) -> dict[str, list[int]]:
    """The templates that the text covers by `least` or more, with the places of the words that match."""
    found, index, out = words(text), telling(least), {}
    held = set(found)
    may = {name for w in held & index.keys() for name in index[w]}
    if not may:
        return out
    number = Counter(found)
    for name in sorted(may):
        need = math.ceil(least * len(templates()[name]) - 1e-9)
        if sum(min(n, number[w]) for w, n in counts()[name].items() if w in held) >= need:
            pairs = matched(found, templates()[name])
            if len(pairs) >= need:
                out[name] = [i for i, _ in pairs]
    return out


def ranked(found: dict[str, list[int]]) -> list[tuple[str, float]]:
    """(template, coverage), the highest coverage first, then the most words, then the shortest stretch, then by name;
    without those of whose matches most belong to one before them."""
    out, taken = [], set()
    for name in sorted(found, key=lambda n: (-len(found[n]) / len(templates()[n]), -len(templates()[n]), found[n][-1] - found[n][0], n)):
        if 2 * sum(i in taken for i in found[name]) <= len(found[name]):
            out.append((name, len(found[name]) / len(templates()[name])))
            taken |= set(found[name])
    return out


def scan_documents(docs: DataFrame, least: float = COVERAGE) -> DataFrame:
    """A row for each row of docs(doc_id, text, ...): doc_id, license (of most coverage, then of most words, then in the
    shortest stretch, then by name; null if none has `least`), coverage (its coverage, 0 if none), licenses (all of them, sorted; of templates that share
    most of their matched words the first by that order).

    A null or empty text has none; repeated rows and null ids are rows like any other; an empty table gives none; other
    columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [ranked(scan(x.as_py(), least)) if x.is_valid else [] for x in batch.column(1)]
            first = [x[0] if x else (None, 0.0) for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in first], pa.string()), pa.array([c for _, c in first], pa.float64()), pa.array([sorted(n for n, _ in x) for x in found], pa.list_(pa.string()))], ["doc_id", "license", "coverage", "licenses"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, license string, coverage double, licenses array<string>")
