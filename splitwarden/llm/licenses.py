"""License scans: MinHash bands retrieve templates for overlapping text windows, exact containment verifies them.

A template of n word shingles is looked up in windows of a length L >= n from a fixed grid, which overlap so that any stretch of L
shingles lies in a window of about 1.25 L. A window that holds a share c of the template and nothing else of it has a Jaccard
similarity of at least c n / (1.25 L + (1 - c) n): 0.4 for c = 0.8 and the coarsest step of the grid, 0.45 to 0.55 for templates of
over 8 shingles. With 24 bands of 2 minima it is retrieved with a probability of 1 - (1 - 0.4**2)**24 = 0.985, 0.996 to 0.9998 for
these, and every exact copy (0.5 or more) with 0.999. Only what the bands retrieve is verified.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import body, slices

#: Public license texts, and the notices that stand for longer ones.
_MIT_GRANT = """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software"""
_MIT_WARRANTY = """
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_WARRANTY = """
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY
DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_GRANT = """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are
met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution."""
_BSD_NAMES = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this
software without specific prior written permission."""
_BSD_WARRANTY = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GPL_HEADER = """
This {work} is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free
Software Foundation{comma} either version {version} of the License, or (at your option) any later version. This {work} is distributed in the
hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
PURPOSE. See the GNU {name} for more details."""
TEMPLATES = {
    "MIT": f"""
        {_MIT_GRANT}, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright
        notice and this permission notice shall be included in all copies or substantial portions of the Software. {_MIT_WARRANTY}""",
    "MIT-grant": _MIT_GRANT,
    "MIT-0": f"{_MIT_GRANT}, and to permit persons to whom the Software is furnished to do so. {_MIT_WARRANTY}",
    "MIT-line": "Released under the MIT License.",
    "ISC": f"""
        Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
        above copyright notice and this permission notice appear in all copies. {_ISC_WARRANTY}""",
    "ISC-grant": """
        Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
        above copyright notice and this permission notice appear in all copies.""",
    "0BSD": f"""
        Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. {_ISC_WARRANTY}""",
    "BSD-2-Clause": f"{_BSD_GRANT} {_BSD_WARRANTY}",
    "BSD-3-Clause": f"{_BSD_GRANT} {_BSD_NAMES} {_BSD_WARRANTY}",
    "BSD": """
        Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are
        met:""",
    "Zlib": """
        This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
        arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
        applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be
        misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the
        product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be
        misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    "BSL-1.0": """
        Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation
        covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare
        derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The
        copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following
        disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such
        copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.""",
    "Unlicense": """
        This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
        distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any
        means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the
        software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and
        successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software
        under copyright law.""",
    "Unlicense-grant": """
        This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
        distribute this software""",
    "WTFPL": """
        Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the
        name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO
        WHAT THE FUCK YOU WANT TO.""",
    "Apache-2.0": """
        Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
        obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or
        implied. See the License for the specific language governing permissions and limitations under the License.""",
    "Apache-2.0-grant": """
        Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
        obtain a copy of the License at""",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "GPL-2.0": _GPL_HEADER.format(work="program", colon=";", comma=";", version="2", name="General Public License"),
    "GPL-3.0": _GPL_HEADER.format(work="program", colon=":", comma=",", version="3", name="General Public License"),
    "GPL-3.0-grant": """
        This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-2.1": _GPL_HEADER.format(work="library", colon=";", comma=";", version="2.1", name="Lesser General Public License"),
    "LGPL-3.0": _GPL_HEADER.format(work="program", colon=":", comma=",", version="3", name="Lesser General Public License"),
    "AGPL-3.0": _GPL_HEADER.format(work="program", colon=":", comma=",", version="3", name="Affero General Public License"),
    "MPL-2.0": """
        This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
        file, You can obtain one at""",
    "EPL-2.0": """
        This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at""",
    "CC0-1.0": """
        The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work
        worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law. You can copy, modify, distribute
        and perform the work, even for commercial purposes, all without asking permission.""",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
}
TOKEN = re.compile(r"[^\W_]+")
NEVER = np.uint32(0xFFFFFFFF)  # the value of a place that holds no shingle
_words: dict = {}


def word_hashes(words: list[str]) -> np.ndarray:
    found = list(map(_words.get, words))
    if None in found:
        if len(_words) > 200_000:
            _words.clear()
        found = [_words.setdefault(w, xxhash.xxh64_intdigest(w)) if f is None else f for w, f in zip(words, found)]
    return np.array(found, np.uint64)


def shingles_of(words: list[str], k: int) -> np.ndarray:
    """The hash of every k consecutive words, never 0."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    w = word_hashes(words)
    x = np.zeros(len(w) - k + 1, np.uint64)
    for j in range(k):
        x = x * np.uint64(0x9E3779B97F4A7C15) + w[j : len(w) - k + 1 + j]
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return (x ^ (x >> np.uint64(33))) | np.uint64(1)


def window_grid(n: int) -> tuple[int, int, int]:
    """(length, stride, blocks) of the windows for a template of n shingles; a window is ``blocks`` x ``stride`` shingles."""
    length = next((x for x in (1, 2, 4, 8) if x >= n), 0)
    if not length:
        length = 10
        while length < n:
            length = -(-length * 5 // 4)
    stride = max(1, length // 8)
    return length, stride, -(-length // stride) + 1


@dataclass
class TemplateIndex:
    """Distinct shingles and MinHash minima of the templates, grouped by their windows."""

    templates: dict
    words_per_shingle: int = 5
    bands: int = 24
    rows: int = 2
    seed: int = 9
    shingles: dict = field(default_factory=dict)
    grids: dict = field(default_factory=dict)
    minima: dict = field(default_factory=dict)

    def __post_init__(self):
        k = self.words_per_shingle
        self.keys = np.random.default_rng(self.seed).integers(0, 1 << 32, (2, self.bands * self.rows), np.uint32) | np.uint32(1)
        for name, text in self.templates.items():
            found = shingles_of(TOKEN.findall(text.lower()), k)
            if not len(found):
                raise ValueError(f"template of fewer than {k} words: {name}")
            self.shingles[name] = np.unique(found)
            self.grids.setdefault(window_grid(len(found)), []).append(name)
            self.minima[name] = self.hashes(self.shingles[name]).min(0).reshape(self.rows, self.bands)
        self.reach = max(stride * (blocks + 2) for _, stride, blocks in self.grids)

    def hashes(self, shingles: np.ndarray) -> np.ndarray:
        """One column of values for each of rows x bands hash functions; places without a shingle have the largest value."""
        out = ((shingles >> np.uint64(32)).astype(np.uint32)[:, None] ^ self.keys[0]) * self.keys[1]
        out[shingles == 0] = NEVER
        return out

    def retrieved(self, shingles: np.ndarray):
        """(template, start, end) of windows that share a band with a template."""
        values, ladders = self.hashes(shingles), {}
        for (_, stride, blocks), names in self.grids.items():
            if stride not in ladders:  # minima of 1, 2, 4, ... blocks
                ladders[stride] = [_padded(values, -(-len(values) // stride) * stride).reshape(-1, stride, values.shape[1]).min(1) if stride > 1 else values]
            ladder, top = ladders[stride], blocks.bit_length() - 1
            while len(ladder) <= top:
                step = 1 << len(ladder) - 1
                last = _padded(ladder[-1], step + 1)
                ladder.append(np.minimum(last[:-step], last[step:]))
            step = blocks - (1 << top)
            low = _padded(ladder[top], step + 1)
            low = np.minimum(low[: len(low) - step], low[step:]) if step else low
            low = low.reshape(len(low), self.rows, self.bands)
            for name in names:
                own = self.minima[name]
                met = low[:, 0] == own[0]
                if not met.any():
                    continue
                for row in range(1, self.rows):
                    met &= low[:, row] == own[row]
                for at in np.flatnonzero(met.any(1)).tolist():
                    yield name, (at - 1) * stride, (at + blocks + 1) * stride


def _padded(values: np.ndarray, length: int) -> np.ndarray:
    """``values`` with places without a shingle up to ``length``."""
    lack = length - len(values)
    return values if lack <= 0 else np.concatenate([values, np.full((lack, values.shape[1]), NEVER)])


def matches(index: TemplateIndex, name: str, shingles: np.ndarray, start: int, end: int, containment: float) -> tuple[int, int, int] | None:
    """(held, first, last): how many of a template's distinct shingles stand in a stretch, if they are enough, and where."""
    own = index.shingles[name]
    here = shingles[max(0, start) : end]
    hits = np.flatnonzero(np.isin(here, own))
    held = len(np.unique(here[hits]))
    return (held, max(0, start) + int(hits[0]), max(0, start) + int(hits[-1])) if held and held >= containment * len(own) else None


def _settled(found: list[tuple[str, int, int, int]]) -> list[tuple[str, int, int]]:
    """Stretches (template, held, first, last) of one template merged where they overlap. Where stretches of two templates overlap by over
    half of the shorter one, the one that holds fewer shingles of its template goes."""
    merged: list = []
    for name, held, a, b in sorted(found, key=lambda m: (m[0], m[2], m[3])):
        if merged and merged[-1][0] == name and a <= merged[-1][3]:
            merged[-1][1], merged[-1][3] = max(merged[-1][1], held), max(merged[-1][3], b)
        else:
            merged.append([name, held, a, b])
    kept: list = []
    for name, _, a, b in sorted(merged, key=lambda m: (-m[1], m[0], m[2])):
        if all(2 * (min(b, y) - max(a, x) + 1) <= min(b - a, y - x) + 1 for _, x, y in kept):
            kept.append((name, a, b))
    return sorted(kept, key=lambda m: (m[1], m[0]))


def scan(index: TemplateIndex, texts: list[str], containment: float = 0.8, at_once: int = 1 << 13) -> list[list[tuple[str, int, int]]]:
    """For each text, (template, start, end) in code points: where at least ``containment`` of a template's shingles stand close together."""
    k = index.words_per_shingle
    lowered = [t.lower() for t in texts]
    shingles = [shingles_of(TOKEN.findall(t), k) for t in lowered]
    found: dict = {}
    held, size = [], 0

    def look():
        buffer = np.concatenate([p for _, _, p in held for p in (p, np.zeros(1, np.uint64))])
        starts = np.cumsum([0] + [len(p) + 1 for _, _, p in held])
        for name, s, e in set(index.retrieved(buffer)):
            for j in range(max(0, int(np.searchsorted(starts, s, "right")) - 1), len(held)):  # the pieces that the window touches
                doc, offset, _ = held[j]
                if starts[j] >= e:
                    break
                hit = matches(index, name, shingles[doc], s - int(starts[j]) + offset, e - int(starts[j]) + offset, containment)
                if hit:
                    found.setdefault(doc, set()).add((name, *hit))

    for doc, own in enumerate(shingles):
        for at in range(0, len(own), at_once):  # long texts in parts that overlap by a window
            held.append((doc, at, own[at : at + at_once + index.reach]))
            size += len(held[-1][2])
            if size >= at_once:
                look()
                held, size = [], 0
    if held:
        look()
    out: list = [[] for _ in texts]
    for doc, hits in found.items():
        text = lowered[doc] if len(lowered[doc]) == len(texts[doc]) else texts[doc]
        marks = [m.span() for m in TOKEN.finditer(text)]
        if len(marks) == len(shingles[doc]) + k - 1:  # lower case can, rarely, change the words; their places are then unknown
            out[doc] = [(name, marks[a][0], marks[b + k - 1][1]) for name, a, b in _settled(list(hits))]
        else:
            out[doc] = [(name, 0, len(texts[doc])) for name, _, _ in _settled(list(hits))]
    return out


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict | None = None, containment: float = 0.8) -> DataFrame:
    """(doc_id, n_matches, licenses, spans) of every row: template names and name:start:end in code points, comma-joined.

    Null texts count as empty and match nothing, like texts under five words. Where templates overlap (a short notice inside a
    longer one, versions of one license), the one stays of which the text holds more shingles. Repeated rows give equal results; an
    empty table gives an empty result; other columns are not read. Templates travel with the tasks: they are a fixed list, not data.
    """
    index = TemplateIndex(templates or TEMPLATES)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        for batch in slices(batches):
            found = scan(shared.value, batch.column(1).to_pylist(), containment)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([len(f) for f in found], pa.int64()),
                    pa.array([",".join(sorted({n for n, _, _ in f})) for f in found], pa.string()),
                    pa.array([",".join(f"{n}:{s}:{e}" for n, s, e in f) for f in found], pa.string())
                ],
                names=["doc_id", "n_matches", "licenses", "spans"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), body(F.col(text_col)).alias("t"))
    return rows.mapInArrow(run, "doc_id long, n_matches long, licenses string, spans string")
