"""License scans: winnowed fingerprints of templates pick candidates, banded alignment measures them."""

from __future__ import annotations

import re
import sys
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import pieces

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Notices as their licenses ask for them, whole texts of the short ones.
BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission. "
)
BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
    "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "mit-line": "Released under the MIT License.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either '
        "express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "mit": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "gpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope "
        "that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU General Public License for more details."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies."
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "gpl-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope "
        "that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; "
        "if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."
    ),
    "lgpl-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope "
        "that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU Lesser General Public License for more details."
    ),
    "lgpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope "
        "that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU Lesser General Public License for more details."
    ),
    "agpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope "
        "that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU Affero General Public License for more details."
    ),
    "bsd-2-clause": BSD_HEAD + BSD_TAIL,
    "bsd-3-clause": BSD_HEAD + BSD_THIRD + BSD_TAIL,
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software "
        "to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend "
        "this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
        "from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
        "alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must "
        "not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
        "appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original "
        "software. 3. This notice may not be removed or altered from any source distribution."
    ),
    "bsl-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation "
        'covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative '
        "works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"
    ),
    "cc-by-4.0": (
        "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit "
        "http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."
    ),
    "cc-by-sa-4.0": (
        "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit "
        "http://creativecommons.org/licenses/by-sa/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."
    ),
    "cc-by-nc-4.0": (
        "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit "
        "http://creativecommons.org/licenses/by-nc/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."
    ),
    "cc0-1.0": (
        "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work."
    ),
    "epl-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
        "https://www.eclipse.org/legal/epl-2.0/"
    ),
}

GRAM = 3
#: The least hash of so many runs is a fingerprint; GRAM + WINNOW - 1 words in common always share one.
WINNOW = 2
MIN_COVERAGE = 0.7
#: Bytes of templates that one scan carries; more are scanned in blocks.
BLOCK_BYTES = 8 << 20
#: Bytes of a table of templates that :func:`template_table` takes at most.
TABLE_BYTES = 64 << 20
PIECE = 4 << 20
STATE = "array<struct<license: string, coverage: double, start: int, stop: int>>"
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
NONE = np.uint64((1 << 64) - 1)


def band_of(size: int) -> int:
    """Words that an alignment may be shifted by on the way."""
    return max(2, size // 8)


def _gram_hashes(ids: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all runs of words; runs with a word of no template (0) get the greatest value."""
    h, known = np.zeros(len(ids) - gram + 1, dtype=np.uint64), np.ones(len(ids) - gram + 1, dtype=bool)
    for k in range(gram):
        part = ids[k : len(ids) - gram + 1 + k]
        h = (h ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
        known &= part > 0
    return np.where(known, h >> np.uint64(1), NONE)


def winnow(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the fingerprints: the least hash in every window of WINNOW runs."""
    if len(ids) < GRAM:
        return np.array([], dtype=np.int64), np.array([], dtype=np.uint64)
    h = _gram_hashes(ids, GRAM)
    low = h if len(h) < WINNOW else np.min([h[k : len(h) - WINNOW + 1 + k] for k in range(WINNOW)], axis=0)
    chosen = np.zeros(len(h), dtype=bool)
    for k in range(WINNOW):
        part = h[k : len(h) - WINNOW + 1 + k] if len(h) >= WINNOW else h
        chosen[k : k + len(part)] |= part == low[: len(part)]
        if len(h) < WINNOW:
            break
    at = np.flatnonzero(chosen & (h != NONE))
    return at, h[at]


class Index:
    """Inverted index: fingerprint -> (template, position)."""

    def __init__(self, templates: list[tuple[str, bytes]]):
        self.words: dict[bytes, int] = {}
        self.names, self.ids = [], []
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for name, text in templates:
            ids = np.array([self.words.setdefault(w, len(self.words) + 1) for w in text.translate(NORMAL).split()], dtype=np.int64)
            for at, h in zip(*winnow(ids), strict=True):
                self.places[int(h)].append((len(self.names), int(at)))
            self.names.append(name)
            self.ids.append(ids)
        self.known = np.array(sorted(self.places), dtype=np.uint64)

    def hits(self, ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(position, template, position in the template) of every fingerprint in common."""
        at, h = winnow(ids)
        if not len(at) or not len(self.known):
            return
        found = self.known[np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)] == h
        for p, x in zip(at[found].tolist(), h[found].tolist(), strict=True):
            for template, place in self.places[x]:
                yield p, template, place


def align(template: np.ndarray, words: np.ndarray, diagonal: int, band: int) -> tuple[int, int, int]:
    """(matched words, first word, end) of the best local alignment within the band of diagonals.

    A match counts 1, a mismatch or a gap costs 1. Position j of row i is the word i + diagonal - band + j.
    """
    width, m = 2 * band + 1, len(template)
    score = np.zeros((m + 1, width + 2), dtype=np.int64)
    steps = np.arange(width)
    for i in range(m):
        at = i + diagonal - band + steps
        inside = (at >= 0) & (at < len(words))
        equal = np.zeros(width, dtype=bool)
        equal[inside] = words[at[inside]] == template[i]
        best = np.maximum(score[i, 1:-1] + np.where(equal, 1, -1), score[i, 2:] - 1)
        best = np.where(inside, np.maximum(best, 0), 0)
        best = np.maximum.accumulate(best + steps) - steps  # gaps in the template
        score[i + 1, 1:-1] = np.where(inside, best, 0)
    i, j = np.unravel_index(int(score[:, 1:-1].argmax()), (m + 1, width))
    matched, first, stop = 0, 0, i - 1 + diagonal - band + j + 1
    while i > 0 and score[i, j + 1] > 0:
        at = i - 1 + diagonal - band + j
        equal = words[at] == template[i - 1]
        if score[i, j + 1] == score[i - 1, j + 1] + (1 if equal else -1):
            if equal:
                matched, first = matched + 1, at
            i -= 1
        elif score[i, j + 1] == score[i - 1, j + 2] - 1:
            i, j = i - 1, j + 1
        else:
            j -= 1
    return matched, int(first), int(stop)


def matches(index: Index, ids: np.ndarray, hits: list[tuple[int, int, int]], least: float) -> list[tuple[str, float, int, int]]:
    """(license, coverage, first word, end) of the aligned candidates of a document."""
    diagonals: dict[int, set[int]] = defaultdict(set)
    for p, template, place in hits:
        diagonals[template].add(p - place)
    out = []
    for template, found in diagonals.items():
        size = len(index.ids[template])
        band, aligned, last = band_of(size), set(), None
        for d in sorted(found):
            # Diagonals within a band are one candidate; its band reaches over all of them.
            if last is None or d - last > band:
                aligned.add(align(index.ids[template], ids, d, 2 * band))
                last = d
        kept: list[tuple[int, int, int]] = []
        for matched, first, stop in sorted(aligned, key=lambda x: (-x[0], x[1])):
            if matched >= least * size and all(stop <= a or first >= b for _, a, b in kept):
                kept.append((matched, first, stop))
        out += [(index.names[template], matched / size, first, stop) for matched, first, stop in kept]
    return sorted(out, key=lambda x: (x[2], x[0]))


def best_of(found: list[dict], sizes: dict[str, int]) -> list[dict]:
    """Of findings that overlap, the one that explains most; the input's order stays.

    A finding weighs its matched words less the template's words that are missing; ties go to the greater coverage, the
    earlier start, then the name. One that shares more than half of the shorter span with a
    better one goes.
    """
    # Coverage is matched / size, so the product is whole but for its last bits.
    weight = lambda x: (round(2 * x["coverage"] * sizes[x["license"]]) - sizes[x["license"]], x["coverage"])
    kept: list[dict] = []
    for x in sorted(found, key=lambda x: (*(-w for w in weight(x)), x["start"], x["license"])):
        shared = ((min(x["stop"], y["stop"]) - max(x["start"], y["start"]), min(x["stop"] - x["start"], y["stop"] - y["start"])) for y in kept)
        if all(2 * common <= shorter for common, shorter in shared):
            kept.append(x)
    return [x for x in found if x in kept]


def _scan(templates: list[tuple[str, bytes]], text_at: int, least: float, sizes: dict[str, int] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates)
        for batch in batches:
            for part in pieces(batch, text_at, PIECE):
                texts = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in part.column(text_at)]
                ids: list[int] = []
                starts = []
                for text in texts:
                    starts.append(len(ids))
                    ids += map(index.words.get, text.translate(NORMAL).split(), repeat(0))
                    ids += [0] * (GRAM + WINNOW)  # nothing crosses documents
                numbers = np.array(ids, dtype=np.int64)
                hits = defaultdict(list)
                for p, template, place in index.hits(numbers):
                    row = bisect_right(starts, p) - 1
                    hits[row].append((p - starts[row], template, place))
                out = [list(x or []) for x in part.column(part.num_columns - 1).to_pylist()]
                for row, found in hits.items():
                    end = starts[row + 1] if row + 1 < len(starts) else len(ids)
                    text, ends = texts[row], None
                    for name, coverage, first, stop in matches(index, numbers[starts[row] : end - GRAM - WINNOW], found, least):
                        ends = ends or [m.span() for m in re.finditer(rb"[^ ]+", text.translate(NORMAL))]
                        chars = [len(text[:at].decode("utf-8", "replace")) for at in (ends[first][0], ends[stop - 1][1])]
                        out[row].append({"license": name, "coverage": coverage, "start": chars[0], "stop": chars[1]})
                    out[row].sort(key=lambda x: (x["start"], x["license"]))
                if sizes is not None:
                    out = [best_of(found, sizes) if len(found) > 1 else found for found in out]
                state = pa.array(out, type=batch.schema.field(batch.num_columns - 1).type)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], state], schema=batch.schema)

    return run


def template_table(templates: DataFrame, name_col: str = "license", text_col: str = "text", limit: int = TABLE_BYTES) -> dict[str, str]:
    """Templates of a table, in order of their names; null names and texts are left out.

    The table goes to the driver and in blocks to the tasks, so it is refused above ``limit`` bytes, as is a name that has several texts.
    """
    rows = templates.select(F.col(f"`{name_col}`").cast("string").alias("name"), F.col(f"`{text_col}`").alias("text")).where("name IS NOT NULL AND text IS NOT NULL").distinct()
    size = rows.agg(F.sum(F.octet_length("name") + F.octet_length("text")).alias("size"), F.count(F.lit(1)).alias("n"), F.count_distinct("name").alias("names")).first()
    if (size["size"] or 0) > limit:
        raise ValueError(f"templates of {size['size']} bytes are more than {limit}")
    if size["n"] != size["names"]:
        raise ValueError("a template name has several texts")
    return {r["name"]: r["text"] for r in rows.orderBy("name").collect()}


def scan_licenses(
    docs: DataFrame, templates: dict[str, str] | DataFrame = TEMPLATES, text_col: str = "text", least: float = MIN_COVERAGE, out: str = "licenses",
    block_bytes: int = BLOCK_BYTES, best: bool = True,
) -> DataFrame:
    """Add an array column: license, coverage, start and stop (code points) of every notice found.

    ``templates`` are texts by name, or a table (:func:`template_table`). Coverage is the share of a template's words
    that the best alignment matches; ``least`` is the least one reported. Overlapping findings of one template are one.
    Of those of different templates the best is reported (:func:`best_of`), so that variants of a license are told
    apart; all of them without ``best``. Null and wordless texts have none, as have templates of fewer than three words.
    Documents are not shuffled; the index of a block of templates, of bounded size, travels with the task.
    """
    templates = template_table(templates) if isinstance(templates, DataFrame) else templates
    work = docs.withColumn(out, F.array().cast(STATE))
    blocks: list[list[tuple[str, bytes]]] = [[]]
    for name, text in templates.items():
        if blocks[-1] and sum(len(t) for _, t in blocks[-1]) + len(text.encode()) > block_bytes:
            blocks.append([])
        blocks[-1].append((name, text.encode()))
    sizes = {name: len(text.encode().translate(NORMAL).split()) for name, text in templates.items()}
    for k, block in enumerate(blocks, 1):
        work = work.mapInArrow(_scan(block, work.columns.index(text_col), least, sizes if best and k == len(blocks) else None), work.schema)
    return work
