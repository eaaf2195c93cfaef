"""License scan: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Texts and templates are lower-cased words of letters and digits in shingles of ``SHINGLE`` words. Templates are classed by
length; each class has its own windows over a text: every position for the shortest, else one and a half class lengths at
steps of half a length, so that a whole template always lies in one. From the least Jaccard index that a window with a
contained template can have, ``settings`` takes the bands: the most rows per band for which a pair collides with
probability ``SURE`` or more. Windows that collide with a template in a band are verified by containment of its distinct
shingles in the stretch around the window.

Templates are a bounded list that goes to the tasks; texts are read once, whole, where they are.

Defined cases: null, empty and very short texts have no shingle and no license; a license met by several templates or at
several places gives one row, with the highest containment and of these the first place; where matches of two licenses
overlap (a notice of another version), only the better one counts, and a license
whose notice is a part of others (BSD) only where none of them is met; rows are judged one by one; templates of fewer words than a shingle are refused; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import by_batch
from attesta.llm.substrings import window_hashes

SHINGLE = 5
CONTAINED = 0.8
SURE = 0.999
MOST_HASHES = 48
STEPLESS = 4  # classes up to this length have a window at every position
WORDS_AT_ONCE = 100_000
WORDS = re.compile(r"[^\W_]+")

# fixed values: GNU licenses, and the notices they share; punctuation does not count
GNU = (
    ("GPL-1.0", "General", "1"), ("GPL-2.0", "General", "2"), ("GPL-3.0", "General", "3"), ("LGPL-2.0", "Library General", "2"),
    ("LGPL-2.1", "Lesser General", "2.1"), ("LGPL-3.0", "Lesser General", "3"), ("AGPL-3.0", "Affero General", "3"),
)
GNU_NOTICES = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} Public License as published by the Free "
    "Software Foundation, either version {1} of the License, or (at your option) any later version.",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} Public License as published by the Free "
    "Software Foundation, either version {1}, or (at your option) any later version.",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} Public License version {1} as published by "
    "the Free Software Foundation.",
    "Licensed under the GNU {0} Public License, version {1}.",
    "Licensed under the GNU {0} Public License v{1}.",
)
# fixed values: the conditions of the BSD licenses; lists come with numbers or with bullets
BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "{0} Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. {1} "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
BSD_NAME = (
    "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
)
BSD_END = "This software is provided by the copyright holders and contributors \"as is\""
#: A license whose notice is a part of others: it stays only where none of those is met.
PART_OF = {"BSD": ("BSD-2-Clause", "BSD-3-Clause")}
# fixed values: notices and opening paragraphs of public licenses
TEMPLATES: tuple[tuple[str, str], ...] = (
    *((name, notice.format(title, version)) for name, title, version in GNU for notice in GNU_NOTICES),
    *(("BSD-2-Clause", BSD.format(*marks) + BSD_END) for marks in (("1.", "2."), ("*", "*"))),
    *(("BSD-3-Clause", f"{BSD.format(*marks)}{marks[2]} Neither the name of the copyright holder {BSD_NAME}{BSD_END}") for marks in (("1.", "2.", "3."), ("*", "*", "*"))),
    ("BSD-3-Clause", BSD_NAME + BSD_END),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this "
                "distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
                "https://www.eclipse.org/legal/epl-2.0/"),
    ("EPL-1.0", "Licensed under the Eclipse Public License, version 1.0."),
    ("EPL-2.0", "Licensed under the Eclipse Public License, version 2.0."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("CC-BY-4.0", "Licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. The software is "
            "provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness "
            "for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other "
            "liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other "
            "dealings in the software."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
            "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
            "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
            "subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
                   "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
                   "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
                   "either express or implied."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
                "file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
            "above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
)


def words_of(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


def word_hashes(words: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False) if words else np.zeros(0, dtype=np.uint64)


def class_of(shingles: int) -> int:
    return 1 << (shingles - 1).bit_length()


def window_of(length: int) -> tuple[int, int]:
    """(length, step) in shingles of the windows of a class."""
    return (length, 1) if length <= STEPLESS else (length + length // 2, length // 2)


def least_jaccard(length: int, contained: float = CONTAINED) -> float:
    """Of a window of this class and a template contained in it to the given share."""
    window, low = window_of(length)[0], length // 2 + 1
    shared = [math.ceil(contained * n) for n in range(low, length + 1)]
    return min(s / (window + n - s) for s, n in zip(shared, range(low, length + 1), strict=True))


def settings(jaccard: float, sure: float = SURE, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows per band, then the fewest bands, that collide with probability ``sure``."""
    if jaccard >= 1:
        return 1, 1
    for rows in range(8, 0, -1):
        bands = math.ceil(math.log(1 - sure) / math.log(1 - jaccard**rows))
        if bands * rows <= most:
            return bands, rows
    raise ValueError(f"no band setting meets {sure} at a Jaccard index of {jaccard:.2f} with {most} hashes")


def _salted(shingles: np.ndarray, k: int) -> np.ndarray:
    salt = np.random.default_rng((5, k)).integers(1, 2**63, 2, dtype=np.uint64)
    x = (shingles ^ salt[0]) * (salt[1] | np.uint64(1))
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Template:
    no: int
    license: str
    shingles: np.ndarray


class Scanner:
    """Band tables of the templates, by class."""

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, contained: float = CONTAINED) -> None:
        self.contained = contained
        self.classes: dict[int, list[Template]] = {}
        for no, (name, text) in enumerate(templates):
            found = np.unique(window_hashes(word_hashes(words_of(text)), SHINGLE))
            if not len(found):
                raise ValueError(f"template {no} has fewer than {SHINGLE} words")
            self.classes.setdefault(class_of(len(found)), []).append(Template(no, name, found))
        self.bands: dict[int, tuple[int, int]] = {n: settings(least_jaccard(n, contained)) for n in self.classes}
        self.tables: dict[tuple[int, int], dict[int, list[Template]]] = {}
        self.seen: dict[tuple[int, int], np.ndarray] = {}
        for n, known in self.classes.items():
            bands, rows = self.bands[n]
            for b in range(bands):
                table: dict[int, list[Template]] = {}
                for t in known:
                    table.setdefault(int(_band([_salted(t.shingles, b * rows + r).min(keepdims=True) for r in range(rows)])[0]), []).append(t)
                seen = np.zeros(1 << 16, dtype=bool)
                seen[[key >> 48 for key in table]] = True
                self.tables[n, b], self.seen[n, b] = table, seen

    def _collisions(self, shingles: np.ndarray, real: np.ndarray) -> list[tuple[int, int, Template]]:
        """(class, window start, template) of all windows that share a band with a template."""
        found: set[tuple[int, int, int]] = set()
        by_no = {t.no: t for known in self.classes.values() for t in known}
        most = max(b * r for b, r in self.bands.values())
        low = [n for n in sorted(self.classes) if n <= STEPLESS]
        high = [n for n in sorted(self.classes) if n > STEPLESS]
        held: dict[int, list[np.ndarray]] = {}
        for k in range(most):
            hashed = np.where(real, _salted(shingles, k), np.uint64(2**64 - 1))
            minima: dict[int, np.ndarray] = {}
            for n in low:
                if k < self.bands[n][0] * self.bands[n][1]:
                    x = hashed
                    for s in range(1, n):
                        x = np.minimum(x[: len(x) - 1], hashed[s:]) if len(hashed) > s else x[:0]
                    minima[n] = x
            step, blocks = 1, hashed
            for n in high:
                if k >= self.bands[n][0] * self.bands[n][1]:
                    continue
                while step < n // 2:
                    if len(blocks) % 2:
                        blocks = np.append(blocks, np.uint64(2**64 - 1))
                    blocks, step = np.minimum(blocks[::2], blocks[1::2]), step * 2
                padded = np.append(blocks, np.full(2, 2**64 - 1, dtype=np.uint64))
                minima[n] = np.minimum(np.minimum(padded[:-2], padded[1:-1]), padded[2:])
            for n, x in minima.items():
                rows = self.bands[n][1]
                held.setdefault(n, []).append(x)
                if len(held[n]) == rows:
                    band = k // rows
                    key = _band(held.pop(n))
                    for at in np.flatnonzero(self.seen[n, band][(key >> np.uint64(48)).astype(np.int64)]).tolist():
                        for t in self.tables[n, band].get(int(key[at]), ()):
                            found.add((n, at * window_of(n)[1], t.no))
        return [(n, at, by_no[no]) for n, at, no in sorted(found, key=lambda x: (x[1], x[2]))]

    def scan(self, texts: list[str | None]) -> list[dict[str, tuple[float, int, int]]]:
        """Per text: license to (containment, first word, word after the last)."""
        lists = [words_of(t) for t in texts]
        sizes = np.array([len(w) for w in lists], dtype=np.int64)
        ends = np.cumsum(sizes)
        begins = ends - sizes
        flat = word_hashes([w for words in lists for w in words])
        shingles = window_hashes(flat, SHINGLE)
        met: list[list[tuple[float, int, int, str]]] = [[] for _ in texts]
        if len(shingles):
            owner = np.repeat(np.arange(len(texts)), sizes)
            real = owner[: len(shingles)] == owner[SHINGLE - 1 :]
            for n, at, t in self._collisions(shingles, real):
                window = window_of(n)[0]
                for doc in range(int(owner[at]), int(owner[min(at + window, len(owner)) - 1]) + 1):
                    a, b = max(at - n, int(begins[doc])), min(at + window + n, int(ends[doc]) - SHINGLE + 1)
                    hits = np.flatnonzero(np.isin(shingles[a:b], t.shingles)) if b > a else np.zeros(0, dtype=np.int64)
                    share = len(np.unique(shingles[a:b][hits])) / len(t.shingles) if len(hits) else 0.0
                    if share >= self.contained:
                        base = a - int(begins[doc])
                        met[doc].append((share, base + int(hits[0]), base + int(hits[-1]) + SHINGLE, t.license))
        return [best(found) for found in met]


def best(found: list[tuple[float, int, int, str]]) -> dict[str, tuple[float, int, int]]:
    """The best match of each license, without those that a better match of another license overlaps."""

    def better(other: str, s: float, name: str, share: float) -> bool:
        return other in PART_OF.get(name, ()) or s > share and name not in PART_OF.get(other, ())

    kept: dict[str, tuple[float, int, int]] = {}
    for share, first, last, name in sorted(found, key=lambda x: (-x[0], x[1], x[2], x[3])):
        if not any(better(other, s, name, share) and f < last and first < e for s, f, e, other in found if other != name):
            kept.setdefault(name, (share, first, last))
    return kept


def _band(rows: list[np.ndarray]) -> np.ndarray:
    key = rows[0]
    for x in rows[1:]:
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + x
    return (key ^ (key >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)


def licensed(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, contained: float = CONTAINED) -> DataFrame:
    """``(doc_id, license, containment, first_word, last_word)``: the licenses found in each row."""

    def work(batch: pa.RecordBatch) -> Iterator[dict[str, list]]:
        scanner = Scanner(templates, contained)
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        start, held = 0, 0
        for i, text in enumerate(texts):
            held += len(text or "") // 6
            if held >= WORDS_AT_ONCE or i == len(texts) - 1:
                found = scanner.scan(texts[start : i + 1])
                rows = [(d, name, *hit) for d, hits in zip(ids[start : i + 1], found, strict=True) for name, hit in sorted(hits.items())]
                yield {name: [r[k] for r in rows] for k, name in enumerate(("doc_id", "license", "containment", "first_word", "last_word"))}
                start, held = i + 1, 0

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return by_batch(narrow, "doc_id long, license string, containment double, first_word int, last_word int", work)
