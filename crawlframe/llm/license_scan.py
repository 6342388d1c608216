"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies.

Shingles are of K words. Each template belongs to the smallest window size
that is 1.5 times its shingles at least (window_size); windows of that size start every
quarter of it, so that any stretch as long as the template lies in one window
whole. If `containment` of the template's shingles is in the window, their
Jaccard similarity is at least

    s = containment * t / (w + (1 - containment) * t)

and with BANDS bands of ROWS values the window retrieves the template with a
probability of 1 - (1 - s**ROWS)**BANDS; `guarantee` states the least one over
a set of templates. A retrieved template is verified on the whole stretch of
the windows that retrieved it: the share of its shingles found there.

License lines are as short as four words, so K is two here, not five.

A window that has too few places of its templates' shingles to hold any is
passed over before any hash is taken. Of verified stretches that overlap, the
one that is contained best counts; one sweep over them tells. Templates are a
bounded parameter or table; every task holds them.

Defined cases: null, empty and short texts match nothing; equal templates
match alike; repeated rows are each scanned; a template of fewer than K words
is refused.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlframe.llm.common import arrow_batches

K = 2
BANDS, ROWS = 64, 2
CONTAINMENT = 0.8
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 or b == 46 else 32 for b in range(256))

# License notices by SPDX id.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
)

_rng = np.random.Generator(np.random.PCG64(11))
_MUL = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
_hashes: dict[bytes, int] = {}


def shingles(text: bytes | None) -> np.ndarray:
    """Hashes of the K-word shingles in their order; dots within words stay, others don't."""
    words = [w.strip(b".") for w in text.translate(_TABLE).split()] if text else []
    if len(_hashes) > 300_000:
        _hashes.clear()
    for w in set(words).difference(_hashes):
        _hashes[w] = xxhash.xxh3_64_intdigest(w)
    codes = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    if len(codes) < K:
        return np.empty(0, np.uint64)
    mixed = np.full(len(codes) - K + 1, K, np.uint64)
    for j in range(K):
        mixed = (mixed ^ codes[j : j + len(mixed)]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed


def bands(found: np.ndarray) -> np.ndarray:
    low = (found >> np.uint64(32)).astype(np.uint32)
    least = (low[:, None] * _MUL + _ADD).min(axis=0)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        key = (key ^ least[j::ROWS].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    return key


def window_size(t: int) -> int:
    """The least of 4, 6, 8, 12, 16, 24, ... that is 1.5 times t at least."""
    size = 4
    while size < 1.5 * t:
        size = size * 3 // 2 if size & (size - 1) == 0 else size * 4 // 3
    return size


@dataclass
class Templates:
    names: list[str]
    sets: list[np.ndarray]
    every: np.ndarray
    by_size: dict[int, dict[int, list[int]]]
    #: By window size: the shingles of its templates, and the fewest places of them that a match needs.
    known: dict[int, tuple[np.ndarray, int]]
    containment: float

    @classmethod
    def of(cls, templates, containment: float = CONTAINMENT) -> Templates:
        names, sets, by_size = [], [], {}
        for k, (name, text) in enumerate(templates):
            own = np.unique(shingles(text.encode()))
            if not len(own):
                raise ValueError(f"a template of fewer than {K} words: {name}")
            names.append(name)
            sets.append(own)
            keys = by_size.setdefault(window_size(len(own)), {})
            for band in bands(own).tolist():
                keys.setdefault(band, []).append(k)
        known = {}
        for size, keys in by_size.items():
            own = [sets[k] for k in {k for ks in keys.values() for k in ks}]
            known[size] = np.unique(np.concatenate(own)), math.ceil(containment * min(map(len, own)) - 1e-9)
        return cls(names, sets, np.unique(np.concatenate([*sets, np.empty(0, np.uint64)])), by_size, known, containment)

    def guarantee(self) -> float:
        """The least probability that a contained template is retrieved."""
        out = 1.0
        for own in self.sets:
            t, w, c = len(own), window_size(len(own)), self.containment
            s = c * t / (w + (1 - c) * t)
            out = min(out, 1 - (1 - s**ROWS) ** BANDS)
        return out

    def scan(self, text: bytes | None) -> dict[int, float]:
        """Containment of each template that is verified; where templates overlap, of those alone that are contained best."""
        found = shingles(text)
        if not len(found):
            return {}
        verified = self.verified(found)
        out: dict[int, float] = {}
        cover: list[tuple[int, int]] = []  # what better ones reach over, merged
        for share, group in groupby(sorted(verified, reverse=True), key=lambda v: v[0]):
            members = list(group)
            starts = [a for a, _ in cover]
            for _, k, start, end in members:
                at = bisect_left(starts, end) - 1
                if at < 0 or cover[at][1] <= start:
                    out[k] = max(out.get(k, 0.0), share)
            cover = _merged(cover + [(a, b) for _, _, a, b in members])
        return out

    def verified(self, found: np.ndarray) -> set[tuple[float, int, int, int]]:
        """(containment, template, start, end) of the stretches, in shingles, of windows that hold a template.

        A window is hashed only if it has enough places of its size's shingles to hold any of their templates.
        """
        out: set[tuple[float, int, int, int]] = set()
        if not len(self.every):
            return out
        at = np.searchsorted(self.every, found)
        if not (self.every[np.minimum(at, len(self.every) - 1)] == found).any():
            return out
        for size, keys in self.by_size.items():
            step = size // 4
            own, least = self.known[size]
            at = np.searchsorted(own, found)
            places = np.concatenate(([0], np.cumsum(own[np.minimum(at, len(own) - 1)] == found)))
            starts = np.arange(0, len(found), step)
            enough = places[np.minimum(starts + size, len(found))] - places[starts] >= least
            for start in starts[enough].tolist():
                window = found[start : start + size]
                for k in {k for band in bands(window).tolist() for k in keys.get(band, ())}:
                    here = np.flatnonzero(np.isin(window, self.sets[k])) + start
                    share = len(np.unique(found[here])) / len(self.sets[k])
                    if share >= self.containment:
                        out.add((share, k, int(here[0]), int(here[-1]) + 1))
        return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


#: Bytes of all templates together that a task may hold.
TEMPLATE_BYTES = 16 << 20


def listed_templates(templates: DataFrame) -> tuple[tuple[str, str], ...]:
    """The rows (name, text) of a table of templates, after a check of its size; rows without a text go."""
    named = templates.where(F.col("text").isNotNull()).select(F.coalesce("name", F.lit("")).alias("name"), "text")
    size = named.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size > TEMPLATE_BYTES:
        raise ValueError(f"templates of {size} bytes; a task holds at most {TEMPLATE_BYTES}: scan with parts of the table in turn")
    return tuple(sorted((r["name"], r["text"]) for r in named.collect()))


def scan(docs: DataFrame, templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """Rows (doc_id, licenses, n_templates, containment), one for each of docs.

    licenses: the names found, sorted, comma-joined; containment: the largest one.
    templates: pairs (name, text), or a table of them.
    """
    arrow_batches(docs.sparkSession)
    listed = listed_templates(templates) if isinstance(templates, DataFrame) else tuple(templates)

    def run(batches):
        own = Templates.of(listed, containment)
        for batch in batches:
            found = [own.scan(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([",".join(sorted({own.names[k] for k in f})) for f in found], pa.string()),
                    pa.array([len(f) for f in found], pa.int64()),
                    pa.array([max(f.values(), default=0.0) for f in found], pa.float64()),
                ],
                names=["doc_id", "licenses", "n_templates", "containment"],
            )

    chosen = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary").alias("text"))
    return chosen.mapInArrow(run, "doc_id bigint, licenses string, n_templates bigint, containment double")
