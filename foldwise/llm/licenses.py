"""License scans: units of a text compared with licence templates by Dice coefficient.

Units are the whole text, its lines, its sentences, and runs of neighbouring
pieces, so that a notice wrapped over several lines of a longer text is one unit
too. A piece ends at a line break or with its sentence. Text and templates are
normalised (A-Z lowered, runs of other than letters and digits as one space);
each is the set of its distinct word bigrams. A unit matches the template of
highest Dice coefficient 2 |A and B| / (|A| + |B|), if that is ``LEAST`` or more.

Sizes prune first: with d = LEAST, |B| lies between |A| d / (2 - d) and
|A| (2 - d) / d, and of A's bigrams a share of d / (2 - d) must occur in
templates at all. Both bounds lose nothing. Runs also end where more than
|B| 2 (1 - d) / d distinct bigrams occur in no template; they begin and end with
pieces of known bigrams, as others never raise the coefficient, and have at most
_RUN times as many words as a match has distinct bigrams, which only a notice
with far more repeated than own words exceeds.

Some word pairs tell licences apart that else read alike: Affero, Lesser, any
later version, version numbers, the letters of Creative Commons. A template
counts only if unit and template agree in these. Of matching units inside each
other only that of the highest coefficient is told, of equal ones the largest;
a notice that is part of another one, though, gives way to it around it. "All
rights reserved" gives way to a licence that begins right after it. Null and empty texts and units of one
word match nothing. Of templates with equal coefficients the first by name
counts. Rows are scanned one by one, so repeated rows need no rule.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm.tokens import combine, text_slices, word_spans

LEAST = 0.8
_RUN = 4
# Notices as licences ask for them, by SPDX name.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not "
     "use this file except in compliance with the License. You may obtain a copy of the License "
     "at http://www.apache.org/licenses/LICENSE-2.0"),
    ("AGPL-3.0-only", "This work is licensed under the GNU Affero General Public License, "
     "version 3."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it "
     "under the terms of the GNU Affero General Public License as published by the Free Software "
     "Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without "
     "modification, are permitted provided that the following conditions are met"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without "
     "modification, are permitted provided that the following conditions are met: Redistributions "
     "of source code must retain the above copyright notice, this list of conditions and the "
     "following disclaimer. Redistributions in binary form must reproduce the above copyright "
     "notice, this list of conditions and the following disclaimer in the documentation and/or "
     "other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without "
     "modification, are permitted provided that the following conditions are met: Redistributions "
     "of source code must retain the above copyright notice, this list of conditions and the "
     "following disclaimer. Redistributions in binary form must reproduce the above copyright "
     "notice, this list of conditions and the following disclaimer in the documentation and/or "
     "other materials provided with the distribution. Neither the name of the copyright holder nor "
     "the names of its contributors may be used to endorse or promote products derived from this "
     "software without specific prior written permission."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International "
     "License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial "
     "4.0 International License."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons "
     "Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons "
     "Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives "
     "4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 "
     "International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0-only", "This program is free software; you can redistribute it and/or modify it "
     "under the terms of the GNU General Public License as published by the Free Software "
     "Foundation; version 2 of the License."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it "
     "under the terms of the GNU General Public License as published by the Free Software "
     "Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "This program is free software: you can redistribute it and/or modify it "
     "under the terms of the GNU General Public License as published by the Free Software "
     "Foundation, version 3 of the License."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it "
     "under the terms of the GNU General Public License as published by the Free Software "
     "Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1-only", "This work is licensed under the GNU Lesser General Public License, "
     "version 2.1."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it "
     "under the terms of the GNU Lesser General Public License as published by the Free Software "
     "Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it "
     "under the terms of the GNU Lesser General Public License as published by the Free Software "
     "Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, "
     "version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
     "software and associated documentation files (the \"Software\"), to deal in the Software "
     "without restriction, including without limitation the rights to use, copy, modify, merge, "
     "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons "
     "to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, "
     "v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
     "http://mozilla.org/MPL/2.0/."),
    ("Proprietary", "All rights reserved."),
]

# Words that tell, with what follows them; after the others only these or a number.
_TELLING = frozenset("affero lesser neither later".split())
_NUMBERED = frozenset("version v attribution by nc nd sa noncommercial noderivatives sharealike".split())
RESERVED = "Proprietary"
# A licence that begins so many bytes after a reservation of rights is what holds.
_NEAR = 300
# A template is part of another if so much of it is in that.
_PART = 0.9

# Letters and digits of ASCII and all bytes beyond it make words.
_OUTSIDE = np.ones(256, dtype=bool)
_OUTSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".!?"]] = True
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _bigrams(hashes: np.ndarray) -> np.ndarray:
    return combine(hashes[:-1], hashes[1:])


def _tells(first: str, second: str) -> bool:
    return first in _TELLING or first in _NUMBERED and (second.isdigit() or second in _NUMBERED)


class _Templates:
    def __init__(self, templates: list[tuple[str, str]], least: float):
        self.least = least
        self.names, self.sets = [], []
        telling: list[int] = []
        for name, text in sorted(templates):
            data = np.frombuffer(text.encode(), dtype=np.uint8)
            hashes, starts, ends, _ = word_spans(data, np.array([0, len(data)]), _OUTSIDE)
            pairs = _bigrams(hashes)
            words = [bytes(data[a:b]).decode().lower() for a, b in zip(starts, ends)]
            telling += [int(p) for p, a, b in zip(pairs, words, words[1:]) if _tells(a, b)]
            self.names.append(name)
            self.sets.append(np.unique(pairs))
        self.telling = np.unique(np.array(telling, dtype=np.uint64))
        self.told = [np.intersect1d(s, self.telling, assume_unique=True) for s in self.sets]
        # Templates that a template is part of.
        self.wider = [{u for u, other in enumerate(self.sets) if u != t and len(other) > len(own)
                       and len(np.intersect1d(own, other, assume_unique=True)) >= _PART * len(own)}
                      for t, own in enumerate(self.sets)] + [set()]
        self.sizes = np.array([len(s) for s in self.sets])
        self.known = np.unique(np.concatenate(self.sets)) if self.sets else np.zeros(0, np.uint64)

    def best(self, own: np.ndarray) -> tuple[float, int]:
        """Highest coefficient and its template, among templates of a fitting size."""
        ratio = self.least / (2 - self.least)
        fits = (self.sizes >= len(own) * ratio - 1e-9) & (self.sizes * ratio - 1e-9 <= len(own))
        top = (0.0, -1)
        told = np.intersect1d(own, self.telling, assume_unique=True)
        for t in np.flatnonzero(fits):
            if not np.array_equal(told, self.told[t]):
                continue
            both = len(np.intersect1d(own, self.sets[t], assume_unique=True))
            top = max(top, (2 * both / (len(own) + len(self.sets[t])), -int(t)))
        return top[0], -top[1]


def _runs(templates: _Templates, pairs: np.ndarray, hit: np.ndarray, row: np.ndarray,
          breaks: np.ndarray) -> Iterator[tuple[int, int, float, int]]:
    """(first word, word after the last, coefficient, template) of matching runs of pieces.

    Of runs with one beginning those are told that are no worse than each shorter one, or whose
    template holds that of the best shorter one.
    """
    share = templates.least / (2 - templates.least)
    largest = templates.sizes.max() / share
    most = templates.sizes.max() * 2 * (1 - templates.least) / templates.least + 1e-9
    head = np.append(0, np.flatnonzero(breaks) + 1)
    tail = np.append(head[1:], len(row))
    known = np.append(0, np.cumsum(hit))
    # A piece's bigrams with the next piece, and with the one before.
    begins = known[np.minimum(tail, len(hit))] > known[head]
    begins[:-1] &= row[head[1:]] == row[head[:-1]]
    begins[-1] = False
    closes = (known[tail - 1] > known[np.maximum(head - 1, 0)]).tolist()
    last = np.searchsorted(row[head], row[head], "right")
    items, hits = pairs.tolist(), hit.tolist()
    for k in np.flatnonzero(begins).tolist():
        seen: set[int] = set()
        n_known, judged, top, at, best_t = 0, 0, templates.least - 1e-12, int(head[k]), -1
        end = at + _RUN * largest
        for j in range(k, int(last[k])):
            after = int(tail[j])
            if after > end:
                break
            for i in range(at, after - 1):
                if items[i] not in seen:
                    seen.add(items[i])
                    n_known += hits[i]
            at = max(at, after - 1)
            if len(seen) - n_known > most or len(seen) > largest:
                break
            # A first piece of one word has no bigram yet.
            if not closes[j] or not seen or n_known < share * len(seen) - 1e-9:
                continue
            if len(seen) > judged:
                judged = len(seen)
                value, t = templates.best(np.array(sorted(seen), dtype=np.uint64))
            if value >= top or value >= templates.least and t in templates.wider[best_t]:
                top, best_t = value - 1e-12, t
                if j > k:  # else it is a sentence
                    yield int(head[k]), after, value, t


def _scan(templates: _Templates, data: np.ndarray, offsets: np.ndarray) -> list[tuple]:
    """(row, first byte, end byte in the row, template, coefficient) of every matching unit."""
    hashes, starts, ends, bounds = word_spans(data, offsets, _OUTSIDE)
    n = len(hashes)
    if n < 2 or not len(templates.known):
        return []
    row = np.searchsorted(bounds, np.arange(n), "right") - 1
    pairs = _bigrams(hashes)
    at = np.minimum(np.searchsorted(templates.known, pairs), len(templates.known) - 1)
    hit = templates.known[at] == pairs
    # A sentence ends where a stop is followed by white space before the next word.
    ends_here = np.zeros(len(data), dtype=bool)
    ends_here[:-1] = _STOP[data[:-1]] & _SPACE[data[1:]]
    stops, lines = np.cumsum(ends_here), np.cumsum(data == 0x0A)
    new_row = row[1:] != row[:-1]
    new_line = new_row | (lines[starts[1:]] != lines[starts[:-1]])
    new_sentence = new_line | (stops[starts[1:]] != stops[ends[:-1] - 1])
    share = templates.least / (2 - templates.least)
    largest = templates.sizes.max() / share
    found: list[tuple] = []
    for breaks in (new_row, new_line, new_sentence):
        unit = np.append(0, np.cumsum(breaks))
        inner = ~breaks
        some = np.unique(unit[:-1][inner & hit])
        if not len(some):
            continue
        first = np.searchsorted(unit, some)
        last = np.searchsorted(unit, some, "right")
        for a, b in zip(first.tolist(), last.tolist()):
            own, seen = pairs[a:b - 1], hit[a:b - 1]
            # More distinct bigrams than any template allows, or too few known ones.
            if not seen.any() or (len(own) > 4 * largest and len(np.unique(own)) > largest):
                continue
            distinct, index = np.unique(own, return_index=True)
            if seen[index].sum() < share * len(distinct) - 1e-9:
                continue
            value, t = templates.best(distinct)
            if value >= templates.least - 1e-12:
                r = int(row[a])
                found.append((r, int(starts[a] - offsets[r]), int(ends[b - 1] - offsets[r]), t, value))
    for a, b, value, t in _runs(templates, pairs, hit & ~new_row, row, new_sentence):
        r = int(row[a])
        found.append((r, int(starts[a] - offsets[r]), int(ends[b - 1] - offsets[r]), t, value))
    return _chosen(templates, found)


def _chosen(templates: _Templates, found: list[tuple]) -> list[tuple]:
    """Matches (row, first byte, end byte, licence, coefficient) that do not overlap."""
    # Parts of wider notices around them go first.
    wide: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r, first, end, t, _ in found:
        wide.setdefault((r, t), []).append((first, end))
    for spans in wide.values():
        spans.sort()

    def around(r: int, first: int, end: int, t: int) -> bool:
        for u in templates.wider[t]:
            spans = wide.get((r, u), ())
            k = bisect_left(spans, (first + 1,))
            if any(a <= first and b >= end for a, b in spans[max(0, k - 8):k]):
                return True
        return False

    found = [(*f[:3], templates.names[f[3]], f[4]) for f in found if not around(*f[:4])]
    # Of units inside each other the best counts, of equal ones the largest.
    kept: dict[int, list[tuple]] = {}
    for f in sorted(found, key=lambda f: (-round(f[4], 12), f[1] - f[2], f)):
        own = kept.setdefault(f[0], [])
        k = bisect_left(own, f[2], key=lambda o: o[1])
        if not k or own[k - 1][2] <= f[1]:
            own.insert(k, f)
    return sorted(f for own in kept.values() for f, then in zip(own, [*own[1:], None])
                  if f[3] != RESERVED or then is None or then[3] == RESERVED
                  or then[1] - f[2] > _NEAR)


def matches(docs: DataFrame, templates: list[tuple[str, str]] | None = None,
            least: float = LEAST) -> DataFrame:
    """doc_id and matches: (licence, Dice coefficient, first and end byte) of every row."""
    given = TEMPLATES if templates is None else templates
    kind = docs.schema["doc_id"].dataType.simpleString()
    item = pa.struct([("license", pa.string()), ("dice", pa.float64()),
                      ("first", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Templates(given, least)
        for batch in batches:
            for first, data, offsets in text_slices(batch.column("text")):
                out: list[list] = [[] for _ in range(len(offsets) - 1)]
                for r, begin, end, name, value in _scan(own, data, offsets):
                    out[r].append({"license": name, "dice": value, "first": begin, "end": end})
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, len(out)), pa.array(out, pa.list_(item))],
                    names=["doc_id", "matches"])

    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text")).mapInArrow(
        run, f"doc_id {kind}, matches array<struct<license:string,dice:double,"
             "first:bigint,`end`:bigint>>")
