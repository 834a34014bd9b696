"""License scans (operator 1): patience alignment of texts with license templates."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pick

TOKEN = re.compile(r"[^\W_]+(?:[.\-'’][^\W_]+)*")

# Notices as their publishers give them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-4.0-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "all-rights-reserved": "All rights reserved.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License."
    ),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
        "this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution."
    ),
}
# Words that any English text has; they find no candidate places, but are aligned like all others.
COMMON = frozenset("a all an and any are as at be by for form from if in is it may must not of on one or out see that the this to use was with work you".split())


def words(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Lower-cased words and their places in code points."""
    found = [*TOKEN.finditer(text)]
    return [m[0].lower() for m in found], [m.span() for m in found]


def increasing(values: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    before: list[int] = []
    for i, v in enumerate(values):
        at = bisect_left(tops, v)
        before.append(piles[at - 1] if at else -1)
        if at == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[at], piles[at] = v, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence as index pairs, for gaps in which no word is unique to both sides."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Patience alignment: index pairs (in a, in b) of equal words, rising on both sides.

    Words that occur once in each side are anchors; a longest increasing run of them stands, and the gaps between are aligned
    in the same way, where further words become unique. A gap without unique words gets a longest common subsequence.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i >= m or j >= n:
            continue
        once_a, once_b = Counter(a[i:m]), Counter(b[j:n])
        place = {w: k for k, w in enumerate(b[j:n], j) if once_b[w] == 1}
        anchors = [(k, place[w]) for k, w in enumerate(a[i:m], i) if once_a[w] == 1 and w in place]
        if not anchors:
            out += [(i + x, j + y) for x, y in common(a[i:m], b[j:n])]
            continue
        run = [anchors[k] for k in increasing([y for _, y in anchors])]
        out += run
        edges = [(i - 1, j - 1), *run, (m, n)]
        todo += [(x + 1, u, y + 1, v) for (x, y), (u, v) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


@dataclass(frozen=True)
class Hit:
    name: str
    start: int
    end: int
    matched: int
    length: int

    @property
    def coverage(self) -> float:
        return self.matched / self.length


class Scanner:
    """coverage: share of a template's words that must be aligned. density: share that they must make up of their span.

    Where another template reads so much alike that it covers this one, the words that only this one has must be aligned too:
    they tell the licenses apart, whatever else agrees.
    """

    def __init__(self, templates: dict[str, str], coverage: float = 0.8, density: float = 0.6):
        self.templates = {name: words(text)[0] for name, text in templates.items()}
        self.signs: dict[str, list[tuple[str, int]]] = {}
        for name, own in self.templates.items():
            for w in set(own) - COMMON:
                self.signs.setdefault(w, []).append((name, own.index(w)))
        self.coverage, self.density = coverage, density
        self.counts = {name: Counter(own) for name, own in self.templates.items()}
        self.telling = {name: set() for name in self.templates}
        for name, own in self.templates.items():
            for other, theirs in self.templates.items():
                if other != name and len(align(own, theirs)) >= coverage * len(own):
                    self.telling[name] |= set(own) - set(theirs)
        self.marks = ahocorasick.Automaton()
        for w in self.signs:
            self.marks.add_word(w, w)
        self.marks.make_automaton()

    def __call__(self, text: str) -> list[Hit]:
        """The licenses in a text, by start. Of overlapping hits the one that aligns more words stands."""
        if next(self.marks.iter(text.lower()), None) is None:
            return []
        own, places = words(text)
        seen: dict[str, list[tuple[int, int]]] = {}
        for at, w in enumerate(own):
            for name, offset in self.signs.get(w, ()):
                seen.setdefault(name, []).append((at, offset))
        found = [h for name, marks in seen.items() for h in self._hits(name, marks, own, places)]
        kept: list[tuple[int, int]] = []  # spans of hits that stand, by start; none overlap
        stands = []
        for h in sorted(found, key=lambda h: (-h.matched, -h.coverage, h.start, h.name)):
            at = bisect_left(kept, (h.start, h.end))
            if (at == len(kept) or h.end <= kept[at][0]) and (at == 0 or kept[at - 1][1] <= h.start):
                kept.insert(at, (h.start, h.end))
                stands.append(h)
        return sorted(stands, key=lambda h: h.start)

    def _hits(self, name: str, marks: list[tuple[int, int]], own: list[str], places: list[tuple[int, int]]) -> Iterator[Hit]:
        template = self.templates[name]
        slack, done = 2 + len(template) // 4, 0
        least = self.coverage * len(template)
        last, counts, telling = (-1, -1), self.counts[name], self.telling[name]
        known = [i for i, w in enumerate(own) if w in counts]
        for at, offset in marks:
            begin, end = max(done, at - offset - slack), min(len(own), at - offset + len(template) + slack)
            if at < done or (begin, end) == last:
                continue
            last = (begin, end)
            # No alignment has more pairs than both sides share words; most windows end here.
            i, j = bisect_left(known, begin), bisect_left(known, end)
            if j - i < least:
                continue
            here = Counter([own[k] for k in known[i:j]])
            if sum(min(n, counts[w]) for w, n in here.items()) < least:
                continue
            pairs = self._dense(align(template, own[begin:end]), least)
            if pairs and telling <= {template[x] for x, _ in pairs}:
                first, stop = begin + pairs[0][1], begin + pairs[-1][1]
                yield Hit(name, places[first][0], places[stop][1], len(pairs), len(template))
                done = stop + 1

    def _dense(self, pairs: list[tuple[int, int]], least: float) -> list[tuple[int, int]]:
        """The alignment without stray ends, if it covers and is dense enough."""
        while len(pairs) >= least:
            span = pairs[-1][1] - pairs[0][1] + 1
            if len(pairs) >= self.density * span:
                return pairs
            left, right = pairs[1][1] - pairs[0][1], pairs[-1][1] - pairs[-2][1]
            pairs = pairs[1:] if left >= right else pairs[:-1]
        return []


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, n_licenses, licenses and best_coverage of each row of `docs`, over whole texts.

    licenses has name:start:end:matched:length of each hit, by start (code points, end exclusive), comma-joined. Null and empty
    texts have none, with a coverage of 0. Equal rows give equal rows, an empty table an empty result; further columns are
    ignored. Of overlapping hits the one that aligns more words stands, then the fuller, the earlier, the first by name. A long
    text costs time in proportion to its words and to the places where a template's own words stand; only windows that share
    enough words with the template are aligned.
    """
    chosen = templates or TEMPLATES
    rows = pick(docs, key, text).toDF("key", "text")
    schema = T.StructType([rows.schema["key"], T.StructField("n_licenses", T.LongType()), T.StructField("licenses", T.StringType()), T.StructField("best_coverage", T.DoubleType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen, coverage)
        for batch in batches:
            hits = [scanner(t.as_py() or "") for t in batch.column(1)]
            named = [",".join(f"{h.name}:{h.start}:{h.end}:{h.matched}:{h.length}" for h in own) for own in hits]
            best = [max((h.coverage for h in own), default=0.0) for own in hits]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, hits), pa.int64()), pa.array(named, pa.string()), pa.array(best, pa.float64())], ["key", "n_licenses", "licenses", "best_coverage"])

    return rows.mapInArrow(scan, schema).withColumnRenamed("key", key).select(F.col(key), "n_licenses", "licenses", "best_coverage")
