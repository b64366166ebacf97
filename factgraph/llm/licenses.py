"""License scan by conditional compression.

A candidate block is a run of lines that hold a license word, at most ``GAP`` apart.
Notices are looked for in each block and in the words around it, as many as the longest
template can be spread over. A template is confirmed where at least ``MIN_MATCH`` of its
words stand in order, in a block or in a span of which they are ``MIN_MATCH``, and if
zstandard saves bytes with the template as raw dictionary. Of confirmed templates whose
spans overlap, compression decides: the one that saves most bytes less those that are
left, then the one that saves most; every other one is reported. ``differences`` counts the template's words that
are missing and the span's that stand between matches.

A null or empty text, or one without a license word, has no blocks, count 0 and empty
lists; repeated rows give repeated results. Blocks never cut lines, and a long text is
read whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from factgraph.llm.words import lower_ascii, text_slices

GAP = 2
MIN_MATCH = 0.8
LEVEL = 3
TRIGGERS = (b"license", b"licence", b"licensed", b"copyright", b"rights reserved", b"permission is", b"redistribution", b"public domain", b"creative commons", b"warranties")

# fixed values: wording of widely used license notices
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT": "Released under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-text": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has dedicated all copyright to this work to the public domain worldwide under CC0 1.0 Universal.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "All-rights-reserved": "All rights reserved.",
}
WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Scanner:
    """Templates with their dictionaries; results of equal blocks are remembered."""

    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        self.words = [words_of(t) for t in templates.values()]
        self.plain = zstandard.ZstdCompressor(level=LEVEL)
        self.given = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(t.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for t in templates.values()]
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for t in self.words for w in t}))}
        self.member = np.zeros((len(self.words), len(self.vocabulary) + 1), bool)  # the last is any other word
        for t, own in enumerate(self.words):
            self.member[t, [self.vocabulary[w] for w in own]] = True
        self.reach = max((math.ceil(len(t) / MIN_MATCH) for t in self.words), default=0)
        self.judge = lru_cache(4096)(self._judge)

    def spans(self, own: list[str], t: int, loose: bool) -> Iterator[tuple[int, int, int]]:
        """(first word, word behind the last, words matched) of the places where a template's words stand; loose: with any words between."""
        least = MIN_MATCH * len(self.words[t])
        if len(own) < least:
            return
        runs = [m for m in SequenceMatcher(None, own, self.words[t], autojunk=False).get_matching_blocks() if m.size]
        best = None
        if loose and sum(m.size for m in runs) >= least:
            best = (0, runs[0].a, runs[-1].a + runs[-1].size, sum(m.size for m in runs))
        if not loose:
            for i, m in enumerate(runs):
                matched = 0
                for n in runs[i:]:
                    matched += n.size
                    span = n.a + n.size - m.a
                    if matched >= max(least, MIN_MATCH * span) and (best is None or 2 * matched - span > best[0]):
                        best = (2 * matched - span, m.a, n.a + n.size, matched)
        if best is None:
            return
        _, lo, hi, matched = best
        yield lo, hi, matched
        if not loose:
            yield from self.spans(own[:lo], t, False)
            yield from ((hi + a, hi + b, n) for a, b, n in self.spans(own[hi:], t, False))

    def _judge(self, block: str, cores: tuple[tuple[int, int], ...] = ()) -> tuple[tuple[str, int, int, int, int], ...]:
        """(license, bytes saved, differences, first and last character) of the confirmed notices of a lower-cased text, best first; cores: blocks in it."""
        low = block.lower()
        at = [m.span() for m in WORD.finditer(low)]
        own = [low[a:b] for a, b in at]
        begins = np.array([a for a, _ in at], np.int64)
        ids = np.array([self.vocabulary.get(w, len(self.vocabulary)) for w in own], np.int64)
        found = set()
        for t, words in enumerate(self.words):
            if not words:
                continue
            for a, b in cores or ((0, len(low)),):
                p, q = np.searchsorted(begins, (a, b))
                if self.member[t, ids[p:q]].sum() >= MIN_MATCH * len(words):
                    found |= {(t, p + x, p + y, n) for x, y, n in self.spans(own[p:q], t, True)}
            # places that hold enough of the template's words within its spread
            width = math.ceil(len(words) / MIN_MATCH)
            sums = np.concatenate(([0], np.cumsum(self.member[t, ids]), np.full(width, self.member[t, ids].sum())))
            near = np.flatnonzero(sums[width : width + len(own)] - sums[: len(own)] >= MIN_MATCH * len(words))
            for zone in np.split(near, np.flatnonzero(np.diff(near) > width) + 1) if len(near) else []:
                p, q = int(zone[0]), int(zone[-1]) + width
                found |= {(t, p + x, p + y, n) for x, y, n in self.spans(own[p:q], t, False)}
        ranked = []
        for t, p, q, matched in found:
            raw = low[at[p][0] : at[q - 1][1]].encode()
            alone, left = len(self.plain.compress(raw)), len(self.given[t].compress(raw))
            if alone > left:
                d = len(self.words[t]) - matched + int(q - p) - matched
                # bytes that the template explains, less those that it doesn't
                ranked.append((left - (alone - left), left - alone, t, int(p), int(q), d))
        taken: list[tuple] = []
        for x in sorted(ranked):
            if all(x[4] <= y[3] or y[4] <= x[3] for y in taken):
                taken.append(x)
        return tuple((self.names[t], -minus, d, at[p][0], at[q - 1][1]) for _, minus, t, p, q, d in taken)

    def notices(self, text: str, groups: list[tuple[int, int]]) -> list[tuple[int, int, str, int, int]]:
        """(first line, line behind the last, license, bytes saved, differences) of a text with these blocks of lines."""
        low = text.lower()
        breaks = np.array([m.start() for m in re.finditer("\n", low)], np.int64)
        edges = np.concatenate(([0], breaks + 1, [len(low) + 1]))
        at = [m.span() for m in WORD.finditer(low)]
        begins = np.array([a for a, _ in at], np.int64)
        parts: list[list] = []
        for first, last in groups:
            core = (int(edges[first]), int(edges[last]) - 1)
            p, q = max(0, int(np.searchsorted(begins, core[0])) - self.reach), min(len(at), int(np.searchsorted(begins, core[1])) + self.reach)
            if parts and p <= parts[-1][1]:
                parts[-1][1] = max(q, parts[-1][1])
                parts[-1][2].append(core)
            else:
                parts.append([p, q, [core]])
        out = []
        for p, q, cores in parts:
            if p < q:
                lo = at[p][0]
                for name, saved, d, a, b in self.judge(low[lo : at[q - 1][1]], tuple((a - lo, b - lo) for a, b in cores)):
                    out.append((int(np.searchsorted(breaks, lo + a)), int(np.searchsorted(breaks, lo + b - 1)) + 1, name, saved, d))
        return sorted(out)


def blocks(column: pa.Array) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Each text (empty without blocks) and (first line, line behind the last) of its candidate blocks."""
    for _, data, offsets in text_slices(column):
        raw, low = data.tobytes(), lower_ascii(data).tobytes()
        hits = []
        for word in TRIGGERS:
            at = low.find(word)
            while at >= 0:
                hits.append(at)
                at = low.find(word, at + 1)
        hits = np.unique(np.array(hits, np.int64))
        where = np.searchsorted(hits, offsets)
        for r in range(len(offsets) - 1):
            own = hits[where[r] : where[r + 1]] - offsets[r]
            if not len(own):
                yield "", []
                continue
            text = raw[offsets[r] : offsets[r + 1]]
            breaks = np.flatnonzero(data[offsets[r] : offsets[r + 1]] == 10)
            lines = np.unique(np.searchsorted(breaks, own))
            groups = np.split(lines, np.flatnonzero(np.diff(lines) > GAP) + 1)
            yield text.decode("utf-8", "replace"), [(int(g[0]), int(g[-1]) + 1) for g in groups]


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_blocks, n_confirmed, licenses (of the confirmed notices), findings (license:first line:end line:bytes saved:differences)."""
    chosen = templates or TEMPLATES

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen)
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("n_blocks", "n_confirmed", "licenses", "findings")}
            for text, found in blocks(b.column("text")):
                won = scanner.notices(text, found) if found else []
                out["n_blocks"].append(len(found))
                out["n_confirmed"].append(len(won))
                out["licenses"].append(",".join(sorted({w[2] for w in won})))
                out["findings"].append(",".join(f"{name}:{first}:{last}:{gain}:{d}" for first, last, name, gain, d in won))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id")} | {k: pa.array(v, pa.int64() if k[0] == "n" else pa.string()) for k, v in out.items()})

    return docs.select("doc_id", "text").mapInArrow(look, "doc_id long, n_blocks long, n_confirmed long, licenses string, findings string")
