"""License scans by patience alignment.

For a template, stretches of a text that could cover enough of it are found by
counting template words in windows (an upper bound of what can align).  There,
words unique to both sides anchor the alignment: the longest increasing
subsequence of anchors is kept, and the gaps between them are aligned in the same
way, until a gap has no such words.  Coverage is the share of template words
aligned; stretches with ``coverage`` or more are reported, left to right.

Templates are notices, standard headers and full texts (``-text``).  A full text is aligned
again from where it seems to begin, and its ends are where they are most like it.  Where the
longest common subsequence of a window, an upper bound too, falls short by so many words,
the next one tried starts so many words later: a step brings in no more than it passes.  Of
templates of one sort that cover the same stretch, as versions of one license do, the one
most like it stays.

Words are lower-cased runs of ASCII letters, digits and non-ASCII characters.  A
null, empty or wordless text has no matches.  Matches of different templates may overlap, those of
one do not.  A template whose words stand more than ``slack`` times as far apart as in the
template is not looked for: that is the parameter that says what still counts as its text.  Each row is scanned by itself, whole;
no row moves, and the templates are a fixed parameter.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from .text import NOT_ALNUM, Chunk, Words, chunks

# The usual wording of license notices and headers.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License",
    "MIT-header": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "EPL-2.0-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "EPL-1.0-header": "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "CC0-1.0-header": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
}
#: Full texts, without lines that name a holder.
TEMPLATES |= {f"{p.stem}-text": p.read_text() for p in sorted(Path(__file__).with_name("licenses").glob("*.txt"))}
COVERAGE = 0.8
SLACK = 1.25  # words of text that may hold one word of template


def tokens(text: str) -> list[bytes]:
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.encode().lower())


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, ascending in the first place, that ascends in the second too."""
    tops: list[int] = []
    top_of: list[int] = []
    back: list[int] = []
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tops, b)
        back.append(top_of[k - 1] if k else -1)
        tops[k : k + 1], top_of[k : k + 1] = [b], [i]
    out, i = [], top_of[-1] if top_of else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """Aligned places (in a, in b), ascending; gaps wait on a stack, so depth is no matter."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i == j or k == m:
            continue
        once = Counter(a[i:j])
        there = Counter(b[k:m])
        place = {w: y for y, w in enumerate(b[k:m], k) if there[w] == 1}
        anchors = increasing([(x, place[w]) for x, w in enumerate(a[i:j], i) if once[w] == 1 and w in place])
        if not anchors:
            continue
        out += anchors
        ends = [(i - 1, k - 1), *anchors, (j, m)]
        todo += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(ends, ends[1:], strict=False)]
    return sorted(out)


def common(a: list[bytes], b: list[bytes]) -> int:
    """The length of the longest common subsequence, a bit for each place in b."""
    places: dict[bytes, int] = {}
    for i, w in enumerate(b):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(b)) - 1
    left = full
    for w in a:
        if m := places.get(w):
            hit = left & m
            left = (left + hit | left - hit) & full
    return len(b) - left.bit_count()


def trimmed(pairs: list[tuple[int, int]], size: int, need: int) -> list[tuple[int, int]]:
    """Pairs without stray ones at the ends: 2 * pairs / (words from first to last + size) is at its highest."""
    like = lambda i, j: 2 * (j - i) / (pairs[j - 1][0] - pairs[i][0] + 1 + size)
    n = len(pairs)
    first = max(range(n - need + 1), key=lambda i: (like(i, n), -i))
    return pairs[first : max(range(first + need, n + 1), key=lambda j: (like(first, j), j))]


def sort_of(name: str) -> str:
    return next((x for x in ("-header", "-text") if name.endswith(x)), "")


def best(found: list[tuple], length: dict[str, int]) -> list[tuple]:
    """Matches, less those that share half of their words with a better one of their sort."""
    like = lambda m: (2 * m[3] / (m[2] - m[1] + length[m[0]]), m[3])
    kept: list[tuple] = []
    for m in sorted(found, key=lambda m: (*like(m), m[0]), reverse=True):
        if not any(sort_of(m[0]) == sort_of(k[0]) and m[0] != k[0] and 2 * (min(m[2], k[2]) - max(m[1], k[1])) >= min(m[2] - m[1], k[2] - k[1]) for k in kept):
            kept.append(m)
    return kept


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE, slack: float = SLACK):
        self.templates = {name: tokens(t) for name, t in sorted(templates.items())}
        self.coverage, self.slack = coverage, slack
        vocabulary = sorted({w for t in self.templates.values() for w in t})
        data = np.frombuffer(b"".join(vocabulary), np.uint8)
        one = Chunk(pa.RecordBatch.from_pydict({"x": vocabulary}), data, np.concatenate([[0], np.cumsum([len(w) for w in vocabulary])]).astype(np.int64))
        h = Words(one, NOT_ALNUM, lower=False).hashes()
        order = np.argsort(h)
        self.hash = h[order]
        counts = {name: Counter(t) for name, t in self.templates.items()}
        self.count = {name: np.array([c[w] for w in vocabulary])[order] for name, c in counts.items()}
        self.member = {name: c > 0 for name, c in self.count.items()}
        self.length = {name: len(t) for name, t in self.templates.items()}

    @staticmethod
    def text(words: Words, a: int, b: int) -> list[bytes]:
        return [words.data[x:y].tobytes() for x, y in zip(words.start[a:b].tolist(), words.end[a:b].tolist(), strict=True)]

    def scan(self, chunk: Chunk) -> tuple[np.ndarray, list[list[tuple]]]:
        """Word counts, and each row's matches (name, first word, end word, aligned, coverage)."""
        words = Words(chunk, NOT_ALNUM)
        h = words.hashes()
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        known = self.hash[at] == h
        found: list[list[tuple]] = [[] for _ in range(chunk.n)]
        for name, template in self.templates.items():
            need = int(np.ceil(self.coverage * len(template)))
            width = int(self.slack * len(template)) + 2
            inside = np.concatenate([[0], np.cumsum(known & self.member[name][at])])
            last = np.minimum(np.arange(len(h)) + width, words.first[1:][words.doc]) if len(h) else np.empty(0, np.int64)
            count = inside[last] - inside[:-1]
            done = 0
            for s in np.flatnonzero((count >= need) & known & self.member[name][at]).tolist() if len(h) else []:
                if s < done:
                    continue
                whole = sort_of(name) == "-text"
                if whole:  # more than align() can find, as each template word counts as often as it stands there
                    most = np.minimum(np.bincount(at[s : last[s]][known[s : last[s]]], minlength=len(self.hash)), self.count[name]).sum()
                    if most < need:
                        done = min(s + int(need - most), int(words.first[words.doc[s] + 1]))  # the next row's words are no part of that bound
                        continue
                pairs = align(text := self.text(words, s, last[s]), template)
                if whole and len(pairs) < need:
                    done = min(s + max(1, need - common(text, template)), int(words.first[words.doc[s] + 1]))
                elif len(pairs) >= need and (whole or pairs[0][0] == 0):
                    d, at0 = words.doc[s], s
                    if whole:
                        pairs = trimmed(pairs, len(template), need)
                        begin = s + max(0, pairs[0][0] - pairs[0][1])
                        again = align(self.text(words, begin, last[begin]), template)
                        if len(again) > len(pairs):
                            pairs, at0 = trimmed(again, len(template), need), begin
                    a, b = at0 - words.first[d] + pairs[0][0], at0 - words.first[d] + pairs[-1][0] + 1
                    found[d].append((name, int(a), int(b), len(pairs), len(pairs) / len(template)))
                    done = at0 + pairs[-1][0] + 1
        return words.count, [best(f, self.length) for f in found]


def scan(documents: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, n_words, n_matches, licenses (sorted names, comma-joined), best_coverage, matches (array of structs)."""
    templates = templates or TEMPLATES
    held: list[Scanner] = []
    match = T.ArrayType(T.StructType().add("license", "string").add("first_word", "long").add("end_word", "long").add("aligned", "long").add("coverage", "double"))
    kind = pa.list_(pa.struct([("license", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("aligned", pa.int64()), ("coverage", pa.float64())]))

    def run(batches):
        if not held:
            held.append(Scanner(templates, coverage))
        for chunk in chunks(batches):
            n, found = held[0].scan(chunk)
            found = [sorted(f, key=lambda m: (m[1], m[0])) for f in found]
            rows = [[dict(zip(("license", "first_word", "end_word", "aligned", "coverage"), m, strict=True)) for m in f] for f in found]
            yield pa.RecordBatch.from_arrays([chunk.batch.column(0), pa.array(n, pa.int64()), pa.array([len(f) for f in found], pa.int64()), pa.array([",".join(sorted({m[0] for m in f})) for f in found], pa.string()), pa.array([max((m[4] for m in f), default=0.0) for f in found], pa.float64()), pa.array(rows, kind)], names=["doc_id", "n_words", "n_matches", "licenses", "best_coverage", "matches"])

    schema = T.StructType([documents.schema["doc_id"]]).add("n_words", "long").add("n_matches", "long").add("licenses", "string").add("best_coverage", "double").add("matches", match)
    return documents.select("doc_id", "text").mapInArrow(run, schema)
