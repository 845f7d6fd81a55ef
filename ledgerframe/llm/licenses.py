"""License scans by conditional compression.

Candidate blocks are the licensing cues of whole texts with as many words on both sides as the longest notice has. A block is compressed alone and
with each template as a zstandard raw dictionary, in pieces as long as the template needs; the relative size reduction of the best piece ranks the
templates, and those without one are out. The others, all of them, are confirmed in this order by their exact wording: the template's words must run
through the block in order, but for at most `missing` of them, and none of the words that tell licenses apart (version numbers, `NC`, `not`, ...) may
be among the missing; where the longest common runs do not show it, all alignments are gone through. The relative reduction of the confirmed words
is a span's gain; of overlapping spans the one that saves more bytes stays.

Positions are code points of the whole text, end exclusive. Null and empty texts: no span. Null doc_id stays null; every row gives one row, repeated
rows each. Extra columns are ignored. Long blocks are cut at MAX_BLOCK words with REACH words overlapping, so that no text is left out.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Public license notices, by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related rights to this work.", "Released under CC0 1.0."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-NC-SA-4.0": ("Licensed under CC BY-NC-SA 4.0.",),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.",),
}
#: Words whose absence makes another license of it.
TELLING = {"not", "neither", "nor", "without", "nc", "nd", "sa", "noncommercial", "sharealike", "noderivatives", "lesser", "affero", "mit", "apache", "bsd", "gnu", "mozilla", "cc", "cc0", "by", "public", "domain", "clause"}

_CUES = ("licen", "permission", "redistribut", "copyright", "public domain", "creative commons", "warrant", "free software", "released under")
CUE = re.compile("|".join(_CUES).replace(" ", "[^A-Za-z0-9]+"), re.IGNORECASE)
WORD = re.compile(r"[A-Za-z0-9]+")
#: Words around a cue: as far as a notice of the longest template can reach. Words of a block, at most.
REACH = 5 + max(3 * len(WORD.findall(t)) // 2 for texts in TEMPLATES.values() for t in texts)
MAX_BLOCK = 4 * REACH
MISSING = 0.1


class Templates:
    """The templates with their words and compressors, built once per process."""

    _own: Templates | None = None

    def __init__(self) -> None:
        self.plain = zstandard.ZstdCompressor(level=9, write_content_size=False)
        self.rows, self.sets = [], []
        for name, texts in TEMPLATES.items():
            for text in texts:
                words = [w.lower() for w in WORD.findall(text)]
                known = zstandard.ZstdCompressionDict(" ".join(words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                self.rows.append((name, words, zstandard.ZstdCompressor(level=9, dict_data=known, write_content_size=False, write_dict_id=False)))
                self.sets.append(set(self.rows[-1][1]))

    @classmethod
    def get(cls) -> Templates:
        if cls._own is None:
            cls._own = cls()
        return cls._own


def blocks(text: str, spots: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of words (numbers of spots, end exclusive): every cue with REACH words on both sides, joined where they overlap."""
    out: list[list[int]] = []
    starts = [a for a, _ in spots]
    for cue in CUE.finditer(text):
        at = bisect_right(starts, cue.start()) - 1
        a, b = max(0, at - REACH), min(len(spots), at + REACH)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    # Neighbouring cuts share REACH words, so that each notice lies whole in one of them.
    return [(at, min(b, at + MAX_BLOCK)) for a, b in out for at in range(a, max(a + 1, b - REACH), MAX_BLOCK - REACH)]


def longest(template: list[str]) -> int:
    """Words that a notice of the template's wording may have, at most."""
    return 3 * len(template) // 2 + 4


@lru_cache(1024)
def size_alone(low: bytes) -> int:
    """Kept for the templates that share a length, and so the pieces of a block."""
    return len(Templates.get().plain.compress(low))


def sizes(words: list[str], i: int) -> tuple[int, int]:
    """Compressed bytes of the words, one space between: alone, and with template i as the dictionary."""
    low = " ".join(words).encode()
    return size_alone(low), len(Templates.get().rows[i][2].compress(low))


def reduction(words: list[str], i: int) -> float:
    alone, given = sizes(words, i)
    return (alone - given) / alone


def close_pieces(words: list[str], i: int, missing: float = MISSING) -> Iterator[list[str]]:
    """Every run of words that could be a whole notice of template i: it starts and ends on its words, and has so many of them."""
    (_, template, _), own = Templates.get().rows[i], Templates.get().sets[i]
    ends = [j for j, w in enumerate(words) if w in own]
    for a in ends:
        for b in ends:
            if (1 - missing) * len(template) <= b + 1 - a <= longest(template) and len(own.difference(words[a : b + 1])) <= missing * len(template):
                yield words[a : b + 1]


def ranked(words: list[str], missing: float = MISSING) -> list[tuple[float, int]]:
    """(reduction, template) of a block, best first: the best piece's relative size reduction, for every template that has one.

    In a whole block, what a short notice saves is lost among the rest. So a template's pieces are twice its longest notice, half of it overlapping:
    each notice lies whole in one. Where no piece gets smaller, the entropy coder may still hide a few bytes, and every run that could be a notice is
    compressed by itself. So whatever would gain by itself is ranked."""
    out = []
    for i, (_, template, _) in enumerate(Templates.get().rows):
        most = longest(template)
        pieces = [words[at : at + 2 * most] for at in range(0, max(1, len(words) - most), most)]
        best = max(reduction(p, i) for p in pieces)
        if best <= 0:
            best = next((r for p in pieces for q in close_pieces(p, i, missing) if (r := reduction(q, i)) > 0), best)
        if best > 0:
            out.append((best, i))
    return sorted(out, key=lambda r: (-r[0], r[1]))


def confirm(words: list[str], template: list[str], missing: float = MISSING) -> tuple[int, int, list[str]] | None:
    """First and last word of the block that the template's words cover, and the missing words; None if it is not this wording.

    The words around a notice are of no weight: only those near its longest run are aligned, and chance hits at the ends are left out."""
    size, most = len(template), longest(template)
    if sum(w not in words for w in set(template)) > missing * size:
        return None
    run = SequenceMatcher(None, words, template, autojunk=False).find_longest_match()
    at = max(0, int(run.a - run.b - size // 2 - 4))
    near = words[at : run.a - run.b + size + size // 2 + 4]
    pairs = SequenceMatcher(None, near, template, autojunk=False).get_matching_blocks()[:-1]
    best = None
    for i, p in enumerate(pairs):
        hits = 0
        for q in pairs[i:]:
            hits += q.size
            first, last = p.a, q.a + q.size
            rank = (2 * hits - (last - first), -first)
            if last - first > most or size - hits > missing * size or best and rank <= best[0]:
                continue
            hit = {j for r in pairs[i:] if r.a < last for j in range(r.b, r.b + r.size)}
            lost = [w for j, w in enumerate(template) if j not in hit]
            if not any(w in TELLING or w.isdigit() for w in lost) and not any(w in TELLING for w in near[first:last] if w not in template):
                best = rank, (at + first, at + last, lost)
    return best and best[1]


def aligned(words: list[str], template: list[str], missing: float = MISSING) -> tuple[int, int, list[str]] | None:
    """confirm() over all alignments, for what the longest runs first do not find: the best notice of this wording in the words, if there is one."""
    size, most, spare = len(template), longest(template), int(missing * len(template))
    must = [w in TELLING or w.isdigit() for w in template]
    places: dict[str, list[int]] = {}
    for j in reversed(range(size)):
        places.setdefault(template[j], []).append(j)
    best = None
    # By last template word found and number of lost ones: the latest first word, with what was lost; the latest makes the shortest notice.
    latest: dict[tuple[int, int], tuple[int, tuple[int, ...]]] = {}
    for p, word in enumerate(words):
        if word in TELLING and word not in places:
            latest.clear()
        for j in places.get(word, ()):  # from the end, so that no word of the block stands for two of the template
            for skip in range(min(spare, j) + 1):
                if skip and must[j - skip]:
                    break
                gap, last = tuple(range(j - skip, j)), j - skip - 1
                for lost in range(spare - skip + 1):
                    old = latest.get((last, lost)) if last >= 0 else None if lost else (p, ())
                    if old and old[0] > latest.get((j, lost + skip), (-1,))[0]:
                        latest[j, lost + skip] = old[0], old[1] + gap
            if any(must[j + 1 :]):
                continue
            for lost in range(spare - (size - 1 - j) + 1):
                first, gone = latest.get((j, lost), (-1, ()))
                rank = (2 * (size - lost - (size - 1 - j)) - (p + 1 - first), -first)
                if first >= 0 and p + 1 - first <= most and (not best or rank > best[0]):
                    best = rank, (first, p + 1, [template[i] for i in (*gone, *range(j + 1, size))])
    return best and best[1]


def confirm_all(words: list[str], template: list[str], missing: float = MISSING) -> list[tuple[int, int, list[str]]]:
    """confirm(), or else aligned(), again and again on the words that are left on both sides of each hit."""
    out, open_parts = [], [(0, len(words))]
    while open_parts:
        a, b = open_parts.pop()
        part = words[a:b]
        if b - a < (1 - missing) * len(template) or sum(w not in part for w in set(template)) > missing * len(template):
            continue
        hit = confirm(part, template, missing) or aligned(part, template, missing)
        if hit:
            first, last, lost = hit
            out.append((a + first, a + last, lost))
            open_parts += [(a, a + first), (a + last, b)]
    return out


def find(text: str | None, missing: float = MISSING) -> list[tuple[int, int, str, float, int]]:
    """(start, end, license, gain, missing words) of a whole text; of overlapping spans the one that saves more bytes stays."""
    if not text or not CUE.search(text):
        return []
    known, found = Templates.get(), []
    spots = [m.span() for m in WORD.finditer(text)]
    for a, b in blocks(text, spots):
        words = [text[x:y].lower() for x, y in spots[a:b]]
        for _, i in ranked(words, missing):
            name, template, _ = known.rows[i]
            for first, last, lost in confirm_all(words, template, missing):
                # The gain is that of the notice's own words: in a long block, what a short notice saves is lost among the rest.
                alone, given = sizes(words[first:last], i)
                if given < alone:
                    found.append((spots[a + first][0], spots[a + last - 1][1], name, round((alone - given) / alone, 4), len(lost), alone - given))
    out: list[tuple] = []
    for s in sorted(set(found), key=lambda s: (-s[5], s[4], s[0], s[2], -s[3])):
        if all(s[1] <= o[0] or s[0] >= o[1] for o in out):
            out.append(s)
    return [s[:5] for s in sorted(out)]


def scan(docs: DataFrame, missing: float = MISSING) -> DataFrame:
    """One row per row of docs(doc_id, text): spans array<struct<start, end, license, gain, missing>> by start."""

    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("license", pa.string()), ("gain", pa.float64()), ("missing", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("start", "end", "license", "gain", "missing")
        for batch in batches:
            spans = [[dict(zip(names, s, strict=True)) for s in find(t, missing)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, spans array<struct<start int, end int, license string, gain double, missing int>>")
