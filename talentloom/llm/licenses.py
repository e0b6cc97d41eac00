"""License scans by conditional compression.

A candidate block is compressed alone and once with each license template as a zstandard raw
dictionary: the more a template says what the block says, the more bytes it saves. Templates are
taken in the order of that reduction and confirmed by their exact wording, as the least number of
word insertions, deletions and replacements that turn the template into some part of the block.
Licenses share wording, and the order decides between them: words that a license has won go to no license that saves less.
One of those is looked for elsewhere in the block, as long as it can be confirmed, and so is a winner's next place. A template is
passed over without alignment only if so many of its words are missing from the block that it can't be confirmed.

A block is the words around a trigger word or around an anchor, across line ends, with as many before
and after as the longest template may take; blocks that meet are joined. Anchors are the parts of a
template cut into one more than the words that may differ: one of them stands whole in any wording
that is confirmed, so the blocks hold every such wording of the text. Null and empty texts have no
block. Texts are scanned whole; only the blocks of a very long one are compressed. Templates that save alike are
looked at in the order listed; of a license's templates the least number of differing words counts. Repeated rows are
repeated rows of the result; an empty table gives an empty result. Extra columns are left out.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from talentloom.llm.common import field_sql, map_arrow

#: Notices by SPDX identifier: fixed values, as publishers write them.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": ("GNU Affero General Public License Version 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License"),
    "Apache-2.0": (
        "Apache License Version 2.0",
        "Apache License Version 2.0, January 2004",
        "Licensed under the Apache License, Version 2.0.",
        "You may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "BSD-2-Clause": ("BSD 2-Clause License", "Released under the BSD 2-Clause License."),
    "BSD-3-Clause": (
        "BSD 3-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Released under the BSD 3-Clause License.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",),
    "GPL-3.0": ("GNU General Public License Version 3", "This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "LGPL-3.0": ("GNU Lesser General Public License Version 3", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",),
    "LicenseRef-All-Rights-Reserved": ("All rights reserved.",),
    "MIT": (
        "The MIT License (MIT)",
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.",
    ),
    "MPL-2.0": ("Mozilla Public License Version 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "Zlib": ("This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",),
}
TRIGGER = re.compile(r"licen[cs]e|copyright|redistribut|permission is hereby|free software|all rights reserved|creative commons|spdx", re.I)
WORD = re.compile(r"[^\W_]+(?:[.\-/'][^\W_]+)*")
#: Words that may differ, as a share of the template's, to be confirmed.
MOST_DIFFERENT = 0.1
LEVEL = 9


def words_of(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


@cache
def _anchors() -> tuple[int, list[tuple[list[str], re.Pattern]]]:
    """Most words of a confirmed wording; each anchor's words and pattern."""
    context, anchors = 0, {}
    for notices in TEMPLATES.values():
        for wording in map(words_of, notices):
            most = int(MOST_DIFFERENT * len(wording))
            context = max(context, len(wording) + most)
            cuts = [len(wording) * k // (most + 1) for k in range(most + 2)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                anchors[tuple(wording[a:b])] = re.compile(r"[\W_]+".join(map(re.escape, wording[a:b])), re.I)
    return context, [(list(words), pattern) for words, pattern in anchors.items()]


def candidate_blocks(text: str | None) -> list[str]:
    """The words around each trigger and anchor, joined where they meet."""
    if not text:
        return []
    context, anchors = _anchors()
    low = text.lower()
    patterns = [TRIGGER, *(pattern for words, pattern in anchors if all(w in low for w in words))]
    hits = sorted(m.span() for p in patterns for m in p.finditer(text))
    if not hits:
        return []
    starts, ends = zip(*(m.span() for m in WORD.finditer(text)), strict=True)
    spans: list[list[int]] = []
    for start, end in hits:
        a = max(0, bisect_right(starts, start) - 1 - context)
        b = min(len(starts), bisect_left(starts, end) + context)
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(b, spans[-1][1])
        else:
            spans.append([a, b])
    return [text[starts[a] : ends[b - 1]] for a, b in spans]


@cache
def _compressors() -> tuple[zstandard.ZstdCompressor, list[tuple[str, list[str], zstandard.ZstdCompressor]]]:
    options = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    out = []
    for name, notices in TEMPLATES.items():
        for notice in notices:
            held = zstandard.ZstdCompressionDict(" ".join(words_of(notice)).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            out.append((name, words_of(notice), zstandard.ZstdCompressor(dict_data=held, **options)))
    return zstandard.ZstdCompressor(**options), out


@cache
def _vocabulary() -> frozenset[str]:
    return frozenset(w for notices in TEMPLATES.values() for n in notices for w in words_of(n))


def reductions(block: list[str]) -> list[tuple[float, int]]:
    """(share of bytes saved, template number), the largest first; of equal ones the shorter template, which says less that isn't there.

    Words that no template has stand as one blank each: no template saves on them, and what they cost would only add noise.
    """
    plain, templates = _compressors()
    raw = " ".join(w if w in _vocabulary() else "" for w in block).encode("utf-8", "surrogatepass")
    alone = len(plain.compress(raw))
    saved = [((alone - len(c.compress(raw))) / alone, k) for k, (_, _, c) in enumerate(templates)]
    return sorted(saved, key=lambda x: (-x[0], len(templates[x[1]][1]), x[1]))


def best_place(template: list[str], block: list[str]) -> tuple[int, int]:
    """Fewest word edits that turn the template into some run of the block's words, and where the first such run ends."""
    code = {w: k for k, w in enumerate(dict.fromkeys(template))}
    b = np.array([code.get(w, -1) for w in block], np.int64)
    row, steps = np.zeros(len(b) + 1, np.int64), np.arange(len(b) + 1)
    for i, w in enumerate(template, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (b != code[w]), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min()), int(row.argmin())


def wording_differences(template: list[str], block: list[str]) -> int:
    return best_place(template, block)[0]


def winners(block: list[str], order: list[int]) -> list[tuple[str, int]]:
    """(license, differing words) of the places that templates win when they are taken in this order."""
    _, templates = _compressors()
    held, won = set(block), []
    for k in order:
        name, wording, _ = templates[k]
        most, n = int(MOST_DIFFERENT * len(wording)), len(wording)
        # each word that the block lacks is one difference at least
        if sum(w not in held for w in wording) > most:
            continue
        view = list(block)
        while True:
            different, end = best_place(wording, view)
            if different > most:
                break
            rivals = [(a, b) for other, _, a, b in won if other != name and 2 * (min(b, end) - max(a, end - n)) > n]
            if not rivals:
                won.append((name, different, end - n, end))
                rivals = [(end - n, end)]
            for a, b in rivals:
                view[max(a, 0) : b] = [""] * (b - max(a, 0))
    return [(name, different) for name, different, _, _ in won]


def scan(text: str | None) -> tuple[int, list[tuple[str, int]]]:
    """Candidate blocks, and (license, fewest differing words) of the confirmed ones."""
    blocks, found = candidate_blocks(text), {}
    for words in map(words_of, blocks):
        for name, different in winners(words, [k for _, k in reductions(words)]):
            found[name] = min(different, found.get(name, different))
    return len(blocks), sorted(found.items())


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_blocks, n_licenses, licenses (comma-joined, sorted), n_different (words, over all of them)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, found = zip(*map(scan, batch.column("text").to_pylist()), strict=True)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array([len(f) for f in found], pa.int64()), pa.array([",".join(k for k, _ in f) for f in found], pa.string()), pa.array([sum(d for _, d in f) for f in found], pa.int64())],
            ["doc_id", "n_blocks", "n_licenses", "licenses", "n_different"],
        )

    return map_arrow(docs.select("doc_id", "text"), run, f"{field_sql(docs, 'doc_id')}, n_blocks long, n_licenses long, licenses string, n_different long")
