"""Licence notices in texts, by conditional compression.

Blocks are windows of words around cue words (a licence's usual words in the notices' languages), as wide as
a template on both sides and across line breaks, so a notice may be wrapped. A template's block is compressed alone and with
the template as a zstandard raw dictionary: the more of the block it explains, the larger the reduction. Templates
whose reduction is at least SHARE of what they save on their own wording are candidates, ranked by it. A candidate is confirmed by its exact word difference from a stretch of the block: the
fewest words inserted, deleted and replaced, at most `edits` of them (one for templates of under five words, a word in twenty for long
ones). Words that tell a short template's licence from the others, and numbers, may not be lost. Of confirmed stretches that overlap, the one whose
compression its template reduces most stands, then that with fewer edits. Case and punctuation don't count, in sizes and wordings alike.

Templates are a parameter: (licence, notice) pairs of a bounded number; every task holds them. The default ones
are short mentions, headers of files and licence texts; of texts of thousands of words, their titles.
SPDX-License-Identifier tags need no template: each licence of the tag's expression is a finding by its name.
"""
from __future__ import annotations

import bisect
import functools
import hashlib
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in "
    "the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
    "Software, and to permit persons to whom the Software is furnished to do so"
)
_NO_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
    "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"
)
_COPIES = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = (
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution."
)
_BSD_3 = "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_GNU = "is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation"


def _bsd(ends: Sequence[str]) -> tuple[str, ...]:
    """The clauses with and without numbers, up to each end: what follows the second clause tells the licences apart."""
    return tuple(f"{_BSD} {n[0]}{_BSD_1} {n[1]}{_BSD_2} {n[2] if three else ''}{end}" for n in (("", "", ""), ("1. ", "2. ", "3. ")) for three, end in ((not e.startswith("THIS"), e) for e in ends))


def _gnu(name: str, kind: str, version: str) -> tuple[tuple[str, str], ...]:
    head = _GNU.format(kind=kind)
    return (
        (f"{name}-or-later", f"{head}, either version {version} of the License, or (at your option) any later version"),
        (f"{name}-only", f"{head}; version {version} of the License"),
        (f"{name}-only", f"{head}, version {version}"),
    )


_TEXTS: tuple[tuple[str, str], ...] = (
    ("MIT", f"{_MIT}, subject to the following conditions"),
    ("MIT", f"{_MIT}, subject to the following conditions: {_COPIES}. {_NO_WARRANTY}"),
    ("MIT-0", f"{_MIT}. {_NO_WARRANTY}"),
    *(("BSD-2-Clause", t) for t in _bsd(["THIS SOFTWARE IS PROVIDED BY"])),
    *(("BSD-3-Clause", t) for t in _bsd(["Neither the name of", f"Neither the name of the copyright holder {_BSD_3}", "The name of the author may not be used to endorse", "The names of its contributors may not be used to endorse"])),
    *(("BSD-4-Clause", t) for t in _bsd(["All advertising materials mentioning features or use of this software must display the following"])),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("0BSD", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED"),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions"),
    *_gnu("GPL-2.0", "", "2"), *_gnu("GPL-3.0", "", "3"), *_gnu("AGPL-3.0", "Affero ", "3"), *_gnu("LGPL-2.1", "Lesser ", "2.1"), *_gnu("LGPL-3.0", "Lesser ", "3"),
    ("LGPL-2.0-or-later", _GNU.format(kind="Library ") + "; either version 2 of the License, or (at your option) any later version"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("CC-BY-4.0", "You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-SA-4.0", "You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC-BY-NC-4.0", "You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
)
#: Usual short notices, headers and texts, by SPDX identifier.
NOTICES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "This project is licensed under the Apache License 2.0"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "Released under the CC0 1.0 Universal Public Domain Dedication"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("ISC", "Released under the ISC License"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("proprietary", "All rights reserved"),
    *_TEXTS,
)
CUES = r"licen[cs]|lizen|copyright|all[\W_]+rights|public[\W_]+domain|urheber|droits[\W_]+d.auteur|derechos|permission|redistribut|free[\W_]+to[\W_]+copy|legal[\W_]+code"
_ID = r"(?:DocumentRef-[A-Za-z0-9.\-]+:)?[A-Za-z0-9](?:[A-Za-z0-9.\-]*[A-Za-z0-9])?\+?"
_TAG = re.compile(r"SPDX-License-Identifier[ \t]*:", re.IGNORECASE)
_OPERAND = re.compile(rf"[ \t(]*({_ID}(?:[ \t]+WITH[ \t]+{_ID})?)[ \t)]*", re.IGNORECASE)
_OPERATOR = re.compile(r"(?:AND|OR)(?=[ \t(])", re.IGNORECASE)
_WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")


def _words(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    found = list(_WORD.finditer(text))
    return [m.group().lower() for m in found], [m.span() for m in found]


#: Templates of more words are texts; shorter ones are told apart by words of their own.
SHORT = 15
#: Part of what a template saves on its own wording that it must save on a block.
SHARE = 0.1
#: Letters that are compressed before every block, alike with and without a template: zstandard codes the literals of very short
#: texts in another way than those of longer ones, which would hide what a template saves.
_PAD = bytes(b"etaoinshrdlucmfwypvbgkqjxz "[x % 27] for x in hashlib.shake_128(b"pad").digest(300))
_MATCH, _REPLACE, _DELETE, _INSERT = range(4)
#: Weights of the edits: a stretch that has all of a template's words, parted by others, goes before a part of the template.
WEIGHT = {_REPLACE: 7, _DELETE: 5, _INSERT: 3}
_NEVER = 1 << 20


def own_words(templates: Sequence[tuple[str, list[str]]]) -> list[frozenset[str]]:
    """Of each (licence, words): words that a stretch may not lack, i.e. those with a digit, and in short templates those that no other licence's short ones have."""
    of: dict[str, set[str]] = {}
    for name, words in templates:
        if len(words) <= SHORT:
            for w in words:
                of.setdefault(w, set()).add(name)
    return [frozenset(w for w in words if any(c.isdigit() for c in w) or len(words) <= SHORT and len(of[w]) == 1) for _, words in templates]


def differences(block: Sequence[str], wanted: Sequence[str], kept: frozenset[str], most: int) -> list[tuple[int, int, list[tuple[int, str]]]]:
    """Stretches (first, end, edits) of block that are wanted but for at most `most` words inserted, deleted or replaced, none of kept lost.

    Edits are (kind, words) in order, those of least weight. Of stretches that overlap, that of least weight counts, then the one that ends first.
    """
    m = len(wanted)
    old, begun = [0] * (m + 1), [0] * (m + 1)
    for j in range(1, m + 1):
        old[j] = min(_NEVER, old[j - 1] + (_NEVER if wanted[j - 1] in kept else WEIGHT[_DELETE]))
    steps, ends = [], []
    for p, word in enumerate(block):
        new, start, step = [0] * (m + 1), [p + 1] * (m + 1), bytearray(m + 1)
        for j in range(1, m + 1):
            w = wanted[j - 1]
            lost = _NEVER if w in kept else 0
            best, kind, at = (old[j - 1], _MATCH, begun[j - 1]) if w == word else (old[j - 1] + lost + WEIGHT[_REPLACE], _REPLACE, begun[j - 1])
            if new[j - 1] + lost + WEIGHT[_DELETE] < best:
                best, kind, at = new[j - 1] + lost + WEIGHT[_DELETE], _DELETE, start[j - 1]
            if old[j] + WEIGHT[_INSERT] < best:
                best, kind, at = old[j] + WEIGHT[_INSERT], _INSERT, begun[j]
            new[j], start[j], step[j] = min(best, _NEVER), at, kind
        steps.append(step)
        old, begun = new, start
        if new[m] <= most * WEIGHT[_REPLACE]:
            ends.append((new[m], p + 1, start[m]))
    out: list[tuple[int, int, list[tuple[int, str]]]] = []
    for _, end, first in sorted(ends):
        if end > first and all(end <= a or z <= first for a, z, _ in out):
            edits = _trace(block, wanted, steps, first, end)
            if len(edits) <= most:
                out.append((first, end, edits))
    return sorted(out)


def _trace(block: Sequence[str], wanted: Sequence[str], steps: list[bytearray], first: int, end: int) -> list[tuple[int, str]]:
    edits, p, j = [], end, len(wanted)
    while j > 0:
        kind = steps[p - 1][j] if p > first else _DELETE
        if kind == _REPLACE:
            edits.append((kind, f"{wanted[j - 1]}>{block[p - 1]}"))
        elif kind == _DELETE:
            edits.append((kind, wanted[j - 1]))
        elif kind == _INSERT:
            edits.append((kind, block[p - 1]))
        p, j = p - (kind != _DELETE), j - (kind != _INSERT)
    return edits[::-1]


class Scanner:
    """Templates made ready; one a task."""

    def __init__(self, templates: Sequence[tuple[str, str]], edits: int, cues: str = CUES):
        self.templates = [(name, *_words(text)[:1], text) for name, text in templates]
        self.most = [edits and (min(1, edits) if len(words) < 5 else max(edits, len(words) // 20)) for _, words, _ in self.templates]
        self.kept = own_words([(name, words) for name, words, _ in self.templates])
        self.cue = re.compile(cues, re.IGNORECASE)
        self.plain = zstandard.ZstdCompressor(level=9, write_content_size=False, write_checksum=False)
        self.given = [
            zstandard.ZstdCompressor(
                level=9, dict_data=zstandard.ZstdCompressionDict(" ".join(words).encode().ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT),
                write_content_size=False, write_checksum=False, write_dict_id=False,
            )
            for words in [*(words for _, words, _ in self.templates), ["spdx-license-identifier"]]
        ]
        self.width = [len(words) + edits for _, words, _ in self.templates]
        self.reach = max(self.width, default=0)
        self.alone = functools.lru_cache(maxsize=20_000)(lambda words: len(self.plain.compress(self._raw(words))))
        self.saved = functools.lru_cache(maxsize=100_000)(self.reduction)  # notices repeat from text to text
        self.least = [max(1, int(SHARE * self.reduction(tuple(words), i))) for i, (_, words, _) in enumerate(self.templates)]

    def cues(self, text: str, spans: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
        """(first, end) of the words that each cue lies in."""
        ends = [z for _, z in spans]
        return [(bisect.bisect_right(ends, c.start()), bisect.bisect_left(spans, (c.end(),))) for c in self.cue.finditer(text)]

    @staticmethod
    def _raw(words: Sequence[str]) -> bytes:
        return _PAD + " ".join(words).encode("utf-8", "replace")

    def reduction(self, words: tuple[str, ...], i: int) -> int:
        """Bytes that template i saves (len(templates): the name of the tag)."""
        return self.alone(words) - len(self.given[i].compress(self._raw(words)))

    def reductions(self, words: Sequence[str]) -> list[int]:
        return [self.reduction(tuple(words), i) for i in range(len(self.templates))]

    def candidates(self, words: Sequence[str], cues: Sequence[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
        """(reduction, template, first, end) of the blocks around cues of which a template saves enough, those that it saves most of first."""
        found, there = set(), set(words)
        for i, (width, kept, least) in enumerate(zip(self.width, self.kept, self.least, strict=True)):
            if kept <= there:
                for first, end in dict.fromkeys((max(0, a - width), min(len(words), z + width)) for a, z in cues):
                    block = tuple(words[first:end])
                    if kept <= set(block) and (saved := self.saved(block, i)) >= least:
                        found.add((saved, i, first, end))
        return sorted(found, key=lambda c: (-c[0], c[1:]))

    def confirmed(self, words: list[str], cues: Sequence[tuple[int, int]]) -> list[tuple[int, int, int, int, list[tuple[int, str]]]]:
        """(first word, end, template, reduction, edits) of confirmed stretches, by place."""
        found = {}
        for _, i, first, end in self.candidates(words, cues):
            wanted = self.templates[i][1]
            first, end = max(0, first - self.width[i]), end + self.width[i]  # a notice may go on beyond the block
            for a, z, edits in differences(words[first:end], wanted, self.kept[i], self.most[i]):
                lost = sum(kind != _INSERT for kind, _ in edits)
                if lost * 20 <= 9 * len(wanted) and (saved := self.saved(tuple(words[first + a : first + z]), i)) > 0:
                    found[first + a, first + z, i] = (first + a, first + z, i, saved, edits)
        taken: list[tuple[int, int, int, int, list[tuple[int, str]]]] = []
        for f in sorted(found.values(), key=lambda f: (-f[3], len(f[4]), f[0], f[2], f[1])):
            if all(f[1] <= t[0] or t[1] <= f[0] for t in taken):
                taken.append(f)
        return sorted(taken)

    def tags(self, text: str) -> Iterator[dict]:
        """Findings of SPDX tags: the first from the tag on, others at their names."""
        for tag in _TAG.finditer(text):
            start, at = tag.start(), tag.end()  # start: of the tag, then None
            while (operand := _OPERAND.match(text, at)) is not None:
                name = " ".join(operand.group(1).split())
                if name.upper() not in ("NONE", "NOASSERTION"):
                    saved = self.saved(tuple(_words(f"SPDX-License-Identifier: {name}")[0]), len(self.templates))
                    yield {"start": operand.start(1) if start is None else start, "end": operand.end(1), "license": name, "saved": saved, **_counts([])}
                operator = _OPERATOR.match(text, operand.end())
                if operator is None:
                    break
                start, at = None, operator.end()

    def scan(self, text: str) -> tuple[int, list[dict]]:
        """Number of blocks, and the findings by place."""
        if not self.cue.search(text):
            return 0, []
        n, out = 0, list(self.tags(text))
        tagged = [(f["start"], f["end"]) for f in out]
        words, spans = _words(text)
        cues, end = self.cues(text, spans), -1
        for a, z in cues:
            n += a - self.reach > end or end < 0  # windows of the widest template that overlap are one block
            end = max(end, z + self.reach)
        for a, z, i, saved, edits in self.confirmed(words, cues):
            start, stop = spans[a][0], spans[z - 1][1]
            if all(stop <= b or e <= start for b, e in tagged):
                out.append({"start": start, "end": stop, "license": self.templates[i][0], "saved": saved, **_counts(edits)})
        return n, sorted(out, key=lambda f: f["start"])


def _counts(edits: list[tuple[int, str]]) -> dict:
    n = [sum(k == kind for k, _ in edits) for kind in (_INSERT, _DELETE, _REPLACE)]
    signs = {_INSERT: "+", _DELETE: "-", _REPLACE: "~"}
    return {"inserted": n[0], "deleted": n[1], "replaced": n[2], "difference": " ".join(signs[k] + w for k, w in edits)}


FINDINGS = "findings array<struct<start:int,end:int,license:string,saved:int,inserted:int,deleted:int,replaced:int,difference:string>>"


def scan_licenses(
    docs: DataFrame, templates: Sequence[tuple[str, str]] = NOTICES, edits: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every row of docs as (id_col, n_blocks, findings array of (start, end, license, saved, inserted, deleted, replaced, difference)).

    start and end are characters of the text; difference lists the edits of a template's words (+inserted -deleted ~wanted>found). Null and empty texts, and texts without cues, have no blocks and
    no findings; templates that tie in all else stand in the order given. Repeated rows and null ids are rows like any others; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("license", pa.string()), ("saved", pa.int32()), ("inserted", pa.int32()), ("deleted", pa.int32()), ("replaced", pa.int32()), ("difference", pa.string())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, edits)
        for rb in rows:
            scanned = [scanner.scan(t.as_py() or "") for t in rb.column(1)]
            n, found = [x for x, _ in scanned], [x for _, x in scanned]
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(n, pa.int64()), pa.array(found, pa.list_(span))], ["_id", "n_blocks", "findings"])

    # texts without a cue don't go to Python
    cued = F.when(F.lower(F.col(text_col)).rlike(CUES), F.col(text_col)).alias("_text")
    out = docs.select(F.col(id_col).alias("_id"), cued).mapInArrow(run, f"_id {kind}, n_blocks long, {FINDINGS}")
    return out.withColumnRenamed("_id", id_col)
