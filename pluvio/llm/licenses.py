"""License scans by conditional compression.

The words around each place that names a license, over as many lines as the longest confirmed
notice can have, are a candidate block: lines joined, comment marks dropped, neighbouring places in one block.
Each block, in lower case, is compressed on its own and with every template as a zstandard raw
dictionary; the templates that save bytes are candidates, and the exact differences
in wording between block and template confirm them: all but a bounded share of the
template's words, and every word that tells it apart from other licenses (names, conditions, versions), must
stand in the block, in order, within a span that has a bounded number of other words, none of which
contradicts it.  Words outside the span do not count, but for a negation right before it.  All confirmed notices are
reported; of those that share words, the one that differs least by its length.  An SPDX tag
states its license by itself and is reported as written.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """A notice: the license it states, its wording, and the words of it that no confirmed notice may lack."""

    license: str
    text: str
    telling: str


#: Fixed wordings of common license notices.
TEMPLATES = (
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0.", "apache 2.0"),
    Template("Apache-1.1", "Licensed under the Apache License, Version 1.1.", "apache 1.1"),
    Template("MIT", "Released under the MIT License.", "mit"),
    Template(
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction",
        "permission granted free of charge copy associated documentation without restriction",
    ),
    Template("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", "general public license 3"),
    Template("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", "general public license 2"),
    Template("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3.", "lesser general public license 3"),
    Template("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1.", "lesser general public license 2.1"),
    Template("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3.", "affero general public license 3"),
    Template("CC-BY-4.0", "Licensed under CC BY 4.0.", "cc by 4.0"),
    Template("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", "cc by nc 4.0"),
    Template("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", "cc by sa 4.0"),
    Template(
        "CC-BY-4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "creative commons attribution 4.0",
    ),
    Template(
        "CC-BY-NC-4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "creative commons attribution noncommercial 4.0",
    ),
    Template(
        "CC-BY-SA-4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "creative commons attribution sharealike 4.0",
    ),
    Template(
        "BSD-3-Clause",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "bsd license",
    ),
    Template(
        "BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission.",
        "neither nor contributors endorse promote derived without permission",
    ),
    Template(
        "BSD",  # the clauses all its kinds share
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer.",
        "redistribution source binary with or without permitted retain copyright disclaimer",
    ),
    Template("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla public 2.0"),
    Template("AllRightsReserved", "Copyright. All rights reserved.", "all rights reserved"),
)
#: Words that change what a notice says: a span that holds one its template lacks is another license, or none.
CONTRADICTING = frozenset(
    "not never no non lesser library affero nc noncommercial commercial sa sharealike nd noderivs noderivatives".split()
)
#: Words that deny a notice when they stand right before it.
DENYING = frozenset("not never".split())
#: How far before a notice a word can deny it.
DENIAL = 2
#: An SPDX tag and its expression, whose operators are capitals.
_NAME = r"\(?[\w+-]+(?:\.[\w+-]+)*\+?\)?"
SPDX = re.compile(rf"(?i:spdx-license-identifier):[ \t]*({_NAME}(?:[ \t]+(?:AND|OR|WITH)[ \t]+{_NAME})*)")
SPDX_LEAD = "spdx-license-identifier: "
#: What makes a place a candidate; its words may stand on several lines.
TRIGGER = r"(?i)licen[sc]|copyright|all\W+rights\W+reserved|spdx|permission\W+is\W+hereby|redistribution|cc\W+by\W"
#: Dropped from both ends of a line before lines are joined.
MARKS = " \t\r\f\v/*#;%!<>-|"
#: Share of the template's words that must stand in the block, and words their span may have besides for each of the template's.
MATCHED, EXTRA = 0.75, 3.0
#: Characters of a block beyond which it is compressed in overlapping windows.
WINDOW = 4096


@lru_cache(maxsize=8)
def _compressors(templates: tuple[Template, ...]):
    def dictionary(text: str):
        data = zstandard.ZstdCompressionDict(text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return zstandard.ZstdCompressor(level=19, write_content_size=False, dict_data=data)

    plain = zstandard.ZstdCompressor(level=19, write_content_size=False)
    return plain, [dictionary(t.text) for t in templates], dictionary(SPDX_LEAD + " ".join(t.license for t in templates))


#: Words are letters or a version number, whose final zeros say nothing.
_WORD = re.compile(r"[A-Za-z]+|\d+(?:\.\d+)*")


def _plain(word: str) -> str:
    word = word.lower()
    while word.endswith(".0"):
        word = word[:-2]
    return word


def _words(text: str) -> list[str]:
    return [_plain(w) for w in _WORD.findall(text)]


@lru_cache(maxsize=256)
def _wording(template: Template) -> tuple[tuple[str, ...], tuple[int, ...], frozenset[str]]:
    """The template's words, the places (from 1) of the telling ones, and the words that contradict it."""
    words = _words(template.text)
    telling, at = _words(template.telling), []
    for i, w in enumerate(words, 1):
        if len(at) < len(telling) and w == telling[len(at)]:
            at.append(i)
    if len(at) < len(telling):
        raise ValueError(f"telling words of {template.license} do not stand in its text, in order: {template.telling}")
    return tuple(words), tuple(at), CONTRADICTING - set(words)


@lru_cache(maxsize=8)
def reach(templates: tuple[Template, ...]) -> int:
    """Words that the span of a confirmed notice has at most, and the words before it that can deny it."""
    return max((math.floor((1 + EXTRA) * len(_words(t.text))) for t in templates), default=0) + DENIAL


def spans(template: Template, own: list[str]) -> list[tuple[int, int, int]]:
    """(first, last, words in common) of the confirmed spans of ``own``: for each last word the one
    that differs least from the template.  Exact: for each number of words in common
    the latest first word is kept, by prefix of the template; a telling word is never passed over.
    """
    words, telling, against = _wording(template)
    m, need = len(words), math.ceil(MATCHED * len(words))
    if sum((Counter(words) & Counter(own)).values()) < need or not {words[i - 1] for i in telling} <= set(own):
        return []
    at: dict[str, list[int]] = {}
    for i, w in enumerate(words, 1):
        at.setdefault(w, []).append(i)
    # contradicting words up to each place
    bad = np.cumsum([0, *[w in against for w in own]])
    borders = [0, *telling, m + 1]
    first = np.full((m + 1, m + 1), -1)  # by template prefix and words in common
    out = []
    for j, w in enumerate(own):
        if w not in at:
            continue
        first[: borders[1], 0] = j
        old = first.copy()
        for i in at[w]:
            np.maximum(first[i, 1:], old[i - 1, :-1], out=first[i, 1:])
        for a, b in zip(borders[:-1], borders[1:], strict=True):
            first[a:b] = np.maximum.accumulate(first[a:b], axis=0)
        best = None
        for k in range(m, need - 1, -1):
            f = int(first[m, k])
            fits = f >= 0 and j - f + 1 - k <= EXTRA * m and bad[j + 1] == bad[f] and DENYING.isdisjoint(own[max(f - DENIAL, 0) : f])
            if fits and (best is None or j - f - 2 * k < best[0]):
                best = (j - f - 2 * k, f, j, k)
        if best:
            out.append(best[1:])
    return out


def _sizes(block: str, templates: tuple[Template, ...]) -> list[tuple[int, int, int, dict[int, int]]]:
    """(start, end, bytes alone, bytes with each template's dictionary that saves any) of the windows of the block."""
    plain, known, _ = _compressors(templates)
    out = []
    for at in range(0, max(len(block), 1), WINDOW // 2):
        data = block[at : at + WINDOW].lower().encode()
        alone = len(plain.compress(data))
        sizes = [len(c.compress(data)) for c in known]
        out.append((at, at + WINDOW, alone, {i: x for i, x in enumerate(sizes) if x < alone}))
        if at + WINDOW >= len(block):
            break
    return out


def _tags(block: str, templates: tuple[Template, ...]) -> list[tuple[int, str, int, int, int, int]]:
    plain, _, tag = _compressors(templates)
    out = []
    for m in SPDX.finditer(block):
        data = m.group().lower().encode()
        out.append((m.start(), m.group(1), len(plain.compress(data)), len(tag.compress(data)), 0, 0))
    return out


def scan_block(block: str, templates: tuple[Template, ...] = TEMPLATES) -> list[tuple[int, str, int, int, int, int]]:
    """All notices: (first character, license, plain bytes, bytes with its dictionary, template words missing, words extra in the span)."""
    windows = _sizes(block, templates)
    at = [(m.start(), m.end(), _plain(m.group())) for m in _WORD.finditer(block)]
    own = [w for _, _, w in at]
    found = []
    for i in sorted({n for *_, saved in windows for n in saved}):
        m = len(_wording(templates[i])[0])
        for first, last, k in spans(templates[i], own):
            begin, end = at[first][0], at[last][1]
            # the window that holds most of the notice; windows that save nothing say nothing about it
            held = [(min(end, e) - max(begin, b), alone - saved[i], alone, saved[i]) for b, e, alone, saved in windows if i in saved and b < end and begin < e]
            if held:
                _, _, alone, size = max(held)
                missing, extra = m - k, last - first + 1 - k
                found.append(((missing + extra) / m, size - alone, first, last, extra, (begin, templates[i].license, alone, size, missing, extra)))
    taken = np.zeros(len(own), bool)
    out = []
    for _, _, first, last, extra, row in sorted(found):
        # words of a notice that stands inside another one are extra words of the outer one
        if not (taken[first] or taken[last] or taken[first : last + 1].sum() > extra):
            taken[first : last + 1] = True
            out.append(row)
    return sorted(out + _tags(block, templates))


def blocks(text: str, reach: int, trigger: str = TRIGGER) -> list[tuple[list[int], list[int], str]]:
    """Candidate blocks: first character and number (from 0) of each of its lines, and the joined lines."""
    lines = [x.strip(MARKS) for x in text.split("\n")]
    starts = np.cumsum([0, *[len(x) + 1 for x in lines]])[:-1]
    joined = " ".join(lines)
    hits = [(m.start(), m.end()) for m in re.finditer(trigger, joined)]
    if not hits:
        return []
    at = np.array([(m.start(), m.end()) for m in _WORD.finditer(joined)])
    near: list[list[int]] = []
    for begin, end in hits:  # no confirmed notice reaches farther
        a, b = np.searchsorted(at[:, 1], begin, "right"), np.searchsorted(at[:, 0], end) - 1
        a, b = max(int(a) - reach, 0), min(int(b) + reach, len(at) - 1)
        if near and a <= near[-1][1] + 1:
            near[-1][1] = b
        else:
            near.append([a, b])
    out = []
    for a, b in near:
        # to the line's or the next word's border, so that punctuation stays
        begin = 0 if a == 0 else int(at[a, 0])
        end = len(joined) if b == len(at) - 1 else int(at[b + 1, 0])
        i, j = int(np.searchsorted(starts, begin, "right")) - 1, int(np.searchsorted(starts, end))
        out.append(((starts[i:j] - begin).tolist(), list(range(i, j)), joined[begin:end].rstrip()))
    return out


_FOUND = "_id long, line int, license string, plain_bytes int, template_bytes int, missing_words int, extra_words int, block string"


def _scan(batches: Iterator[pa.RecordBatch], templates: tuple[Template, ...], trigger: str) -> Iterator[pa.RecordBatch]:
    names = ["_id", "line", "license", "plain_bytes", "template_bytes", "missing_words", "extra_words", "block"]
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
    far = reach(templates)
    for batch in batches:
        rows = []
        for key, text in zip(*(batch.column(c).to_pylist() for c in ("_id", "_text")), strict=True):
            for starts, numbers, block in blocks(text, far, trigger):
                for begin, *row in scan_block(block, templates):
                    rows.append((key, numbers[bisect_right(starts, begin) - 1], *row, block))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def license_blocks(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES, trigger: str = TRIGGER
) -> DataFrame:
    """License notices: id, line (from 0), license, plain_bytes, template_bytes, missing_words, extra_words, block.

    One row per confirmed notice, with the line it begins on and the block it stands in.
    ``templates`` are the notices looked for, at places that ``trigger`` finds.
    Null and empty texts have none; repeated rows are
    scanned each; a null identifier stays null; an empty table gives an empty result; long lines are read
    whole.  Other columns of ``docs`` are not read.
    """
    templates = tuple(templates)
    text = F.col(text_col).cast("string")
    found = docs.where(text.rlike(trigger)).select(F.col(id_col).cast("long").alias("_id"), text.alias("_text"))
    return found.mapInArrow(lambda it: _scan(it, templates, trigger), _FOUND).withColumnRenamed("_id", id_col)
