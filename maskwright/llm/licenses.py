"""Operator 9, license scans by conditional compression with zstandard."""

from __future__ import annotations

import bisect
import functools
import re
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared as S

#: Published full texts and file headers, by SPDX identifier (fixed texts; holders and years left out).
WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software'
BSD_TWO = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
BSD_THREE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
ISC_END = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
TEXTS = {
    "MIT": [GRANT + ", and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + WARRANTY, GRANT],
    "MIT-0": [GRANT + ", and to permit persons to whom the Software is furnished to do so. " + WARRANTY],
    "BSD-1-Clause": [BSD_TWO[: BSD_TWO.index("2. ")] + BSD_END],
    "BSD-2-Clause": [BSD_TWO + BSD_END],
    "BSD-3-Clause": [BSD_TWO + BSD_THREE + BSD_END],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + ISC_END, "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "0BSD": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + ISC_END],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ],
    "BSL-1.0": [
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, '
        "and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
        "Distributed under the Boost Software License, Version 1.0.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "This is free and unencumbered software released into the public domain.",
    ],
    "PostgreSQL": ["Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies."],
    "NTP": ["Permission to use, copy, modify, and distribute this software and its documentation for any purpose with or without fee is hereby granted, provided that the above copyright notice appears in all copies and that both the copyright notice and this permission notice appear in supporting documentation"],
    "WTFPL": ["Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."],
    "Apache-2.0": ['Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "MPL-1.1": ['The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License.'],
    "EPL-1.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at"],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"],
    "CDDL-1.0": ['The contents of this file are subject to the terms of the Common Development and Distribution License (the "License"). You may not use this file except in compliance with the License.'],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "OFL-1.1": ["This Font Software is licensed under the SIL Open Font License, Version 1.1."],
}
#: Names under which licenses are mentioned: with versions, and without (fixed names).
VERSIONED = (
    ("Apache License", "Apache-{}", ("1.1", "2.0")), ("Mozilla Public License", "MPL-{}", ("1.1", "2.0")), ("Eclipse Public License", "EPL-{}", ("1.0", "2.0")), ("European Union Public License", "EUPL-{}", ("1.1", "1.2")),
    ("Common Development and Distribution License", "CDDL-{}", ("1.0", "1.1")), ("Artistic License", "Artistic-{}", ("1.0", "2.0")), ("Boost Software License", "BSL-{}", ("1.0",)), ("SIL Open Font License", "OFL-{}", ("1.0", "1.1")),
    ("Open Software License", "OSL-{}", ("2.1", "3.0")), ("Academic Free License", "AFL-{}", ("2.1", "3.0")), ("Universal Permissive License", "UPL-{}", ("1.0",)),
)
UNVERSIONED = (
    ("MIT License", "MIT"), ("ISC License", "ISC"), ("BSD 2-Clause License", "BSD-2-Clause"), ("BSD 3-Clause License", "BSD-3-Clause"), ("zlib License", "Zlib"),
    ("PostgreSQL License", "PostgreSQL"), ("Microsoft Public License", "MS-PL"), ("Microsoft Reciprocal License", "MS-RL"),
)
GNU = (("GNU General Public License", "GPL", ("1", "2", "3")), ("GNU Library General Public License", "LGPL", ("2",)), ("GNU Lesser General Public License", "LGPL", ("2.1", "3")), ("GNU Affero General Public License", "AGPL", ("3",)))
CREATIVE = (("Attribution", "BY"), ("Attribution-ShareAlike", "BY-SA"), ("Attribution-NonCommercial", "BY-NC"), ("Attribution-NoDerivatives", "BY-ND"), ("Attribution-NoDerivs", "BY-ND"), ("Attribution-NonCommercial-ShareAlike", "BY-NC-SA"), ("Attribution-NonCommercial-NoDerivatives", "BY-NC-ND"))
PORTS = (("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International"))


def notice_texts() -> dict[str, list[str]]:
    """Full texts and headers, and the notices that name a license and its version, made by rule."""
    out = {k: list(v) for k, v in TEXTS.items()}

    def add(name: str, *texts: str) -> None:
        out.setdefault(name, []).extend(texts)

    for title, name, versions in VERSIONED:
        for v in versions:
            add(name.format(v), f"licensed under the {title}, Version {v}", f"under the terms of the {title} {v}")
    for title, name in UNVERSIONED:
        add(name, f"released under the {title}", f"licensed under the {title}", f"under the terms of the {title}")
    for title, name, versions in GNU:
        for v in versions:
            full = v if "." in v else v + ".0"
            for short in (f"{name} version {v}", f"{name} v{v}", f"{name}v{v}", f"{name}-{v}"):
                add(f"{name}-{full}-only", f"licensed under the {short}", f"licensed under the {short} only", f"under the {short} license")
                add(f"{name}-{full}-or-later", f"licensed under the {short} or later", f"licensed under the {short} or any later version", f"under the {short} or later license")
            add(f"{name}-{full}-only", f"licensed under the {title} v{full} only", f"licensed under the {title}, version {v} only")
            add(f"{name}-{full}-or-later", f"licensed under the {title} v{full} or later")
            start = f"free software: you can redistribute it and/or modify it under the terms of the {title} as published by the Free Software Foundation, version {v}"
            add(f"{name}-{full}-only", f"This program is {start}.", f"This program is {start} of the License.")
            add(f"{name}-{full}-only", f"licensed under the {title}, version {v}", f"under the terms of the {title} version {v} as published by the Free Software Foundation")
            head = f"free software: you can redistribute it and/or modify it under the terms of the {title} as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version."
            add(f"{name}-{full}-or-later", f"licensed under the {title}, version {v} or later", f"licensed under the {title}, version {v} or any later version", f"This program is {head}")
    for title, name in CREATIVE:
        for v, port in PORTS:
            add(f"CC-{name}-{v}", f"licensed under a Creative Commons {title} {v} {port} License", f"licensed under the Creative Commons {title} {v} License", f"licensed under CC {name} {v}")
    add("CC0-1.0", "Licensed under CC0 1.0", "Creative Commons CC0 1.0 Universal Public Domain Dedication license")
    for name in list(out):
        add(name, f"SPDX-License-Identifier: {name}")
    return out


def joined_texts() -> dict[str, list[str]]:
    """What names a further license right after a notice: "... or the Apache License, Version 2.0"."""
    out: dict[str, list[str]] = {}
    for title, name, versions in VERSIONED:
        for v in versions:
            out.setdefault(name.format(v), []).extend([f"or the {title}, Version {v}", f"or {title} {v}", f"or the {title} {v}"])
    for title, name in UNVERSIONED:
        out.setdefault(name, []).extend([f"or the {title}", f"or {title}"])
    for title, name, versions in GNU:
        for v in versions:
            full = v if "." in v else v + ".0"
            out.setdefault(f"{name}-{full}-only", []).append(f"or the {title}, version {v}")
            out.setdefault(f"{name}-{full}-or-later", []).append(f"or the {title}, version {v} or later")
    return out


WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
#: Words that must agree in number and order: negations, and words that tell one license from another. Numbers must agree, too.
NEGATIONS = frozenset("not never neither nor no cannot isn't without".split())
TELLING = frozenset(
    "apache mozilla eclipse european development artistic boost sil font academic open universal mit isc bsd zlib postgresql microsoft reciprocal gnu library lesser affero later only "
    "creative cc attribution attribution-sharealike attribution-noncommercial attribution-noderivatives attribution-noderivs attribution-noncommercial-sharealike attribution-noncommercial-noderivatives "
    "by by-sa by-nc by-nd by-nc-sa by-nc-nd sharealike noncommercial noderivatives noderivs unlicense ntp wtfpl ms-pl ms-rl gpl lgpl agpl".split()
)
#: What ends a sentence: a negation before a notice counts within its own.
SENTENCE = re.compile(r"[.!?;:](?=\s)|\n\s*\n")
TAG = "spdx-license-identifier"
NUMBER = re.compile("[0-9]")
#: Least share of a block's size that its best template must save, and most words that may differ by template word.
LEAST_SAVED, MOST_DIFFERENT = 0.1, 0.1
#: Words in a row by which a template is tried; templates too short to keep so many under all edits allowed are tried at each pair, or word.
GRAMS = (3, 2, 1)


def _words(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    found = list(WORD.finditer(text))
    return [m[0].lower() for m in found], [m.span() for m in found]


def telling(words: tuple[str, ...] | list[str]) -> list[str]:
    """The words that must agree, in order; v2 and 2 and 2.0 are one number."""
    out = []
    for w in words:
        if w in NEGATIONS or w in TELLING:
            out.append(w)
        elif NUMBER.search(w):
            out.append(re.sub(r"\.0$", "", w.removeprefix("v")))
    return out


@dataclass(frozen=True)
class Template:
    license: str
    number: int
    words: tuple[str, ...]
    telling: list[str]
    packer: zstandard.ZstdCompressor
    joined: bool = False


def _packer(dictionary: bytes | None) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters.from_level(3, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
    held = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if dictionary else None
    if held is not None:
        held.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(compression_params=params, dict_data=held)


def most_different(template: Template) -> int:
    return max(1, int(MOST_DIFFERENT * len(template.words)))


@functools.lru_cache(maxsize=1)
def templates() -> list[Template]:
    out = []
    for texts, joined in ((notice_texts(), False), (joined_texts(), True)):
        for name, held in texts.items():
            for number, text in enumerate(held):
                words = tuple(_words(text)[0])
                out.append(Template(name, number, words, telling(words), _packer(" ".join(words).encode()), joined))
    return out


def gram_size(template: Template) -> int:
    """The most words in a row of which some stay whole under every edit allowed: an edit touches as many runs as they have words.

    Words that must agree cannot be edited, so a template too short for that is tried at these.
    """
    n, k = len(template.words), most_different(template)
    return next((q for q in GRAMS if n - q + 1 - q * k >= 1), 1)


@functools.lru_cache(maxsize=1)
def by_gram() -> dict[tuple[str, ...], list[tuple[Template, int]]]:
    """Where templates are tried: at any of their grams."""
    out: dict[tuple[str, ...], list[tuple[Template, int]]] = {}
    for t in templates():
        q = gram_size(t)
        for k in range(len(t.words) - q + 1):
            gram = t.words[k : k + q]
            if q > 1 or telling(gram) or TAG in gram:
                out.setdefault(gram, []).append((t, k))
    return out


@functools.lru_cache(maxsize=1)
def _plain() -> zstandard.ZstdCompressor:
    return _packer(None)


def wording(template: tuple[str, ...], block: list[str]) -> tuple[int, int, int, int, int]:
    """(differences, missing, added, first, end): the stretch of ``block`` closest to the whole template.

    Words before and after the stretch are free; a replaced word is one missing
    and one added, counted as one difference.
    """
    row = [(0, 0, 0, j) for j in range(len(block) + 1)]  # cost, missing, added, first
    for i, x in enumerate(template, 1):
        new = [(i, i, 0, 0)]
        for j, y in enumerate(block, 1):
            c, m, a, f = row[j - 1]
            best = (c, m, a, f) if x == y else (c + 1, m + 1, a + 1, f)
            c, m, a, f = row[j]
            best = min(best, (c + 1, m + 1, a, f))
            c, m, a, f = new[j - 1]
            new.append(min(best, (c + 1, m, a + 1, f)))
        row = new
    end = min(range(len(row)), key=lambda j: (row[j][0], j))
    cost, missing, added, first = row[end]
    return cost, missing, added, first, end


def notices(text: str) -> list[tuple[str, int, int, float, int, int, int]]:
    """(license, start, end, saved share, differences, missing, added) of the notices in a text, in order.

    Wherever some words in a row are those of a template, it proposes the block
    of its own length around them; the words are so few that some survive any
    edit allowed. The block is compressed alone and with the template as raw
    dictionary, and templates are ranked by the bytes they save. The first one
    whose exact wording is confirmed takes the block, or a later one whose
    notice goes on beyond it: few words may differ, none of them a number, a
    negation or a word that tells licenses apart, and no negation may stand
    before the notice in its sentence. Further licenses that a notice or an
    SPDX tag joins by "or" or "and" count, too.
    """
    if leading().isdisjoint(WORD.findall(text.lower())):
        return []
    words, spans = _words(text)
    ends = [m.end() for m in SENTENCE.finditer(text)]
    grams, first_words, tried = by_gram(), leading(), set()
    found: list[tuple] = []
    taken = -1
    alone: dict[tuple[int, int], int] = {}
    for at, word in enumerate(words):
        if word not in first_words or at <= taken:
            continue
        ranked = []
        for q in GRAMS:
            for t, k in grams.get(tuple(words[at : at + q]), ()):
                if (id(t), at - k) in tried or t.joined and (not found or abs(at - k - taken - 1) > 1):
                    continue
                tried.add((id(t), at - k))
                slack = most_different(t)
                first, end = max(taken + 1, at - k - slack), min(len(words), at - k + len(t.words) + slack)
                if end - first < len(t.words) - slack:
                    continue
                block = words[first:end]
                raw = " ".join(block).encode()
                if (first, end) not in alone:
                    alone[first, end] = len(_plain().compress(raw))
                saved = alone[first, end] - len(t.packer.compress(raw))
                if saved >= LEAST_SAVED * alone[first, end]:
                    ranked.append((saved, saved / alone[first, end], t, first, block))
        best = None
        for _, share, t, first, block in sorted(ranked, key=lambda r: (-r[0], r[2].license, r[2].number)):
            differ, missing, added, a, b = wording(t.words, block)
            if differ > most_different(t) or b <= a or telling(block[a:b]) != t.telling:
                continue
            if t.joined and (first + a != taken + 1 or block[a] not in ("or", "and")):
                continue
            begin = bisect.bisect_right(ends, spans[first + a][0])
            sentence = ends[begin - 1] if begin else 0
            if NEGATIONS & set(_words(text[max(sentence, spans[taken][1] if taken >= 0 else 0) : spans[first + a][0]])[0]):
                continue
            if best is None or (first + a <= best[0] and first + b >= best[1] and b - a > best[1] - best[0]):
                best = (first + a, first + b, t.license, share, differ, missing, added)
        if best is not None:
            a, b, name, *numbers = best
            found.append((name, spans[a][0], spans[b - 1][1], *numbers))
            taken = b - 1
            while words[a] == TAG and taken + 2 < len(words) and words[taken + 1] in ("or", "and") and words[taken + 2] in identifiers():
                taken += 2
                found.append((identifiers()[words[taken]], *spans[taken], *numbers))
    return found


@functools.lru_cache(maxsize=1)
def leading() -> frozenset[str]:
    """The first words of all grams: a text without any holds no notice."""
    return frozenset(gram[0] for gram in by_gram())


@functools.lru_cache(maxsize=1)
def identifiers() -> dict[str, str]:
    return {name.lower(): name for name in notice_texts()}


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per notice: doc_id, license, start, end (code points), saved, differences, missing, added.

    Whole texts are scanned where they lie; nothing is shuffled. Null and empty
    texts and texts without a notice give no row; a text with many gives one
    for each, however long it is (blocks are as long as templates, and the work
    is linear in the text). Ties go to the first identifier in alphabetical
    order; what no template confirms is left unknown and gives no row.
    Repeated rows are reported each; an empty table gives no rows.
    """
    names = ("doc_id", "license", "start", "end", "saved", "differences", "missing", "added")

    def run(batch: pa.RecordBatch) -> dict:
        rows = [(d, *n) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for n in notices(t)]
        return dict(zip(names, zip(*rows, strict=True) if rows else [[]] * 8, strict=True))

    return S.map_batches(S.texts(docs, id_col, text_col), run, "doc_id long, license string, start int, end int, saved double, differences int, missing int, added int")


def by_license(notices_: DataFrame) -> DataFrame:
    """license, documents, notices, exact: how often each was found. Repeated rows count as notices each, as documents once."""
    return notices_.groupBy("license").agg(F.countDistinct("doc_id").alias("documents"), F.count("*").alias("notices"), F.count_if(F.col("differences") == 0).alias("exact"))
