"""License scans by conditional compression.

Around each word that mentions licensing a candidate block is cut for short templates
(notices) and one for long ones (license texts), wide enough for any template of the kind
that has the word, whatever lines or sentences it runs over. Blocks are compressed with
each template as a zstandard raw dictionary and without one. Templates are ranked by the
bytes they save, against what the block or the template itself takes, and the first one
whose wording is confirmed wins: case and punctuation aside, few words of the template
may be missing or changed, none of them one that tells licenses apart (a version, a name,
a restriction), and no "not" may stand before it. Words of the block before and after the
template don't count. A confirmed passage claims its words, so several notices of a text,
also within a line, are each told.

Defined cases: null and empty texts have no license; a block that no template shrinks
by ``LEAST`` is left; of equal reductions the first template in name order wins; repeated
rows are scanned each for itself. Work grows with the mentions of a text.
"""

from __future__ import annotations

import bisect
import difflib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Short notes of common licenses; fixed values.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Released under the CC0 1.0 public domain dedication.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This file is licensed under the Mozilla Public License, version 2.0.",
}
_DISCLAIMED = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_TWO_CLAUSES = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
#: License texts and standard headers in full; fixed values.
FULL_TEXTS = {
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
    'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or '
    "implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause": _TWO_CLAUSES + 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"',
    "BSD-3-Clause": _TWO_CLAUSES + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    'derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"',
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
    "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in "
    "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
    "See the GNU General Public License for more details.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
    "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in "
    "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
    "See the GNU General Public License for more details.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
    "above copyright notice and this permission notice appear in all copies.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
    "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _DISCLAIMED,
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
    "file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
    "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
#: Words that tell one license from another; fixed values.
TELLING = {"apache", "bsd", "mit", "gnu", "gpl", "lgpl", "lesser", "mozilla", "mpl", "cc", "cc0", "by", "nc", "sa", "nd", "domain", "only", "later", "isc", "unlicense", "neither", "endorse"}
DENIED = {"not", "never", "neither", "without"}
MENTION = r"(?i)licen[sc]|\bspdx\b|redistribut|public domain|all rights reserved|permission (?:is hereby granted|to use)"
#: Least share of the bytes saved, most words that differ and their share of a long template, words of the longest short template.
LEAST, MOST_WORDS, MOST_SHARE, SHORT = 0.05, 4, 0.05, 30
WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")


def standard() -> list[tuple[str, str]]:
    """(license, template): notices, full texts and machine-readable tags."""
    names = sorted({*TEMPLATES, *FULL_TEXTS})
    return [*TEMPLATES.items(), *FULL_TEXTS.items(), *((n, f"SPDX-License-Identifier: {n}") for n in names)]


def _words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def aligned(block: list[str], template: list[str]) -> tuple[int, int, int, bool] | None:
    """Where the template begins and ends in the block, how many words differ there, and whether a telling word or a number is among them."""
    steps = difflib.SequenceMatcher(None, block, template, autojunk=False).get_opcodes()
    equal = [k for k, step in enumerate(steps) if step[0] == "equal"]
    if not equal:
        return None
    first, last, out = equal[0], equal[-1], []
    for k, (op, i, j, m, n) in enumerate(steps):
        if op != "equal":
            out += template[m:n]
            if first < k < last:
                out += block[i:j]
    # A word of the template that the block has another one for: that one tells as well.
    for k, take in ((first - 1, slice(-1, None)), (last + 1, slice(0, 1))):
        if 0 <= k < len(steps) and steps[k][0] == "replace":
            out += block[steps[k][1] : steps[k][2]][take]
    return steps[first][1], steps[last][2], len(out), any(w in TELLING or w[0].isdigit() for w in out)


class Scanner:
    def __init__(self, templates: list[tuple[str, str]]):
        settings = zstandard.ZstdCompressionParameters.from_level(12, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.plain = zstandard.ZstdCompressor(compression_params=settings).compress
        self.kinds: list[tuple[int, list]] = []
        every = [(name, t, _words(t)) for name, t in sorted(templates)]
        for group in ([x for x in every if len(x[2]) > SHORT], [x for x in every if len(x[2]) <= SHORT]):
            made = []
            for name, t, words in group:
                raw = " ".join(words).encode().rjust(8)
                given = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=settings).compress
                made.append((name, words, given, len(self.plain(raw))))
            if made:
                self.kinds.append((max(len(x[1]) for x in made), made))
        self.mentions = re.compile(MENTION)
        self.seen: dict[tuple, tuple | None] = {}

    def scan(self, kind: int, block: tuple[str, ...]) -> tuple[str, float, int, int, int] | None:
        """Name, reduction, differing words, begin and end of the confirmed winner."""
        if (kind, block) in self.seen:
            return self.seen[kind, block]
        raw = " ".join(block).encode()
        before, out = len(self.plain(raw)), None
        ranked = sorted((((before - len(given(raw))) / min(before, own), k) for k, (_, _, given, own) in enumerate(self.kinds[kind][1])), key=lambda x: (-x[0], x[1]))
        for reduction, k in ranked:
            if reduction < LEAST:
                break
            name, words, *_ = self.kinds[kind][1][k]
            found = aligned(list(block), words)
            if found is None:
                continue
            begin, end, n, tells = found
            if n <= max(MOST_WORDS if len(words) > 8 else 1, MOST_SHARE * len(words)) and not tells and not (begin and block[begin - 1] in DENIED):
                out = name, round(reduction, 4), n, begin, end
                break
        if len(self.seen) < 20_000:
            self.seen[kind, block] = out
        return out

    def found(self, text: str) -> list[tuple[int, str, float, int]]:
        """Line number from 0, name, reduction, differing words of each licensed passage."""
        places = [m.start() for m in self.mentions.finditer(text)]
        if not places:
            return []
        lower = text.lower()
        if len(lower) != len(text):  # a few letters change their number
            lower = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
        spans = [m.span() for m in WORD.finditer(lower)]
        words, ends, out, claimed = [lower[i:j] for i, j in spans], [j for _, j in spans], [], []
        for kind, (longest, _) in enumerate(self.kinds):
            for place in places:
                at = bisect.bisect_right(ends, place)
                if any(i <= at < j for i, j, _ in claimed):
                    continue
                start = max(0, at - longest - MOST_WORDS)
                # What an earlier passage claims is not looked at again.
                start = max([start, *(j for i, j, _ in claimed if j <= at)])
                stop = min([at + longest + MOST_WORDS, *(i for i, j, _ in claimed if i > at)])
                hit = self.scan(kind, tuple(words[start:stop]))
                if hit:
                    name, reduction, n, begin, end = hit
                    claimed.append((start + begin, start + end, (text.count("\n", 0, spans[start + begin][0]), name, reduction, n)))
        return [x for *_, x in sorted(claimed)]


def scanned(documents: DataFrame, templates: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, ``found`` (line, license, reduction, n_differing) and ``licenses``, the distinct names in order."""
    chosen = templates or standard()
    kind = pa.list_(pa.struct([("line", pa.int64()), ("license", pa.string()), ("reduction", pa.float64()), ("n_differing", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen)
        for batch in batches:
            rows = [[dict(zip(("line", "license", "reduction", "n_differing"), x, strict=True)) for x in scanner.found(t.as_py() or "")] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], [id_col, "found"])

    rows = documents.select(F.col(id_col).cast("long").alias(id_col), text_col)
    # Only rows that mention licensing cross to Python with their text.
    rows = rows.withColumn(text_col, F.when(F.col(text_col).rlike(MENTION), F.col(text_col)))
    out = rows.mapInArrow(work, f"{id_col} long, found array<struct<line:long,license:string,reduction:double,n_differing:long>>")
    return out.withColumn("licenses", F.array_sort(F.array_distinct(F.transform("found", lambda x: x["license"]))))


def licenses(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, n_blocks, licenses joined by commas, first_line and least reduction."""
    return scanned(documents).select(
        "doc_id", F.size("found").cast("long").alias("n_blocks"), F.array_join("licenses", ",").alias("licenses"), F.get("found", F.lit(0))["line"].alias("first_line")
    )
