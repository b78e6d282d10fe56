"""License scans by conditional compression.

Words around a license's vocabulary, as many as the longest template can take up, are candidates;
where they overlap they are one block, whatever the lines. A block is compressed alone
and with each template as the raw dictionary of a Zstandard compressor; templates are ranked
by how much smaller it gets. All are confirmed by the exact differences of wording:
the template is placed where most of its word pairs line up, and the words that are missing
or extra between its first and last matching word are counted. Short templates must match
word for word, long ones may differ in `SLACK` of their words. Confirmed words are taken out
of the block and the rest is scanned again, so one block may hold several licenses.

Defined cases: a null or empty text has no license; words are compared in lower case, without
punctuation; equal differences go to the larger reduction, then to the longer template, then
to the smaller name; texts of any length are scanned whole; repeated rows are each scanned; an
empty table gives an empty result; other columns are kept, whatever their names, but
license_matches is replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm.common import as_bytes, chunks, extended, map_batches, read, with_columns

#: Templates of fewer words must match exactly; longer ones may differ in this part of their words.
SHORT, SLACK = 16, 0.1
LEVEL = 6
CACHED_BLOCKS = 20_000

#: The vocabulary of license notices (lower case).
TRIGGERS = ("licen", "released under", "distributed under", "copyright", "permission", "redistribut", "warrant", "spdx", "public domain", "rights reserved", "creative commons")

#: Published license texts and the notices they ask for, without names and years.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAME = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""

#: Identifiers, their texts, and the names by which one-line notices call them.
TEMPLATES = [
    ("MIT", _MIT),
    ("BSD-2-Clause", f"{_BSD}\n{_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD}\n{_BSD_NAME}\n{_BSD_END}"),
    ("ISC", _ISC),
    ("Apache-2.0", _APACHE),
    ("GPL-2.0", _GPL.format(name="General Public License", version="2")),
    ("GPL-3.0", _GPL.format(name="General Public License", version="3")),
    ("LGPL-3.0", _GPL.format(name="Lesser General Public License", version="3")),
    ("AGPL-3.0", _GPL.format(name="Affero General Public License", version="3")),
    ("MPL-2.0", _MPL),
    ("Unlicense", _UNLICENSE),
]
CALLED = {
    "MIT": ["MIT License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License"],
    "ISC": ["ISC License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GPLv2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GPLv3"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPLv3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPLv3"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "MPL 2.0"],
    "CC0-1.0": ["CC0 1.0", "Creative Commons Zero 1.0"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0"],
}
#: How one-line notices begin.
OPENINGS = ["Licensed under", "Licensed under the", "Released under", "Released under the", "Distributed under the", "This work is licensed under", "This work is licensed under the", "SPDX-License-Identifier:"]
NOTICES = [(name, f"{opening} {called}") for name, calls in CALLED.items() for called in calls for opening in OPENINGS[:-1]] + [(name, f"{OPENINGS[-1]} {name}") for name in CALLED] + [("All-Rights-Reserved", "All rights reserved")]

WORDS = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
#: The vocabulary, also where a line break (and a comment sign) lies between its words.
HOT = re.compile("|".join(t.replace(" ", "[^a-z0-9]+") for t in TRIGGERS))


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def allowed(size: int) -> int:
    """Words of a template that may be missing or extra."""
    return 0 if size < SHORT else int(SLACK * size)


class Scanner:
    def __init__(self):
        self.templates = [(name, words_of(text), text) for name, text in [*TEMPLATES, *NOTICES]]
        # words that one license takes up at most
        self.reach = max(len(w) + allowed(len(w)) for _, w, _ in self.templates)
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        params = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=0, write_dict_id=0)
        self.given = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(" ".join(w).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params) for _, w, _ in self.templates]
        # templates are tried where a block has as many of their pairs of words as the differences allowed must leave
        self.by_pair: dict[tuple[str, str], set[int]] = {}
        for n, (_, w, _) in enumerate(self.templates):
            for pair in zip(w, w[1:], strict=False):
                self.by_pair.setdefault(pair, set()).add(n)
        self.block = lru_cache(maxsize=CACHED_BLOCKS)(self._block)

    def ranked(self, words: list[str]) -> list[tuple[float, int]]:
        """(reduction of the block's compressed size, template), largest first, ties by the longer template."""
        data = " ".join(words).encode()
        alone = len(self.plain.compress(data))
        pairs = set(zip(words, words[1:], strict=False))
        near = {n for pair in pairs for n in self.by_pair.get(pair, ())}
        sizes = [((alone - len(self.given[n].compress(data))) / alone, n) for n in near if self.may_hold(pairs, n)]
        return sorted(sizes, key=lambda x: (-x[0], -len(self.templates[x[1]][1]), x[1]))

    def may_hold(self, pairs: set[tuple[str, str]], n: int) -> bool:
        """Whether a block of these pairs can hold template n: a missing or extra word breaks two of its pairs at most."""
        wanted = self.templates[n][1]
        return sum(p in pairs for p in zip(wanted, wanted[1:], strict=False)) >= len(wanted) - 1 - 2 * allowed(len(wanted))

    def differences(self, words: list[str], n: int) -> tuple[int, int, int, int] | None:
        """(missing, extra, first, end) of template n where most of its word pairs line up in the block."""
        wanted = self.templates[n][1]
        at: dict[tuple[str, ...], list[int]] = {}
        for j, pair in enumerate(zip(words, words[1:], strict=False)):
            at.setdefault(pair, []).append(j)
        votes = Counter(j - i for i, pair in enumerate(zip(wanted, wanted[1:], strict=False)) for j in at.get(pair, ()))
        if not votes:
            return None
        offset = min(votes, key=lambda o: (-votes[o], o))
        slack = 0 if len(wanted) < SHORT else len(wanted) // 5
        start = max(0, offset - slack)
        window = words[start : max(start, offset + len(wanted) + slack)]
        same = [b for b in SequenceMatcher(None, wanted, window, autojunk=False).get_matching_blocks() if b.size]
        if not same:
            return None
        first, end, matched = same[0].b, same[-1].b + same[-1].size, sum(b.size for b in same)
        return len(wanted) - matched, end - first - matched, start + first, start + end

    def _block(self, text: str) -> tuple[tuple[str, float, int, int, int, int], ...]:
        """(license, reduction, missing, extra, first word, last word) of each license confirmed in a block."""
        words, out = text.split(" "), []
        number = list(range(len(words)))
        while words:
            best = None
            for reduction, n in self.ranked(words):
                found = self.differences(words, n)
                if found is None:
                    continue
                missing, extra, first, end = found
                size = len(self.templates[n][1])
                if missing + extra <= allowed(size):
                    rank = (size < SHORT, missing + extra, -size if size < SHORT else 0, -reduction, -size, self.templates[n][0])
                    if best is None or rank < best[0]:
                        best = (rank, (self.templates[n][0], reduction, missing, extra), first, end)
            if best is None:
                break
            out.append((*best[1], number[best[2]], number[best[3] - 1]))
            words, number = words[: best[2]] + words[best[3] :], number[: best[2]] + number[best[3] :]
        return tuple(out)

    def scan(self, text: str) -> list[dict]:
        low = text.lower()
        if not HOT.search(low):
            return []
        matches = list(WORDS.finditer(low))
        words, starts = [m.group() for m in matches], [m.start() for m in matches]
        spans: list[list[int]] = []
        for m in HOT.finditer(low):
            # the words from the one the vocabulary begins in to the one it ends in, and those around
            first, end = max(0, bisect_right(starts, m.start()) - 1 - self.reach), bisect_left(starts, m.end()) + self.reach
            if spans and first <= spans[-1][1]:
                spans[-1][1] = end
            else:
                spans.append([first, end])
        breaks = [m.start() for m in re.finditer("\n", low)] if spans else []
        found = []
        for first, end in spans:
            for name, reduction, missing, extra, a, b in self.block(" ".join(words[first:end])):
                found.append({"license": name, "first_line": bisect_left(breaks, starts[first + a]), "last_line": bisect_left(breaks, starts[first + b]), "reduction": reduction, "missing": missing, "extra": extra})
        return found


_SCANNER: list[Scanner] = []


def scanner() -> Scanner:
    if not _SCANNER:
        _SCANNER.append(Scanner())
    return _SCANNER[0]


FOUND = T.ArrayType(T.StructType([T.StructField("license", T.StringType()), T.StructField("first_line", T.LongType()), T.StructField("last_line", T.LongType()), T.StructField("reduction", T.DoubleType()), T.StructField("missing", T.LongType()), T.StructField("extra", T.LongType())]))


def scan_licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with license_matches: license, its first and last line (from 0), size reduction, and words missing and extra."""

    def work(batches):
        one = scanner()
        kind = pa.list_(pa.struct([("license", pa.string()), ("first_line", pa.int64()), ("last_line", pa.int64()), ("reduction", pa.float64()), ("missing", pa.int64()), ("extra", pa.int64())]))
        for batch in chunks(batches, text_col):
            rows = [one.scan((t or b"").decode("utf-8", "replace")) for t in as_bytes(batch.column(text_col))]
            yield with_columns(batch, {"license_matches": pa.array(rows, kind)})

    return map_batches(docs, work, extended(docs, [("license_matches", FOUND)]))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(read(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.array_sort(F.array_distinct(F.transform("license_matches", lambda m: m["license"])))
    return found.select("doc_id", F.size("license_matches").cast("long").alias("n_matches"), F.array_join(names, ",").alias("licenses"), "license_matches")
