"""License scans: MinHash bands over overlapping word windows, then exact containment.

DataFrame functions only, all in one row: nothing is shuffled. Texts become
words (runs of ASCII letters and digits, A-Z as a-z); shingles are five words.
For each size class of templates a text is cut into windows that overlap by
half, so an occurrence of a template lies whole in some window of its class.
Each band is the least of the window's shingle hashes under one seed. A class
has as many bands of one row as its least similarity asks for: an occurrence
with just 80 % of its shingles, in a window of other words, is missed with a
chance of ``MISS`` at most, and a whole one less often. Classes with a template
of ``FEW`` shingles or fewer have no bands: all their templates are retrieved
by every window, so nothing is missed. A retrieved template is reported if the
window holds at least 80 % of its distinct shingles exactly.

A gate spares most windows: from each template come words that together stand
in over 20 % of its shingles, so no occurrence lacks all of them. Windows
without any gate word are left out; this loses nothing.

Null and empty texts hold no license. Templates under five words are one
shingle of all their words; without any word they are refused. Repeated rows
give a row each, and an empty table none. Of windows that hold equally much of a
template the first is given. A text of any length is cut into words whole, in
its row; only windows with a gate word become shingles. The columns of the
input that aren't named licenses stay.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS, CONTAINED = 5, 0.8
#: Chance to miss an occurrence by its bands, at most; distinct shingles up to which templates do without bands.
MISS, FEW = 0.0002, 4

# Notices and texts of public licenses.
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
)
_MIT_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_CLAUSES = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
    "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY "
    "SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
    "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_GNU_WARRANTY = (
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
    "See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program."
)
TEMPLATES = {
    "MIT": ["Released under the MIT License.", _MIT, f"{_MIT} {_MIT_WARRANTY}"],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL-2.1": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "GPL": [_GNU_WARRANTY],
    "BSD": [_BSD],
    "BSD-2-Clause": [f"{_BSD} {_BSD_CLAUSES} {_BSD_WARRANTY}"],
    "BSD-3-Clause": [f"{_BSD} {_BSD_CLAUSES} {_BSD_NAMES} {_BSD_WARRANTY}"],
    "ISC": [
        f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies.",
        f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_WARRANTY}",
    ],
    "0BSD": [f"{_ISC}. {_ISC_WARRANTY}"],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this "
        "software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim "
        "that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as "
        "such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ],
    "BSL-1.0": [
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, "
        "execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software "
        "and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, "
        "unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND-4.0": ["This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "All rights reserved": ["Copyright. All rights reserved worldwide."],
}


@dataclass(frozen=True)
class Template:
    name: str
    words: tuple[str, ...]

    @property
    def shingles(self) -> list[str]:
        n = max(1, len(self.words) - WORDS + 1)
        return sorted({" ".join(self.words[k : k + WORDS]) for k in range(n)})

    def gate(self) -> set[str]:
        """Few long words that together stand in over 20 % of the distinct shingles."""
        left = [set(s.split()) for s in self.shingles]
        most, chosen = len(left), set()
        while len(left) >= CONTAINED * most - 1e-9:
            seen = Counter(w for s in left for w in s)
            word = max(seen, key=lambda w: (len(w) >= 7, seen[w], len(w), w))
            chosen.add(word)
            left = [s for s in left if word not in s]
        return chosen

    def window(self) -> int:
        """Words of a window: at least twice the template's, by steps of a quarter."""
        size = 10
        while size < 2 * max(WORDS, len(self.words)):
            size += size // 4
        return size + size % 2

    def bands(self) -> int:
        """Bands that retrieve an occurrence with just enough shingles, in a window of other ones, but for a chance of MISS."""
        n, most = len(self.shingles), self.window() - WORDS + 1
        least = math.ceil(CONTAINED * n - 1e-9)
        return math.ceil(math.log(MISS) / math.log(1 - least / (n + most - least)))


def templates(named: dict[str, list[str]]) -> list[Template]:
    out = [Template(name, tuple(re.findall("[a-z0-9]+", text.lower()))) for name, texts in named.items() for text in texts]
    if not all(t.words for t in out):
        raise ValueError("a template has no words")
    return out


def _hash(shingle: Column) -> Column:
    return F.xxhash64(shingle)


def _bands(hashes: Column, count: int) -> Column:
    """The least hash under each seed; the seed stands first, so bands don't mix."""

    least = lambda k: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, k)))
    return F.transform(F.expr(f"sequence(0, {count - 1})"), lambda k: F.xxhash64(k, least(k)))


def _windows(words: Column, size: int, gate: set[str]) -> Column:
    """Windows (at, shingles) of a class that hold a gate word."""
    literal = F.array(*map(F.lit, sorted(gate)))
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(size // 2))
    cut = F.filter(F.transform(starts, lambda s: F.struct(s.alias("at"), F.slice(words, s + 1, size).alias("words"))), lambda w: F.arrays_overlap(w["words"], literal))
    return F.transform(
        cut,
        lambda w: F.struct(
            w["at"].alias("at"),
            F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w["words"]) - WORDS + 1, F.lit(1))), lambda i: _hash(F.array_join(F.slice(w["words"], i, WORDS), " ")))).alias("shingles"),
        ),
    )


def _matcher(literal: Column, count: int):
    """For a window: the templates that share a band with it (all, without bands) and are contained in it."""

    def matched(w: Column) -> Column:
        retrieved = F.filter(literal, lambda t: F.arrays_overlap(t["bands"], w["bands"])) if count else literal
        share = lambda t: F.size(F.array_intersect(t["shingles"], w["shingles"])) / F.size(t["shingles"])
        exact = F.transform(retrieved, lambda t: F.struct(t["template"].alias("template"), share(t).alias("contained"), (-w["at"]).alias("back"), t["name"].alias("name")))
        return F.filter(exact, lambda m: m["contained"] >= CONTAINED)

    return matched


def _hashed(spark: SparkSession, known: list[Template], counts: dict[int, int]) -> list[tuple[list[int], list[int]]]:
    """Shingle hashes and bands of each template, worked out once, by the expressions that windows use; the size follows from the templates."""
    table = spark.createDataFrame([(n, t.shingles, t.window()) for n, t in enumerate(known)], "n int, shingles array<string>, window int")
    hashes = table.select("n", "window", F.transform("shingles", _hash).alias("shingles"))
    bands = F.coalesce(*(F.when(F.col("window") == size, _bands(F.col("shingles"), count)) for size, count in counts.items() if count), F.array().cast("array<bigint>"))
    rows = hashes.select("n", "shingles", bands.alias("bands")).collect()
    return [(list(r["shingles"]), list(r["bands"])) for r in sorted(rows, key=lambda r: r["n"])]


def scan(docs: DataFrame, named: dict[str, list[str]] | None = None) -> DataFrame:
    """Add ``licenses``: (name, template, contained, at) of every verified match, best window of each template."""
    known = templates(named or TEMPLATES)
    gate = set().union(*(t.gate() for t in known))
    # a text that no gate word stands in isn't cut into words at all
    gated = F.col("text").rlike(f"(?i)(?<![a-z0-9])(?:{'|'.join(sorted(gate))})(?![a-z0-9])")
    words = F.filter(F.split(F.lower(F.translate("text", "\u0130\u212a", "  ")), "[^a-z0-9]+"), lambda w: w != "")
    sizes = sorted({t.window() for t in known})
    classes = {size: [(n, t) for n, t in enumerate(known) if t.window() == size] for size in sizes}
    counts = {size: 0 if any(len(t.shingles) <= FEW for _, t in own) else max(t.bands() for _, t in own) for size, own in classes.items()}
    hashed = _hashed(docs.sparkSession, known, counts)
    # one literal, read by the parser at once
    quoted = lambda name: "'" + name.replace("\\", "\\\\").replace("'", "\\'") + "'"
    longs = lambda values: f"cast(array({', '.join(f'{v}L' if v > -(2**63) else 'cast(' + chr(39) + str(v) + chr(39) + ' AS bigint)' for v in values)}) AS array<bigint>)"
    one = lambda n, t: f"named_struct('name', {quoted(t.name)}, 'template', {n}, 'shingles', {longs(hashed[n][0])}, 'bands', {longs(hashed[n][1])})"
    found = []
    for size, own in classes.items():
        count = counts[size]
        literal = F.expr(f"array({', '.join(one(n, t) for n, t in own)})")
        windows = F.transform(
            _windows(F.col("_words"), size, set().union(*(t.gate() for _, t in own))),
            lambda w: F.struct(w["at"].alias("at"), w["shingles"].alias("shingles"), *([_bands(w["shingles"], count).alias("bands")] if count else [])),  # noqa: B023
        )
        found.append(F.flatten(F.transform(windows, _matcher(literal, count))))
    kind = "array<struct<template:int,contained:double,back:int,name:string>>"
    every = F.concat(*(f.cast(kind) for f in found))
    # of each template the window with most of it, the first of these
    numbers = F.array_sort(F.array_distinct(F.transform("_all", lambda m: m["template"])))
    best = F.transform(numbers, lambda n: F.array_max(F.filter("_all", lambda m: m["template"] == n)))
    shown = F.transform(best, lambda m: F.struct(m["name"].alias("name"), m["template"].alias("template"), m["contained"].alias("contained"), (-m["back"]).alias("at")))
    names = [c for c in docs.columns if c != "licenses"]
    none = F.array().cast(kind)
    split = docs.select(*names, F.when(gated, words).alias("_words"))
    listed = split.select(*names, F.when(F.col("_words").isNull(), none).otherwise(every).alias("_all"))
    return listed.select(*names, F.when(F.size("_all") > 0, shown).otherwise(F.array().cast("array<struct<name:string,template:int,contained:double,at:int>>")).alias("licenses"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, the number of templates found, and the names of their licenses in order."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs)
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("licenses", lambda m: m["name"]))), ",")
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_templates"), names.alias("licenses"))
