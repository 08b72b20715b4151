"""Licence scans in DataFrame functions only: parts of a text against licence templates by Dice coefficient over word bigrams.

The parts are every line, every block of lines between blank lines (if it has more than one line) and the whole text (if it
has more than one block). Part and template are normalised to words (digits, a-z with A-Z in lower case, everything beyond
ASCII) and these to the set of their bigrams. With sizes a and b of the sets, a Dice coefficient 2 * common / (a + b) of t or
more needs t / (2 - t) * b <= a <= (2 - t) / t * b, so only templates within these bounds are compared. Templates are a
parameter of at most ``MAX_TEMPLATES`` texts and part of the plan, so nothing is shuffled or broadcast.

Stretches are what these parts miss: notices inside a line and licences of several paragraphs inside a longer text. A stretch is a
run of words across lines and blocks, of at most (2 - t) / t * b bigrams (repeats counted); for every template each run that
begins with one of its bigrams is compared, by one fold over the run. A template needs t / (2 - t) * b of its bigrams in the
text and within the length of a run, so few texts and few beginnings get so far. Of stretches that overlap, the one with the most
common bigrams after deducting those of one side only is reported, if it isn't inside a part that has a match. The templates of
stretches are those of the parts and the full texts in ``LICENCES``; the full Apache and GPL texts are found by the notices they quote.

Defined results: null and empty texts have no matches; a part of fewer than two words has no bigrams and no match; of templates with equal
coefficients the one whose name sorts last is reported; a part that is repeated is reported each time; stretches follow the parts,
are numbered on and have their words as text; all rows and columns are kept (a column named ``licenses`` is replaced).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tutorloom.functions.text import let

MAX_TEMPLATES = 200
THRESHOLD = 0.8
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Notices as they are commonly written, and the wording of short licences.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("all-rights-reserved", "All rights reserved."),
]

# Full texts of short licences, for stretches only.
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
LICENCES = [
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD_THIRD + _BSD_END),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
]


def _words(text: Column) -> Column:
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def _pairs(words: Column) -> Column:
    first = F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))
    return F.transform(first, lambda w, i: F.concat_ws(" ", w, F.get(words, i + 1)))


def bigrams(text: Column) -> Column:
    """Distinct word bigrams of a text."""
    return let(_words(text), lambda words: F.array_distinct(_pairs(words)))


def parts(text: Column) -> Column:
    """Lines, blocks of lines, and the whole text, where they differ."""
    blocks = F.split(text, r"\n\s*\n")

    def lines(block: Column) -> Column:
        return let(F.split(block, "\n"), lambda own: F.when(F.size(own) > 1, F.concat(own, F.array(block))).otherwise(own))

    return let(blocks, lambda b: F.concat(F.flatten(F.transform(b, lines)), F.when(F.size(b) > 1, F.array(text)).otherwise(F.array().cast("array<string>"))))


def _ranges(text: Column) -> Column:
    """(start, stop) of each of the ``parts`` in the words of the text."""

    def span(start: Column, stop: Column) -> Column:
        return F.struct(start.alias("start"), stop.alias("stop"))

    def state(at: Column, spans: Column) -> Column:
        return F.struct(at.alias("at"), spans.alias("spans"))

    none = F.array().cast("array<struct<start:int,stop:int>>")

    def line(s: Column, own: Column) -> Column:
        return let(s["at"] + F.size(_words(own)), lambda stop: state(stop, F.concat(s["spans"], F.array(span(s["at"], stop)))))

    def block(s: Column, own: Column) -> Column:
        inside = F.aggregate(F.split(own, "\n"), state(s["at"], none), line)
        more = lambda b: F.when(F.size(b["spans"]) > 1, F.array(span(s["at"], b["at"]))).otherwise(none)
        return let(inside, lambda b: state(b["at"], F.concat(s["spans"], b["spans"], more(b))))

    blocks = F.split(text, r"\n\s*\n")
    whole = F.aggregate(blocks, state(F.lit(0), none), block)
    return let(whole, lambda s: F.concat(s["spans"], F.when(F.size(blocks) > 1, F.array(span(F.lit(0), s["at"]))).otherwise(none)))


RUN = "rank int, start int, stop int, license string, dice double"


def _stretches(words: Column, templates: list[tuple[str, list[str]]], threshold: float) -> Column:
    """The best stretches of a text's words that don't overlap, in order: array<struct<RUN>>."""
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    rows, anchors = [], set()
    for name, own in templates:
        need, most = math.ceil(len(own) * low - 1e-9), math.floor(len(own) * high + 1e-9)
        rows.append(F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, own)).alias("own"), F.lit(len(own)).alias("size"), F.lit(need).alias("need"), F.lit(most).alias("most")))
        # a text with ``need`` of the bigrams has one of any others but need - 1; long words are rare ones
        longest = sorted((max(g.split(" "), key=len) for g in own), key=len, reverse=True)
        anchors.update(longest[: len(own) - need + 1])
    every = sorted({g for _, own in templates for g in own})
    none = F.array().cast(f"array<struct<{RUN.replace(' ', ':').replace(',:', ',')}>>")

    def runs_of(t: Column, pairs: Column, hits: Column, earlier: Column) -> Column:
        marked = F.transform(pairs, lambda g, j: F.struct(F.get(earlier, j).alias("earlier"), F.array_contains(t["own"], g).alias("hit")))

        def run(cells: Column, p: Column) -> Column:
            def fields(a: Column, c: Column, at: Column, dice: Column, rank: Column, stop: Column) -> Column:
                return F.struct(a.alias("a"), c.alias("c"), at.alias("at"), dice.alias("dice"), rank.alias("rank"), stop.alias("stop"))

            def step(s: Column, cell: Column) -> Column:
                new = F.when(cell["earlier"] < p, 1).otherwise(0)
                a, c, at = s["a"] + new, s["c"] + F.when(cell["hit"], new).otherwise(0), s["at"] + 1
                better = lambda m: 2.0 * m["c"] / (m["a"] + t["size"]) > s["dice"]

                def settle(m: Column) -> Column:
                    chosen = F.when(better(m), F.struct((2.0 * m["c"] / (m["a"] + t["size"])).alias("dice"), (3 * m["c"] - m["a"] - t["size"]).alias("rank"), m["at"].alias("stop")))
                    return let(chosen.otherwise(F.struct(s["dice"], s["rank"], s["stop"])), lambda b: fields(m["a"], m["c"], m["at"], b["dice"], b["rank"], b["stop"]))

                return let(F.struct(a.alias("a"), c.alias("c"), at.alias("at")), settle)

            start = fields(F.lit(0), F.lit(0), p, F.lit(0.0), F.lit(0), p)
            return F.aggregate(F.slice(cells, p + 1, t["most"]), start, step, lambda s: F.struct((-s["rank"]).alias("rank"), p.alias("start"), s["stop"].alias("stop"), t["name"].alias("license"), s["dice"].alias("dice")))

        own = F.transform(F.filter(hits, lambda h: F.array_contains(t["own"], h["gram"])), lambda h: h["at"])
        starts = let(own, lambda at: F.filter(at, lambda p, k: F.get(at, k + t["need"] - 1) < p + t["most"]))
        return let(marked, lambda cells: F.filter(F.transform(starts, lambda p: run(cells, p)), lambda r: r["dice"] >= threshold))

    def found(pairs: Column) -> Column:
        hits = F.filter(F.transform(pairs, lambda g, i: F.struct(i.alias("at"), g.alias("gram"))), lambda h: h["gram"].isin(every))

        def meet(hits: Column) -> Column:
            near = F.filter(F.array(*rows), lambda t: F.size(F.array_intersect(hits["gram"], t["own"])) >= t["need"])

            def judge(near: Column) -> Column:
                reach = F.array_max(near["most"])
                # place of the same bigram before, as far back as a run reaches, else -1
                before = lambda g, j: F.array_position(F.reverse(F.slice(pairs, F.greatest(j - reach, F.lit(0)) + 1, F.least(j, reach))), g).cast("int")
                earlier = F.transform(pairs, lambda g, j: let(before(g, j), lambda k: F.when(k > 0, j - k).otherwise(-1)))
                return F.when(F.size(near) > 0, let(earlier, lambda e: F.flatten(F.transform(near, lambda t: runs_of(t, pairs, hits, e))))).otherwise(none)

            return let(near, judge)

        return let(hits, meet)

    def apart(kept: Column, r: Column) -> Column:
        # a run of bigrams start .. stop - 1 has the words start .. stop
        return F.when(F.exists(kept, lambda k: (k["start"] <= r["stop"]) & (r["start"] <= k["stop"])), kept).otherwise(F.concat(kept, F.array(r)))

    chosen = F.aggregate(F.array_sort(let(_pairs(words), found)), none, apart)
    in_order = F.array_sort(chosen, lambda a, b: a["start"] - b["start"])
    return F.when(F.arrays_overlap(words, F.array(*map(F.lit, sorted(anchors)))), in_order).otherwise(none)


def scan(docs: DataFrame, templates: list[tuple[str, str]] = NOTICES, threshold: float = THRESHOLD, text: str = "text", whole: list[tuple[str, str]] = LICENCES, stretches: bool = True) -> DataFrame:
    """``docs`` with ``licenses``: array<struct<part, dice, license, text>>, one entry per matching part and, with ``stretches``, stretch, in order."""
    if len(templates) + len(whole) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates")
    every = [*templates, *whole]
    sets = docs.sparkSession.range(1).select(F.array(*(bigrams(F.lit(t)) for _, t in every)).alias("sets")).first().sets
    known = sets[: len(templates)]
    listed = F.array(*(F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, own)).alias("own"), F.lit(len(own)).alias("size")) for (name, _), own in zip(templates, known, strict=True)))
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold

    def best(own: Column) -> Column:
        near = F.filter(listed, lambda t: (F.size(own) >= t["size"] * low - 1e-9) & (F.size(own) <= t["size"] * high + 1e-9))  # 1.2 / 0.8 is below 1.5
        scored = F.transform(near, lambda t: F.struct((2.0 * F.size(F.array_intersect(own, t["own"])) / (F.size(own) + t["size"])).alias("dice"), t["name"].alias("license")))
        return F.array_max(F.filter(scored, lambda s: s["dice"] >= threshold))

    scored = F.transform(parts(F.coalesce(text, F.lit(""))), lambda p, i: F.struct(i.alias("part"), let(bigrams(p), best).alias("best"), p.alias("text")))
    found = F.transform(F.filter(scored, lambda s: s["best"].isNotNull()), lambda s: F.struct(s["part"].alias("part"), s["best"]["dice"].alias("dice"), s["best"]["license"].alias("license"), s["text"].alias("text")))
    kind = "array<struct<part:int,dice:double,license:string,text:string>>"

    def with_stretches(found: Column, words: Column) -> Column:
        runs = _stretches(words, [(name, own) for (name, _), own in zip(every, sets, strict=True) if own], threshold)

        def added(runs: Column) -> Column:
            def left(spans: Column) -> Column:
                inside = lambda r: F.exists(found, lambda m: (F.get(spans, m["part"])["start"] <= r["start"]) & (r["stop"] < F.get(spans, m["part"])["stop"]))
                entry = lambda r, i: F.struct((F.size(spans) + i).alias("part"), r["dice"], r["license"], F.array_join(F.slice(words, r["start"] + 1, r["stop"] - r["start"] + 1), " ").alias("text"))
                return F.concat(found, F.transform(F.filter(runs, lambda r: ~inside(r)), entry).cast(kind))

            return F.when(F.size(runs) > 0, let(_ranges(given), left)).otherwise(found)

        return let(runs, added)

    given = F.coalesce(text, F.lit(""))
    if not stretches:
        return docs.withColumn("licenses", found)
    return docs.withColumn("licenses", let(found.cast(kind), lambda f: let(_words(given), lambda words: with_stretches(f, words))))
