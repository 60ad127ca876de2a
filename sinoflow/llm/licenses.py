"""Licence scan: Dice coefficient over word bigrams against templates, as native column expressions.

A text is cut into units: its lines, the sentences of its lines, its paragraphs (parted by blank lines) and itself. A
unit and a template are normalised alike (lower-cased, "licence" spelled "license", words are runs of ASCII letters
and digits), and their sets of word bigrams A and B are compared: 2 |A & B| / (|A| + |B|). A unit has the template of
the greatest coefficient, if that is ``DICE`` or more.

Two bounds prune, and neither can lose a match. Size: |A| lies between |B| t / (2 - t) and |B| (2 - t) / t. Words: a
match shares |B| t / (2 - t) bigrams at least, so it has one of any |B| - ceil(|B| t / (2 - t)) + 1 bigrams of B;
``needed_words`` picks few words that so many bigrams of each template hold, and a unit without these is passed over.

A null text counts as empty and has no licence. Every row gets a row, repeated ids and null ids too. Further columns are
ignored. Long licences (GPL, Apache, MPL, EPL) are known by their notices, short ones by their whole text. Licences that no
template words are not found, nor is a notice run into other words of its own sentence.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

DICE = 0.8

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD2 = _BSD + ": 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD3 = _BSD2 + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_FEE = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_FEE_END = '. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_ISC = _FEE + ", provided that the above copyright notice and this permission notice appear in all copies" + _FEE_END
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
_UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."
_BOOST = 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.'
_GNU = {"GPL-2.0": ("General", "2"), "GPL-3.0": ("General", "3"), "LGPL-2.1": ("Lesser General", "2.1"), "LGPL-3.0": ("Lesser General", "3"), "AGPL-3.0": ("Affero General", "3")}
_CC = [(f"CC-{k.replace(' ', '-')}-{v}", f"Licensed under CC {k} {v}.") for k in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND") for v in ("2.0", "3.0", "4.0")]
#: Letters that stand inside many other words; ``needed_words`` takes them last.
_COMMON = {"by", "nc", "nd", "sa", "of", "in", "is", "to", "or", "2", "3", "4", "0"}
#: The wording of public licences and their notices, as (SPDX id, or BSD for the whole family; text).
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", _MIT),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", _APACHE),
    *((name, f"This work is licensed under the GNU {kind} Public License, version {v}.") for name, (kind, v) in _GNU.items()),
    *((f"GPL-{v}.0", _GPL.format(v)) for v in (2, 3)),
    *_CC,
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD", "Released under the BSD License."),
    ("BSD", _BSD),
    ("BSD-2-Clause", _BSD2 + _AS_IS),
    ("BSD-3-Clause", _BSD3 + _AS_IS),
    ("ISC", _ISC),
    ("0BSD", _FEE + _FEE_END),
    ("Zlib", _ZLIB),
    ("Unlicense", _UNLICENSE),
    ("BSL-1.0", _BOOST),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
)


def words_of(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", text.lower().replace("licence", "license")) if w]


def bigrams_of(text: str) -> set[str]:
    w = words_of(text)
    return {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}


def _least_shared(n: int, dice: float) -> int:
    """How many bigrams a match shares at least with a template of ``n``."""
    return math.ceil(n * dice / (2 - dice) - 1e-9)


def needed_words(templates: Iterable[set[str]], dice: float = DICE) -> list[str]:
    """Words of which every unit that matches a template holds one; long words, rare in other text, are preferred."""
    words: set[str] = set()
    for b in templates:
        need = len(b) - _least_shared(len(b), dice) + 1
        while sum(not words.isdisjoint(x.split()) for x in b) < need:
            left = [w for x in b if words.isdisjoint(x.split()) for w in x.split()]
            words.add(max(left, key=lambda w: (w not in _COMMON, min(len(w), 7), left.count(w), w)))
    return sorted(words)


def _normal(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("licence"), F.lit("license"))


def scan(docs: DataFrame, templates=TEMPLATES, dice: float = DICE) -> DataFrame:
    """One row a document: doc_id, license (of the greatest coefficient, or null), score (0 without one), licenses (all, sorted)."""
    known = [(name, sorted(b)) for name, text in templates if (b := bigrams_of(text))]
    words = needed_words([set(b) for _, b in known], dice)
    hint = lambda t: reduce(lambda a, b: a | b, (t.contains(w) for w in words))  # noqa: E731  not a lambda over the words: the text would be normalised once a word
    table = F.array(*(F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, b)).alias("b")) for name, b in known))
    low, high = dice / (2 - dice), (2 - dice) / dice
    least, greatest = min(len(b) for _, b in known) * low, max(len(b) for _, b in known) * high

    def coefficient(a: Column, t: Column) -> Column:
        n, m = F.size(a), F.size(t["b"])
        fits = (n >= m * F.lit(low) - 1e-9) & (n <= m * F.lit(high) + 1e-9)
        return F.struct(F.when(fits, F.lit(2.0) * F.size(F.array_intersect(a, t["b"])) / (n + m)).otherwise(0.0).alias("score"), t["name"].alias("name"))

    bigrams = lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i))))
    rows = docs.select(F.col("doc_id"), _normal(text_of()).alias("t"))
    cut = lambda pattern: F.split("t", pattern)
    units = F.array_distinct(F.concat(cut(r"[\r\n]+"), cut(r"[\r\n]+|(?<=[.;:!?])\s+"), cut(r"(?:\r?\n[ \t]*){2,}"), F.array("t")))
    none = F.array().cast("array<string>")
    rows = rows.select("doc_id", F.when(hint(F.col("t")), F.filter(units, hint)).otherwise(none).alias("u"))
    rows = rows.select("doc_id", F.filter(F.transform("u", lambda u: F.filter(F.split(u, "[^a-z0-9]+"), lambda w: w != "")), lambda w: F.size(w) > least).alias("w"))
    rows = rows.select("doc_id", F.filter(F.transform("w", bigrams), lambda b: F.size(b) <= greatest + 1e-9).alias("b"))
    rows = rows.select("doc_id", F.filter(F.transform("b", lambda a: F.array_max(F.transform(table, lambda t: coefficient(a, t)))), lambda s: s["score"] >= dice).alias("found"))
    best = F.array_max("found")
    return rows.select("doc_id", best["name"].alias("license"), F.coalesce(best["score"], F.lit(0.0)).alias("score"), F.array_sort(F.array_distinct(F.transform("found", lambda s: s["name"]))).alias("licenses"))
