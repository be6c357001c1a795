"""Licence scans with DataFrame functions only: Dice coefficient of word bigrams against licence templates.

A document is compared as a whole, block by block (blocks end at blank lines) and line by line, so a licence is found
alone and inside a longer text. Two sets of a and b bigrams reach a coefficient t only if b lies between a t / (2 - t)
and a (2 - t) / t, so templates of other sizes are not compared; the sets then share at least a t / (2 - t) bigrams, so
a passage that shares fewer with all templates together is compared with none. By the same bound, a text that has none
of the `telling_words` matches no template and is not cut up at all. All of it is one pass without a shuffle.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfen.llm.common import table, text_or_empty

THRESHOLD = 0.8
#: Templates of at most so many bigrams form one group, longer ones another; it only saves time.
SHORT = 24
#: Words that most prose has; they are taken as telling only where no others suffice.
COMMON = {"a", "and", "any", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "or", "that", "the", "this", "to", "under", "with", "you"}
# How a notice names its licence.
NOTICES = ["Licensed under {}.", "Released under {}.", "This work is licensed under {}.", "Distributed under the terms of {}."]
NAMES = {
    "AGPL-3.0": "the GNU Affero General Public License, version 3",
    "Apache-2.0": "the Apache License, Version 2.0",
    "BSD-2-Clause": "the BSD 2-Clause License",
    "BSD-3-Clause": "the BSD 3-Clause License",
    "BSL-1.0": "the Boost Software License, Version 1.0",
    "CC-BY-4.0": "CC BY 4.0",
    "CC-BY-NC-4.0": "CC BY-NC 4.0",
    "CC-BY-NC-ND-4.0": "CC BY-NC-ND 4.0",
    "CC-BY-NC-SA-4.0": "CC BY-NC-SA 4.0",
    "CC-BY-ND-4.0": "CC BY-ND 4.0",
    "CC-BY-SA-4.0": "CC BY-SA 4.0",
    "CC0-1.0": "CC0 1.0 Universal",
    "EPL-2.0": "the Eclipse Public License, version 2.0",
    "GPL-2.0": "the GNU General Public License, version 2",
    "GPL-3.0": "the GNU General Public License, version 3",
    "ISC": "the ISC License",
    "LGPL-2.1": "the GNU Lesser General Public License, version 2.1",
    "LGPL-3.0": "the GNU Lesser General Public License, version 3",
    "MIT": "the MIT License",
    "MPL-2.0": "the Mozilla Public License, version 2.0",
}
# The wording of public licences and of the notices that they ask for.
WORDINGS = {
    "Apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "GPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "MIT": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
}


#: Parts that the wordings of a family share.
_GNU = "This {thing} is free software{sign} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation{comma} either version {version} of the License, or (at your option) any later version."
_GNU_REST = "This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details."
_GNU_COPY = "You should have received a copy of the GNU {kind}General Public License along with this {thing}. If not, see https://www.gnu.org/licenses/."
_GNU_POST = "You should have received a copy of the GNU {kind}General Public License along with this {thing}; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA"
_BSD_TWO = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAME = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ISC_END = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_GNU_FORMS = {
    "AGPL-3.0": ("program", ":", "Affero ", ",", "3", [_GNU_COPY]),
    "GPL-2.0": ("program", ";", "", ";", "2", [_GNU_COPY, _GNU_POST]),
    "GPL-3.0": ("program", ":", "", ",", "3", [_GNU_COPY]),
    "LGPL-2.1": ("library", ";", "Lesser ", ";", "2.1", [_GNU_COPY, _GNU_POST]),
    "LGPL-3.0": ("library", ":", "Lesser ", ",", "3", [_GNU_COPY]),
}
for _name, (_thing, _sign, _kind, _comma, _version, _ends) in _GNU_FORMS.items():
    _fill = {"thing": _thing, "sign": _sign, "kind": _kind, "comma": _comma, "version": _version}
    WORDINGS[_name] = [form.format(**_fill) for form in [_GNU, *(f"{_GNU} {_GNU_REST} {end}" for end in _ends)]]
WORDINGS["BSD-2-Clause"] = [_BSD_TWO, f"{_BSD_TWO} {_BSD_END}"]
WORDINGS["BSD-3-Clause"] += [_BSD_NAME, f"{_BSD_TWO} {_BSD_NAME} {_BSD_END}"]
WORDINGS["ISC"] += [f"{WORDINGS['ISC'][0]} {_ISC_END}"]


def bigrams_of(text: str) -> list[str]:
    words = re.findall("[a-z0-9]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def templates() -> list[tuple[str, str]]:
    """(name, wording) of every template."""
    notices = [(name, form.format(called)) for name, called in NAMES.items() for form in NOTICES]
    return notices + [(name, text) for name, texts in WORDINGS.items() for text in texts]


def telling_words(wanted: list[list[str]], threshold: float) -> list[str]:
    """Words one of which every match has: without them more bigrams of a template are missing than a match may miss.

    A match has n t / (2 - t) of the n bigrams of its template at least. Long words are taken first.
    """
    chosen: set[str] = set()
    for bigrams in wanted:
        pairs = [set(b.split()) for b in bigrams]
        spare = len(pairs) - math.ceil(len(pairs) * threshold / (2 - threshold) - 1e-9)
        for word in sorted(set().union(*pairs), key=lambda w: (w in COMMON, -len(w), w)):
            if sum(bool(pair & chosen) for pair in pairs) > spare:
                break
            chosen.add(word)
    return sorted(chosen)


def _literals(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def _best(passage: Column, group: list[tuple[str, list[str]]], threshold: float) -> Column:
    """The best template of a passage (its bigrams) as (d, name), d being the negated coefficient, 0 without any."""
    size = F.size(passage)

    def dice(want: list[str]) -> Column:
        fits = (size >= len(want) * threshold / (2 - threshold) - 1e-9) & (size <= len(want) * (2 - threshold) / threshold + 1e-9)
        return F.when(fits, F.lit(2.0) * F.size(F.array_intersect(passage, _literals(want))) / (size + len(want))).otherwise(0.0)

    return F.array_min(F.array(*[F.struct((-dice(want)).alias("d"), F.lit(name).alias("name")) for name, want in group]))


def _scored(passages: Column, group: list[tuple[str, list[str]]], threshold: float) -> Column:
    """The best template of every passage that the sizes and the bigrams of the whole group allow."""
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    fewest, largest = min(len(b) for _, b in group) * low - 1e-9, max(len(b) for _, b in group) * high + 1e-9
    union = _literals(sorted({b for _, want in group for b in want}))

    def near(p: Column) -> Column:
        return (F.size(p) >= fewest) & (F.size(p) <= largest) & (F.size(F.array_intersect(p, union)) >= F.size(p) * low - 1e-9)

    return F.transform(F.filter(passages, near), lambda p: _best(p, group, threshold))


def licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: key, license (best template of at least the threshold, else null), dice (0 without), found.

    `found` lists the licences that are the best match of some passage, sorted and joined by commas. Null texts and
    passages of fewer than two words match nothing; ties go to the first name. Repeated rows come back as often as
    they came in, and an empty table gives an empty one.
    """
    wanted = [(name, bigrams_of(wording)) for name, wording in templates()]
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    least, most = min(len(b) for _, b in wanted) * low - 1e-9, max(len(b) for _, b in wanted) * high + 1e-9
    own = text_or_empty(text)
    telling = "(?<![a-z0-9])(?:" + "|".join(telling_words([b for _, b in wanted], threshold)) + ")"
    passages = F.array_distinct(F.concat(F.split(own, "\n"), F.split(own, r"\n\s*\n"), F.array(own)))
    passages = F.when(F.lower(own).rlike(telling), F.filter(passages, lambda p: F.length(p) > 2 * least))
    rows = docs.select(F.col(key).alias("key"), F.coalesce(passages, F.array().cast("array<string>")).alias("passages"))
    rows = rows.select("key", F.transform("passages", lambda p: F.regexp_extract_all(F.lower(p), F.lit("[a-z0-9]+"), F.lit(0))).alias("words"))
    # A passage has fewer bigrams than words, and at least as many different ones as different words but one.
    rows = rows.select("key", F.filter("words", lambda w: (F.size(w) > least) & (F.size(F.array_distinct(w)) - 1 <= most)).alias("words"))

    def pairs(w: Column) -> Column:
        n = F.greatest(F.size(w) - 1, F.lit(0))
        return F.array_distinct(F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.concat(a, F.lit(" "), b)))

    rows = rows.select("key", F.transform("words", pairs).alias("passages"))
    short, long = ([x for x in wanted if (len(x[1]) <= SHORT) == small] for small in (True, False))
    scored = [_scored(F.col("passages"), group, threshold) for group in (short, long)]
    rows = rows.select("key", F.filter(F.concat(*scored), lambda s: -s["d"] >= threshold).alias("hits"))
    best = F.array_min("hits")
    return rows.select(
        F.col("key").alias(key),
        best["name"].alias("license"),
        F.coalesce(-best["d"], F.lit(0.0)).alias("dice"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("hits", lambda s: s["name"]))), ",").alias("found"),
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    return licenses(table(spark, folder, "documents"))
