"""License scans by patience alignment of texts with templates.

A text and a template are words in lower case. A copy is a stretch of a text that has a share of a template's words in
their order, neighbouring ones at most the template's length apart. Words of the template that follow each other so
closely are searched, by the longest common subsequence, for the copy that ends first, then for the next behind its end;
so copies apart from each other are all met. Each is then carried on while more words match and aligned with the
template: words unique to both are anchors, the longest increasing run of anchors is kept, and the gaps between them,
where more words are unique, are aligned in the same way; what begins or ends a gap alike is matched as well. Where
that matches fewer words than a longest common subsequence, the latter is taken. Coverage is the share of the
template's words matched.

A notice or header counts only if the words that tell it from its siblings match and no others of them stand
between. Of overlapping copies of notices, of headers or of texts the one with most
words matched beyond those missing is reported.

A text whose words cannot reach the coverage asked for is not aligned; that test and the search are exact. Null, empty and wordless
texts have no matches. Rows are scanned whole and each by itself. Other columns pass through; a column
named like the result is replaced.
"""

from __future__ import annotations

import math
import re
import sys
from bisect import bisect_left
from collections import Counter
from pathlib import Path

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Sent to tasks by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORD = re.compile(r"\w+")

# Words that do not mark a license by themselves.
COMMON = set("a all an and any are as at be by for from if in is it its may no not of on or other such that the this to under "
             "use which will with work you your".split())

# Notices and texts of licenses.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "MIT notice": "Released under the MIT License.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "Apache-2.0 header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
        'law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT '
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
        'shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY '
        "OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR "
        "THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "
        '"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL "
        "DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE "
        "OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
}

_AS_IS = ('THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, '
          "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT "
          "SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
          "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
          "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
          "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution. ")
_ENDORSE = ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
            "from this software without specific prior written permission. ")
TEMPLATES |= {
    "BSD-2-Clause": _BSD + _AS_IS,
    "BSD-3-Clause": _BSD + "3. " + _ENDORSE + _AS_IS,
    "BSD-4-Clause": _BSD + ("3. All advertising materials mentioning features or use of this software must display the following "
                            "acknowledgement: This product includes software developed by the organization. 4. ") + _ENDORSE + _AS_IS,
    "MIT-0": TEMPLATES["MIT"].replace(", subject to the following conditions: The above copyright notice and this permission notice "
                                      "shall be included in all copies or substantial portions of the Software", ""),
    "0BSD": TEMPLATES["ISC"].replace(", provided that the above copyright notice and this permission notice appear in all copies", ""),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
        "damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including "
        "commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of "
        "this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in "
        "a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions "
        "must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be "
        "removed or altered from any source distribution."),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
        "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
        "non-commercial, and by any means."),
    "MPL-2.0 header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
}


def _gnu_header(kind: str, version: str) -> str:
    return (f"This program is free software; you can redistribute it and/or modify it under the terms of the GNU {kind} as published by "
            f"the Free Software Foundation; either version {version} of the License, or (at your option) any later version. This program "
            "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
            f"MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} for more details. You should have received a copy "
            f"of the GNU {kind} along with this program; if not, see http://www.gnu.org/licenses/.")


_GNU = [("GPL", "General Public License", "1 2 3"), ("LGPL", "Library General Public License", "2"),
        ("LGPL", "Lesser General Public License", "2.1 3"), ("AGPL", "Affero General Public License", "3"),
        ("GFDL", "Free Documentation License", "1.1 1.2 1.3")]
for _short, _kind, _versions in _GNU:
    for _v in _versions.split():
        _name = f"{_short}-{_v if '.' in _v else _v + '.0'}"
        TEMPLATES.setdefault(f"{_name} notice", f"This work is licensed under the GNU {_kind}, version {_v}.")
        if _short != "GFDL":
            TEMPLATES[f"{_name} header"] = _gnu_header(_kind, _v)
for _kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
    _words = "-".join({"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}[k] for k in _kind.split("-"))
    for _v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
        TEMPLATES.setdefault(f"CC-{_kind}-{_v} notice", f"Licensed under CC {_kind} {_v}.")
        TEMPLATES[f"CC-{_kind}-{_v} long notice"] = f"This work is licensed under a Creative Commons {_words} {_v} License."
for _name, _words in {"Apache-1.0": "Apache License, Version 1.0", "Apache-1.1": "Apache License, Version 1.1", "BSD": "BSD License",
                      "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License", "ISC": "ISC License",
                      "MPL-1.1": "Mozilla Public License, Version 1.1", "MPL-2.0": "Mozilla Public License, Version 2.0",
                      "EPL-1.0": "Eclipse Public License, Version 1.0", "EPL-2.0": "Eclipse Public License, Version 2.0",
                      "BSL-1.0": "Boost Software License, Version 1.0", "Zlib": "zlib License",
                      "Artistic-2.0": "Artistic License, Version 2.0"}.items():
    TEMPLATES[f"{_name} notice"] = f"Licensed under the {_words}."
for _file in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
    TEMPLATES[f"{_file.stem} text"] = _file.read_text(encoding="utf-8", errors="replace")
# The Affero text is the GNU text with its name and its section 13.
TEMPLATES["AGPL-3 text"] = re.sub(
    r"13\. Use with the GNU AFFERO.*?(?=\n *14\. )",
    "13. Remote Network Interaction; Use with the GNU GPL. Notwithstanding any other provision of this License, if you modify the Program, "
    "your modified version must prominently offer all users interacting with it remotely through a computer network (if your version "
    "supports such interaction) an opportunity to receive the Corresponding Source of your version by providing access to the "
    "Corresponding Source from a network server at no charge, through some standard or customary means of facilitating copying of "
    "software. This Corresponding Source shall include the Corresponding Source for any work covered by version 3 of the GPL that is "
    "incorporated pursuant to the following paragraph. Notwithstanding any other provision of this License, you have permission to link "
    "or combine any covered work with a work licensed under version 3 of the GPL into a single combined work, and to convey the resulting "
    "work. The terms of this License will continue to apply to the part which is the covered work, but the work with which it is combined "
    "will remain governed by version 3 of the GPL.",
    TEMPLATES["GPL-3 text"].replace("GNU AFFERO", "GNU Affero"), flags=re.DOTALL | re.IGNORECASE)
TEMPLATES["AGPL-3 text"] = re.sub(r"GNU General Public", "GNU Affero General Public", TEMPLATES["AGPL-3 text"],
                                  flags=re.IGNORECASE).replace("the GPL", "the GNU General Public License")

# Words that tell a notice or header from its siblings: all of the template's must match, and no other stand between.
DECIDING = set("affero apache artistic attribution boost bsd by cc clause commons documentation eclipse general gnu isc lesser library mit "
               "mozilla mpl nc nd noncommercial noderivatives noderivs sa sharealike zlib 0 1 2 3 4 5 v1 v2 v3".split())


def rising(numbers: list[int]) -> list[int]:
    """Places of a longest increasing run."""
    tails: list[int] = []
    places: list[int] = []
    before: list[int] = []
    for i, n in enumerate(numbers):
        at = bisect_left(tails, n)
        before.append(places[at - 1] if at else -1)
        tails[at:at + 1], places[at:at + 1] = [n], [i]
    run, i = [], places[-1] if places else -1
    while i >= 0:
        run.append(i)
        i = before[i]
    return run[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of equal words, rising in both."""
    pairs: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            pairs.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            pairs.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: i for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and in_b[w] == 1}
        both = [(place[w], j) for j, w in enumerate(b[b0:b1], b0) if w in place]
        anchors = [both[i] for i in rising([i for i, _ in both])]
        if anchors:
            pairs += anchors
            ends = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            gaps += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(ends, ends[1:])]
    return sorted(pairs)


class Template:
    def __init__(self, name: str, text: str, least: float):
        self.name, self.words = name, WORD.findall(text.lower())
        self.counts = Counter(self.words)
        self.marks = {w for w, n in self.counts.items() if n == 1 and w not in COMMON}
        self.least = max(1, math.ceil(least * len(self.words)))
        # Of the words that must match, at most so many are none of the marks.
        self.marks_needed = max(1, self.least - (len(self.words) - len(self.marks)))
        # A notice, a header or a text.
        self.kind = name.split()[-1] if name.endswith((" notice", " header")) else "text"
        self.deciding = DECIDING & self.counts.keys() if self.kind != "text" else set()
        self.forward, self.backward = bits(self.words), bits(self.words[::-1])

    def near(self, known: set[str], n: int) -> bool:
        """Whether a text of so many words, these among them, can reach the coverage."""
        return (n >= self.least and self.deciding <= known and len(self.marks & known) >= self.marks_needed
                and sum(c for w, c in self.counts.items() if w in known) >= self.least)

    def decided(self, words: list[str], pairs: list[tuple[int, int]]) -> bool:
        """Whether a notice is this one and none of its siblings."""
        if self.kind == "text":
            return True
        matched = Counter(self.words[j] for _, j in pairs)
        return (all(matched[w] == self.counts[w] for w in self.deciding)
                and DECIDING.intersection(words[pairs[0][0]:pairs[-1][0] + 1]) <= self.deciding)

    def stretches(self, words: list[str]) -> list[tuple[int, int]]:
        """Where words of the template follow each other within its length, and enough of them to reach the coverage."""
        at = [i for i, w in enumerate(words) if w in self.counts]
        begins = [k for k in range(len(at)) if not k or at[k] - at[k - 1] > len(self.words)]
        found = []
        for b, e in zip(begins, [*begins[1:], len(at)]):
            if e - b >= self.least:
                held = Counter(words[i] for i in at[b:e])
                if sum(min(n, self.counts[w]) for w, n in held.items()) >= self.least:
                    found.append((at[b], at[e - 1] + 1))
        return found

    def regions(self, words: list[str]) -> list[tuple[int, int]]:
        """Stretches of a text that hold one copy each."""
        return [region for low, high in self.stretches(words) for region in self.copies(words, low, high)]

    def copies(self, words: list[str], low: int, high: int) -> list[tuple[int, int]]:
        cores, at = [], low
        while True:
            # The copy that ends first, as short as it can be; so no other copy apart from it is lost.
            end = next((i + 1 for i, n in common(words, range(at, high), self.forward) if n >= self.least), None)
            if end is None:
                break
            cores.append((next(i for i, n in common(words, range(end - 1, at - 1, -1), self.backward) if n >= self.least), end))
            at = end
        found = []
        for k, (begin, end) in enumerate(cores):
            end = self.reach(words, range(begin, cores[k + 1][0] if k + 1 < len(cores) else high), self.forward, end - 1) + 1
            begin = self.reach(words, range(end - 1, (found[-1][1] if found else low) - 1, -1), self.backward, begin)
            found.append((begin, end))
        return found

    def reach(self, words: list[str], places: range, masks: dict[str, int], core: int) -> int:
        """The last place, at the core's end or behind, at which more words match; none further off than the template's length."""
        last, most, past = core, 0, False
        for i, n in common(words, places, masks):
            if n > most:
                most = n
                last = i if past or i == core else last
            past |= i == core
            if n == len(self.words) or past and abs(i - last) > len(self.words):
                break
        return last


def bits(words: list[str]) -> dict[str, int]:
    masks: dict[str, int] = {"": (1 << len(words)) - 1}
    for i, w in enumerate(words):
        masks[w] = masks.get(w, 0) | 1 << i
    return masks


def common(words: list[str], places: range, masks: dict[str, int]):
    """Each place of a word of the template, with the length of the longest common subsequence up to there, by bits."""
    row = whole = masks[""]
    n = 0
    for i in places:
        match = masks.get(words[i])
        if match:
            step = row & match
            after = (row + step | row - step) & whole
            if after != row:
                row, n = after, (whole ^ after).bit_count()
        yield i, n


def longest(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of a longest common subsequence."""
    masks = bits(b)
    rows = [masks[""]]
    for w in a:
        step = rows[-1] & masks.get(w, 0)
        rows.append((rows[-1] + step | rows[-1] - step) & masks[""])
    pairs, i, j = [], len(a), len(b)
    while i and j:
        if rows[i] >> j - 1 & 1:
            j -= 1
        else:
            i -= 1
            if rows[i] >> j - 1 & 1:
                j -= 1
                pairs.append((i, j))
    return pairs[::-1]


def scan(text: str | None, templates: list[Template]) -> list[dict]:
    """Copies of templates in a text, in order of place, with the letters they begin and end at."""
    all_words = WORD.findall((text or "").lower())
    known = set(all_words)
    near = [t for t in templates if t.near(known, len(all_words))]
    if not near:
        return []
    # Lower case may be longer than the text, so places are taken from the text itself.
    places = [(m.start(), m.end()) for m in WORD.finditer(text)]
    words = [text[b:e].lower() for b, e in places]
    found = []
    for template in near:
        for low, high in template.regions(words):
            # Patience keeps whole lines together; where it keeps fewer words than there are, the longest run counts.
            pairs, most = align(words[low:high], template.words), longest(words[low:high], template.words)
            pairs = pairs if len(pairs) == len(most) else most
            if template.decided(words[low:high], pairs):
                found.append((template.kind, 2 * len(pairs) - len(template.words), {
                    "license": template.name, "coverage": len(pairs) / len(template.words),
                    "begin": places[low + pairs[0][0]][0], "end": places[low + pairs[-1][0]][1]}))
    return sorted(best(found), key=lambda m: (m["begin"], m["license"], m["end"]))


def best(found: list[tuple[str, int, dict]]) -> list[dict]:
    """Of overlapping copies of one kind the one with most words matched beyond those missing, then of the best coverage."""
    kept: list[tuple[str, dict]] = []
    for kind, _, m in sorted(found, key=lambda f: (-f[1], -f[2]["coverage"], f[2]["begin"], f[2]["license"])):
        if all(k != kind or m["end"] <= o["begin"] or o["end"] <= m["begin"] for k, o in kept):
            kept.append((kind, m))
    return [m for _, m in kept]


MATCHES = T.ArrayType(T.StructType([T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()),
                                    T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))
_ARROW = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("begin", pa.int64()), ("end", pa.int64())]))


def find(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8) -> DataFrame:
    """``docs`` with ``matches``, the copies of ``templates`` in each text with at least that coverage."""
    known = [Template(name, text, least) for name, text in (TEMPLATES if templates is None else templates).items()]

    @F.arrow_udf(MATCHES)
    def matches(texts: pa.Array) -> pa.Array:
        return pa.array([scan(t.as_py(), known) for t in texts], _ARROW)
    return docs.withColumn("matches", matches("text"))
