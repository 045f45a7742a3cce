"""License scans by patience alignment.

A text and a license template are aligned on the words that occur once in either: the longest
increasing subsequence of their positions gives the anchors, and the gaps between them are aligned
in the same way, with what is unique inside them. The coverage is the aligned share of the template.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lettermill.llm.common import id_and_text, slices

# The usual wording of licenses and license notices.
MIT_PERMISSION = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
MIT_CONDITION = ", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
MIT_WARRANTY = " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
X11_NAME = " Except as contained in this notice, the name of the copyright holders shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization."
BSD_FORMS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
BSD_TWO = ": Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_NAME = " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_WARRANTY = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
GNU_NOTICE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
CC_LINE = "This work is licensed under a Creative Commons Attribution{} 4.0 International License."
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "Apache-1.1": "Licensed under the Apache License, Version 1.1.",
    "MIT": MIT_PERMISSION + MIT_CONDITION + MIT_WARRANTY,
    "MIT-0": MIT_PERMISSION + "." + MIT_WARRANTY,
    "X11": MIT_PERMISSION + MIT_CONDITION + MIT_WARRANTY + X11_NAME,
    "MIT-permission": MIT_PERMISSION + ".",
    "MIT-line": "Released under the MIT License.",
    "MIT-licensed-line": "Licensed under the MIT License.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause": BSD_FORMS + BSD_TWO + BSD_WARRANTY,
    "BSD-3-Clause": BSD_FORMS + BSD_TWO + BSD_NAME + BSD_WARRANTY,
    "BSD-sentence": BSD_FORMS + ":",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": GNU_NOTICE.format("General Public License", "2"),
    "GPL-3.0-notice": GNU_NOTICE.format("General Public License", "3"),
    "LGPL-2.1-notice": GNU_NOTICE.format("Lesser General Public License", "2.1"),
    "LGPL-3.0-notice": GNU_NOTICE.format("Lesser General Public License", "3"),
    "AGPL-3.0-notice": GNU_NOTICE.format("Affero General Public License", "3"),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0": CC_LINE.format(""),
    "CC-BY-NC-4.0-line": CC_LINE.format("-NonCommercial"),
    "CC-BY-SA-4.0-line": CC_LINE.format("-ShareAlike"),
    "CC-BY-ND-4.0-line": CC_LINE.format("-NoDerivatives"),
    "CC-BY-NC-SA-4.0-line": CC_LINE.format("-NonCommercial-ShareAlike"),
    "CC-BY-NC-ND-4.0-line": CC_LINE.format("-NonCommercial-NoDerivatives"),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "ARR": "All rights reserved.",
    "MIT-heading": "MIT License",
    "Apache-2.0-heading": "Apache License Version 2.0, January 2004",
    "BSD-2-Clause-conditions": BSD_FORMS + BSD_TWO,
    "BSD-3-Clause-conditions": BSD_FORMS + BSD_TWO + BSD_NAME,
    "GPL-2.0-short": "Licensed under the GPL v2.",
    "GPL-3.0-short": "Licensed under the GPL v3.",
    "GPL-2.0-only-notice": "GNU General Public License version 2 as published by the Free Software Foundation",
    "GPL-3.0-only-notice": "GNU General Public License version 3 as published by the Free Software Foundation",
}
SPDX = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-1.1", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "GPL-2.0-only", "GPL-2.0-or-later",
    "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MIT-0", "MPL-2.0", "Unlicense", "X11",
)
TEMPLATES |= {f"SPDX-{x}": f"SPDX-License-Identifier: {x}" for x in SPDX}
WORD = re.compile(r"\w+(?:[.-]\w+)*")
NC, SA, ND = r"\W*non\W?commercial", r"\W*share\W?alike", r"\W*no\W?deriv\w*"


def _cc(kind: str) -> str:
    return rf"\battribution{kind}\W+(?:(?:international|public|licen[sc]e|version|v|cc|by)\W+){{0,3}}4\.0(?!\.?\d)"


def _gpl(n: int) -> str:
    return rf"\bgnu\W+general\W+public\W+licen[sc]e\W+(?:gpl\W+)?(?:(?:version|v)?\W*\d(?:\.\d)?\W+(?:and|or)\W+)?(?:version\W+|v\W*)?{n}(?:\.0)?\b(?!\.\d)"


def _apache(n: str) -> str:
    return rf"\bapache\W+(?:\w+\W+){{0,3}}?{re.escape(n)}(?!\.?\d)"


#: What tells a template from its siblings, whatever the coverage: it stands in the aligned span, or up to TAIL words behind.
TELLING = {
    "Apache-2.0": _apache("2.0"),
    "Apache-2.0-notice": _apache("2.0"),
    "Apache-1.1": _apache("1.1"),
    "GPL-3.0": _gpl(3),
    "GPL-2.0": _gpl(2),
    "GPL-2.0-notice": r"\bgnu\W+general\W+public\W+licen[sc]e.*?\bversion\W+2\b(?!\.[1-9])",
    "GPL-3.0-notice": r"\bgnu\W+general\W+public\W+licen[sc]e.*?\bversion\W+3\b(?!\.[1-9])",
    "LGPL-2.1-notice": r"\bgnu\W+lesser\W+general\W+public\W+licen[sc]e.*?\bversion\W+2\.1\b",
    "LGPL-3.0-notice": r"\bgnu\W+lesser\W+general\W+public\W+licen[sc]e.*?\bversion\W+3\b(?!\.[1-9])",
    "AGPL-3.0-notice": r"\bgnu\W+affero\W+general\W+public\W+licen[sc]e.*?\bversion\W+3\b(?!\.[1-9])",
    "MPL-2.0": r"\bmozilla\W+public\W+licen[sc]e\W+(?:version|v)?\W*2\.0",
    "MIT": r"\bcopyright\W+notice\W+and\W+this\W+permission\W+notice",
    "MIT-line": r"\bmit\b",
    "MIT-licensed-line": r"\bmit\b",
    "X11": r"\bexcept\W+as\W+contained\W+in\W+this\W+notice",
    "BSD-3-Clause": r"\bendorse\W+or\W+promote\b",
    "CC-BY-4.0": _cc(""),
    "CC-BY-NC-4.0-line": _cc(NC),
    "CC-BY-SA-4.0-line": _cc(SA),
    "CC-BY-ND-4.0-line": _cc(ND),
    "CC-BY-NC-SA-4.0-line": _cc(NC + SA),
    "CC-BY-NC-ND-4.0-line": _cc(NC + ND),
}
#: What tells a template from its siblings by not being there: in the aligned span, or up to TAIL words before or behind.
LACKING = {
    "MIT-0": TELLING["MIT"],
    "MIT-permission": TELLING["MIT"],
    "BSD-2-Clause": TELLING["BSD-3-Clause"],
    "BSD-2-Clause-conditions": TELLING["BSD-3-Clause"],
    "ARR": r"\b(?:not|without|no)\W+all\W+rights",
}
TELLING |= {
    "BSD-3-Clause-conditions": TELLING["BSD-3-Clause"],
    "GPL-2.0-short": r"\bgpl\W*v2\b",
    "GPL-3.0-short": r"\bgpl\W*v3\b",
    "GPL-2.0-only-notice": TELLING["GPL-2.0-notice"],
    "GPL-3.0-only-notice": TELLING["GPL-3.0-notice"],
    "Apache-2.0-heading": TELLING["Apache-2.0"],
}
TAIL = 3
#: Aligned share of a template from which a text carries the license.
COVERAGE = 0.85
#: What a match is: words of a text that lie at most so many times the template's length apart (words that are further apart are no notice).
STRETCH = 2


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence."""
    tops, tails, back = [], [], []
    for i, v in enumerate(values):
        at = bisect_left(tops, v)
        back.append(tails[at - 1] if at else -1)
        if at == len(tops):
            tops.append(v)
            tails.append(i)
        else:
            tops[at], tails[at] = v, i
    out, i = [], tails[-1] if tails else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned places of two word lists, ascending in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:  # equal ends need no anchors
            out.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            out.append((ahi, bhi))
        if alo >= ahi or blo >= bhi:
            continue
        once_a, once_b = Counter(a[alo:ahi]), Counter(b[blo:bhi])
        where = {w: j for j, w in enumerate(b[blo:bhi], blo) if once_b[w] == 1 and once_a[w] == 1}
        both = [(i, where[w]) for i, w in enumerate(a[alo:ahi], alo) if w in where]
        anchors = [both[k] for k in increasing([j for _, j in both])]
        if not anchors:
            continue
        out += anchors
        ends = [(alo - 1, blo - 1), *anchors, (ahi, bhi)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(ends, ends[1:], strict=False)]
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, str], telling: dict[str, str] | None = None, lacking: dict[str, str] | None = None):
        self.lacking = {k: re.compile(v, re.IGNORECASE | re.DOTALL) for k, v in (lacking or {}).items()}
        self.telling = {k: re.compile(v, re.IGNORECASE | re.DOTALL) for k, v in (telling or {}).items()}
        self.templates = {k: words_of(v) for k, v in sorted(templates.items())}
        joined = {k: f" {' '.join(t)} " for k, t in self.templates.items()}
        self.wholes = {k: {n for n, y in joined.items() if x in y and x != y} for k, x in joined.items()}  # templates of which one is a part
        self.words = {w for t in self.templates.values() for w in t}
        self.vocabulary = {k: Counter(dict(sorted(Counter(t).items(), key=lambda x: -len(x[0])))) for k, t in self.templates.items()}  # longer words first: those that texts often don't have

    def windows(self, places: list[tuple[int, str]], name: str, coverage: float) -> Iterator[list[tuple[int, str]]]:
        """Windows, STRETCH times the template long, from each of its words in a text; only those in which
        so many of its words occur that an alignment of the coverage is possible at all."""
        bag = self.vocabulary[name]
        size = len(self.templates[name])
        need, own = coverage * size, [x for x in places if x[1] in bag]
        inside: Counter[str] = Counter()
        end = shared = 0
        for start, (p, word) in enumerate(own):
            while end < len(own) and own[end][0] < p + STRETCH * size:
                w = own[end][1]
                shared += inside[w] < bag[w]
                inside[w] += 1
                end += 1
            if shared >= need:
                yield own[start:end]
            inside[word] -= 1
            shared -= inside[word] < bag[word]

    def possible(self, there: Counter[str], name: str, coverage: float) -> bool:
        """Whether a text has enough of the template's words."""
        spare = len(self.templates[name]) * (1 - coverage)
        for w, n in self.vocabulary[name].items():
            if (m := there.get(w, 0)) < n:
                spare -= n - m
                if spare < -1e-9:
                    return False
        return True

    def scan(self, text: str, coverage: float) -> list[tuple[str, float, int, int]]:
        """Licenses of a text: name, coverage, first and one past the last character."""
        matches = [(m.start(), m.end(), m.group()) for m in WORD.finditer(text)] if text else []
        lower = [(i, w) for i, (_, _, raw) in enumerate(matches) if (w := raw.lower()) in self.words]
        there = Counter(w for _, w in lower)
        out = []
        for name in self.templates:
            if not self.possible(there, name, coverage):
                continue
            best = (0.0, 0, -1)
            for part in self.windows(lower, name, coverage):
                if best[0] == 1.0:  # none can be better, or as good and earlier
                    break
                pairs = align([w for _, w in part], self.templates[name])
                if not pairs or len(pairs) < coverage * len(self.templates[name]):
                    continue
                first, last = part[pairs[0][0]][0], part[pairs[-1][0]][0]
                if name in self.telling and not self.telling[name].search(text, matches[first][0], matches[min(last + TAIL, len(matches) - 1)][1]):
                    continue
                if name in self.lacking and self.lacking[name].search(text, matches[max(0, first - TAIL)][0], matches[min(last + TAIL, len(matches) - 1)][1]):
                    continue
                best = max(best, (len(pairs) / len(self.templates[name]), -first, last))
            if best[0] >= coverage:
                out.append((name, best[0], matches[-best[1]][0], matches[best[2]][1]))
        longer = lambda x, y: len(self.templates[y[0]]) > len(self.templates[x[0]]) and y[2] <= x[2] and x[3] <= y[3]
        return [x for x in out if not any(longer(x, y) or y[0] in self.wholes[x[0]] for y in out)]


SCHEMA = "doc_id long, n_chars long, n_licenses int, license string, coverage double, span_start long, span_end long, all_licenses string"


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """A row for each document: its licenses with the best aligned template.

    license, coverage and the span in characters are of the template with the largest coverage (of
    equals the longest, then the first by name), null without one; all_licenses has the names of all
    templates with the coverage, joined by commas, but for those that are part of a longer one's match or template. A match is
    at most STRETCH times as long as its template. The own templates also need what tells them from their
    siblings (see TELLING and LACKING). A null or empty text has none; a null doc_id stays
    null; repeated rows give repeated rows; an empty table gives no rows. Only doc_id and text are read.
    """
    chosen, telling, lacking = (dict(TEMPLATES), dict(TELLING), dict(LACKING)) if templates is None else (dict(templates), {}, {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen, telling, lacking)
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        types = [pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.string()]
        for batch in slices(batches, "text"):
            rows = []
            for text in batch.column("text").to_pylist():
                found = scanner.scan(text, coverage)
                best = max(found, key=lambda x: (x[1], len(scanner.templates[x[0]])), default=(None, None, None, None))
                rows.append((len(text), len(found), *best, ",".join(x[0] for x in found) or None))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names=names)

    return id_and_text(docs).mapInArrow(run, SCHEMA)
