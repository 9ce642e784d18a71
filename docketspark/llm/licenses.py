"""License scans: winnowed template fingerprints, an inverted index, and banded alignment.

Words are lower-cased runs of letters and digits. Runs of ``gram`` words are hashed, and every window of ``window``
such runs selects its smallest hash, in templates and documents alike: a shared stretch of window + gram - 1 words
always shares a selected fingerprint. The index from fingerprint to (template, place) is built from the templates,
a table given by the caller that must be small enough for one machine; its size is checked against ``max_index``.

Templates are cut into paragraphs. Hits of a document that suggest about the same start of a paragraph are taken
together, and the words there are aligned with it within a band around that diagonal (matches count 1, mismatches and
gaps -1, ends free). Paragraphs that follow each other as in the template are one match, reported if one of them is
covered to ``coverage``, with the share of the whole template's words that match (coverage), the span of words and its
text. So one paragraph of a license is found, and has the small share it is. A template of fewer than EXACT words is a
notice, of which one word is the name or version, and must match whole.

Null and empty texts and templates match nothing. Repeated rows are scanned each. Of overlapping matches of one
license the one with most matched words, then the earliest, is reported. Different licenses are independent, but
for paragraphs inside a longer match of another license: they belong to that one.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import Words, slices, span_hashes

GRAM, WINDOW, BAND, COVERAGE = 3, 2, 4, 0.8
MAX_INDEX = 2_000_000

#: a paragraph of fewer words is joined to its neighbour; a text of fewer than EXACT words must match whole
PART, EXACT, SLACK = 20, 16, 40

_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
    "to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:\n\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
)
_BSD_NAME = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission.\n\n"
)
_BSD_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU = (
    "This {what} is free software{sep} you can redistribute it and/or modify it under the terms of the GNU {name} as published "
    "by the Free Software Foundation; either version {version} of the License, or (at your option) any later version.\n\n"
    "This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
    "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
)

#: fixed values: public license texts; those in license_texts/ are whole files, added by ``template_table``
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "MIT": (
        _GRANT + "\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        'the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL "
        "THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
        "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n"
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
        "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
        "THIS SOFTWARE."
    ),
    "BSD-2-Clause": _BSD + _BSD_DISCLAIMER,
    "BSD-3-Clause": _BSD + _BSD_NAME + _BSD_DISCLAIMER,
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0\n\nUnless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License."
    ),
    "GPL-2.0-header": _GNU.format(what="program", sep=";", name="General Public License", version="2"),
    "GPL-3.0-header": _GNU.format(what="program", sep=":", name="General Public License", version="3"),
    "LGPL-2.1-header": _GNU.format(what="library", sep=";", name="Lesser General Public License", version="2.1"),
    "LGPL-3.0-header": _GNU.format(what="library", sep=":", name="Lesser General Public License", version="3"),
    "AGPL-3.0-header": _GNU.format(what="program", sep=":", name="Affero General Public License", version="3"),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
}

#: the names a notice gives a license
NAMES = {
    "MIT": ("MIT License", "MIT/X11 License"),
    "ISC": ("ISC License",),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License"),
    "BSD": ("BSD License",),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "Mozilla Public License, v. 2.0"),
    **{f"{short}-{v}": tuple(f"GNU {name}{x}" for x in (f", version {v.removesuffix('.0')}", f" v{v.removesuffix('.0')}", f", version {v}", f" v{v}")) for short, name, versions in (("GPL", "General Public License", ("2.0", "3.0")), ("LGPL", "Lesser General Public License", ("2.1", "3.0")), ("AGPL", "Affero General Public License", ("3.0",))) for v in versions},
    "BSL-1.0": ("Boost Software License, Version 1.0",),
    "CC0-1.0": ("CC0 1.0 Universal", "CC0 1.0", "Creative Commons Zero v1.0 Universal"),
    **{f"CC-{part}-{v}": (f"CC {part} {v}", f"CC-{part}-{v}", f"Creative Commons {name} {v} International License" if v == "4.0" else f"Creative Commons {name} {v} Unported License", f"Creative Commons {name} {v} License") for v in ("3.0", "4.0") for part, name in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))},
    "Unlicense": ("Unlicense",),
}
_PHRASES = ("under the {}", "under {}", "under a {}", "under the terms of the {}", "under the terms of {}", "subject to the {}", "subject to the terms of the {}")
_SPDX = ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "MPL-2.0", "BSL-1.0", "CC0-1.0", "Unlicense", *(f"{x}{y}" for x in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for y in ("", "-only", "-or-later")), *(n for n in NAMES if n.startswith("CC-")))


def template_table() -> list[tuple[str, str]]:
    """(license, text): TEMPLATES, the whole texts of license_texts/, and notices that name a license."""
    folder = resources.files(__package__) / "license_texts"
    whole = sorted((f.name.removesuffix(".txt"), f.read_text("utf-8")) for f in folder.iterdir() if f.name.endswith(".txt"))
    notices = [(f"{license}-notice", phrase.format(name)) for license, names in NAMES.items() for name in names for phrase in _PHRASES]
    tags = [(f"{tag}-notice", f"SPDX-License-Identifier: {tag}") for tag in _SPDX]
    return [*TEMPLATES.items(), *whole, *notices, *tags]


def parts_of(text: str) -> list[str]:
    """The paragraphs of a text, those of fewer than PART words joined to the next (the last to the one before)."""
    parts, held = [], ""
    for paragraph in re.split(r"\n\s*\n|\f", text or ""):
        held = f"{held} {paragraph}" if held else paragraph
        if len(re.findall(r"[^\W_]+", held)) >= PART:
            parts.append(held)
            held = ""
    if held and parts:
        parts[-1] += " " + held
    return parts or [text or ""]


class Prints:
    """Word hashes of consecutive documents and the places of their selected runs."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, gram: int, window: int) -> None:
        self.words = w = Words(data, offsets, lower=True, plain=True)
        self.hashes = w.hashes()
        # the last windows of a document, or its only one, may hold fewer runs
        left = w.counts[w.doc] - w.place if len(w.doc) else w.doc
        at = np.flatnonzero((left >= gram) | (w.place == 0))
        runs = span_hashes(self.hashes, at, np.minimum(at + gram, at + left[at]))
        doc = w.doc[at]
        chosen = np.arange(len(at))
        for j in range(1, window):
            nxt = np.minimum(np.arange(len(at)) + j, len(at) - 1)
            better = (doc[nxt] == doc) & (runs[nxt] < runs[chosen])
            chosen = np.where(better, nxt, chosen)
        begins = np.ones(len(at), bool)
        begins[1:] = doc[1:] != doc[:-1]
        full = np.concatenate([doc[window - 1 :] == doc[: len(doc) - window + 1], np.zeros(min(window - 1, len(doc)), bool)])
        picked = np.unique(chosen[full | begins])
        self.at, self.runs = at[picked], runs[picked]


def _text_prints(text: str, gram: int, window: int) -> Prints:
    data = np.frombuffer((text or "").encode(), np.uint8)
    return Prints(data, np.array([0, len(data)]), gram, window)


def align(doc: np.ndarray, template: np.ndarray, band: int) -> tuple[int, int, int]:
    """(matched words, start, end) of the best local alignment of two hash sequences, |diagonal| <= band.

    doc[i] stands on diagonal i - j - band of template[j]; cells outside the band do not exist.
    """
    width = 2 * band + 1
    score, matched, begin = [0] * (width + 1), [0] * (width + 1), [0] * (width + 1)
    best = (0, 0, 0, 0)
    for j, t in enumerate(template.tolist()):
        new_score, new_matched, new_begin = [0] * (width + 1), [0] * (width + 1), [0] * (width + 1)
        for d in range(width):
            i = j + d
            if i >= len(doc):
                continue
            same = int(doc[i]) == t
            # diagonal d of the row before, a gap in the document (d + 1 before), a gap in the template (d - 1 here)
            steps = [(score[d] + (1 if same else -1), matched[d] + same, begin[d] if score[d] > 0 else i), (score[d + 1] - 1, matched[d + 1], begin[d + 1])]
            if d:
                steps.append((new_score[d - 1] - 1, new_matched[d - 1], new_begin[d - 1]))
            s, m, b = max(steps, key=lambda x: (x[0], x[1], -x[2]))
            if s <= 0:
                continue
            new_score[d], new_matched[d], new_begin[d] = s, m, b
            best = max(best, (s, m, -b, i + 1))
        score, matched, begin = new_score, new_matched, new_begin
    return best[1], -best[2], best[3]


class Apart:
    """Spans of which no two share more than a number of places.

    Spans of up to that length share no more with any; of longer ones, those that begin later also end later, so that a new one has
    to be compared with its neighbours alone.
    """

    def __init__(self, shared: int = 0) -> None:
        self.shared, self.begins, self.ends = shared, [], []

    def add(self, b: int, e: int) -> bool:
        """Whether the span may stay; if so it does."""
        if e - b <= self.shared:
            return True
        at = bisect_right(self.begins, b)
        if any(min(e, self.ends[k]) - max(b, self.begins[k]) > self.shared for k in (at - 1, at) if 0 <= k < len(self.begins)):
            return False
        self.begins.insert(at, b)
        self.ends.insert(at, e)
        return True


def within_longer(spans: list[tuple[str, int, int, int, int]]) -> list[bool]:
    """For each (name, matched, size, start, end), in the order of falling matched, whether one with more matched holds it.

    A tree over the starts keeps the furthest end of all spans that begin up to each.
    """
    starts = sorted({x[3] for x in spans})
    furthest = [-1] * (len(starts) + 1)
    out, waiting = [], []
    for k, (_, m, _, b, e) in enumerate(spans):
        if k and m < spans[k - 1][1]:
            for begin, end in waiting:
                i = bisect_right(starts, begin)
                while i <= len(starts):
                    furthest[i] = max(furthest[i], end)
                    i += i & -i
            waiting = []
        waiting.append((b, e))
        i, most = bisect_right(starts, b), -1
        while i > 0:
            most = max(most, furthest[i])
            i -= i & -i
        out.append(most >= e)
    return out


def scan(docs: DataFrame, templates: dict[str, str] | Iterable[tuple[str, str]] | None = None, id_col: str = "doc_id", gram: int = GRAM, window: int = WINDOW, band: int = BAND, coverage: float = COVERAGE, max_index: int = MAX_INDEX) -> DataFrame:
    """(id, license, coverage, start, end, matched_text): the words start..end of a document that match a license."""
    rows = template_table() if templates is None else templates.items() if isinstance(templates, dict) else templates
    named = sorted(dict.fromkeys((n, t or "") for n, t in rows))
    index, bodies, owner, begin = defaultdict(list), [], [], []
    sizes = [0] * len(named)
    for t, (_, text) in enumerate(named):
        for part in parts_of(text):
            prints = _text_prints(part, gram, window)
            for h, at in zip(prints.runs.tolist(), prints.at.tolist(), strict=True):
                index[h].append((len(bodies), at))
            bodies.append(prints.hashes)
            owner.append(t)
            begin.append(sizes[t])
            sizes[t] += len(prints.hashes)
    if sum(map(len, index.values())) > max_index:
        raise ValueError(f"templates have more than {max_index} fingerprints")
    shared = docs.sparkSession.sparkContext.broadcast((dict(index), bodies, [np.unique(b) for b in bodies], owner, begin, sizes, [n for n, _ in named], np.array(sorted(index), np.uint64)))

    def place(doc: np.ndarray, hits: list[tuple[int, int]], index: dict, bodies: list[np.ndarray], vocabulary: list[np.ndarray]) -> Iterator[tuple[int, int, int, int]]:
        """(part, matched, start, end) of parts of which half or more matches, hits being (place, fingerprint) of one document."""
        offsets = defaultdict(set)
        for at, h in hits:
            for p, begins in index[h]:
                offsets[p].add(at - begins)
        for p, starts in offsets.items():
            body, found, last = bodies[p], [], None
            n = len(body)
            least = n if n < EXACT else n / 2
            for start in sorted(starts):
                if start >= 0 and np.array_equal(doc[start : start + n], body):
                    found.append((n, start, start + n))
                    last = start
                    continue
                if n < EXACT or last is not None and start - last <= band:
                    continue
                last = start
                lo = start - band
                inside = doc[max(0, lo) : start + n + band]
                # no more words can match than stand in the piece at all
                slot = np.minimum(np.searchsorted(vocabulary[p], inside), len(vocabulary[p]) - 1)
                if np.count_nonzero(vocabulary[p][slot] == inside) < least:
                    continue
                m, b, e = align(np.concatenate([np.zeros(max(0, -lo), np.uint64), inside]), body, band)
                if m >= least:
                    found.append((m, lo + b, lo + e))
            taken = Apart()
            yield from ((p, m, b, e) for m, b, e in sorted(found, key=lambda x: (-x[0], x[1])) if taken.add(b, e))

    def matches(doc: np.ndarray, hits: list[tuple[int, int]], index: dict, bodies: list[np.ndarray], vocabulary: list[np.ndarray], owner: list[int], begin: list[int], sizes: list[int], names: list[str]) -> Iterator[tuple[str, float, int, int]]:
        """(license, coverage, start, end): parts of one text that follow each other as in the text are one match."""
        by_text, chains = defaultdict(list), []
        for p, m, b, e in place(doc, hits, index, bodies, vocabulary):
            by_text[owner[p]].append((b, p, m, e))
        for t, found in by_text.items():
            apart = Apart(band)
            kept = [(b, p, m, e) for b, p, m, e in sorted(found, key=lambda x: (-x[2] / len(bodies[x[1]]), -x[2], x[0])) if apart.add(b, e)]
            ended: list[list] = []  # [last part, words matched, start, end, a part at the threshold]
            open_: list[list] = []  # those that a part may still continue
            for b, p, m, e in sorted(kept):
                good = m >= coverage * len(bodies[p])
                # a chain whose end lies further back than the text is long goes on no more
                ended += [c for c in open_ if b - c[3] > sizes[t] + SLACK]
                open_ = [c for c in open_ if b - c[3] <= sizes[t] + SLACK]
                # the latest chain that this part continues
                for c in reversed(open_):
                    if c[0] < p and -band <= b - c[3] <= begin[p] - begin[c[0]] - len(bodies[c[0]]) + SLACK:
                        c[0], c[1], c[3], c[4] = p, c[1] + m, e, c[4] or good
                        break
                else:
                    open_.append([p, m, b, e, good])
            chains += [(names[t], min(c[1], sizes[t]), sizes[t], c[2], c[3]) for c in [*ended, *open_] if c[4]]
        taken = defaultdict(Apart)
        spans = sorted(chains, key=lambda x: (-x[1], x[3], x[2]))
        covered = within_longer(spans)
        for (name, m, n, b, e), inside in zip(spans, covered, strict=True):
            # paragraphs that several licenses share go to those with the longest match there
            if not (m < coverage * n and inside) and taken[name].add(b, e):
                yield name, m / n, b, e

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, bodies, vocabulary, owner, begin, sizes, names, known = shared.value
        for batch in batches:
            rows = []
            for row, _, data, offsets in slices(batch.column(1)):
                p = Prints(data, offsets, gram, window)
                w, slot = p.words, np.searchsorted(known, p.runs)
                hit = np.flatnonzero(known[np.minimum(slot, len(known) - 1)] == p.runs) if len(known) else slot[:0]
                by_doc = defaultdict(list)
                for a, h in zip(p.at[hit].tolist(), p.runs[hit].tolist(), strict=True):
                    by_doc[int(w.doc[a])].append((int(w.place[a]), h))
                for d, hits in by_doc.items():
                    first, last = int(w.first[d]), int(w.first[d + 1])
                    for name, share, b, e in matches(p.hashes[first:last], hits, index, bodies, vocabulary, owner, begin, sizes, names):
                        rows.append((row + d, name, share, b, e, bytes(data[w.starts[first + b] : w.ends[first + e - 1]]).decode(errors="replace")))
            if rows:
                at, lic, cov, b, e, text = zip(*rows, strict=True)
                yield pa.record_batch([batch.column(0).take(pa.array(at)), pa.array(lic), pa.array(cov), pa.array(b, pa.int64()), pa.array(e, pa.int64()), pa.array(text)], names=[id_col, "license", "coverage", "start", "end", "matched_text"])

    schema = docs.select(id_col).schema.add("license", "string").add("coverage", "double").add("start", "long").add("end", "long").add("matched_text", "string")
    return docs.select(id_col, "text").mapInArrow(run, schema)
