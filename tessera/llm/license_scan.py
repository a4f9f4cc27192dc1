"""License scans: winnowed fingerprints pick candidates, banded alignment reports coverage and spans.

Templates and documents are words, lower-cased, of letters and digits. From every
three grams of three words in a row the least hash is a fingerprint; the fingerprints of all templates form an inverted
index, small and bounded by the templates. Where a document has fingerprints of a
template near one diagonal, the words around are aligned with the template (local alignment
in a band), which gives the share of the template that is matched and the span in the document.

Any run of five words that a template and a document have in common shares a fingerprint.

Licenses of one family differ in few words, so coverage alone doesn't name them. A notice (a template of at most ``NOTICE_WORDS`` words) matches only where
the words of the span that aren't FILLERS are the template's, in order. A longer template with TELLING words (names, numbers up to 99)
matches only where the span has the same ones; templates without any, such as those of MIT or BSD, go by coverage.

Defined results: null and wordless texts match nothing; a template of fewer than three words is refused; of matches that overlap in the document, the one
with more matched words stays (then the greater coverage, then the first name); repeated rows repeat; an empty table gives none. Other columns pass through; a column ``matches``, in any case, is replaced.
"""

from __future__ import annotations

import bisect
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from tessera.llm._words import Words, among, text_slices

GRAM, WINDOW, BAND, LEAST_COVERAGE = 3, 3, 8, 0.75
NOTICE_WORDS = 20
#: Words that a notice may have or lack.
FILLERS = "a an is licensed of released the this under v version work"
#: Names that tell licenses of one family apart; so do the numbers from 1 to 99.
TELLING = "affero agpl apache bsd gnu gpl isc lesser lgpl mit mozilla mpl noderivatives noncommercial sharealike"
_WORD_BYTES = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])

#: Notices and permission texts as their licenses word them.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0 header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT notice": "Released under the MIT License",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED.'
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
    "MIT full text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT '
        "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC full text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
        "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-2-Clause full text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
        "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
        "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
        "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
        "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
        "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "BSD-3-Clause full text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. "
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
        "this software without specific prior written permission. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
        "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
        "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
        "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
        "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
        "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "MPL-2.0 header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. "
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "GPL-2.0 notice": "licensed under the GNU General Public License, version 2",
    "LGPL-2.1 notice": "licensed under the GNU Lesser General Public License, version 2.1",
    "LGPL-3.0 notice": "licensed under the GNU Lesser General Public License, version 3",
    "AGPL-3.0 notice": "licensed under the GNU Affero General Public License, version 3",
    "GPL-2.0-or-later header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ),
    "LGPL-2.1-or-later header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
    "LGPL-3.0-or-later header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "AGPL-3.0-or-later header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "GPL-3.0 notice": "licensed under the GNU General Public License, version 3",
    "GPL-3.0-or-later header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0",
    "CC-BY-NC-SA-4.0 notice": "Licensed under CC BY-NC-SA 4.0",
    "CC-BY-SA-4.0 long notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC-BY-NC-4.0 long notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
}

MATCH = StructType([
    StructField("license", StringType()), StructField("coverage", DoubleType()), StructField("matched", IntegerType()),
    StructField("word_start", IntegerType()), StructField("word_end", IntegerType()), StructField("char_start", IntegerType()), StructField("char_end", IntegerType()),
])


def _words(text: str) -> Words:
    data = np.frombuffer(text.encode(), np.uint8)
    return Words(data, np.array([0, len(data)]), fold=True, word_bytes=_WORD_BYTES)


def winnow(words: Words) -> np.ndarray:
    """Places of the chosen grams: the least of each WINDOW in a row (the last of equal ones), or of all in a shorter text."""
    grams, inside = words.windows(GRAM)
    if not len(grams):
        return np.zeros(0, np.int64)
    # A window must lie in one text; in a text with fewer grams every gram is kept.
    span = max(1, len(grams) - WINDOW + 1)
    best = np.arange(span)
    for k in range(1, min(WINDOW, len(grams))):
        at = np.arange(span) + k
        best = np.where(grams[at] <= grams[best], at, best)
    whole = words.text[:span] == words.text[np.minimum(np.arange(span) + WINDOW + GRAM - 2, len(words.text) - 1)]
    size = np.bincount(words.text, minlength=words.n_texts)
    short = np.flatnonzero(inside & (size[words.text[: len(grams)]] < WINDOW + GRAM - 1))
    return np.union1d(best[whole & (np.arange(span) + WINDOW + GRAM - 2 < len(words.text))], short)


class Index:
    """The templates' words and, for each fingerprint, where it occurs in which."""

    def __init__(self, templates: dict[str, str]):
        self.names, found = list(templates), [_words(t) for t in templates.values()]
        self.words = [f.hash for f in found]
        if short := [name for name, w in zip(self.names, self.words, strict=True) if len(w) < GRAM]:
            raise ValueError(f"templates of fewer than {GRAM} words can't be found: {short}")
        held = np.unique(np.concatenate(self.words)) if found else np.zeros(0, np.uint64)
        self.nothing = np.uint64(next(v for v in range(len(held) + 1) if v not in held))
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, f in enumerate(found):
            grams = f.windows(GRAM)[0]
            for at in winnow(f).tolist():
                self.places[int(grams[at])].append((t, at))
        self.keys = np.array(sorted(self.places), np.uint64)
        self.fillers = _words(FILLERS).hash
        self.telling = _words(" ".join([TELLING, *map(str, range(1, 100))])).hash

    def named_by(self, t: int, span: np.ndarray) -> bool:
        """Whether the words of a span tell this template from its like."""
        own = self.words[t]
        if len(own) <= NOTICE_WORDS:
            return np.array_equal(*[w[~np.isin(w, self.fillers)] for w in (own, span)])
        told, found = [np.unique(w[np.isin(w, self.telling)]) for w in (own, span)]
        return not len(told) or np.array_equal(told, found)


def align(template: np.ndarray, words: np.ndarray, diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """(matched words, start, end) of the best local alignment whose cells lie within ``band`` of the diagonal.

    A match counts 2, a mismatch or a gap -1; each cell carries the start and the matches of its best path.
    """
    return aligned(template, words, diagonal, band)[:3]


def aligned(template: np.ndarray, words: np.ndarray, diagonal: int, band: int = BAND) -> tuple[int, int, int, int, int]:
    """As align(), and the start and end in the template."""
    none, best = (0, 0, 0, 0), (0, 0, 0, 0, 0, 0)
    above: dict[int, tuple[int, int, int, int]] = {}
    for i, t in enumerate(template.tolist()):
        row: dict[int, tuple[int, int, int, int]] = {}
        lo, hi = max(0, i + diagonal - band), min(len(words), i + diagonal + band + 1)
        left = none
        for j, w in zip(range(lo, hi), words[lo:hi].tolist(), strict=True) if hi > lo else ():
            score, matched, start, own = above.get(j - 1, none)
            cell = (score + 2, matched + 1, start if score else j, own if score else i) if w == t else (score - 1, matched, start, own)
            for score, matched, start, own in (above.get(j, none), left):
                if score - 1 > cell[0]:
                    cell = (score - 1, matched, start, own)
            left = row[j] = cell if cell[0] > 0 else none
            if cell[0] > best[0]:
                best = (cell[0], cell[1], cell[2], j + 1, cell[3], i + 1)
        above = row
    return best[1:]


def matches_of(words: np.ndarray, hits: list[tuple[int, int, int]], index: Index, least: float = LEAST_COVERAGE) -> list[tuple[int, float, int, int, int]]:
    """(template, coverage, matched, start, end) of one text's words, from hits (template, place in the text, place in it).

    A template is aligned along each diagonal that has hits outside what was aligned before, with words taken once only, so that
    neighbouring copies are told apart. Pieces that follow each other in the text and in the template, at most a template's length apart, are chained into one match;
    a piece that runs back into template words of the one before is aligned again together with that one.
    """
    found, by_template = [], defaultdict(list)

    def joined(template: np.ndarray, last: tuple[int, ...], piece: tuple[int, ...]) -> tuple[int, ...] | None:
        """Both as one piece, by an alignment in a band as wide as both diagonals, if that loses few of their words."""
        base, own_base, ends = last[0], last[3], [p[1] - p[4] for p in (last, piece)]
        middle, apart = sum(ends) // 2, abs(ends[0] - ends[1])
        matched, start, end, own, own_end = aligned(template[own_base:], words[base : piece[1]], middle + own_base - base, apart // 2 + 1 + BAND)
        return (base + start, base + end, matched, own_base + own, own_base + own_end) if 10 * matched >= 9 * (last[2] + piece[2]) else None

    for t, at, own in hits:
        by_template[t].append((at - own, at))
    for t, spots in by_template.items():
        template, free, pieces = index.words[t], words.copy(), []
        used, weight = np.zeros(len(words), bool), Counter(diagonal for diagonal, _ in spots)
        for diagonal, at in sorted(spots, key=lambda x: (-weight[x[0]], x)):
            lo = max(0, diagonal - BAND)
            # The three words of a hit match, so each turn takes some words, until these are among them.
            while not used[at : at + GRAM].any():
                matched, start, end, own, own_end = aligned(template, free[lo : diagonal + len(template) + BAND], diagonal - lo)
                if not matched:
                    break
                used[lo + start : lo + end] = True
                # No word of a template hashes to what stands in for used words.
                free[lo + start : lo + end] = index.nothing
                pieces.append((lo + start, lo + end, matched, own, own_end))
        chain: list[tuple[int, ...]] = []
        for piece in [*sorted(pieces), None]:
            if piece and chain and 0 <= piece[0] - chain[-1][1] <= len(template):
                if piece[3] >= chain[-1][4]:
                    chain.append(piece)
                    continue
                if both := joined(template, chain[-1], piece):
                    chain[-1] = both
                    continue
            if chain and sum(p[2] for p in chain) / len(template) >= least and index.named_by(t, words[chain[0][0] : chain[-1][1]]):
                matched = sum(p[2] for p in chain)
                found.append((t, matched / len(template), matched, chain[0][0], chain[-1][1]))
            chain = [piece] if piece else []
    # Of matches that overlap, the one with more matched words stays; those kept are in order of place.
    found.sort(key=lambda m: (-m[2], -m[1], index.names[m[0]], m[3]))
    starts: list[int] = []
    kept: list[tuple[int, float, int, int, int]] = []
    for m in found:
        k = bisect.bisect_right(starts, m[3])
        if (k == 0 or kept[k - 1][4] <= m[3]) and (k == len(kept) or m[4] <= starts[k]):
            starts.insert(k, m[3])
            kept.insert(k, m)
    return kept


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least_coverage: float = LEAST_COVERAGE) -> DataFrame:
    """docs with ``matches``: each license text found, its coverage (``least_coverage`` at least) and its span in words and characters."""
    rows = docs.drop("matches")
    schema = StructType([*rows.schema.fields, StructField("matches", ArrayType(MATCH))])
    chosen = TEMPLATES if templates is None else templates
    Index(chosen)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(chosen)
        for batch in batches:
            out: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for lo, _, data, bounds in text_slices(pa.Table.from_batches([batch])):
                words = Words(data, bounds, fold=True, word_bytes=_WORD_BYTES)
                chosen_at = winnow(words)
                grams = words.windows(GRAM)[0]
                hit = chosen_at[among(grams[chosen_at], index.keys)] if len(chosen_at) else chosen_at
                first = np.searchsorted(words.text, np.arange(words.n_texts + 1))
                by_text = defaultdict(list)
                for at in hit.tolist():
                    text = int(words.text[at])
                    by_text[text] += [(t, at - int(first[text]), own) for t, own in index.places[int(grams[at])]]
                for text, hits in by_text.items():
                    a, b = first[text], first[text + 1]
                    base = bounds[text]
                    # Characters before each byte: all bytes but those that go on with one.
                    before = np.concatenate([[0], np.cumsum((data[base : bounds[text + 1]] & 0xC0) != 0x80)])
                    for t, coverage, matched, start, end in matches_of(words.hash[a:b], hits, index, least_coverage):
                        chars = [int(before[int(x - base)]) for x in (words.starts[a + start], words.ends[a + end - 1])]
                        out[lo + text].append({"license": index.names[t], "coverage": coverage, "matched": matched, "word_start": start, "word_end": end, "char_start": chars[0], "char_end": chars[1]})
            kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), *[(n, pa.int32()) for n in ("matched", "word_start", "word_end", "char_start", "char_end")]]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], [*batch.schema.names, "matches"])

    return rows.mapInArrow(find, schema)
