"""License scans by conditional compression.

Candidate blocks are laid around every cue word of the text, one for each place where a template
has a cue, so that cue stands on cue, with a margin on both sides; sentences and lines don't bound them. Every
block is compressed alone and with each template as a raw zstandard dictionary, and the templates are ranked by
the bytes they save. From the first on, a template is confirmed by aligning its words with the block's: the first that
agrees is the block's, and what is missing or added is returned. Where wordings overlap, the one that saves most bytes wins.
"""

from __future__ import annotations

import bisect
import difflib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.llm import words as W

# Wordings to look for.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
CUE = r"(?i)(licen[sc]ed?(?![^\W_])|redistribution[\W_]+and[\W_]+use|permission[\W_]+is[\W_]+hereby|public[\W_]+license(?![^\W_]))"
SOME = r"(?i)(licen[sc]e|redistribution|hereby)"  #: stands in every cue; Arrow's patterns know no lookahead
MATCHED = 0.85  #: share of the template's words that must stand in the block, in order
SAVED = 0.25  #: least share of bytes the template must save
MARGIN = 3  #: words a block has more than its template on both sides, or a quarter of the template
_CUE = re.compile(CUE)
_WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")


def wording(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def cues(text: str, starts: list[int]) -> list[int]:
    """Which words, given where they start, cues begin in."""
    return sorted({bisect.bisect_right(starts, m.start()) - 1 for m in _CUE.finditer(text)})


class Scanner:
    """Compressors of the templates; one per worker task."""

    def __init__(self, templates: dict[str, str]) -> None:
        import zstandard as z

        self.plain = z.ZstdCompressor(level=19)
        self.templates = []
        for name, text in templates.items():
            compressor = z.ZstdCompressor(level=19, dict_data=z.ZstdCompressionDict(text.encode(), dict_type=z.DICT_TYPE_RAWCONTENT))
            wanted = wording(text)
            if wanted:
                self.templates.append((name, wanted, Counter(wanted), cues(text, [m.start() for m in _WORD.finditer(text)]), compressor))
        self.cued = all(at for _, _, _, at, _ in self.templates)

    def ranked(self, block: str) -> list[tuple[int, int]]:
        """(bytes saved, template) of every template that saves at least `SAVED` of its block, most bytes first. A block
        is as long as what it is compared in: each template sees the same bytes."""
        raw = block.encode()
        alone = len(self.plain.compress(raw))
        found = [(alone - len(t[4].compress(raw)), k) for k, t in enumerate(self.templates)]
        return sorted(((n, k) for n, k in found if n >= SAVED * alone * min(1.0, len(self.templates[k][1]) / max(1, len(wording(block))))), key=lambda p: (-p[0], p[1]))

    def align(self, wanted: list[str], have: list[str]) -> tuple | None:
        """(first, last, missing, added): the words of `have` that are the template's wording, if they are."""
        parts = [p for p in difflib.SequenceMatcher(None, wanted, have, autojunk=False).get_matching_blocks() if p.size]
        if sum(p.size for p in parts) < MATCHED * len(wanted):
            return None
        first, last = parts[0].b, parts[-1].b + parts[-1].size
        hit = {p.a + k for p in parts for k in range(p.size)}
        kept = {p.b + k for p in parts for k in range(p.size)}
        missing = [w for k, w in enumerate(wanted) if k not in hit]
        if any(any(c.isdigit() for c in w) for w in missing):
            return None  # another version is another license
        return first, last, missing, [have[k] for k in range(first, last) if k not in kept]

    def candidates(self, text: str) -> list[tuple]:
        """(bytes saved, start, end, name, saved, exact, missing, added) of the winner of every block."""
        spans = [m.span() for m in _WORD.finditer(text)]
        starts = [a for a, _ in spans]
        words = [text[a:b].lower() for a, b in spans]
        found = cues(text, starts)
        blocks: set[tuple[int, int]] = set()
        for _, wanted, counts, at, _ in self.templates:
            # a template without a cue word is held against every place of each of its words
            pairs = ((c, at) for c in found) if at else ((c, [k for k, w in enumerate(wanted) if w == words[c]]) for c in range(len(words)) if words[c] in counts)
            margin = max(MARGIN, len(wanted) // 4)
            for start in sorted({c - k for c, places in pairs for k in places}):
                for front in (0, margin):
                    a, b = max(0, start - front), min(len(words), max(0, start + len(wanted) + margin))
                    # a block without the template's words can't be its wording
                    if sum(min(n, counts[w]) for w, n in Counter(words[a:b]).items() if w in counts) >= MATCHED * len(wanted):
                        blocks.add((a, b))
        out: dict[tuple, tuple] = {}
        for a, b in sorted(blocks):
            for _, k in self.ranked(text[spans[a][0] : spans[b - 1][1]]):
                name, wanted, _, _, compressor = self.templates[k]
                aligned = self.align(wanted, words[a:b])
                if aligned is None:
                    continue
                first, last, missing, added = aligned
                begin, end = spans[a + first][0], spans[a + last - 1][1]
                raw = text[begin:end].encode()
                alone = len(self.plain.compress(raw))
                gain = alone - len(compressor.compress(raw))
                if gain >= SAVED * alone:
                    out[begin, end, name] = (gain, begin, end, name, gain / alone, not missing and not added, missing, added)
                    break
        return list(out.values())

    def scan(self, text: str) -> list[tuple]:
        """(start, end, name, saved, exact, missing, added); what saves most bytes goes first, and found wordings don't overlap."""
        taken: list[tuple] = []
        for row in sorted(self.candidates(text), key=lambda r: (-r[0], r[3], r[1], r[2])):
            k = bisect.bisect(taken, (row[1],))
            if (k == len(taken) or taken[k][0] >= row[2]) and (k == 0 or taken[k - 1][1] <= row[1]):
                taken.insert(k, row[1:])
        return taken


SCHEMA = "start long, end long, license string, saved double, exact boolean, missing array<string>, added array<string>"


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row per license wording found: doc_id, start and end (code points, end excluded), license,
    `saved` (share of bytes the template saves), exact, missing and added words.

    Whole texts are read. Null and empty texts have none; repeated rows are scanned each; extra columns do no harm.
    """
    templates = dict(templates or TEMPLATES)
    strings = pa.list_(pa.string())
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.bool_(), strings, strings]
    names = ["doc_id", *[f.split()[0] for f in SCHEMA.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            column = batch.column("text")
            out = []
            some = pc.match_substring_regex(column, SOME).fill_null(False) if scanner.cued else pc.is_valid(column)
            for row in np.flatnonzero(some.to_numpy(zero_copy_only=False)).tolist():
                out += [(batch.column("doc_id")[row].as_py(), *found) for found in scanner.scan(column[row].as_py())]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, {SCHEMA}")
