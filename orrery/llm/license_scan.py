"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

1. The templates' words are the vocabulary. Its document frequencies are counted over all files (each batch gives a count
   for each word of the vocabulary, so what is shuffled and collected is bounded by it).
2. Templates are notices and whole short licences. Every line of every whole text, and each line together with the next, is a sparse vector over the vocabulary, words
   outside it weighing as much as the rarest; it takes the template of largest cosine if that reaches ``threshold``. Texts
   and lines whose words hold too little of every template can't reach it and aren't scored. So is, against each template, every run of as many words as it
   has, across line ends and wherever it starts, for notices inside a paragraph or over several lines. Sums along the text
   bound the cosines of all runs from above; those that may reach the best so far are scored.
3. A licence file (by its name) stands for its directory. Each directory inherits from the nearest ancestor with a licence,
   itself included, by joins of paths to their ancestors; files without a licence of their own take their directory's.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import durable, map_batches

# Notices as files usually carry them, and whole short licences.
_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_REDISTRIBUTION = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_ENDORSE = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
TEMPLATES = {
    "MIT": ("Released under the MIT License.", "Licensed under the MIT license. See LICENSE in the project root for license information.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", _MIT),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', _APACHE),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.", _GPL),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "BSD-2-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", f"{_REDISTRIBUTION} {_DISCLAIMER}"),
    "BSD-3-Clause": ("Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", f"{_REDISTRIBUTION} {_ENDORSE} {_DISCLAIMER}"),
    "ISC": (_ISC,),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
}
FILE_NAMES = ("license", "licence", "copying", "notice")
_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")


def words_of(line: str) -> list[str]:
    return _WORD.findall(line.lower())


def vocabulary(templates: dict[str, tuple[str, ...]]) -> list[str]:
    return sorted({w for texts in templates.values() for t in texts for w in words_of(t)})


class Scanner:
    """Cosines of lines to templates under given document frequencies."""

    def __init__(self, templates: dict[str, tuple[str, ...]], counts: dict[str, int], files: int, threshold: float) -> None:
        idf = lambda n: math.log((1 + files) / (1 + n)) + 1
        self.weight = {w: idf(counts.get(w, 0)) for w in vocabulary(templates)}
        self.other, self.threshold = idf(0), threshold
        self.templates = []
        for name in sorted(templates):
            for text in templates[name]:
                vector = {w: n * self.weight[w] for w, n in Counter(words_of(text)).items()}
                norm = math.sqrt(sum(x * x for x in vector.values()))
                self.templates.append((name, {w: x / norm for w, x in vector.items()}))
        self.known = frozenset(self.weight)
        self.parts = [(frozenset(t), {w: x * x for w, x in t.items()}) for _, t in self.templates]
        self.at = {w: i for i, w in enumerate(self.weight, 1)}  # 0: other words
        self.square = np.array([self.other, *self.weight.values()]) ** 2
        self.lengths = [len(words_of(x)) for name in sorted(templates) for x in templates[name]]
        self.gains = [np.array([0.0, *(x * t.get(w, 0.0) for w, x in self.weight.items())]) for _, t in self.templates]

    def within_reach(self, words: set[str]) -> list[int]:
        """Templates whose cosine to any text of just these words can reach the threshold: no text gets more than the length
        of the template's own part on them."""
        present = self.known.intersection(words)
        least = self.threshold**2 - 1e-9
        return [i for i, (own, squares) in enumerate(self.parts) if sum(squares[w] for w in own & present) >= least] if present else []

    def line(self, line: str) -> tuple[float, str] | None:
        return self.words(words_of(line))

    def words(self, words: list[str], length: int | None = None) -> tuple[float, str] | None:
        """Largest cosine and its license, of all templates or those of a length; None below the threshold."""
        vector = {w: n * self.weight.get(w, self.other) for w, n in Counter(words).items()}
        norm = math.sqrt(sum(x * x for x in vector.values()))
        some = [t for t, n in zip(self.templates, self.lengths, strict=True) if length in (None, n)]
        best = max(((sum(x * t[w] for w, x in vector.items() if w in t) / norm, name) for name, t in some), key=lambda x: (x[0], x[1])) if norm else (0.0, "")
        return best if best[0] >= self.threshold else None

    def runs(self, low: str, least: float, near: list[int]) -> tuple[float, str, int] | None:
        """Cosine, license and line of the best run of a template's length, if its cosine is greater than ``least``."""
        found = list(_WORD.finditer(low))
        words = [m.group() for m in found]
        at = np.array([self.at.get(w, 0) for w in words], dtype=np.int64)
        square = np.concatenate(([0.0], np.cumsum(self.square[at])))
        starts, sizes, bounds = [], [], []
        for length in sorted({self.lengths[i] for i in near}):
            n = min(length, len(words))
            if n == 0:
                continue
            # a word that repeats weighs more in the norm than in this sum, never less
            norm = np.sqrt(square[n:] - square[:-n])
            most = np.zeros(len(norm))
            for i in near:
                if self.lengths[i] == length:
                    dot = np.concatenate(([0.0], np.cumsum(self.gains[i][at])))
                    most = np.maximum(most, (dot[n:] - dot[:-n]) / norm)
            i = np.flatnonzero(most >= max(self.threshold, least) - 1e-6)
            starts.append(i)
            sizes.append(np.full(len(i), length))
            bounds.append(most[i])
        if not starts:
            return None
        start, size, bound = np.concatenate(starts), np.concatenate(sizes), np.concatenate(bounds)
        best = None
        for k in np.lexsort((start, -bound)).tolist():
            if bound[k] < (best[0] if best else least) - 1e-6:
                break
            i = int(start[k])
            hit = self.words(words[i : i + int(size[k])], int(size[k]))
            if hit and hit[0] > least + 1e-9 and (best is None or (hit[0], hit[1], -i) > best):
                best = (*hit, -i)
        return best and (best[0], best[1], low.count("\n", 0, found[-best[2]].start()))

    def file(self, text: str | None) -> tuple[str, float, int] | None:
        """License, cosine and line of the best match; of equal ones the first line's."""
        low = (text or "").lower()
        near = self.within_reach(set(_WORD.findall(low)))
        if not near:
            return None
        lines = [words_of(x) for x in low.split("\n")]
        sets = [self.known.intersection(x) for x in lines]
        best = None
        for i, line in enumerate(lines):
            after = lines[i + 1] if i + 1 < len(lines) else None
            for part, seen in ((line, sets[i]), (None if after is None else line + after, sets[i] | sets[i + 1] if after is not None else set())):
                found = self.words(part) if part and seen and self.within_reach(seen) else None
                if found and (best is None or found[0] > best[1]):
                    best = (found[1], found[0], i)
        run = self.runs(low, best[1] if best else 0.0, near)
        return (run[1], run[0], run[2]) if run else best


def fit(files: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, text_col: str = "text", threshold: float = 0.7) -> Scanner:
    """Document frequencies of the vocabulary over all files."""
    known = frozenset(vocabulary(templates))

    def count(batches):
        for batch in batches:
            found = Counter(w for x in batch.column(0) for w in known.intersection(words_of(x.as_py() or "")))
            found[""] = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["w", "n"])

    rows = map_batches(files.select(text_col), count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    counts = {r["w"]: r["n"] for r in rows}
    return Scanner(templates, counts, counts.pop("", 0), threshold)


def scan(files: DataFrame, scanner: Scanner, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(id, path, own_license, score, line) of every whole text; nulls where no line or run reaches the threshold."""
    rows = files.select(F.col(id_col).alias("id"), F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]

    def run(batches):
        for batch in batches:
            made = [scanner.file(x.as_py()) or (None, None, None) for x in batch.column(2)]
            columns = list(zip(*made, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.float64(), pa.int32()), strict=True)]],
                names=["id", "path", "own_license", "score", "line"],
            )

    return map_batches(rows, run, f"id {kind}, path string, own_license string, score double, line int")


def _parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def inherit(found: DataFrame) -> DataFrame:
    """Adds license, inherited_from (the licence file's directory; null for a file's own licence or none).

    Of several licence files in a directory the best score counts, then the license and the path that come first.
    """
    base = F.lower(F.regexp_extract("path", r"([^/]*)$", 1))
    named = base.rlike(r"^(?:" + "|".join(FILE_NAMES) + r")(?:\.[a-z]+)?$")
    best = F.min(F.struct((-F.col("score")).alias("s"), F.col("own_license"), F.col("path")))
    holders = found.where(named & F.col("own_license").isNotNull()).groupBy(_parent(F.col("path")).alias("dir")).agg(best.alias("b"))
    holders = holders.select(F.concat(F.lit("/"), "dir").alias("at"), F.col("b.own_license").alias("license"))
    dirs = found.where("path IS NOT NULL").select(_parent(F.col("path")).alias("dir")).distinct()
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(parts))), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("up")))
    nearest = (
        dirs.select("dir", F.explode(above).alias("x"))
        .select("dir", F.col("x.depth"), F.concat(F.lit("/"), "x.up").alias("at"))
        .join(holders, "at")
        .groupBy("dir")
        .agg(F.max(F.struct("depth", "at", "license")).alias("b"))
        .select(F.concat(F.lit("/"), "dir").alias("d"), F.col("b.license").alias("theirs"), F.expr("substring(b.at, 2)").alias("from"))
    )
    own = F.col("own_license").isNotNull()
    return (
        found.withColumn("d", F.coalesce(F.concat(F.lit("/"), _parent(F.col("path"))), F.lit("")))
        .join(nearest, "d", "left")
        .select("id", "path", "own_license", "score", "line", F.coalesce("own_license", "theirs").alias("license"), F.when(~own, F.col("from")).alias("inherited_from"))
    )


def license_of_files(
    files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", templates: dict[str, tuple[str, ...]] = TEMPLATES, threshold: float = 0.7
) -> DataFrame:
    """The licence of every file: the id column, path, own_license, score, line, license, inherited_from.

    Defined results: a null or empty text has no licence of its own; a null path inherits nothing; rows that repeat an id
    are files of their own; equal cosines go to the license that is last by name, then to the first line; no rows give no
    rows. Other columns are ignored, whatever their names.
    """
    found = durable(scan(files, fit(files, templates, text_col, threshold), id_col, path_col, text_col))
    return inherit(found).withColumnRenamed("id", id_col)
