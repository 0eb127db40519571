"""License scan: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest ancestor directory.

A text is compared as a whole, by its blocks between blank lines, by its lines and by the sentences
of its lines, so a licence file, a header of several lines and a notice in prose are all found.
Every such unit is a sparse vector of terms, weighted by how rare they are among all documents of
the corpus. A unit names the template of the best cosine, and any other whose terms it has in full.
What a unit has of a template must say more than a licence that this one includes (the first lines
of BSD-3 are those of BSD-2). Among what a text's units name, a licence gives way to one whose wording includes its own (BSD-2 to
BSD-3, a reserved right to any licence), and of the rest that with the most matched weight leads: a
whole licence outranks a short line beside it. No unit is left out beforehand: a bound that no weight
can exceed drops those that cannot reach the least cosine. A file without a licence of its own takes
that of the licence file in the nearest directory above it, found by joining the paths of its
ancestors.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written

#: Least cosine of a unit to a template.
LEAST = 0.6

#: Disclaimers that several licences share.
_ISC_DISCLAIMER = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD_DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD_CLAUSES = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
#: Licences by their identifiers, with the notices and passages that stand for them in headers and licence files.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("ISC", "Licensed under the ISC License."),
    ("ISC", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_DISCLAIMER}"),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. Zero-Clause BSD"),
    ("0BSD", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. {_ISC_DISCLAIMER}"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", _BSD_CLAUSES),
    ("BSD-2-Clause", f"{_BSD_CLAUSES} {_BSD_DISCLAIMER}"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted. Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", f"{_BSD_CLAUSES} 3. {_BSD_THIRD}"),
    ("BSD-3-Clause", f"{_BSD_CLAUSES} 3. {_BSD_THIRD} {_BSD_DISCLAIMER}"),
    ("BSD-3-Clause", _BSD_THIRD),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE Version 2, December 2004 Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."),
    ("Artistic-2.0", "The Artistic License 2.0 Copyright (c) 2000-2006, The Perl Foundation. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide under CC0 1.0 Universal. This software is distributed without any warranty."),
    ("CC0-1.0", "Creative Commons CC0 1.0 Universal Public Domain Dedication"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "Creative Commons Attribution NonCommercial 4.0 International"),
    ("proprietary", "All rights reserved."),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE Version 2, December 2004"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("Artistic-2.0", "The Artistic License 2.0"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("MIT", "The MIT License (MIT)"),
    ("0BSD", "BSD Zero Clause License"),
    ("ISC", "ISC License"),
]
#: Licences whose headers differ in a name and a version only, and the sentences of these headers.
FAMILY = [("GPL-2.0", "program", "General", "2"), ("GPL-3.0", "program", "General", "3"), ("LGPL-2.1", "library", "Lesser General", "2.1"), ("LGPL-3.0", "program", "Lesser General", "3"), ("AGPL-3.0", "program", "Affero General", "3")]
HEADER = [
    "This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} Public License as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version.",
    "This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} Public License for more details.",
    "You should have received a copy of the GNU {1} Public License along with this {0}. If not, see <https://www.gnu.org/licenses/>.",
]
#: Identifiers in tags: each licence also has a template of its tag.
TAGGED = sorted({name for name, *_ in [*TEMPLATES, *FAMILY]} - {"proprietary"})
_TERM = re.compile(r"[^\W_]+(?:\.\d+)?")
_STOP = re.compile(r"(?<=[.!?])\s+(?=\S)")
#: What gives way to every licence.
LAST_RESORT = "proprietary"


def templates() -> list[tuple[str, str]]:
    headers = [(name, " ".join(HEADER[:k]).format(*rest)) for name, *rest in FAMILY for k in (1, 2, 3)]
    return [*TEMPLATES, *headers, *((name, f"SPDX-License-Identifier: {name}") for name in TAGGED)]


def terms(s: str) -> list[str]:
    """Words and numbers in order; the parts of a dotted number stay together."""
    return _TERM.findall(s.lower())


def _weight(n: int, df):
    return math.log((1 + n) / (1 + df)) + 1


@lru_cache(1)
def _vocabulary() -> dict[str, int]:
    return {t: i for i, t in enumerate(sorted({t for _, s in templates() for t in terms(s)}))}


@lru_cache(1)
def _support() -> tuple[np.ndarray, np.ndarray]:
    """Terms x templates: whether the template has the term; and how many terms each has."""
    vocabulary, all_ = _vocabulary(), templates()
    out = np.zeros((len(vocabulary), len(all_)), bool)
    for k, (_, s) in enumerate(all_):
        out[[vocabulary[t] for t in terms(s)], k] = True
    return out, out.sum(0)


@lru_cache(1)
def yields() -> list[list[str]]:
    """By template, the licences that it gives way to: those whose templates together have all of its terms."""
    all_ = templates()
    own = [set(terms(s)) for _, s in all_]
    wording: dict[str, set] = {}
    for (name, _), t in zip(all_, own):
        wording.setdefault(name, set()).update(t)
    return [[other for other in sorted(wording) if other != name and other != LAST_RESORT and (name == LAST_RESORT or t <= wording[other])] for (name, _), t in zip(all_, own)]


@lru_cache(1)
def rivals() -> list[np.ndarray]:
    """By template, the terms (licences x terms) of the licences that its licence includes: what a text has of the template must not be all in one of them."""
    (support, _), all_, give = _support(), templates(), yields()
    wording = {name: np.any(support[:, [k for k, (other, _) in enumerate(all_) if other == name]], axis=1) for name, _ in all_}
    out = []
    for k, (name, _) in enumerate(all_):
        inner = sorted({all_[j][0] for j, other in enumerate(give) if name in other} - {LAST_RESORT})
        out.append(np.array([wording[x] for x in inner if not wording[x][support[:, k]].all()], bool).reshape(-1, len(support)))
    return out


def frequencies(docs: DataFrame, text_col: str) -> DataFrame:
    """(term, df): in how many documents each term is, over whole texts; a task sends one row for a term of some hundreds of documents."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            seen: Counter = Counter()
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update(set(terms(text)))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])

    return docs.select(f"`{text_col}`").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("df"))


def _units(text: str):
    """The sentences of a text as lists of terms, with the numbers of their lines and blocks."""
    found, line_of, block_of = [], [], []
    line = block = 0
    blank = True
    for s in text.split("\n"):
        if not s.strip():
            blank = True
            continue
        block += blank
        blank = False
        line += 1
        for part in _STOP.split(s):
            found.append(terms(part)), line_of.append(line), block_of.append(block)
    return found, line_of, block_of


def _matrix(idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the templates, terms x templates, and the norms they had."""
    vocabulary, all_ = _vocabulary(), templates()
    out = np.zeros((len(vocabulary), len(all_)))
    for k, (_, s) in enumerate(all_):
        for t, c in Counter(terms(s)).items():
            out[vocabulary[t], k] = c * idf[vocabulary[t]]
    norms = np.linalg.norm(out, axis=0)
    return out / norms, norms


def near_units(text: str, idf: np.ndarray, matrix: np.ndarray, least: float) -> dict[bytes, tuple]:
    """By key, (terms that no template has, their counts, squared norm of the others, dot products, templates, whether the unit has all of a template's terms) of the units that may reach the least cosine.

    Terms that no template has weigh 1 at least and only lower a cosine; what stays under `least`
    with that weight is done.
    """
    vocabulary, (support, full) = _vocabulary(), _support()
    sentences, line_of, block_of = _units(text)
    if not sentences:
        return {}
    sizes = np.array([len(s) for s in sentences])
    place = np.array([vocabulary.get(t, -1) for s in sentences for t in s], np.int64)
    of = np.repeat(np.arange(len(sentences)), sizes)
    ends = np.cumsum(sizes)
    out: dict[bytes, tuple] = {}
    for level in (np.arange(len(sentences)), np.array(line_of) - 1, np.array(block_of) - 1, np.zeros(len(sentences), np.int64)):
        inside = place >= 0
        unit, v = level[of][inside], place[inside]
        if not len(v):
            return {}
        pair, count = np.unique(unit * len(vocabulary) + v, return_counts=True)
        unit, v = pair // len(vocabulary), pair % len(vocabulary)
        starts = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
        w = count * idf[v]
        own = np.add.reduceat(w * w, starts)
        who = unit[starts]
        other = np.bincount(level[of][~inside], minlength=int(level[-1]) + 1)[who]
        # no dot product exceeds the norm of what is shared
        fine = np.flatnonzero(own >= least * least * (own + other) * (1 - 1e-9))
        for i in fine.tolist():
            a, b = starts[i], starts[i + 1] if i + 1 < len(starts) else len(w)
            dots = w[a:b] @ matrix[v[a:b]]
            hit = np.flatnonzero(dots >= least * math.sqrt(own[i] + other[i]) * (1 - 1e-9))
            hit = hit[[not rivals()[k][:, v[a:b][support[v[a:b], k]]].all(1).any() for k in hit]] if len(hit) else hit
            if not len(hit):
                continue
            first, last = np.searchsorted(level, who[i]), np.searchsorted(level, who[i], "right")
            words = Counter(t for s in sentences[first:last] for t in s if t not in vocabulary)
            names = sorted(words)
            key = xxhash.xxh3_128_digest(np.concatenate((v[a:b], count[a:b])).tobytes() + "\0".join(f"{t} {words[t]}" for t in names).encode())
            out[key] = (names, [words[t] for t in names], float(own[i]), dots[hit].tolist(), hit.tolist(), (support[v[a:b]][:, hit].sum(0) == full[hit]).tolist())
    return out


def own_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """(id, license, score, licenses) of documents that name a licence by a cosine of `least` or more.

    `license` has the most matched weight (cosine times the smaller norm of unit and template; ties by
    name), `score` is its cosine, `licenses` are all that are named, in order of names.
    """
    n = docs.count()
    counted = written(frequencies(docs, text_col), "frequencies")
    vocabulary = _vocabulary()
    # a count for each term of the templates: as many rows as they have terms
    df = {r["term"]: r["df"] for r in counted.where(F.col("term").isin(list(vocabulary))).collect()}
    idf = np.array([_weight(n, df.get(t, 0)) for t in vocabulary])
    matrix, norms = _matrix(idf)
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            took, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for key, unit in near_units(text or "", idf, matrix, least).items():
                    took.append(i), rows.append((key, *unit))
            kinds = [pa.binary(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(took, pa.int32())), *(pa.array(c, kind) for c, kind in zip(zip(*rows) if rows else [[]] * 7, kinds))], names=["id", "key", "others", "counts", "inside", "dots", "which", "full"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    schema = f"id {kind}, key binary, others array<string>, counts array<int>, inside double, dots array<double>, which array<int>, full array<boolean>"
    found = written(docs.select(f"`{id_col}`", f"`{text_col}`").mapInArrow(run, schema), "units")
    # equal units are scored once, however many documents have them
    once = found.groupBy("key").agg(*[F.first(c).alias(c) for c in ("others", "counts", "inside", "dots", "which", "full")])
    outer = once.select("key", F.explode(F.arrays_zip("others", "counts")).alias("o")).select("key", F.col("o.others").alias("t"), F.col("o.counts").alias("c"))
    weight = F.log((1 + n) / (1 + F.col("df"))) + 1
    outside = outer.join(counted, F.col("t") == F.col("term")).groupBy(F.col("key").alias("k")).agg(F.sum(F.pow(F.col("c") * weight, 2)).alias("outside"))
    all_ = templates()
    name = F.array(*[F.lit(n) for n, _ in all_])
    weigh = F.array(*[F.lit(float(x)) for x in norms])
    gives_way = F.array(*[F.array(*[F.lit(x) for x in other]).cast("array<string>") for other in yields()])
    scored = once.join(outside, F.col("key") == F.col("k"), "left").withColumn("norm", F.sqrt(F.col("inside") + F.coalesce("outside", F.lit(0.0))))

    def named(d):
        score = d["dots"] / F.col("norm")
        return F.struct(score.alias("score"), F.get(name, d["which"]).alias("license"), d["which"].alias("which"), d["full"].alias("full"), (score * F.least(F.col("norm"), F.get(weigh, d["which"]))).alias("mass"))

    hits = F.filter(F.transform(F.arrays_zip("dots", "which", "full"), named), lambda x: x["score"] >= least)
    # at most as many as there are templates: of a unit, and of a document
    order = F.array_sort(hits, lambda a, b: F.when(F.round(a["score"], 9) != F.round(b["score"], 9), F.signum(F.round(b["score"], 9) - F.round(a["score"], 9)).cast("int")).when(a["license"] != b["license"], F.when(a["license"] < b["license"], -1).otherwise(1)).otherwise(a["which"] - b["which"]))
    units = scored.select(F.col("key").alias("b"), order.alias("hits")).where("size(hits) > 0")
    first = F.get("hits", F.lit(0))
    own = F.filter("hits", lambda x: (x["which"] == first["which"]) | x["full"] & ~F.array_contains(F.get(gives_way, x["which"]), first["license"]))
    best = units.select("b", own.alias("own")).hint("rebalance")
    each = found.select("id", "key").join(best, F.col("key") == F.col("b")).select("id", F.explode("own").alias("s"))
    most = lambda c: F.min_by(c, F.struct(-F.round(f"{c}.mass", 9), -F.round(f"{c}.score", 9)))
    found_in = each.groupBy("id", "s.which").agg(most("s").alias("s")).groupBy("id").agg(F.collect_list("s").alias("all"))
    beaten = lambda x: F.exists("all", lambda y: F.array_contains(F.get(gives_way, x["which"]), y["license"]) & ~F.array_contains(F.get(gives_way, y["which"]), x["license"]))
    left = found_in.select("id", F.filter("all", lambda x: ~beaten(x)).alias("all"))
    lead = F.array_min(F.transform("all", lambda x: F.struct((-F.round(x["mass"], 9)).alias("m"), x["license"].alias("license"), (-x["score"]).alias("score"))))
    return left.select("id", lead.alias("lead"), F.array_sort(F.array_distinct(F.transform("all", lambda x: x["license"]))).alias("licenses")).select("id", "lead.license", F.least(-F.col("lead.score"), F.lit(1.0)).alias("score"), "licenses")


def license_scan(files: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path", is_license=None) -> DataFrame:
    """One row for each row of files: id, license, score, origin, licenses.

    `licenses` are all that the text names (`MIT OR Apache-2.0` names two), `license` the one with the
    most matched weight, ties by name. origin is the path that the licence was found in: the file's own, or that of the licence file
    in the nearest directory above it (or beside it); of several there the smallest path. Rows
    without either have nulls. `is_license` is a Column that marks licence files; by default those
    named LICENSE, LICENCE, COPYING or NOTICE. Null and empty texts have no licence of their own; texts
    of any length are read whole, a line, block and sentence at a time; a null path
    inherits nothing. Repeated rows get equal results; an empty table gives an empty result. Other
    columns are not read. Hot directories are safe: the join on a directory is one that Spark may
    split, and only ids and paths are shuffled.
    """
    named = F.col(path_col).rlike(r"(?i)(^|/)(licen[sc]e|copying|notice)(\.[a-z]+)?$") if is_license is None else is_license
    rows = files.select(F.col(id_col).alias("id"), F.col(path_col).alias("path"), F.coalesce(named, F.lit(False)).alias("named"))
    own = written(own_licenses(files, id_col, text_col), "own")
    with_own = rows.join(own.withColumnRenamed("id", "o"), F.col("id") == F.col("o"), "left").drop("o")
    directory = F.regexp_replace("path", "[^/]*$", "")
    granted = with_own.where("named AND license IS NOT NULL AND path IS NOT NULL").groupBy(directory.alias("dir")).agg(F.min_by(F.struct("license", "score", "path", "licenses"), F.struct("path", "license")).alias("l")).hint("rebalance")
    # every directory above a file, with its depth
    up = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(F.split("path", "/"), F.lit(1), k - 1), "/").alias("d")))
    bare = with_own.where("license IS NULL AND path IS NOT NULL").select("path").distinct().select("path", F.explode(up).alias("u")).select("path", "u.depth", F.when(F.col("u.d") == "", F.lit("")).otherwise(F.concat("u.d", F.lit("/"))).alias("d"))
    taken = bare.join(granted, F.col("d") == F.col("dir")).groupBy(F.col("path").alias("p")).agg(F.max_by("l", "depth").alias("l"))
    out = with_own.join(taken, F.col("license").isNull() & (F.col("path") == F.col("p")), "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("license", "l.license").alias("license"), F.coalesce("score", "l.score").alias("score"), F.when(F.col("license").isNotNull(), F.col("path")).otherwise(F.col("l.path")).alias("origin"), F.coalesce("licenses", "l.licenses").alias("licenses"))


def with_paths(docs: DataFrame) -> DataFrame:
    """Documents as files: source / shelf of 64 / document; every 64th is its shelf's licence file."""
    d = F.col("doc_id")
    name = F.when(d % 64 == 0, F.lit("LICENSE")).otherwise(F.concat(d.cast("string"), F.lit(".txt")))
    return docs.select("doc_id", "text", F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.floor(d / 64).cast("string"), F.lit("/"), name).alias("path"))


def op2_license(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return license_scan(with_paths(docs)).select("doc_id", "license", F.round("score", 6).alias("score"), "origin", "licenses")
