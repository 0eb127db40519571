"""Language, licences and shards against plain Python on whole tables, and odd rows."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import langid, license_scan, sharding


def test_mixtures_are_those_of_all_sets(spark, sf):
    """Every set of languages tried, with many steps of expectation maximisation."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    langs, logp = langid.contract_model(docs)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs.select("doc_id", "text"), (langs, logp)).collect()}
    same, far = [], []
    for r in docs.collect():
        data = np.frombuffer((r["text"] or "").encode(), np.uint8)
        _, gram, count = langid._bags(data, np.array([0, len(data)]))
        if got[r["doc_id"]][0] == "und":
            assert not any(map(str.isalpha, r["text"] or ""))
            continue
        p, c = np.exp(logp[:, gram].astype(float)), count.astype(float)
        best = (-math.inf, None, 0.0)
        for size in range(1, len(langs) + 1):
            for chosen in itertools.combinations(range(len(langs)), size):
                pi = np.full(size, 1 / size)
                for _ in range(60):
                    part = p[list(chosen)] * pi[:, None]
                    pi = (part / part.sum(0) * c).sum(1) / c.sum()
                fit = (np.log((p[list(chosen)] * pi[:, None]).sum(0)) * c).sum() - size * langid.COST * math.log(max(c.sum(), 2))
                if fit > best[0]:
                    best = (fit, langs[chosen[pi.argmax()]], pi.max())
        same.append(best[1] == got[r["doc_id"]][0])
        far.append(abs(best[2] - got[r["doc_id"]][1]))
    assert np.mean(same) >= 0.99 and np.mean(np.array(far) < 0.05) >= 0.97


def test_long_texts_have_the_trigrams_of_short_ones(monkeypatch):
    data = np.frombuffer("a quick brown fox jumps".encode() * 9, np.uint8)
    whole = langid._bags(data, np.array([0, len(data)]))
    for part in (20, 23, len(data) - 1, len(data) - 2):
        monkeypatch.setattr(langid, "PART", part)
        cut = langid._bags(data, np.array([0, len(data)]))
        assert all((x == y).all() for x, y in zip(whole, cut))


def units_of(text):
    yield text
    block = []
    for line in [*text.split("\n"), ""]:
        if line.strip():
            block.append(line)
            yield line
            yield from license_scan._STOP.split(line)
        elif block:
            yield "\n".join(block)
            block = []


def licences_brute(rows):
    """(license, score, licenses) by id: every unit of every text against every template, in full."""
    n, df = len(rows), Counter()
    for _, text in rows:
        df.update(set(license_scan.terms(text or "")))
    weigh = lambda s: {t: c * (math.log((1 + n) / (1 + df.get(t, 0))) + 1) for t, c in Counter(license_scan.terms(s)).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    all_ = [(name, weigh(s)) for name, s in license_scan.templates()]
    norms = [norm(v) for _, v in all_]
    wording = {name: {t for other, v in all_ if other == name for t in v} for name, _ in all_}

    def includes(name, template):
        """Whether a licence's wording has all terms of another's template; every licence does so of a reserved right."""
        return name != template[0] and name != "proprietary" and (template[0] == "proprietary" or template[1].keys() <= wording[name])

    inner_of = {name: {o[0] for o in all_ if o[0] != "proprietary" and includes(name, o)} for name in wording}
    out = {}
    for d, text in rows:
        named = []
        for unit in set(units_of(text or "")):
            u = weigh(unit)
            if not u:
                continue
            length = norm(u)
            hits = []
            for k, ((name, v), size) in enumerate(zip(all_, norms)):
                cos = sum(x * v.get(t, 0.0) for t, x in u.items()) / (length * size)
                shared = u.keys() & v.keys()
                silent = lambda: any(shared <= wording[o] and not v.keys() <= wording[o] for o in inner_of[name])  # noqa: E731, B023
                if cos >= license_scan.LEAST and not silent():
                    hits.append((-round(cos, 9), name, k, cos, cos * min(length, size)))
            hits.sort()
            named += [h for h in hits[:1]] + [h for h in hits[1:] if all_[h[2]][1].keys() <= u.keys() and not includes(hits[0][1], all_[h[2]])]
        rules = lambda h, g: includes(g[1], all_[h[2]]) and not includes(h[1], all_[g[2]])
        left = [h for h in named if not any(rules(h, g) for g in named)]
        if left:
            lead = min((-round(h[4], 9), h[1], -h[3]) for h in left)
            out[d] = (lead[1], min(-lead[2], 1.0), sorted({h[1] for h in left}))
    return out


#: Licence files and headers as projects have them, by what they grant; none is a template as it stands.
RESERVED = "Copyright (c) 2015, Jo Doe\nAll rights reserved.\n\n"
GRANT = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n"
CLAUSES = "1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n\n"
THIRD = "3. Neither the name of Acme nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n\n"
AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"\nAND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE\nIMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE\nDISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE\nFOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL\nDAMAGES.\n'
MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n'
APACHE = '// Licensed under the Apache License, Version 2.0 (the "License");\n// you may not use this file except in compliance with the License.\n// You may obtain a copy of the License at\n//\n//     http://www.apache.org/licenses/LICENSE-2.0\n'
FILES = [
    (RESERVED + GRANT + CLAUSES + THIRD + AS_IS, "BSD-3-Clause", ["BSD-3-Clause"]),
    (RESERVED + GRANT + CLAUSES + AS_IS, "BSD-2-Clause", ["BSD-2-Clause"]),
    (RESERVED + "Some words on how to build this project and whom to ask.\n\n" + GRANT + CLAUSES + THIRD, "BSD-3-Clause", ["BSD-3-Clause"]),
    ("The MIT License (MIT)\n\n" + RESERVED + MIT, "MIT", ["MIT"]),
    (RESERVED + MIT, "MIT", ["MIT"]),
    ("// Copyright 2020 Acme. All rights reserved.\n" + APACHE + "package x\n", "Apache-2.0", ["Apache-2.0"]),
    ("// Copyright 2009 The Go Authors. All rights reserved.\n// Use of this source code is governed by a BSD-style\n// license that can be found in the LICENSE file.\n\npackage y\n", "BSD-3-Clause", ["BSD-3-Clause"]),
    ("// SPDX-License-Identifier: MIT OR Apache-2.0\nfn main() {}\n", "Apache-2.0", ["Apache-2.0", "MIT"]),
    ('BSD Zero Clause License\n\nCopyright (c) 2022 Jo\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH\nREGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY\nAND FITNESS.\n', "0BSD", ["0BSD"]),
    (RESERVED + "This program is ours.\n", "proprietary", ["proprietary"]),
]


def test_licences_of_whole_files(spark, sf):
    prose = [(i, r["text"]) for i, r in enumerate(spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(150).collect())]
    rows = [*prose, *((1000 + i, f[0]) for i, f in enumerate(FILES))]
    got = {r["id"]: (r["license"], r["licenses"]) for r in license_scan.own_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got.get(1000 + i) for i in range(len(FILES))] == [(name, all_) for _, name, all_ in FILES]
    want = licences_brute(rows)
    assert got == {d: (x[0], x[2]) for d, x in want.items()}


def test_every_template_names_its_licence(spark):
    rows = [(i, s) for i, (_, s) in enumerate(license_scan.templates())]
    got = {r["id"]: r["license"] for r in license_scan.own_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    shared = {i for i, (name, s) in enumerate(license_scan.templates()) if any(name != other and set(license_scan.terms(s)) <= set(license_scan.terms(t)) for other, t in license_scan.templates())}
    assert all(got[i] == name for i, (name, _) in enumerate(license_scan.templates()) if i not in shared)


NOTICES = {
    "GPL-3.0": "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n#\n# This program is distributed in the hope that it will be useful,\n# but WITHOUT ANY WARRANTY; without even the implied warranty of\n# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\n# GNU General Public License for more details.\n\nimport os\n",
    "GPL-2.0": "/* This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. */\nint main() {}\n",
    "MIT": "// SPDX-License-Identifier: MIT\npackage main\n",
    "Apache-2.0": "Copyright 2019 Acme\n\nSPDX-License-Identifier: Apache-2.0\n\nmore code here\n",
    "ISC": "ISC License\n\nCopyright (c) 2020, Jo Doe\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES\n",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License.",
    "MPL-2.0": "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */\n",
    "BSL-1.0": "// Distributed under the Boost Software License, Version 1.0.\n// (See accompanying file LICENSE_1_0.txt or copy at\n// http://www.boost.org/LICENSE_1_0.txt)\n",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "CC0-1.0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "WTFPL": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nVersion 2, December 2004",
}


def test_licences_of_the_supplied_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    want = licences_brute(rows)
    got = {r["id"]: (r["license"], r["score"], r["licenses"]) for r in license_scan.own_licenses(docs).collect()}
    assert got.keys() == want.keys() and len(want) > 0
    assert all(got[d][0] == want[d][0] and abs(got[d][1] - want[d][1]) < 1e-9 and got[d][2] == want[d][2] for d in want)


def test_notices_as_files_have_them(spark, sf):
    prose = [(i, r["text"]) for i, r in enumerate(spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(120).collect())]
    rows = [*prose, *((1000 + i, s) for i, s in enumerate(NOTICES.values())), (2000, "the license of the house is a permission to use it for any purpose, as is")]
    got = {r["id"]: (r["license"], r["score"]) for r in license_scan.own_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got.get(1000 + i, (None,))[0] for i in range(len(NOTICES))] == list(NOTICES)
    want = licences_brute(rows)
    assert got.keys() == want.keys() and all(abs(got[d][1] - want[d][1]) < 1e-9 for d in want)
    assert 2000 not in got and len(license_scan.TAGGED) >= 20


def test_licences_of_odd_rows(spark):
    rows = [(1, "Released under the MIT License.", "a/x", "z", 1.0), (1, "Released under the MIT License.", "a/x", "z", 1.0), (2, None, "a/y", None, None), (None, "", None, None, None), (3, "x " * 300_000 + "\n" + "Released under the MIT License.", "b/long", "z", 2.0), (4, "nothing", "c/LICENSE", "z", 2.0)]
    files = spark.createDataFrame(rows, "doc_id long, text string, path string, LICENSE string, score double")
    got = sorted((r["doc_id"] or 0, r["license"], r["origin"]) for r in license_scan.license_scan(files).collect())
    assert got == [(0, None, None), (1, "MIT", "a/x"), (1, "MIT", "a/x"), (2, None, None), (3, "MIT", "b/long"), (4, None, None)]
    tied = spark.createDataFrame([(1, "Licensed under CC BY 4.0. Licensed under the ISC License.", "p")], "doc_id long, text string, path string")
    assert license_scan.license_scan(tied).first()["license"] == "CC-BY-4.0"  # both are certain: the first by name


@pytest.mark.parametrize("shards", [24, 7])
def test_shards_are_those_of_a_sort(spark, sf, shards):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source")
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    rows = docs.select("doc_id", "source", crc.alias("c"), F.xxhash64(F.lit(17), "doc_id", crc).alias("h")).collect()
    sources = {}
    for r in rows:
        sources.setdefault(r["source"], []).append(r)
    placed = []
    for own in sources.values():
        own.sort(key=lambda r: (r["h"], r["doc_id"], r["c"]))  # one bin: tables of the tests are small
        placed += [((k + 0.5) / len(own), r["h"], r["doc_id"]) for k, r in enumerate(own)]
    placed.sort()
    n, want = len(placed), {}
    for g, (_, _, d) in enumerate(placed):
        s = g * shards // n
        want[d] = (s, g - -(-s * n // shards))
    got = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard(docs, shards).collect()}
    assert got == want


def test_shards_with_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "a", "s", "x", 7), (2, None, None, "y", 8)], "doc_id long, text string, source string, SHARD string, slot int")
    got = sharding.shard(rows, 2).collect()
    assert sorted(r["shard"] for r in got) == [0, 1] and {r["size"] for r in got} == {9, 8}
