import re
from collections import Counter
from math import log, sqrt

from riskloom.llm import licences

from .frames import prose

FILES = "path string, text string, licence string, similarity string, passed int, directory int"


def files(spark, rows):
    return spark.createDataFrame([(p, t, "x", "y", 1, 2) for p, t in rows], FILES)


def brute(rows, threshold=0.7):
    """Licence of each text, unit by unit and without any filter, in plain Python."""
    def vector(text):
        return Counter(x for x in re.split("[^a-z0-9]+", text.lower()) if x)

    known = [(n, vector(t)) for n in licences.NOTICES
             for t in (*licences.NOTICES[n], *licences.HEADERS[n], "SPDX-License-Identifier " + n)]
    texts = [vector(t) for _, t in rows if t is not None]
    idf = {x: log((len(texts) + 1) / (sum(x in t for t in texts) + 1)) + 1 for _, c in known for x in c}
    unseen, out = log(len(texts) + 1) + 1, []
    for _, text in rows:
        found = []
        for unit in {*re.split(r"\n|(?<=[.!?;])\s+", text or ""), *re.split(r"\n[^a-zA-Z0-9\n]*\n", text or "")}:
            words = vector(unit)
            shared = {w: n * idf[w] for w, n in words.items() if w in idf}
            if len(shared) < 2:
                continue
            size = sqrt(sum(v * v for v in shared.values()) + (len(words) - len(shared)) * unseen**2)
            found.append(max(
                (sum(shared.get(w, 0) * n * idf[w] for w, n in t.items()) / size / sqrt(sum((n * idf[w]) ** 2 for w, n in t.items())), name)
                for name, t in known))
        cosine, name = max([f for f in found if f[0] >= threshold], default=(None, None))
        if name == "BSD-2-Clause" and any(c >= threshold and n == "BSD-3-Clause" for c, n in found):
            name = "BSD-3-Clause"
        out.append((cosine, name))
    return out


BSD = """Copyright (c) 2019, Jane Doe
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
GNU = """ * This {0} is free software: you can redistribute it and/or modify
 * it under the terms of the GNU {1}General Public License as published by
 * the Free Software Foundation, either version {2} of the License, or
 * (at your option) any later version.
 *
 * This {0} is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
"""
OPENING = """                    GNU {0}GENERAL PUBLIC LICENSE
                       Version {1}

 Copyright (C) {2} Free Software Foundation, Inc.
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.
"""
# Excerpts in the layout of licence files and source headers; the GNU ones are made from one pattern.
REAL = [
    ("MIT", """MIT License

Copyright (c) 2021 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""),
    ("MIT", "/* Copyright Jane Doe\n *\n * Permission is hereby granted, free of charge, to any person obtaining a copy of this software and\n"
            " * associated documentation files (the Software), to deal in the Software without restriction, including the\n"
            " * rights to use, copy, modify, merge, publish, distribute, sublicense and sell copies of the Software,\n"
            " * subject to the following conditions:\n */\n\nint main() { return 0; }"),
    ("ISC", """Copyright 2020 Jane Doe

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES.
"""),
    ("BSD-2-Clause", BSD),
    ("BSD-3-Clause", BSD + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""),
    ("BSD-3-Clause", BSD + """
3. Neither the name of Foo nor the names of its contributors may be used to
   endorse or promote products derived from this software without specific
   prior written permission.
"""),
    ("Apache-2.0", """# Copyright 2020 Jane Doe
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS.

import os
"""),
    ("Apache-2.0", """
                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION
"""),
    ("GPL-3.0", "/*\n" + GNU.format("program", "", 3) + " */\n"),
    ("GPL-2.0", "/*\n" + GNU.format("program", "", 2) + " */\n"),
    ("LGPL-3.0", "/*\n" + GNU.format("library", "Lesser ", 3) + " */\n"),
    ("GPL-3.0", OPENING.format("", "3, 29 June 2007", 2007)),
    ("GPL-2.0", OPENING.format("", "2, June 1991", 1989)),
    ("LGPL-3.0", OPENING.format("LESSER ", "3, 29 June 2007", 2007)),
    ("MPL-2.0", """// This Source Code Form is subject to the terms of the Mozilla Public
// License, v. 2.0. If a copy of the MPL was not distributed with this
// file, You can obtain one at https://mozilla.org/MPL/2.0/.

fn main() {}
"""),
    ("MPL-2.0", "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions\n--------------\n"),
    ("CC0-1.0", "Creative Commons Legal Code\n\nCC0 1.0 Universal\n\n    CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM\n"),
    ("CC-BY-4.0", "Attribution 4.0 International\n\n=====\n\nCreative Commons Corporation is not a law firm.\n"),
    ("CC-BY-SA-4.0", "Attribution-ShareAlike 4.0 International\n\n=====\n\nCreative Commons Corporation is not a law firm.\n"),
    ("CC-BY-NC-4.0", "Attribution-NonCommercial 4.0 International\n\n=====\n\nCreative Commons Corporation is not a law firm.\n"),
    ("Unlicense", """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.
"""),
    (None, "Mit"), (None, "the license"), (None, "Version 2, June"),
    (None, "Permission to enter the building is granted to any person with a card.\n\nThe software is updated each year.\n"),
]


def sample():
    rows = [(f"/a/{i}.py", prose(i, 60) + f"\n# SPDX-License-Identifier: {name}\n" + prose(i + 50, 20))
            for i, name in enumerate(licences.NOTICES)]
    rows += [(f"/b/{name}{i}", prose(i, 30) + ". " + notice + ".") for name, own in licences.NOTICES.items() for i, notice in enumerate(own)]
    rows += [("/c/prose", "We license nothing here, though a licence was talked about at length by the people of the town."),
             ("/c/long", prose(7, 20_000) + " licensed " + prose(8, 20_000)), ("/c/null", None), ("/c/empty", ""), (None, "Released under the MIT License."),
             ("/c/twice", "Released under the MIT License.\nLicensed under CC BY-NC 4.0."), ("/c/none", prose(9, 100))]
    return rows


def test_agrees_with_plain_python(spark):
    rows = sample()
    got = licences.scan(files(spark, rows)).collect()
    want = dict(zip([p for p, _ in rows], brute(rows)))
    assert len(got) == len(rows)
    for r in got:
        cosine, name = want[r.path]
        assert r.own_licence == name
        assert (r.similarity is None) == (cosine is None) and (cosine is None or abs(r.similarity - cosine) < 1e-9)
    by_path = {r.path: r.own_licence for r in got}
    for i, name in enumerate(licences.NOTICES):
        assert by_path[f"/a/{i}.py"] == name
    assert by_path["/b/MIT0"] == "MIT" and by_path["/c/prose"] is None and by_path["/c/long"] is None


def test_licence_files_and_headers_as_they_are_written(spark):
    rows = [(f"/real/{i}", t) for i, (_, t) in enumerate(REAL)] + [(f"/p/{i}", prose(i, 40)) for i in range(60)]
    want = dict(zip([p for p, _ in rows], brute(rows)))
    for r in licences.scan(files(spark, rows)).collect():
        named = REAL[int(r.path.split("/")[2])][0] if r.path.startswith("/real") else None
        assert (r.own_licence, r.path) == (named, r.path) and want[r.path][1] == named
        assert r.similarity is None or abs(r.similarity - want[r.path][0]) < 1e-9
    assert {n for n, _ in REAL if n} == set(licences.NOTICES)


def test_files_are_scanned_once(spark):
    rows = [("/LICENSE", REAL[0][1]), ("/src/a.c", "code"), ("/src/b.c", REAL[8][1])]
    got = {r.path: (r.licence, r.inherited_from) for r in licences.licence_of_files(files(spark, rows), ["path", "passed"]).collect()}
    assert got == {"/LICENSE": ("MIT", None), "/src/a.c": ("MIT", ""), "/src/b.c": ("GPL-3.0", None)}


def test_nearest_ancestor_passes_its_licence_on(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [("/LICENSE", mit), ("/x/y/COPYING", gpl), ("/x/a.c", "code"), ("/x/y/b.c", "code"), ("/x/y/z/w/c.c", "code"), ("/x/y/z/w/c.c", "code"),
            ("/x/y/own.c", "code\n" + mit), ("/x/y/NOTES", gpl), ("/x/yy/d.c", "code"), ("top", "code"), (None, "code"), ("/x/y/z/LICENSE.txt", "no notice"),
            ("/two/LICENSE", mit), ("/two/LICENSE", gpl), ("/two/e", None)]
    got = licences.inherit(licences.scan(files(spark, rows))).collect()
    assert len(got) == len(rows)
    found = {(r.path, r.own_licence): (r.licence, r.inherited_from) for r in got}
    assert found["/x/a.c", None] == ("MIT", "") and found["/x/yy/d.c", None] == ("MIT", "")
    assert found["/x/y/b.c", None] == ("GPL-3.0", "/x/y") and found["/x/y/z/w/c.c", None] == ("GPL-3.0", "/x/y")
    assert found["/x/y/z/LICENSE.txt", None] == ("GPL-3.0", "/x/y")
    assert found["/x/y/own.c", "MIT"] == ("MIT", None)
    assert found[None, None] == (None, None)
    assert found["/two/e", None] == ("MIT", "/two")
    assert found["top", None] == ("MIT", "")


def test_no_files_and_native_plan(spark):
    assert licences.inherit(licences.scan(files(spark, sample()).limit(0))).collect() == []
    plan = licences.inherit(licences.scan(files(spark, sample())))._jdf.queryExecution().executedPlan().toString()
    assert not any(n in plan for n in ("Python", "Arrow", "Pandas"))
