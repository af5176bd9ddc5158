"""Licence of every file: TF-IDF cosine of its sentences and paragraphs to templates, then the nearest ancestor's."""

from __future__ import annotations

import re
from math import log, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.tables import free_name
from riskloom.session import materialize

# Identifiers of licences and the notices by which works refer to them.
NOTICES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0"],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License", "Use of this source code is governed by a BSD 2-Clause license"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License", "Use of this source code is governed by a BSD-style license"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0",
                     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0",
                     "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0 Universal"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3"],
    "ISC": ["Released under the ISC License"],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3"],
    "MIT": ["Released under the MIT License", "Licensed under the MIT License"],
    "MPL-2.0": ["Subject to the terms of the Mozilla Public License, version 2.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain"],
}
# Titles and naming paragraphs of licence texts, and the headers they ask for in source files.
HEADERS = {
    "Apache-2.0": [
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with '
        "the License. You may obtain a copy of the License at",
    ],
    "BSD-2-Clause": [
        "BSD 2-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:",
    ],
    "BSD-3-Clause": [
        "BSD 3-Clause License",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission.",
    ],
    "CC-BY-4.0": ["Attribution 4.0 International", "Creative Commons Attribution 4.0 International Public License"],
    "CC-BY-NC-4.0": [
        "Attribution-NonCommercial 4.0 International",
        "Creative Commons Attribution-NonCommercial 4.0 International Public License",
    ],
    "CC-BY-SA-4.0": [
        "Attribution-ShareAlike 4.0 International",
        "Creative Commons Attribution-ShareAlike 4.0 International Public License",
    ],
    "CC0-1.0": [
        "CC0 1.0 Universal",
        "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related "
        "or neighboring rights to this work.",
    ],
    "GPL-2.0": [
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later "
        "version.",
    ],
    "GPL-3.0": [
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version.",
    ],
    "ISC": [
        "ISC License",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "LGPL-3.0": [
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
        "License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later "
        "version.",
    ],
    "MIT": [
        "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions:",
    ],
    "MPL-2.0": [
        "Mozilla Public License Version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "Unlicense": [
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or "
        "as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
}
# Licences whose text holds that of another and a clause more.
EXTENDS = {"BSD-3-Clause": "BSD-2-Clause"}
TOKEN = "[^a-z0-9]+"
LICENCE_NAMES = "(?i)^(licen[cs]e|copying|notice)([.-].*)?$"
SENTENCES = "\\n|(?<=[.!?;])\\s+"
PARAGRAPHS = "\\n[^a-z0-9\\n]*\\n"  # comment marks alone make an empty line


def templates() -> list[tuple[str, dict[str, int]]]:
    """Term counts of every notice, title and header, and of the one-line identifier of every licence."""
    made = []
    for name in sorted(NOTICES):
        for text in [*NOTICES[name], *HEADERS[name], f"SPDX-License-Identifier: {name}"]:
            counts: dict[str, int] = {}
            for term in re.split(TOKEN, text.lower()):
                if term:
                    counts[term] = counts.get(term, 0) + 1
            made.append((name, counts))
    return made


def naming_terms(idf: dict[str, float], threshold: float) -> list[str]:
    """Terms of which a text must hold one to reach the threshold with any template.

    Shared terms carry at least ``threshold`` squared of a template's squared length. So of each
    template the heaviest terms count, until those left carry less than that.
    """
    needed = set()
    for _, counts in templates():
        squares = sorted(((n * idf[t]) ** 2, t) for t, n in counts.items())
        left = sum(w for w, _ in squares)
        least = left * threshold**2 * (1 - 1e-9)
        while squares and left >= least:
            weight, term = squares.pop()
            needed.add(term)
            left -= weight
    return sorted(needed)


def _any_of(terms: list[str]) -> str:
    """A pattern for any of the terms as a whole token; grouped by first letter, so that few branches are tried."""
    by_first: dict[str, list[str]] = {}
    for term in terms:
        by_first.setdefault(term[0], []).append(term[1:])
    groups = [first + "(?:" + "|".join(rests) + ")" for first, rests in by_first.items()]
    return "(?<![a-z0-9])(?:" + "|".join(groups) + ")(?![a-z0-9])"


def _tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), TOKEN), lambda t: t != "")


def inverse_frequencies(files: DataFrame, text: str, terms: list[str]) -> tuple[dict[str, float], float]:
    """Inverse document frequency of each template term over all files, and that of a word in none."""
    met = F.array_intersect(_tokens(F.col(text)), F.array(*map(F.lit, terms)))
    counts = files.select(F.explode(met).alias("term")).groupBy("term").count().collect()  # at most the templates' terms
    total, seen = files.where(F.col(text).isNotNull()).count(), {r["term"]: r["count"] for r in counts}
    return {t: log((total + 1) / (seen.get(t, 0) + 1)) + 1 for t in terms}, log(total + 1) + 1


def _times(own: Column):
    """Adds a term's weight times its weight in the map ``own``."""
    return lambda total, k: total + k["weight"] * F.coalesce(own[k["term"]], F.lit(0.0))


def _best_match(sentence: Column, idf: dict[str, float], unseen: float, threshold: float) -> Column:
    """Struct of the highest cosine to a template and its licence; equal ones go to the last name.

    Null where even a template of the sentence's known words alone could not reach the threshold. A sentence's words that no template has all weigh as much as a word in no file, so they take
    from the cosine what prose around a notice should take.
    """
    terms = F.array(*map(F.lit, idf))
    weights = F.create_map(*[F.lit(x) for pair in idf.items() for x in pair])
    words = _tokens(sentence)

    def scored(words: Column) -> Column:
        known = F.transform(
            F.array_intersect(words, terms),
            lambda t: F.struct(t.alias("term"), (F.size(F.filter(words, lambda w: w == t)) * weights[t]).alias("weight")))

        def compared(known: Column) -> Column:
            square = F.aggregate(known, F.lit(0.0), lambda s, k: s + k["weight"] * k["weight"])
            whole = square + F.size(F.array_except(words, terms)) * (unseen * unseen)
            length = F.sqrt(whole)
            cosines = []
            for name, counts in templates():
                own = {t: n * idf[t] for t, n in counts.items()}
                size = sqrt(sum(v * v for v in own.values()))
                dot = F.aggregate(known, F.lit(0.0), _times(F.create_map(*[F.lit(x) for pair in own.items() for x in pair])))
                cosines.append(F.struct((dot / (length * size)).alias("similarity"), F.lit(name).alias("licence")))
            return F.when(square >= whole * (threshold**2 * (1 - 1e-9)), F.array_max(F.array(*cosines)))

        # A one-element transform binds what is used many times, so that it is computed once.
        return F.element_at(F.transform(F.array(known), compared), 1)

    return F.element_at(F.transform(F.array(words), scored), 1)


def scan(files: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``files(path, text, ...)`` with ``own_licence`` and ``similarity`` (null without a licence).

    Every line, sentence and paragraph of the whole text is compared to every template: notices, titles and naming
    paragraphs of the licences, headers. The best at or above ``threshold`` is the file's; a licence that
    extends the best one wins where its own clause is found too. One shared word names no licence. Texts and units that
    hold none of the words without which no template can be reached (``naming_terms``) are passed over.

    Row by row, nothing is shuffled but the counts of the templates' terms. Null and empty texts have no
    licence. Columns of the result that ``files`` already has are replaced.
    """
    terms = sorted({t for _, counts in templates() for t in counts})
    idf, unseen = inverse_frequencies(files, "text", terms)
    naming, low = _any_of(naming_terms(idf, threshold)), F.lower("text")
    units = F.array_distinct(F.concat(F.split(low, SENTENCES), F.split(low, PARAGRAPHS)))
    known = F.array(*map(F.lit, terms))
    units = F.filter(F.when(low.rlike(naming), units), lambda u: u.rlike(naming))
    units = F.filter(units, lambda u: F.size(F.array_intersect(_tokens(u), known)) > 1)
    matches = F.filter(
        F.transform(units, lambda u: _best_match(u, idf, unseen, threshold)), lambda m: m["similarity"] >= threshold)

    def settled(found: Column) -> Column:
        best = F.array_max(found)
        name = best["licence"]
        for longer, shorter in EXTENDS.items():
            more = (name == shorter) & F.array_contains(found["licence"], longer)
            name = F.when(more, longer).otherwise(name)
        return F.struct(best["similarity"].alias("similarity"), name.alias("licence"))

    own = F.element_at(F.transform(F.array(matches), settled), 1)
    return files.withColumn("own_licence", own).withColumns(
        {"similarity": F.col("own_licence.similarity"), "own_licence": F.col("own_licence.licence")})


def licence_of_files(files: DataFrame, keep: list[str], threshold: float = 0.7) -> DataFrame:
    """``keep`` columns, ``own_licence``, ``similarity``, ``licence`` and ``inherited_from`` of every file.

    Texts are read once; what the scan found is written, without texts, before it is inherited.
    """
    scanned = scan(files, threshold).select(*dict.fromkeys([*keep, "path", "own_licence", "similarity"]))
    return inherit(materialize(scanned, "scanned-files"))


def inherit(scanned: DataFrame) -> DataFrame:
    """``scanned`` with ``licence`` and ``inherited_from``.

    A file named like a licence file that has a licence of its own declares it for its directory and all
    below. A file without a licence takes that of its nearest declaring ancestor directory; the
    directory is given in ``inherited_from``. Two declarations of one directory: the larger name
    counts. Null paths inherit nothing. Files with licences take no part in the join; the declarations
    are one row per directory and, when large, are joined by a shuffle that can split a crowded
    directory's files.
    """
    source, passed = free_name(scanned, "source"), free_name(scanned, "passed")
    name = F.regexp_extract("path", "([^/]*)$", 1)
    parent = F.regexp_replace("path", "/?[^/]*$", "")
    declared = materialize(
        scanned.where(F.col("own_licence").isNotNull() & name.rlike(LICENCE_NAMES))
        .groupBy(parent.alias("directory")).agg(F.max("own_licence").alias("passed")),
        "declared-licences",
    )
    parts = F.split(parent, "/")
    ancestors = F.transform(
        F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    open_paths = scanned.where("own_licence is null and path is not null").select("path").distinct()
    nearest = (
        open_paths.select("path", F.explode(F.array_distinct(ancestors)).alias("directory"))
        .join(declared, "directory")
        .groupBy("path")
        .agg(F.max(F.struct(F.length("directory").alias("depth"), "directory", "passed")).alias("near"))
        .select("path", F.col("near.directory").alias(source), F.col("near.passed").alias(passed))
    )
    found = materialize(nearest, "inherited-licences")
    return scanned.join(found, "path", "left").select(
        *[c for c in scanned.columns if c not in ("licence", "inherited_from")],
        F.when(F.col("own_licence").isNull(), F.col(source)).alias("inherited_from"),
        F.coalesce("own_licence", passed).alias("licence"),
    )
