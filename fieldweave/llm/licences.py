"""Licence scans: Dice coefficient over word bigrams, all native.

A text's segments are its lines, its paragraphs and itself. A segment's words
are lower-cased runs of letters and digits; its bigrams are a set. With sets of
m and n bigrams the coefficient is 2|both| / (m + n), which can reach t only if
n lies between m t/(2-t) and m (2-t)/t. So a segment meets only the templates
whose bounds hold its size, and one that fits no template's bounds is dropped
before its bigrams are made. The templates are a constant of the plan.

A notice within a line, or wrapped over lines of a paragraph, is found by windows
over all words of the text. The window with a template's best coefficient starts
and ends with bigrams of the template and holds at least m t/(2-t) of them, so
windows run between the template's places in the text, where that many lie close
enough. A licence's best window counts as one more segment where it is better
than all of the others.

The same bound says which texts need no look: whatever reaches t holds all but
some of a template's bigrams, so a few words of each template are chosen of which
one at least must occur. A text without any of them is passed over.

Null and empty texts have no licence. A segment counts once however often it is
repeated in a text. Of licences with equal coefficients the first by name is the
best one. Rows keep their number, repeated ones too; null ids pass through; other
columns stay, whatever their names, but for one called `licences`, which gives
way; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, packed

# Licence notices, opening paragraphs and short full texts, by SPDX name.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'
        " You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    (
        "Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an"
        ' "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific'
        " language governing permissions and limitations under the License.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation"
        ' files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,'
        " modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the"
        " Software is furnished to do so, subject to the following conditions:",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as"
        " published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as"
        " published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,"
        " provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed"
        " with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("all-rights-reserved", "All rights reserved."),
    (
        "LGPL-3.0",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as"
        " published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "LGPL-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as"
        " published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    (
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as"
        " published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available"
        " at https://www.eclipse.org/legal/epl-2.0/",
    ),
    (
        "CC0-1.0",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ),
    (
        "BSL-1.0",
        "Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt or copy at"
        " https://www.boost.org/LICENSE_1_0.txt",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation"
        ' files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,'
        " modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the"
        " Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice"
        ' shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY'
        " OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR"
        " PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER"
        " LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR"
        " THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following"
        " conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the"
        " following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and"
        " the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following"
        " conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the"
        " following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and"
        " the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the"
        " copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"
        " without specific prior written permission.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any"
        " damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including"
        " commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ),
]


def bigrams(text: str) -> list[str]:
    """The distinct word bigrams of a template, in order of appearance."""
    words = "".join(c.lower() if c.isalnum() else " " for c in text).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def telling_words(templates: list[tuple[str, str]], least: float) -> list[str]:
    """Words of which every text has one that reaches `least` with a template.

    It then has `few` of the template's n bigrams, so it misses n - few at most;
    words in more bigrams than that cannot all be missing. Long words go first.
    """
    chosen: list[str] = []
    for _, text in templates:
        grams = [g.split(" ") for g in bigrams(text)]
        missing = len(grams) - max(1, math.ceil(len(grams) * least / (2 - least) - 1e-9))
        while sum(any(w in chosen for w in g) for g in grams) <= missing:
            rest = {w for g in grams for w in g} - set(chosen)
            chosen.append(max(rest, key=lambda w: (min(len(w), 8), sum(w in g for g in grams), w)))
    return chosen


def _literal(templates: list[tuple[str, str]], least: float) -> Column:
    rows = []
    for name, text in templates:
        grams = bigrams(text)
        n = len(grams)
        rows.append(
            F.struct(
                F.lit(name).alias("name"),
                F.lit(n * least / (2 - least) - 1e-9).alias("low"),
                F.lit(n * (2 - least) / least + 1e-9).alias("high"),
                F.lit(n).alias("n"),
                F.lit(max(1, math.ceil(n * least / (2 - least) - 1e-9))).alias("few"),
                F.lit(math.floor(n * (2 - least) / least + 1e-9)).alias("many"),
                F.array(*[F.lit(g) for g in grams]).alias("grams"),
            )
        )
    return F.array(*rows)


def _split(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def _paired(words: Column) -> Column:
    """The word bigrams in order, with repetitions."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat_ws(" ", a, b))


def _marks(grams: Column, known: Column) -> Column:
    """(i, before, gram) for each place of a text's bigrams: where the same bigram was before (-1: nowhere), and the bigram if a template has it."""
    sorted_by_gram = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    before = lambda pairs, x, k: F.when(F.get(pairs, k - 1)["g"] == x["g"], F.get(pairs, k - 1)["i"]).otherwise(F.lit(-1))
    marked = lambda pairs: F.transform(pairs, lambda x, k: F.struct(x["i"].alias("i"), before(pairs, x, k).alias("before"), F.when(known(x["g"]), x["g"]).alias("gram")))
    return F.array_sort(let(sorted_by_gram, marked))


def _slid(marks: Column, t: Column, a: Column) -> Column:
    """The best coefficient of the windows that begin at the place `a` of the template `t` and end at another: one pass over the bigrams after it.

    A bigram is new to the window if it was not there since `a`, so counts are all that is carried along.
    """

    def step(at: Column, x: Column) -> Column:
        new = (x["before"] < a).cast("int")
        sizes = F.struct((at["all"] + new).alias("all"), (at["both"] + F.when(x["hit"], new).otherwise(F.lit(0))).alias("both"), (at["places"] + x["hit"].cast("int")).alias("places"), at["best"].alias("best"))
        reached = lambda n: F.when(x["hit"] & (n["places"] >= t["few"]), F.greatest(n["best"], n["both"] * 2.0 / (n["all"] + t["n"]))).otherwise(n["best"])
        return let(sizes, lambda n: F.struct(n["all"].alias("all"), n["both"].alias("both"), n["places"].alias("places"), reached(n).alias("best")))

    begin = F.struct(F.lit(0).alias("all"), F.lit(0).alias("both"), F.lit(0).alias("places"), F.lit(0.0).alias("best"))
    return F.aggregate(F.slice(marks, a + 1, t["many"]), begin, step, lambda at: at["best"])


def _best_window(marks: Column, t: Column) -> Column:
    """(name, dice) of the best window between two of a template's places in a text, or null where the places lie too far apart."""

    def best(own: Column, places: Column) -> Column:
        near = lambda a, k: F.coalesce(F.get(places, k + t["few"] - 1) - a < t["many"], F.lit(False))
        firsts = F.filter(F.transform(places, lambda a, k: F.when(near(a, k), a)), lambda a: a.isNotNull())
        # One number at a time: windows never lie side by side.
        return F.aggregate(firsts, F.lit(0.0), lambda most, a: F.greatest(most, _slid(own, t, a)))

    of_template = lambda x: F.coalesce(F.array_contains(t["grams"], x["gram"]), F.lit(False))
    own = F.transform(marks, lambda x: F.struct(x["before"].alias("before"), of_template(x).alias("hit")))
    places = F.filter(F.transform(marks, lambda x: F.when(of_template(x), x["i"])), lambda i: i.isNotNull())
    dice = let(places, lambda at: F.when(F.size(at) >= t["few"], let(own, lambda marks: best(marks, at))))
    return F.struct(t["name"].alias("name"), F.coalesce(dice, F.lit(0.0)).alias("dice"))


def scan(docs: DataFrame, text: str = "text", least: float = 0.85, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """`docs` with `licences` (array of name, dice, segments): each licence that a segment reaches `least` with, by name."""
    templates = TEMPLATES if templates is None else templates
    sizes = [len(bigrams(t)) for _, t in templates]
    low, high = min(sizes) * least / (2 - least) - 1e-9, max(sizes) * (2 - least) / least + 1e-9
    own = [c for c in docs.columns if c.lower() != "licences"]
    d = packed(docs.select(*[F.col(f"`{c}`") for c in own], F.col(f"`{text}`").alias("licences")), "licences")
    d = d.select("row", F.coalesce("c0", F.lit("")).alias("text"))
    lowered = F.lower("text")
    hopeful = F.lit(False)
    for w in telling_words(templates, least):
        hopeful = hopeful | F.contains(lowered, F.lit(w))
    d = d.withColumn("text", F.when(hopeful, F.col("text")).otherwise(""))
    segments = F.array_distinct(F.concat(F.split("text", "\n"), F.split("text", r"\n\s*\n"), F.array("text")))
    d = d.withColumn("words", F.transform(segments, _split))
    # Distinct words less one is at most the number of distinct bigrams.
    d = d.withColumn("words", F.filter("words", lambda w: (F.size(w) - 1 >= low) & (F.size(F.array_distinct(w)) - 1 <= high)))
    d = d.withColumn("grams", F.transform("words", lambda w: F.array_distinct(_paired(w))))
    known = _literal(templates, least)
    hits = F.flatten(
        F.transform(
            "grams",
            lambda g: F.transform(
                F.filter(known, lambda t: (F.size(g) >= t["low"]) & (F.size(g) <= t["high"])),
                lambda t: F.struct(
                    t["name"].alias("name"),
                    (F.size(F.array_intersect(g, t["grams"])) * 2.0 / (F.size(g) + t["n"])).alias("dice"),
                ),
            ),
        )
    )
    d = d.withColumn("all", _paired(_split(F.col("text"))))
    every = sorted({g for _, t in templates for g in bigrams(t)})
    known_grams = lambda g: g.isin(*every)
    d = d.withColumn("marks", F.when(F.exists("all", known_grams), _marks(F.col("all"), known_grams)))
    d = d.withColumn("hits", F.filter(hits, lambda h: h["dice"] >= least - 1e-9))
    windows = F.filter(F.transform(known, lambda t: _best_window(F.col("marks"), t)), lambda h: h["dice"] >= least - 1e-9)
    d = d.withColumn("windows", F.when(F.col("marks").isNotNull(), windows).otherwise(F.slice("hits", 1, 0)))
    best = lambda hits, n: F.array_max(F.transform(F.filter(hits, lambda h: h["name"] == n), lambda h: h["dice"]))
    better = F.filter(
        F.transform(F.array_distinct(F.transform("windows", lambda h: h["name"])), lambda n: F.struct(n.alias("name"), best("windows", n).alias("dice"))),
        lambda h: h["dice"] > F.coalesce(best("hits", h["name"]), F.lit(0.0)),
    )
    d = d.withColumn("hits", F.concat("hits", better))
    names = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["name"])))
    found = F.transform(
        names,
        lambda n: F.struct(
            n.alias("name"),
            best("hits", n).alias("dice"),
            F.size(F.filter("hits", lambda h: h["name"] == n)).alias("hits"),
        ),
    )
    d = d.select("row", found.alias("found"))
    return d.select(*[F.col(f"row.`{c}`").alias(c) for c in own], F.col("found").alias("licences"))


def summary(scanned: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, licences, best_licence, best_dice): names joined by commas, and the best of them (the first by name on ties)."""
    found = scanned.select(F.col(doc_id).alias("doc_id"), F.col("licences").alias("_found"))
    best = F.array_max(F.transform("_found", lambda x: x["dice"]))
    first = F.get(F.filter("_found", lambda x: x["dice"] == best), F.lit(0))
    return found.select(
        "doc_id",
        F.array_join(F.transform("_found", lambda x: x["name"]), ",").alias("licences"),
        first["name"].alias("best_licence"),
        F.round(best, 6).alias("best_dice"),
    )


def oracle_sql(least: float = 0.85) -> str:
    """The same over `documents` in DuckDB SQL."""
    rows = ", ".join(
        "({}, {}, [{}])".format(i, "'" + name + "'", ", ".join("'" + g.replace("'", "''") + "'" for g in bigrams(text)))
        for i, (name, text) in enumerate(TEMPLATES)
    )
    return rf"""
WITH tpl(k, name, grams) AS (VALUES {rows}),
bound AS (SELECT *, greatest(1, ceil(len(grams) * {least} / (2 - {least}) - 1e-9)) AS few, floor(len(grams) * (2 - {least}) / {least} + 1e-9) AS many FROM tpl),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
seg AS (
  SELECT DISTINCT rid, s FROM (
    SELECT rid, unnest(string_split(text, chr(10))) AS s FROM d
    UNION ALL SELECT rid, unnest(regexp_split_to_array(text, '\n\s*\n')) FROM d
    UNION ALL SELECT rid, text FROM d)),
w AS (SELECT rid, s, list_filter(string_split(regexp_replace(lower(s), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '') AS words FROM seg),
g AS (SELECT rid, s, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i+1])) AS grams FROM w WHERE len(words) > 1),
hit AS (
  SELECT rid, name, 2.0 * len(list_intersect(g.grams, tpl.grams)) / (len(g.grams) + len(tpl.grams)) AS dice
  FROM g JOIN tpl ON len(g.grams) BETWEEN len(tpl.grams) * {least} / (2 - {least}) - 1e-9 AND len(tpl.grams) * (2 - {least}) / {least} + 1e-9),
tw AS (SELECT d.rid, words FROM w JOIN d ON d.rid = w.rid AND d.text = w.s),
a AS (SELECT rid, unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i+1])) AS gram, unnest(range(1, len(words))) AS pos FROM tw),
tg AS (SELECT k, unnest(grams) AS gram FROM tpl),
p AS (SELECT rid, k, pos, row_number() OVER (PARTITION BY rid, k ORDER BY pos) AS i FROM a JOIN tg USING (gram)),
ends AS (SELECT x.rid, x.k, x.pos AS a, y.pos AS b FROM p x JOIN bound ON bound.k = x.k JOIN p y ON y.rid = x.rid AND y.k = x.k AND y.i BETWEEN x.i + few - 1 AND x.i + many - 1 AND y.pos - x.pos < many),
win AS (SELECT e.rid, tpl.name, tpl.grams AS t, list_distinct(list_transform(range(e.a, e.b + 1), lambda i: words[i] || ' ' || words[i+1])) AS g FROM ends e JOIN tpl ON tpl.k = e.k JOIN tw ON tw.rid = e.rid),
every AS (SELECT rid, name, dice FROM hit UNION ALL SELECT rid, name, 2.0 * len(list_intersect(g, t)) / (len(g) + len(t)) FROM win),
per AS (SELECT rid, name, CAST(max(dice) AS DOUBLE) AS dice FROM every WHERE dice >= {least} - 1e-9 GROUP BY rid, name),
best AS (SELECT rid, name, dice, row_number() OVER (PARTITION BY rid ORDER BY dice DESC, name) AS n FROM per),
doc AS (SELECT rid, string_agg(name, ',' ORDER BY name) AS licences, max(CASE WHEN n = 1 THEN name END) AS best_licence, max(dice) AS best_dice FROM best GROUP BY rid)
SELECT d.doc_id, coalesce(licences, '') AS licences, best_licence, round(best_dice, 6) AS best_dice FROM d LEFT JOIN doc USING (rid)
"""
