"""Licence notices, found by the Dice coefficient over word bigrams.

Lines, paragraphs and the whole text of a document are normalised and compared to templates,
all with column functions inside the row: nothing is shuffled. Two sets of a and b bigrams
can reach a coefficient of ``least`` only when ``least / (2 - least) <= a / b`` and the other
way round, so a unit meets only the templates within these bounds. It must also hold more of a
template's bigrams than those without a cue word, so a text without any cue word matches nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 0.8

# Notices as they are usually worded, by SPDX identifier where there is one.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "All-Rights-Reserved": "All rights reserved.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-4.0-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-SA-4.0-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def template_bigrams(templates: dict[str, str]) -> dict[str, list[str]]:
    """The different bigrams of each template, normalised as texts are."""
    found = {}
    for name, text in sorted(templates.items()):
        words = "".join(c.lower() if c.isascii() and c.isalnum() else " " for c in text).replace("licence", "license").split()
        found[name] = sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})
    return found


# Words that most English texts hold; as cue words they would tell nothing.
_PLAIN = set("a all and any are as at be by following for free from in is may not of on or other that the this to under use with without work you".split())


def cue_words(held: dict[str, list[str]], least: float) -> list[str]:
    """Words of which each unit that reaches ``least`` with some template holds at least one.

    A unit with c common bigrams reaches it only if c is at least ``least / (2 - least)`` of the
    template's, so the words are chosen to leave fewer bigrams than that without one of them.
    """
    chosen: set[str] = set()
    for grams in held.values():
        need = max(1, math.ceil(len(grams) * least / (2 - least) - 1e-9))
        words = sorted({w for g in grams for w in g.split()}, key=lambda w: (w not in chosen, w in _PLAIN, -len(w), w))
        bare = [g for g in grams if not chosen.intersection(g.split())]
        for word in words:
            if len(bare) < need:
                break
            chosen.add(word)
            bare = [g for g in bare if word not in g.split()]
    return sorted(chosen)


def normalised(text: Column) -> Column:
    """ASCII letters and digits in lower case, line ends kept, everything else one space; one spelling of licence."""
    return F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^A-Za-z0-9\n]+", " ")), "licence", "license")


def _words(unit: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(unit, r"[ \n]+", " ")), " ")


def matches(text: Column, templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> Column:
    """For a text the array of (score, name) of every unit and template that reach ``least``."""
    held = template_bigrams(templates)
    sizes = [len(b) for b in held.values()]
    low, high = min(sizes) * least / (2 - least), max(sizes) * (2 - least) / least
    known = F.array(*[F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, b)).alias("grams"), F.lit(len(b)).alias("n")) for name, b in held.items()])
    plain = normalised(text)
    cue = r"\b(?:" + "|".join(cue_words(held, least)) + r")\b"
    units = F.array_distinct(F.concat(F.split(plain, "\n"), F.split(plain, r"\n[ \n]*\n"), F.array(plain)))
    units = F.when(F.rlike(plain, F.lit(cue)), F.filter(units, lambda u: F.rlike(u, F.lit(cue)))).otherwise(F.array().cast("array<string>"))
    # A unit of w words has at most w - 1 different bigrams; those with too few go before any is made.
    words = F.filter(F.transform(units, _words), lambda w: F.size(w) > low)
    grams = F.transform(words, lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.element_at(w, i), F.element_at(w, i + 1)))))
    fitting = F.filter(grams, lambda g: (F.size(g) >= low) & (F.size(g) <= high))

    def against(g: Column) -> Column:
        near = F.filter(known, lambda t: (F.size(g) * (2 - least) >= t["n"] * least) & (F.size(g) * least <= t["n"] * (2 - least)))
        return F.transform(near, lambda t: F.struct((2.0 * F.size(F.array_intersect(g, t["grams"])) / (F.size(g) + t["n"])).alias("score"), t["name"].alias("name")))

    return F.filter(F.flatten(F.transform(fitting, against)), lambda m: m["score"] >= least)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """(doc_id, license, score, n_matches, licenses) of every document.

    ``license`` is the template with the highest score, ties going to the first name, null
    without a match (as for a null or empty text); ``licenses`` lists all by name.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), matches(F.col(text_col).cast("string"), templates, least).alias("found"))
    top = F.array_max(F.transform("found", lambda m: m["score"]))
    first = F.array_min(F.transform(F.filter("found", lambda m: m["score"] == top), lambda m: m["name"]))
    names = F.array_sort(F.array_distinct(F.transform("found", lambda m: m["name"])))
    return rows.select("doc_id", first.alias("license"), F.round(top, 6).alias("score"), F.size("found").alias("n_matches"), F.concat_ws(",", names).alias("licenses"))


def oracle(templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> str:
    """The same in SQL, with every unit met by every template."""
    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    rows = ", ".join(f"({quoted(n)}, [{', '.join(map(quoted, b))}])" for n, b in template_bigrams(templates).items())
    return f"""WITH t(name, grams) AS (VALUES {rows}),
p AS (SELECT doc_id, replace(lower(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9\\n]+', ' ', 'g')), 'licence', 'license') AS plain FROM documents),
u AS (SELECT doc_id, unnest(list_distinct(list_concat(list_concat(string_split(plain, chr(10)), regexp_split_to_array(plain, '\\n[ \\n]*\\n')), [plain]))) AS unit FROM p),
w AS (SELECT doc_id, string_split(trim(regexp_replace(unit, '[ \\n]+', ' ', 'g')), ' ') AS w FROM u),
g AS (SELECT doc_id, list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS g FROM w WHERE len(w) > 1),
m AS (SELECT doc_id, name, 2.0::DOUBLE * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS score FROM g, t),
b AS (SELECT doc_id, arg_min(name, (-score, name)) AS license, max(score) AS score, count(*) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses FROM m WHERE score >= {least} GROUP BY doc_id)
SELECT d.doc_id, b.license, round(b.score, 6) AS score, CAST(coalesce(b.n, 0) AS INTEGER) AS n_matches, coalesce(b.licenses, '') AS licenses FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id"""
