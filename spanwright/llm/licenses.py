"""Licence scans: normalised lines, paragraphs and texts against templates by Dice over word bigrams.

Dice(A, B) = 2 |A & B| / (|A| + |B|) over sets of bigrams can only reach ``least`` if the sizes
are within a factor of (2 - least) / least, so every template has a range of sizes, and a
unit is compared with the templates whose range it is in: mostly none. Units are judged
where they lie, by SQL functions alone; nothing is shuffled.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Templates are part of the plan; longer lists belong in several calls.
MOST_TEMPLATES = 2_000
#: What divides paragraphs: a line end and one or more lines without letters and digits.
PARAGRAPHS = r"\n([^\p{L}\p{N}\n]*\n)+"


@dataclass(frozen=True)
class Template:
    license_id: str
    name: str
    text: str


#: Public notices and headers, as their licences word them.
TEMPLATES = (
    Template("MIT", "notice", "Released under the MIT License."),
    Template("MIT", "notice-licensed", "Licensed under the MIT License."),
    Template(
        "MIT",
        "permission",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    Template("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    Template(
        "Apache-2.0",
        "header",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    Template("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    Template("GPL-2.0", "notice", "This work is licensed under the GNU General Public License, version 2."),
    Template(
        "GPL-3.0",
        "header",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    Template("BSD-3-Clause", "notice", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    Template(
        "ISC",
        "permission",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    Template("MPL-2.0", "header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    Template("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    Template("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    Template("CC-BY-SA-4.0", "notice", "Licensed under CC BY-SA 4.0."),
    Template("CC-BY-4.0", "deed", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    Template("CC0-1.0", "notice", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    Template("Unlicense", "notice", "This is free and unencumbered software released into the public domain."),
)


def normal_words(text: str) -> list[str]:
    """Lower-case runs of letters and digits."""
    return re.findall(r"[^\W_]+", text.lower())


def bigrams(text: str) -> list[str]:
    """The different word bigrams of a text, in order."""
    w = normal_words(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:])))


def size_range(n: int, least: float) -> tuple[int, int]:
    """Sizes of a set that can reach a Dice of ``least`` with a set of ``n``; one is added for rounding."""
    return max(1, int(n * least / (2 - least))), int(n * (2 - least) / least) + 1


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once: SQL repeats an expression wherever its column is named."""
    return F.transform(F.array(value), use)[0]


def _unit_bigrams(text: Column) -> Column:
    words = F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")
    pairs = lambda w: F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(_bound(words, pairs))


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, *, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, unit, license_id, template, dice): the units of each document that are a licence text.

    Units are the lines of the whole text (``unit`` counts from 1), where there are
    several lines the text as one (``unit`` 0), and where lines without letters and digits divide it the
    paragraphs of several lines (``unit`` -1, -2, ... along all paragraphs), so a notice that is
    wrapped, or framed as a comment, is found. A unit is a licence if its best template
    reaches ``least``; ties go to the larger template, then to the smaller licence and template
    name. Null, empty and one-word units have no bigram and match nothing; repeated rows are
    scanned one by one. Templates without a bigram are refused.
    """
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates in one call")
    sets = [(t, bigrams(t.text)) for t in templates]
    if bare := [t.name for t, s in sets if not s]:
        raise ValueError(f"templates without a bigram: {bare}")
    ordered = sorted(sets, key=lambda x: (-len(x[1]), x[0].license_id, x[0].name))
    listed = F.array(
        *[
            F.struct(F.lit(-i).alias("place"), F.lit(t.license_id).alias("license_id"), F.lit(t.name).alias("template"), F.lit(len(s)).alias("n"), *[F.lit(v).alias(k) for k, v in zip(("low", "high"), size_range(len(s), least))], F.array(*map(F.lit, s)).alias("grams"))
            for i, (t, s) in enumerate(ordered)
        ]
    )
    low, high = min(size_range(len(s), least)[0] for _, s in sets), max(size_range(len(s), least)[1] for _, s in sets)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct((i + 1).alias("unit"), x.alias("body")))
    blocks = F.transform(F.split(text, PARAGRAPHS), lambda x, i: F.struct((-i - 1).alias("unit"), x.alias("body")))
    blocks = F.when(text.rlike(PARAGRAPHS), F.filter(blocks, lambda u: F.contains(u["body"], F.lit("\n")))).otherwise(F.array().cast("array<struct<unit:int,body:string>>"))
    units = F.when(F.contains(text, F.lit("\n")), F.concat(F.array(F.struct(F.lit(0).alias("unit"), text.alias("body"))), lines, blocks)).otherwise(lines)
    # a set of ``low`` bigrams takes ``2 * low + 1`` characters at least
    long = F.filter(units, lambda u: F.length(u["body"]) > 2 * low)
    sets_of = F.transform(long, lambda u: F.struct(u["unit"].alias("unit"), _unit_bigrams(u["body"]).alias("grams")))
    rows = docs.select(F.col(id_col).alias("id"), F.inline(F.filter(sets_of, lambda u: F.size(u["grams"]).between(low, high))))
    near = F.filter(listed, lambda t: F.size("grams").between(t["low"], t["high"]))
    scored = F.transform(
        near,
        lambda t: F.struct((F.lit(2.0) * F.size(F.array_intersect(F.col("grams"), t["grams"])) / (F.size("grams") + t["n"])).alias("dice"), t["place"].alias("place"), t["license_id"].alias("license_id"), t["template"].alias("template")),
    )
    best = rows.select("id", "unit", F.array_max(scored).alias("best")).filter(F.col("best.dice") >= least)
    return best.select(F.col("id").alias(id_col), "unit", "best.license_id", "best.template", "best.dice")
