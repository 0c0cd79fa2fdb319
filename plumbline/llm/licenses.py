"""Licence scan: Dice coefficient over word bigrams against licence templates.

A text is looked at in units: every line, every paragraph (lines between blank lines) of two lines or more, and the
whole text if it has several lines. A unit is normalised (lower case, runs of other characters than letters and digits
become one space) and turned into its set of word bigrams. The Dice coefficient of sets A and B can reach t only if
|B| lies between |A| t / (2 - t) and |A| (2 - t) / t, so a unit is compared only to the templates of such sizes, and
most units to none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import let, named

#: name: texts that state it. Short public statements; a caller may pass full licence texts as well.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "SPDX-License-Identifier: MIT",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
LEAST = 0.8


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def bigrams(unit: Column) -> Column:
    """Distinct word bigrams, joined by a space, of a normalised text. Fewer than two words: none."""
    return let(F.split(unit, " "), lambda w: F.when(F.size(w) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat(F.get(w, i), F.lit(" "), F.get(w, i + 1))))))


def template_grams(texts: list[str]) -> list[list[str]]:
    import re

    out = []
    for text in texts:
        words = re.sub(r"[\W_]+", " ", text.lower()).split()
        out.append(sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}))
    return out


def license_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """(doc_id, license, dice, n_units, start, length): one row for each row of docs and licence found in it.

    dice: the best of its units, rounded to 6 digits; n_units: units that reach `least`; start and length: code points
    of the best unit (ties: the first one, then the shorter). Null, empty and template-free texts give no row. Null ids
    stay null. Repeated rows give repeated results. The templates are literals of the plan: a few thousand at most.
    """
    known = [(name, grams) for name, texts in templates.items() for grams in template_grams(texts) if grams]
    lo, hi = least / (2 - least), (2 - least) / least
    shortest = min(len(g) for _, g in known) * lo
    longest = max(len(g) for _, g in known) * hi
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    # A cheap test of the whole text before it is cut up.
    needed = hitting_words([g for _, g in known], least)
    # A unit has more characters than twice its bigrams, and at least one bigram of a template.
    span = lambda start, unit: named(start=start.cast("long"), unit=unit)

    def pieces(body: Column, mark: str) -> Column:
        start = named(at=F.lit(0).cast("long"), out=F.array().cast("array<struct<start:bigint,unit:string>>"))
        step = lambda a, x: named(at=a["at"] + F.length(x) + len(mark), out=F.when((F.length(x) > 2 * shortest) & F.lower(x).rlike("|".join(needed)), F.concat(a["out"], F.array(span(a["at"], x)))).otherwise(a["out"]))
        return F.aggregate(F.split(body, mark), start, step)["out"]

    hinted = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), row_id().alias("row")).where(F.lower(F.col("text")).rlike("|".join(needed)))
    several = F.col("text").contains("\n")
    units = F.concat(
        pieces(F.col("text"), "\n"),
        F.when(several, F.filter(pieces(F.col("text"), "\n\n"), lambda x: x["unit"].contains("\n") & (F.length(x["unit"]) < F.length("text")))).otherwise(F.array()),
        F.when(several, F.array(span(F.lit(0), F.col("text")))).otherwise(F.array()),
    )
    cut = hinted.select("doc_id", "row", "text", F.explode(units).alias("u")).select("doc_id", "row", "u.start", F.length("u.unit").alias("length"), normalised(F.col("u.unit")).alias("unit"))
    cut = cut.where(F.col("unit").rlike("|".join(needed)))
    sized = cut.select("doc_id", "row", "start", "length", bigrams(F.col("unit")).alias("grams")).where(F.size("grams").between(max(1, int(shortest)), int(longest) + 1))
    found = F.array(*[F.when((F.size("grams") >= len(g) * lo - 1e-9) & (F.size("grams") <= len(g) * hi + 1e-9), F.struct(F.lit(name).alias("license"), (2 * F.size(F.array_intersect("grams", F.array(*map(F.lit, g)))) / (F.size("grams") + len(g))).alias("dice"))) for name, g in known])
    hits = sized.select("doc_id", "row", "start", "length", F.explode(F.filter(found, lambda x: x["dice"] >= least - 1e-9)).alias("hit")).select("doc_id", "row", "start", "length", "hit.license", F.round("hit.dice", 6).alias("dice"))
    best = F.max(F.struct("dice", (-F.col("start")).alias("first"), (-F.col("length")).alias("short")))
    return hits.groupBy("doc_id", "row", "license").agg(best.alias("b"), F.count_distinct("start", "length").alias("n_units")).select("doc_id", "license", F.col("b.dice").alias("dice"), F.col("n_units").cast("long").alias("n_units"), (-F.col("b.first")).alias("start"), (-F.col("b.short")).cast("long").alias("length"))


def row_id() -> Column:
    """Tells repeated rows apart within this plan; nothing of it is returned."""
    return F.monotonically_increasing_id()


def hitting_words(templates: list[list[str]], least: float) -> list[str]:
    """Words of which every unit that reaches `least` holds one.

    2 |A and B| >= t (|A| + |B|) and |A| >= |A and B| give |A and B| >= |B| t / (2 - t). So a template's words are
    taken, longest first, until fewer of its bigrams than that are without a taken word.
    """
    need: set[str] = set()
    for grams in templates:
        shared = len(grams) * least / (2 - least) - 1e-9
        left = set(grams)
        for w in sorted({w for g in grams for w in g.split()}, key=lambda w: (-len(w), w)):
            if len(left) < shared:
                break
            if any(w in g.split() for g in left):
                need.add(w)
                left = {g for g in left if w not in g.split()}
    return sorted(need)


def oracle(docs: str = "documents", templates: dict[str, list[str]] = TEMPLATES, least: float = LEAST) -> str:
    """DuckDB SQL of license_scan where doc_id is unique: every unit against every template, nothing pruned."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(name)}, [{', '.join(map(quoted, grams))}])" for name, texts in templates.items() for grams in template_grams(texts) if grams)
    pieces = lambda mark, n, test: f"SELECT doc_id, unit, coalesce(sum(length(unit) + {n}) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, {test} AS ok FROM (SELECT doc_id, text, unnest(s) AS unit, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, text, string_split(text, {mark}) AS s FROM {docs} WHERE text IS NOT NULL))"
    return f"""
WITH t(license, grams) AS (VALUES {rows}),
u AS ({pieces("chr(10)", 1, "true")} UNION ALL {pieces("chr(10) || chr(10)", 2, "contains(unit, chr(10)) AND length(unit) < length(text)")} UNION ALL SELECT doc_id, text, 0, true FROM {docs} WHERE contains(text, chr(10))),
w AS (SELECT doc_id, start, length(unit) AS length, string_split(trim(regexp_replace(lower(unit), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM u WHERE ok),
g AS (SELECT doc_id, start, length, list_distinct(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) AS g FROM w WHERE len(w) > 1),
d AS (SELECT doc_id, license, start, length, 2 * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS dice FROM g, t),
b AS (SELECT doc_id, license, arg_max({{'d': round(dice, 6), 's': start, 'l': length}}, {{'d': round(dice, 6), 's': -start, 'l': -length}}) AS b, count(DISTINCT {{'s': start, 'l': length}}) AS n_units FROM d WHERE dice >= {least} - 1e-9 GROUP BY doc_id, license)
SELECT doc_id, license, b.d AS dice, n_units, b.s AS start, b.l AS length FROM b"""
