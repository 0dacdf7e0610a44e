"""Op 1: licence scans, in Spark SQL functions only.

A text's units are its lines and the whole of it. A unit's words are its runs of `[a-z0-9]+` after A-Z are lower-cased; its
set holds its distinct word bigrams. A unit matches a template with Dice = 2 * common / (size + size) >= `threshold`. Since
common <= the smaller size, only templates whose size is within [s * t / (2 - t), s * (2 - t) / t] of a unit's size s are
compared, however often a unit repeats its bigrams. Since n distinct words make n - 1 distinct bigrams at least, sets are built only
of units with few enough distinct words.

What stands in no matching unit is searched for runs of words, of part of a line or across lines: all runs that start and end with
a bigram of a template (others are no better) and whose bigrams, repeats counted, are as many as its size bounds allow. The words of
matching lines are blanks to them, and a document that matches as a whole has none. Two lossless bounds come first: a template whose
share of words a text lacks, and starts that too few of its bigrams follow. Of overlapping runs the best counts. Each document is judged in its own row: no shuffle, no join, whatever the sources or copies.

Per document: license (the best match's; ties to the smaller name), dice, n_units (units that match any template, and runs). Null or
empty texts and texts without a match have null, 0.0 and 0. A line of a very long text is a unit as any other; units outside
all size bounds are dropped before their sets are built. Repeated rows give repeated results; other columns pass through,
but columns of the result's names are replaced.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.9

# Licence notices and short licence texts.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0."],
    "BSD-3-Clause": ["Licensed under the 3-Clause BSD License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bigrams(text: str) -> list[str]:
    w = re.findall("[a-z0-9]+", text.translate(str.maketrans(UPPER, LOWER)))
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:])))  # noqa: B905


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """`docs` with columns license, dice and n_units."""
    known = [(k, b) for k, texts in (TEMPLATES if templates is None else templates).items() for t in texts if (b := bigrams(t))]
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    least, most = (min(len(b) for _, b in known) * low, max(len(b) for _, b in known) * high) if known else (1, 0)
    table = F.array(*(F.struct(F.lit(k).alias("name"), F.array(*map(F.lit, b)).alias("b")) for k, b in known)) if known else None
    lines = F.transform(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), "\n"), lambda x: F.regexp_extract_all(x, F.lit("[a-z0-9]+"), F.lit(0)))
    sized = lambda w: (F.size(w) - 1 >= F.lit(least)) & (F.size(F.array_distinct(w)) - 1 <= F.lit(most))
    pairs = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i)))
    whole = F.when(F.size("__ls_lines") > 1, F.array(F.flatten("__ls_lines"))).otherwise(F.array().cast("array<array<string>>"))
    sets = F.transform(F.concat(F.col("__ls_lines"), whole), lambda w: F.when(sized(w), F.array_distinct(pairs(w))))
    if table is None:
        return docs.withColumns({"license": F.lit(None).cast("string"), "dice": F.lit(0.0), "n_units": F.lit(0).cast("long")})

    def best(b: Column) -> Column:
        near = F.filter(table, lambda t: F.size(t["b"]).between(F.size(b) * F.lit(low), F.size(b) * F.lit(high)))
        scored = F.transform(near, lambda t: F.struct((F.lit(-2.0) * F.size(F.array_intersect(b, t["b"])) / (F.size(b) + F.size(t["b"]))).alias("minus"), t["name"].alias("name")))
        return F.array_min(F.filter(scored, lambda s: s["minus"] <= F.lit(-threshold)))

    # Of each template: its words, how many of them and of its bigrams a run needs, and how many bigrams a run may have.
    needs = []
    for name, grams in known:
        need = math.ceil(len(grams) * low - 1e-9)
        own = sorted({w for g in grams for w in g.split(" ")})
        needs.append((name, grams, own, len(own) - 2 * (len(grams) - need), need, math.floor(len(grams) * high + 1e-9)))
    sought = F.array(*(F.struct(F.lit(n).alias("name"), F.array(*map(F.lit, b)).alias("b"), F.array(*map(F.lit, w)).alias("w"), F.lit(k).alias("words"), F.lit(c).alias("need"), F.lit(m).alias("most")) for n, b, w, k, c, m in needs))
    seen = F.array_intersect("__ls_rest", F.array(*map(F.lit, sorted({w for x in needs for w in x[2]}))))
    rest = F.flatten(F.transform("__ls_lines", lambda w, i: F.when(F.get("__ls_judged", i).isNull(), w).otherwise(F.transform(w, lambda _: F.lit("")))))
    at_all = (F.size("__ls_lines") > 1) & F.get("__ls_judged", F.size("__ls_lines")).isNotNull()
    hits = lambda t: F.filter(F.sequence(F.lit(0), F.size("__ls_grams") - 1), lambda i: F.array_contains(t["b"], F.get("__ls_grams", i)))
    # Ends of runs from the hit in place p: the hits that follow within the template's bounds, but those too near.
    ends = lambda h, a, p: F.filter(F.slice(h["hits"], p + 1, h["t"]["most"]), lambda x: x < a + h["t"]["most"])
    starts = lambda h: F.filter(F.transform(h["hits"], lambda a, p: F.struct(a.alias("a"), h["t"].alias("t"), ends(h, a, p).alias("e"))), lambda x: F.size(x["e"]) >= x["t"]["need"])

    def run(x: Column, e: Column) -> Column:
        part = F.slice("__ls_grams", x["a"] + 1, e - x["a"] + 1)
        minus = F.lit(-2.0) * F.size(F.array_intersect(part, x["t"]["b"])) / (F.size(F.array_distinct(part)) + F.size(x["t"]["b"]))
        return F.struct(minus.alias("minus"), x["t"]["name"].alias("name"), x["a"].alias("a"), e.alias("e"))

    runs = F.transform("__ls_starts", lambda x: F.array_min(F.filter(F.transform(F.slice(x["e"], x["t"]["need"], F.size(x["e"])), lambda e: run(x, e)), lambda s: s["minus"] <= F.lit(-threshold))))
    by_start = F.array_sort(F.transform(F.filter("__ls_runs", lambda s: s.isNotNull()), lambda s: F.struct(s["a"], s["minus"], s["e"])))
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("minus"), F.lit(-1).alias("e"))
    apart = lambda s, x: F.struct((s["n"] + 1).alias("n"), x["minus"].alias("minus"), x["e"].alias("e"))
    better = lambda s, x: F.struct(s["n"].alias("n"), x["minus"].alias("minus"), x["e"].alias("e"))
    n_runs = F.aggregate(by_start, none, lambda s, x: F.when(x["a"] > s["e"], apart(s, x)).when(x["minus"] < s["minus"], better(s, x)).otherwise(s), lambda s: s["n"])

    found = docs.withColumn("__ls_lines", lines).withColumn("__ls_sets", sets)
    found = found.withColumn("__ls_judged", F.transform("__ls_sets", lambda b: F.when(b.isNotNull(), best(b)))).drop("__ls_sets")
    found = found.withColumn("__ls_rest", F.when(at_all, F.array().cast("array<string>")).otherwise(rest)).drop("__ls_lines").withColumn("__ls_seen", seen)
    found = found.withColumn("__ls_likely", F.filter(sought, lambda t: (F.size("__ls_rest") > t["need"]) & (F.size(F.array_intersect("__ls_seen", t["w"])) >= t["words"])))
    found = found.withColumn("__ls_grams", F.when(F.size("__ls_likely") > 0, pairs(F.col("__ls_rest"))).otherwise(F.array().cast("array<string>"))).drop("__ls_rest", "__ls_seen")
    found = found.withColumn("__ls_hits", F.transform("__ls_likely", lambda t: F.struct(t.alias("t"), hits(t).alias("hits")))).drop("__ls_likely")
    found = found.withColumn("__ls_starts", F.flatten(F.transform("__ls_hits", starts))).drop("__ls_hits")
    found = found.withColumn("__ls_runs", runs).drop("__ls_starts", "__ls_grams").withColumn("__ls_units", F.filter("__ls_judged", lambda s: s.isNotNull()))
    found = found.withColumn("__ls_all", F.concat("__ls_units", F.transform(F.filter("__ls_runs", lambda s: s.isNotNull()), lambda s: F.struct(s["minus"], s["name"])))).withColumn("__ls_n", F.size("__ls_units") + n_runs)
    one = F.array_min("__ls_all")
    return found.withColumns({"license": one["name"], "dice": F.coalesce(-one["minus"], F.lit(0.0)), "n_units": F.col("__ls_n").cast("long")}).drop("__ls_judged", "__ls_runs", "__ls_units", "__ls_all", "__ls_n")
