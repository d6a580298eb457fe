"""Licence notices found by the Dice coefficient of word bigrams, with DataFrame functions only.

A segment is a line of a document, or a whole text of several lines.  Its words
are the runs of a-z, 0-9 and dots between them after lower-casing; its bigrams
are the distinct pairs of neighbouring words (a lone word is paired with
nothing).  Against a template T a segment S has Dice 2|S and T| / (|S| + |T|).

Since Dice can't exceed 2 min / (|S| + |T|), a template asks only for segments of
at least limit / (2 - limit) and at most (2 - limit) / limit times its bigrams:
segments outside all such ranges are dropped by their number of words before any
bigram is made, and the others meet only templates of their range.

A notice that is wrapped over lines, or a sentence of a longer line, is found by
windows: runs of words, of any lines, that begin and end with a bigram of a
template and have at most (2 - limit) / limit times its bigrams.  Only documents
with enough of a template's bigrams have windows.  Of those that overlap, the one
that shares most bigrams stays (ties: the higher Dice, the name, the place), and
it is reported unless its line, or a line or text around it that states the same
or a longer form of it, is reported itself.

A segment or window that reaches the limit shares at least limit / (2 - limit) of
a template's bigrams.  So for each template there are a few words such that the
bigrams without them are too few; a document that has none of these words is
passed over by a search of its text, before any word is cut out.  The others are
written once, for lines and windows.

Templates are a fixed list in the plan itself; nothing is joined or shuffled.

Defined results: null and empty texts have no segments; a segment is reported
once, with its best template (ties: the name that comes first); repeated rows
are reported each; line is the number of the line from 0 (of a window, its first), -1 for a whole text.
"""

from __future__ import annotations

import re
from fractions import Fraction
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents

#: Short notices and grants by which public licences are stated.
TEMPLATES = {
    "AGPL-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "BSD-2-Clause": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies."
    ),
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
LIMIT = 0.8
_WORD = "[a-z0-9]+(?:[.][a-z0-9]+)*"


def template_words(text: str) -> list[str]:
    return re.findall(_WORD, text.lower())


def _pairs(words: list[str]) -> set[str]:
    return {f"{a} {b}" for a, b in zip(words, words[1:])} or {f"{w} " for w in words}


def _lowered(text: Column) -> Column:
    """A-Z to lower case, and nothing else, so that results don't depend on a locale."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _words(text: Column) -> Column:
    return F.regexp_extract_all(_lowered(text), F.lit(f"({_WORD})"), 1)


def _bigrams(w: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.coalesce(F.get(w, i), F.lit(""))))
    return F.array_distinct(pairs)


def telling_words(known: dict[str, list[str]], least: dict[str, int]) -> list[str]:
    """Words without any of which no text shares ``least`` bigrams with a template; longer words, which are rarer, are preferred."""
    left = {name: {tuple(p.split(" ")) for p in pairs} for name, pairs in known.items()}
    chosen: list[str] = []
    while open_ := [name for name, pairs in left.items() if len(pairs) >= least[name]]:
        needed: dict[str, int] = {}
        for name in open_:
            for w in {x for p in left[name] for x in p if x}:
                needed[w] = needed.get(w, 0) + min(len(left[name]) - least[name] + 1, sum(w in p for p in left[name]))
        best = max(needed, key=lambda w: (len(w) > 5, needed[w], sum(w in p for name in open_ for p in left[name]), len(w), w))
        chosen.append(best)
        left = {name: {p for p in pairs if best not in p} for name, pairs in left.items()}
    return sorted(chosen)


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, limit: float = LIMIT) -> DataFrame:
    """doc_id, line, license, shared, segment_bigrams, template_bigrams, dice of every segment with Dice of at least ``limit``."""
    if not templates:
        raise ValueError("no templates")
    top = Fraction(str(limit))
    up = (2 - top) / top
    known = {name: sorted(_pairs(template_words(text))) for name, text in sorted(templates.items())}
    bounds = {name: (-(-len(p) * up.denominator // up.numerator), len(p) * up.numerator // up.denominator) for name, p in known.items()}
    least, most = min(b[0] for b in bounds.values()), max(b[1] for b in bounds.values())
    every = sorted({p for pairs in known.values() for p in pairs})
    s = Scratch(docs.sparkSession, "licenses")
    docs = s.save(_telling(documents(docs), telling_words(known, {name: low for name, (low, _) in bounds.items()})), "few")
    # each step's arrays are made by a generator of their own: what follows then reads them as columns, and filters don't make them again
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("line"), x.alias("s")))
    whole = F.when(F.contains(F.col("text"), F.lit("\n")), F.array(F.struct(F.lit(-1).alias("line"), F.col("text").alias("s"))))
    none = F.array().cast("array<struct<line:int,s:string>>")
    cut = F.transform(F.concat(lines, F.coalesce(whole, none)), lambda x: F.struct(x["line"].alias("line"), _words(x["s"]).alias("w")))
    found = documents(docs).where("text is not null").select("doc_id", F.explode(cut).alias("x")).select("doc_id", "x.line", "x.w")
    # a segment of n bigrams has more than n words, or one
    found = found.where(F.size("w") >= (least + 1 if least > 1 else 1))
    found = found.select("doc_id", "line", F.explode(F.array(_bigrams(F.col("w")))).alias("p"))
    found = found.where(F.size("p").between(least, most) & F.arrays_overlap("p", F.array(*map(F.lit, every)))).withColumn("n", F.size("p"))
    scored = []
    for name, p in known.items():
        low, high = bounds[name]
        shared = F.size(F.array_intersect("p", F.array(*map(F.lit, p))))
        score = F.when(F.col("n").between(low, high), shared).otherwise(0)
        scored.append(F.struct(score.alias("shared"), F.lit(name).alias("license"), F.lit(len(p)).alias("m")))
    fit = F.filter(F.array(*scored), lambda x: F.lit(2 * top.denominator) * x["shared"] >= F.lit(top.numerator) * (F.col("n") + x["m"]))
    found = found.select("doc_id", "line", "n", F.explode(F.array(fit)).alias("fit")).where(F.size("fit") > 0)
    # the best comes first: a higher Dice, then the name that sorts first (the list is sorted by name)
    best = F.aggregate(
        "fit", F.element_at("fit", 1), lambda a, x: F.when(x["shared"] * (F.col("n") + a["m"]) > a["shared"] * (F.col("n") + x["m"]), x).otherwise(a)
    )
    found = found.select("doc_id", "line", "n", F.explode(F.array(best)).alias("b"))
    dice = F.col("b.shared") * 2.0 / (F.col("n") + F.col("b.m"))
    segments = found.select(
        "doc_id", "line", "b.license", F.col("b.shared").alias("shared"), F.col("n").alias("segment_bigrams"), F.col("b.m").alias("template_bigrams"),
        dice.alias("dice"),
    )
    return s.close(segments.unionByName(_windows(docs, known, bounds, top)))


def _telling(docs: DataFrame, words: list[str]) -> DataFrame:
    """The documents that have one of the words: most are told by a plain search, the others by the pattern of whole words."""
    low = docs.select("*", F.explode(F.array(F.lower("text"))).alias("low"))  # lowered once for all searches
    some = low.where(reduce(or_, (F.contains("low", F.lit(w)) for w in words))).drop("low")
    return some.where(F.col("text").rlike(f"(?i)(?<![a-z0-9])(?:{'|'.join(map(re.escape, words))})(?![a-z0-9])"))


def _among(p: list[str]):
    return lambda h: h["p"].isin(p)


def _windows(docs: DataFrame, known: dict[str, list[str]], bounds: dict[str, tuple[int, int]], top: Fraction) -> DataFrame:
    """Rows of the notices that are neither lines nor whole texts."""
    every = sorted({p for pairs in known.values() for p in pairs})
    firsts = sorted({p.split(" ")[0] for p in every})
    least = min(low for low, _ in bounds.values())
    enough = lambda shared, n, m: F.lit(2 * top.denominator) * shared >= F.lit(top.numerator) * (n + F.lit(m))
    found = documents(docs).where("text is not null").select("doc_id", F.explode(F.array(F.transform(F.split("text", "\n"), _words))).alias("lines"))
    found = found.select("doc_id", "lines", F.explode(F.array(F.flatten("lines"))).alias("w"))
    starts = F.filter(F.transform("w", lambda x, i: F.when(x.isin(firsts), i)), F.isnotnull)
    found = found.select("doc_id", "lines", "w", F.explode(F.array(starts)).alias("at")).where(F.size("at") >= least)
    hits = F.transform("at", lambda i: F.struct(i.alias("i"), F.concat_ws(" ", F.get("w", i), F.get("w", i + 1)).alias("p")))
    found = found.select("doc_id", "lines", "w", F.explode(F.array(F.filter(hits, lambda h: h["p"].isin(every)))).alias("hits")).where(F.size("hits") >= least)
    # of each template its hits, where there are enough different ones
    own = []
    for name, p in known.items():
        low, high = bounds[name]
        mine = F.filter("hits", _among(p))
        own.append(F.struct(F.lit(name).alias("license"), F.lit(len(p)).alias("m"), F.lit(low).alias("low"), F.lit(high).alias("high"), F.array(*map(F.lit, p)).alias("q"), mine.alias("hits")))
    own = F.filter(F.array(*own), lambda t: F.size(F.array_distinct(F.transform(t["hits"], lambda h: h["p"]))) >= t["low"])
    found = found.select("doc_id", "lines", "w", F.explode(F.array(own)).alias("own")).where(F.size("own") > 0)

    def best(t: Column, start: Column, k: Column) -> Column:
        """The best window from one start, the k-th hit, on: it ends with one of as many hits as it may have bigrams."""
        ends = F.filter(F.slice(t["hits"], k + 1, t["high"]), lambda h: h["i"] < start + t["high"])
        pairs = F.transform(ends, lambda h: F.struct(h["i"].alias("end"), _bigrams(F.slice(F.col("w"), start + 1, h["i"] - start + 2)).alias("p")))
        counted = F.transform(pairs, lambda x: F.struct(F.size(F.array_intersect(x["p"], t["q"])).alias("shared"), F.size(x["p"]).alias("n"), x["end"].alias("end")))
        fit = F.filter(counted, lambda x: (x["n"] >= t["low"]) & (F.lit(2 * top.denominator) * x["shared"] >= F.lit(top.numerator) * (x["n"] + t["m"])))
        rows = F.transform(
            fit, lambda x: F.struct(
                (-x["shared"] * 2.0 / (x["n"] + t["m"])).alias("less"), (-x["shared"]).alias("fewer"), x["end"].alias("end"), x["n"].alias("n"), t["m"].alias("m"),
                t["license"].alias("license"), start.alias("start"),
            )
        )
        return F.array_min(rows)

    each = F.flatten(F.transform("own", lambda t: F.filter(F.transform(t["hits"], lambda h, k: best(t, h["i"], k)), F.isnotnull)))
    order = F.array_sort(
        F.transform(
            each, lambda x: F.struct(x["fewer"].alias("fewer"), x["less"].alias("less"), x["license"].alias("license"), x["start"].alias("start"), x["end"].alias("end"), x["n"].alias("n"), x["m"].alias("m"))
        )
    )
    found = found.select("doc_id", "lines", "w", F.explode(F.array(order)).alias("all")).where(F.size("all") > 0)
    # bigrams start to end are words start to end + 1
    apart = lambda x, y: (x["start"] > y["end"] + 1) | (y["start"] > x["end"] + 1)
    kept = F.aggregate("all", F.filter("all", lambda x: F.lit(False)), lambda a, x: F.when(F.forall(a, lambda y: apart(x, y)), F.concat(a, F.array(x))).otherwise(a))
    # what the segments around report
    names = list(known)

    def fits(p: Column) -> Column:
        one = [F.when(F.size(p).between(*bounds[t]) & enough(F.size(F.array_intersect(p, F.array(*map(F.lit, known[t])))), F.size(p), len(known[t])), F.lit(t)) for t in names]
        return F.filter(F.array(*one), F.isnotnull)

    longer = F.lit(None).cast("array<string>")
    for t in names:
        longer = F.when(F.col("x.license") == t, F.array(*[F.lit(u) for u in names if set(known[t]) <= set(known[u])])).otherwise(longer)
    # what lines and text report is found once a document; a window looks up its own lines
    found = found.select("doc_id", "lines", "w", F.explode(F.array(kept)).alias("kept"))
    line_of = F.flatten(F.transform("lines", lambda x, i: F.transform(x, lambda _: i)))
    by_line = F.transform("lines", lambda x: F.when(F.size(x) > 0, fits(_bigrams(x))).otherwise(F.array().cast("array<string>")))
    whole = F.when(F.size("lines") > 1, fits(_bigrams(F.col("w")))).otherwise(F.array().cast("array<string>"))
    found = found.select("doc_id", "kept", F.explode(F.array(F.struct(line_of.alias("line_of"), by_line.alias("by_line"), whole.alias("whole")))).alias("d"))
    placed = F.transform(
        "kept", lambda x: F.struct(x.alias("x"), F.get("d.line_of", x["start"]).alias("line"), F.get("d.line_of", x["end"] + 1).alias("last"))
    )
    said = F.transform(placed, lambda y: F.struct(y["x"].alias("x"), y["line"].alias("line"), y["last"].alias("last"), F.flatten(F.slice("d.by_line", y["line"] + 1, y["last"] - y["line"] + 1)).alias("lines")))
    found = found.select("doc_id", F.col("d.whole").alias("whole"), F.explode(said).alias("y")).select("doc_id", "whole", "y.*")
    same = F.arrays_overlap(longer, F.concat("lines", "whole"))
    inside = (F.col("line") == F.col("last")) & (F.size("lines") > 0)
    shared = -F.col("x.fewer")
    return found.where(~same & ~inside).select(
        "doc_id", "line", "x.license", shared.alias("shared"), F.col("x.n").alias("segment_bigrams"), F.col("x.m").alias("template_bigrams"),
        (shared * 2.0 / (F.col("x.n") + F.col("x.m"))).alias("dice"),
    )


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    rows = []
    for name, text in sorted(TEMPLATES.items()):
        pairs = ", ".join(f"'{p}'" for p in sorted(_pairs(template_words(text))))
        rows.append(f"('{name}', [{pairs}])")
    return f"""
WITH t(license, q) AS (VALUES {", ".join(rows)}),
l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS line, lines[i] AS s FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM l)
      UNION ALL SELECT doc_id, CAST(-1 AS INTEGER), text FROM l WHERE len(lines) > 1),
w AS (SELECT doc_id, line, regexp_extract_all(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM s),
p AS (SELECT doc_id, line, CASE WHEN len(w) = 1 THEN [w[1] || ' ']
             ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS p FROM w WHERE len(w) > 0),
d AS (SELECT doc_id, line, license, len(list_intersect(p, q)) AS shared, len(p) AS n, len(q) AS m FROM p, t
      WHERE len(p) <= 1.5 * len(q) AND len(q) <= 1.5 * len(p)),
r AS (SELECT *, 2.0 * shared / (n + m) AS dice, row_number() OVER (PARTITION BY doc_id, line ORDER BY 2.0 * shared / (n + m) DESC, license) AS k
      FROM d WHERE 20 * shared >= 8 * (n + m))
SELECT doc_id, line, license, CAST(shared AS INTEGER) AS shared, CAST(n AS INTEGER) AS segment_bigrams, CAST(m AS INTEGER) AS template_bigrams,
       CAST(dice AS DOUBLE) AS dice FROM r WHERE k = 1
"""


SQL4 = _sql()
