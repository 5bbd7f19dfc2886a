"""Licence texts in documents, by the Dice coefficient of word bigrams.

A template with bigrams T and a stretch of a document with bigrams A agree by
2 |A n T| / (|A| + |T|). Reaching a threshold t needs

* an |A| between t / (2 - t) and (2 - t) / t times |T|: the size bounds;
* t / (2 - t) of T's bigrams at least, so any choice of a few more bigrams of
  T than may be missing has one in common with A: the anchors;
* a positive gain |A n T| - t/2 |A| of at least t/2 |T|, which turns the search
  for the stretch into a largest-sum search over the places of common bigrams.

Versions and variants of a licence differ in a word or two, which a coefficient
hardly notices. Words in braces in a template tell them apart: a stretch must
have all of their bigrams, and one of them is anchor enough.

Documents without an anchor leave in the scan; of the rest the common bigrams
are joined; window functions over their places leave out the templates that no
stretch can reach, and take for each first bigram the stretch with the largest
coefficient over multisets of bigrams. Of stretches that overlap, whatever their
templates, the one that agrees best stays, then the best of what it leaves, and
so on; all occurrences are reported. Everything is DataFrame expressions.

Defined results: words are runs of letters and digits in lower case; a null or
empty text matches nothing, nor does a template of fewer than two words; of
equally good stretches the longer, then the first, then that of the first template stays;
repeated rows are reported each. Empty tables give no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadrille.llm.common import with_row

THRESHOLD = 0.8
# Anchors compared in one expression, and template bigrams that travel to every task.
ANCHORS, BROADCAST_ROWS = 4_000, 100_000

# Names of public licences (identifier, article and name in a sentence), words that tell them apart in braces.
NAMES: tuple[tuple[str, str], ...] = (
    ("MIT", "the {MIT License}"),
    ("BSD-2-Clause", "the {BSD 2-Clause License}"),
    ("BSD-3-Clause", "the {BSD 3-Clause License}"),
    ("ISC", "the {ISC License}"),
    ("Zlib", "the {zlib License}"),
    ("Unlicense", "{the Unlicense}"),
    ("Apache-2.0", "the {Apache License, Version 2.0}"),
    ("GPL-2.0-only", "the {GNU General} Public {License, version 2}"),
    ("GPL-3.0-only", "the {GNU General} Public {License, version 3}"),
    ("LGPL-2.1-only", "the GNU {Lesser General} Public {License, version 2.1}"),
    ("LGPL-3.0-only", "the GNU {Lesser General} Public {License, version 3}"),
    ("AGPL-3.0-only", "the GNU {Affero General} Public {License, version 3}"),
    ("MPL-1.1", "the {Mozilla Public License, version 1.1}"),
    ("MPL-2.0", "the {Mozilla Public License, version 2.0}"),
    ("EPL-1.0", "the {Eclipse Public License 1.0}"),
    ("EPL-2.0", "the {Eclipse Public License 2.0}"),
    ("BSL-1.0", "the {Boost Software License, Version 1.0}"),
    ("EUPL-1.2", "the {European Union Public License, version 1.2}"),
    ("CC0-1.0", "{CC0 1.0} Universal"),
    *((f"CC-{part}-{version}", f"{{CC {part} {version}}}") for part in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND") for version in ("3.0", "4.0")),
    *((f"CC-{part}-4.0", f"a Creative {{Commons {name} 4.0}} International License") for part, name in (
        ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"),
        ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))),
)
OPENINGS = ("Released under", "Licensed under", "This work is licensed under")

# Notices of common public licences (published wording).
GNU_NOTICE = ("This program is free software: you can redistribute it and/or modify it under the terms of {name} as "
              "published by the Free Software Foundation, either {version} of the License, or (at your option) any later version.")
BSD_NOTICE = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
              "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
              "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
              "documentation and/or other materials provided with the distribution.")
NOTICES: tuple[tuple[str, str], ...] = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
            "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the {Apache License, Version 2.0} (the \"License\"); you may not use this file except in compliance with the License."),
    *((f"{kind}-{version}-or-later", GNU_NOTICE.format(name=name, version=f"{{version {version.removesuffix('.0')}}}")) for kind, name, version in (
        ("GPL", "the {GNU General} Public License", "2.0"), ("GPL", "the {GNU General} Public License", "3.0"),
        ("LGPL", "the GNU {Lesser General} Public License", "2.1"), ("LGPL", "the GNU {Lesser General} Public License", "3.0"),
        ("AGPL", "the GNU {Affero General} Public License", "3.0"))),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the {Mozilla Public License, v. 2.0}."),
    ("BSD-2-Clause", BSD_NOTICE),
    ("BSD-3-Clause", BSD_NOTICE + " 3. {Neither the name of} the copyright holder nor the names of its contributors may be used to endorse or promote "
                                  "products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
             "damages arising from the use of this software."),
)
TEMPLATES = tuple((identifier, f"{opening} {name}.") for identifier, name in NAMES for opening in OPENINGS) + NOTICES


def key_phrases(body: str) -> list[str]:
    """What a template has in braces."""
    return re.findall(r"\{(.*?)\}", body)


def _pairs(words: str) -> str:
    """A hash of each pair of neighbouring words, as SQL."""
    return f"case when size({words}) < 2 then array() else transform(sequence(1, size({words}) - 1), i -> xxhash64({words}[i - 1], {words}[i])) end"


def _trimmed(text: Column) -> Column:
    """Words of a text, without the empty ones before the first and after the last separator."""
    return F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")


def license_matches(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(row, license, template, dice, first_word, last_word), a row for each stretch of a document that agrees with a template.

    ``row`` holds the other columns of ``docs``; words count from 0, pieces
    before a first separator included.
    """
    spark: SparkSession = docs.sparkSession
    listed = spark.createDataFrame([(i, name, body, key_phrases(body)) for i, (name, body) in enumerate(templates)],
                                   "template int, license string, body string, keys array<string>")
    words = listed.select("template", "license", _trimmed(F.col("body")).alias("words"), F.transform("keys", _trimmed).alias("keys"))
    known = [r for r in words.select("template", "license", "words", F.expr(_pairs("words")).alias("pairs"),
                                     F.expr(f"flatten(transform(keys, k -> {_pairs('k')}))").alias("keys")).collect() if r["pairs"]]
    share = threshold / (2 - threshold)
    anchors: set[int] = set()
    rows = []
    for r in known:
        size, keys, times = len(r["pairs"]), set(r["keys"]), Counter(r["pairs"])
        # Long words are seldom elsewhere. Without keys: more bigrams than may be missing.
        by_rarity = sorted(range(size), key=lambda i: (-len(r["words"][i]) - len(r["words"][i + 1]), i))
        by_rarity = [r["pairs"][i] for i in by_rarity]
        anchors.update([p for p in by_rarity if p in keys][:1] or by_rarity[:int(size * (1 - share) + 1e-9) + 1])
        needed = sum(times[p] for p in keys)
        rows += [(r["template"], r["license"], size, pair, n, pair in keys, needed) for pair, n in times.items()]
    table = spark.createDataFrame(rows, "template int, license string, size int, pair long, times int, key boolean, needed int")
    table = F.broadcast(table) if len(rows) <= BROADCAST_ROWS else table

    parts = sorted(anchors)
    blocks = [parts[i:i + ANCHORS] for i in range(0, len(parts), ANCHORS)]
    anchored = F.lit(False)
    for block in blocks:
        anchored = anchored | F.arrays_overlap("pairs", F.array(*map(F.lit, block)))
    scanned = (with_row(docs, text, drop_text=True).withColumn("words", F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))
               .select(F.monotonically_increasing_id().alias("n"), "row", F.expr(_pairs("words")).alias("pairs")).filter(anchored))
    hits = scanned.select("n", "row", F.posexplode("pairs").alias("place", "pair")).join(table, "pair")

    own = W.partitionBy("n", "template")
    ordered = own.orderBy("place")
    half = threshold / 2
    hits = hits.withColumn("hits", F.count("*").over(own)).filter(F.col("hits") >= F.col("size") * share - 1e-9)
    # The stretch that ends here gains most if it begins where the sum before was least. Repeats of a bigram
    # count in full here, so this is an upper bound, which leaves out what cannot reach the threshold.
    hits = hits.withColumn("i", F.row_number().over(ordered))
    before = F.min(F.col("i") - 1 - half * F.col("place")).over(ordered.rowsBetween(W.unboundedPreceding, W.currentRow))
    gain = F.max(F.col("i") - half * (F.col("place") + 1) - F.col("before")).over(own)
    hits = hits.withColumn("before", before).withColumn("gain", gain).filter(F.col("gain") >= half * F.col("size") - 1e-9)

    # A hit counts for a stretch unless the stretch already has as many of its bigram as the template.
    most = max((r[4] for r in rows), default=1)
    same = W.partitionBy("n", "template", "pair").orderBy("place").rowsBetween(-most, -1)
    earlier = F.collect_list("place").over(same)
    hits = hits.withColumn("full", F.when(F.size(earlier) >= F.col("times"), F.element_at(earlier, -F.col("times"))).otherwise(-1))
    longest = int(max((r[2] for r in rows), default=1) / share + 1e-9)
    ahead = F.collect_list(F.struct("place", "full", "key")).over(ordered.rangeBetween(0, longest - 1))
    # From each hit on: the best end by the coefficient itself, within the size bounds and with all keys.
    best = F.expr(f"""aggregate(ahead, struct(0 as common, 0 as keys, cast(0 as double) as dice, -1 as last), (a, h) ->
      aggregate(array(struct(a.common + if(h.full < place, 1, 0) as common, a.keys + if(h.full < place and h.key, 1, 0) as keys)), a, (o, c) -> aggregate(
        array(if(c.keys >= needed and h.place - place + 1 between size * {share} - 1e-9 and size / {share} + 1e-9,
                 2.0D * c.common / (h.place - place + 1 + size), 0.0D)), o,
        (q, d) -> struct(c.common as common, c.keys as keys, greatest(q.dice, d) as dice, if(d > q.dice, h.place, q.last) as last))))""")
    found = (hits.withColumn("ahead", ahead).withColumn("best", best).filter(F.col("best.dice") >= threshold - 1e-9)
             .select("n", "row", "license", "template", F.round("best.dice", 12).alias("dice"), "place", (F.col("best.last") + 1).alias("end")))

    # Stretches that hang together by overlaps are decided together, best first.
    along = W.partitionBy("n").orderBy("place", "end", "template")
    reached = F.max("end").over(along.rowsBetween(W.unboundedPreceding, -1))
    found = found.withColumn("begins", F.when(F.col("place") <= reached, 0).otherwise(1)).withColumn("island", F.sum("begins").over(along))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("dice")).alias("rank"), (F.col("place") - F.col("end")).alias("shorter"), "place", "template",
                                                  "end", "license", "dice")))
    kept = F.aggregate("ranked", F.slice("ranked", 1, 0), lambda got, x: F.when(
        F.exists(got, lambda g: (g["place"] <= x["end"]) & (x["place"] <= g["end"])), got).otherwise(F.concat(got, F.array(x))))
    return (found.groupBy("n", "island").agg(ranked.alias("ranked"), F.first("row").alias("row"))
            .select("row", F.explode(kept).alias("k"))
            .select("row", "k.license", "k.template", "k.dice", F.col("k.place").cast("long").alias("first_word"), F.col("k.end").cast("long").alias("last_word")))


def report(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """doc_id, license, template, dice, first_word, last_word."""
    return found.select(F.col(f"row.{id_column}").alias("doc_id"), "license", "template", F.round("dice", 6).alias("dice"), "first_word", "last_word")
