"""License scans: MinHash bands over overlapping text windows retrieve templates; exact containment verifies them.

Templates and texts become shingles of five words. A template is cut into pieces of at most 16 shingles, the last flush
with its end. For each length of piece there are text windows a little longer, which overlap so that every place where
a piece can stand is wholly inside one. With rows of one and `BANDS` bands, a window that holds a piece shares a band
with probability 1 - (1 - J)^BANDS, where J is at least one half for a piece of which 0.8 is there, so above 0.999.
Retrieved windows vote exactly, shingle by shingle, each at its place in the text. Along a text, the votes for a template
fall into occurrences (`_occurrences`); those that hold the threshold's share of its distinct shingles are matches. A text
without any shingle of any template contains none and gets no windows.

Everything runs on DataFrame functions. The templates are a configuration list, so their bands are a small broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from freightlens.llm.tables import let

WORDS = 5
PIECE = 16
BANDS = 12
THRESHOLD = 0.8

#: Fixed texts: public license notices.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
#: What turns one hash into another order of hashes, one for each band.
MASKS = [(0x9E3779B97F4A7C15 * (2 * k + 1)) % (1 << 64) - (1 << 63) for k in range(BANDS)]


def words_of(text: Column) -> Column:
    """Runs of ASCII letters and digits, lower-cased."""
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def shingle_hashes(text: Column) -> Column:
    """A hash of every run of five words; empty for texts with fewer."""
    def hashed(found: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(found) - WORDS + 1)
        return F.when(F.size(found) >= WORDS, F.transform(starts, lambda i: F.xxhash64(F.slice(found, i, WORDS)))).otherwise(
            F.array().cast("array<bigint>"))

    return let(words_of(text), hashed)


def band_values(hashes: Column) -> Column:
    """The smallest hash of a window under each band's order."""
    return F.transform(F.array(*map(F.lit, MASKS)), lambda m: F.array_min(F.transform(hashes, lambda h: h.bitwiseXOR(m))))


def window_plan(size: int) -> tuple[int, int]:
    """(length, step) of text windows for pieces of `size` shingles: any piece stands wholly inside one."""
    step = max(size // 2, 1)
    return size + step - 1, step


def template_pieces(hashes: list[int]) -> list[list[int]]:
    last = max(len(hashes) - PIECE, 0)
    return [hashes[i : i + PIECE] for i in [*range(0, last, PIECE), last]]


def load_templates(spark: SparkSession, templates: list[tuple[str, str]]) -> list[tuple[int, str, list[int]]]:
    """(number, license, shingle hashes) of each template; templates of fewer than five words are not used."""
    rows = [(i, name, text) for i, (name, text) in enumerate(templates)]
    frame = spark.createDataFrame(rows, "id int, license string, text string").withColumn("hashes", shingle_hashes(F.col("text")))
    return [(r["id"], r["license"], list(r["hashes"])) for r in sorted(frame.collect()) if r["hashes"]]


def _windows(hashes: Column, size: int) -> Column:
    """Windows for pieces of `size` shingles: (size, start, hashes)."""
    length, step = window_plan(size)
    starts = F.sequence(F.lit(0), F.greatest(F.size(hashes) - length + step - 1, F.lit(0)), F.lit(step))
    return F.transform(starts, lambda s: F.struct(F.lit(size).alias("size"), s.alias("start"), F.slice(hashes, s + 1, length).alias("hashes")))


def find_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, key: str = "doc_id", text: str = "text",
                  threshold: float = THRESHOLD) -> DataFrame:
    """One row per document and occurrence of a template: key, license, template (its number), containment (share of the
    template's distinct shingles in the occurrence), first_word and last_word (the words it spans, end exclusive). An
    occurrence goes if a better contained one of another template covers half of its words or more: of notices that differ
    in a word or two, the better one stands, place by place.

    NULL texts and texts of fewer than five words hold nothing. Rows that repeat key and text are one document; rows with
    the same key, or none, and other texts are judged one by one. Empty tables give no rows.
    """
    spark = docs.sparkSession
    known = load_templates(spark, templates)
    sizes = sorted({len(p) for _, _, h in known for p in template_pieces(h)})
    vocabulary = sorted({h for _, _, hs in known for h in hs})
    bands = sorted({(k, min(_xor(h, m) for h in piece), size, number)
                    for number, _, hs in known for piece in template_pieces(hs) for size in [len(piece)] for k, m in enumerate(MASKS)})
    lookup = spark.createDataFrame(bands, "band int, value long, size int, template int")
    facts = [(i, name, (order := list(dict.fromkeys(hs))), [order.index(h) for h in order if hs.count(h) > 1]) for i, name, hs in known]
    facts = spark.createDataFrame(facts, "template int, license string, wanted array<long>, repeated array<int>")
    hashed = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), shingle_hashes(F.col(text)).alias("hashes"))
    if not known:
        return hashed.limit(0).select(F.col("k").alias(key), F.lit("").alias("license"), F.lit(0).alias("template"), F.lit(0.0).alias("containment"),
                                      F.lit(0).alias("first_word"), F.lit(0).alias("last_word"))
    hopeful = hashed.where(F.arrays_overlap("hashes", F.array(*map(F.lit, vocabulary)).cast("array<long>")))
    every = F.concat(*[_windows(F.col("hashes"), s) for s in sizes])
    hopeful = hopeful.select("k", F.sha2("t", 256).alias("digest"), "hashes")  # once a text, not once a window
    windows = hopeful.select("k", "digest", F.explode(every).alias("w")).select("k", "digest", "w.size", "w.start", "w.hashes")
    banded = windows.select("*", F.posexplode(band_values(F.col("hashes"))).alias("band", "value"))
    found = banded.join(F.broadcast(lookup), ["band", "value", "size"]).join(F.broadcast(facts), "template")
    vote = lambda h, i: F.struct((F.col("start") + i).alias("at"), (F.array_position("wanted", h).cast("int") - 1).alias("place"))
    votes = found.select("k", "digest", "template", F.explode(F.filter(F.transform("hashes", vote), lambda v: v["place"] >= 0)).alias("v"))
    # a vote is a number while it is combined: sets of numbers are hashed
    votes = votes.groupBy("k", "digest", "template").agg(F.collect_set(F.shiftleft(F.col("v.at").cast("long"), 20) + F.col("v.place")).alias("votes"))
    votes = votes.select("k", "digest", "template", F.explode("votes").alias("v")).select(
        "k", "digest", "template", F.shiftright("v", 20).cast("int").alias("at"), (F.col("v") % (1 << 20)).cast("int").alias("place"))
    placed = votes.join(F.broadcast(facts.select("template", "license", F.size("wanted").alias("of"), "repeated")), "template")
    return _best(_occurrences(placed).where(F.col("containment") >= threshold), 2 * max(len(h) for _, _, h in known) + 2 * WORDS).select(
        F.col("k").alias(key), "license", "template", "containment", "first_word", "last_word")


def _occurrences(votes: DataFrame) -> DataFrame:
    """Votes (at: place in the text, place: place in the template) as occurrences, one row each.

    A run of votes ends where the template's places fall back, or where the text goes on by more than the template's length
    (`PIECE` words at least) beyond what the template has there. A run that follows closely and is, by half or more, not in
    the run before belongs to the same occurrence: parts were swapped, or a phrase was said twice. Shingles that a
    template repeats say nothing about order; they go with the votes before them.
    """
    one = ["k", "digest", "template", "license", "of"]
    along = Window.partitionBy(*one).orderBy("at", "place")
    slack = F.greatest(F.lit(PIECE), F.col("of"))
    told = ~F.array_contains("repeated", F.col("place"))
    before = F.last(F.when(told, F.struct("at", "place")), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    votes = votes.withColumn("told", told).withColumn("before", before)
    gap = F.col("at") - F.col("before.at")
    begins = F.col("told") & (F.col("before").isNull() | (F.col("place") <= F.col("before.place")) | (gap - (F.col("place") - F.col("before.place")) > slack))
    near = F.col("told") | F.col("before").isNull() | (gap <= slack + F.col("of"))
    runs = votes.withColumn("run", F.greatest(F.sum(begins.cast("int")).over(along), F.lit(1))).where(near).groupBy(*one, "run").agg(
        F.min("at").alias("first"), F.max("at").alias("last"), F.collect_set("place").alias("places"))
    follows = Window.partitionBy(*one).orderBy("run")
    last, held = F.lag("last").over(follows), F.lag("places").over(follows)
    runs = runs.withColumn("apart", last.isNull() | (F.col("first") - last > slack + F.col("of"))
                           | (2 * F.size(F.array_intersect("places", held)) >= F.least(F.size("places"), F.size(held))))
    parts = runs.withColumn("part", F.sum(F.col("apart").cast("int")).over(follows)).groupBy(*one, "part")
    return parts.agg(F.min("first").alias("first_word"), (F.max("last") + WORDS).alias("last_word"),
                     F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("n")).select(
        "k", "digest", "license", "template", (F.col("n") / F.col("of")).alias("containment"), "first_word", "last_word")


def _best(matches: DataFrame, stretch: int) -> DataFrame:
    """Matches of which no better one covers half. They meet in stretches of `stretch` words, which hold a few each."""
    names = ["license", "template", "containment", "first_word", "last_word"]
    spread = matches.withColumn("stretch", F.explode(F.sequence(F.floor(F.col("first_word") / stretch), F.floor((F.col("last_word") - 1) / stretch))))
    met = spread.groupBy("k", "digest", "stretch").agg(F.collect_list(F.struct(*names)).alias("all"))

    def beaten(m: Column) -> Column:
        def by(n: Column) -> Column:
            common = F.least(n["last_word"], m["last_word"]) - F.greatest(n["first_word"], m["first_word"])
            return (n["containment"] > m["containment"]) & (2 * common >= m["last_word"] - m["first_word"])

        return F.exists("all", by)

    judged = met.select("k", "digest", F.explode(F.transform("all", lambda m: F.struct(*[m[n].alias(n) for n in names], beaten(m).alias("beaten")))).alias("m"))
    return judged.select("k", "digest", "m.*").groupBy("k", "digest", *names).agg(F.bool_or("beaten").alias("beaten")).where("NOT beaten")


def _xor(value: int, mask: int) -> int:
    return value ^ mask
