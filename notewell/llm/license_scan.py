"""License scan (DataFrame functions only): MinHash bands over overlapping windows, then exact containment.

A text is cut into words and 3-word shingles; each window covers two blocks of 6 shingles and overlaps the next one by
a block. Every band is one min-hash of the window (the least of shingle hash XOR the band's seed), found once per block
and combined. A window whose band equals a template window's band retrieves the template. A template of up to 7
shingles lies whole in some window of 12, and longer ones fill windows; with Jaccard similarity J of window and template
window, 24 bands find it with probability 1 - (1 - J) ** 24: 0.999 at J = 1/4. Templates of one or two shingles would
share too little with a window of 12, so the windows for them are single shingles: J is 1 for the first shingle, the
min-hash of such a window is the shingle itself, and it is always found. Then the template's share of shingles that
occur in the region around the window is counted exactly.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 3
BLOCK = 6
BANDS = 24
FEW = 2  # shingles up to which a template is looked up by single shingles
CONTAINMENT = 0.8
MAX_TEMPLATE_BYTES = 1 << 20  # of all templates: they are part of the plan

# Notices as they are commonly given with public licenses.
TEMPLATES: Mapping[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.",),
    "CC-BY-SA-4.0": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",),
    "CC0-1.0": (
        "has waived all copyright and related or neighboring rights to this work",
        "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to "
        "this software to the public domain worldwide",
    ),
    "LGPL": (
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "under the terms of the GNU Library General Public License as published by the Free Software Foundation",
    ),
    "AGPL-3.0": ("under the terms of the GNU Affero General Public License as published by the Free Software Foundation",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "All-rights-reserved": ("All rights reserved.",),
}


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9\u0080-￿]+"), lambda w: w != "")


def _seed(band: int) -> int:
    return (0x9E3779B97F4A7C15 * (band + 1)) % (1 << 63)


def _with_shingles(rows: DataFrame, text: str) -> DataFrame:
    """Adds _h, the hashes of all shingles in order; a text of one or two words has one shingle of those."""
    worded = rows.withColumn("_w", _words(F.col(text)))
    three = F.expr("transform(slice(_w, 1, greatest(size(_w) - 2, 0)), (w, i) -> xxhash64(w, get(_w, i + 1), get(_w, i + 2)))")
    few = F.when(F.size("_w") > 0, F.array(F.xxhash64(F.array_join("_w", " ")))).otherwise(F.array().cast("array<long>"))
    return worded.withColumn("_h", F.when(F.size("_w") >= SHINGLE, three).otherwise(few)).drop("_w")


def _with_windows(rows: DataFrame) -> DataFrame:
    """Adds _sig: for each window, the BANDS keys (min-hash mixed with its band)."""
    blocks = F.expr(f"if(size(_h) = 0, array(), transform(sequence(1, size(_h), {BLOCK}), s -> slice(_h, s, {BLOCK})))")
    mins = ", ".join(f"array_min(transform(b, x -> x ^ {_seed(i)}L))" for i in range(BANDS))
    both = ", ".join(
        f"least(get(_min, i)[{i}], coalesce(get(_min, i + 1)[{i}], {2**63 - 1}L)) ^ {(_seed(i) * 31) % (1 << 62)}L" for i in range(BANDS)
    )
    return (
        rows.withColumn("_blocks", blocks)
        .withColumn("_min", F.expr(f"transform(_blocks, b -> array({mins}))"))
        .withColumn("_sig", F.expr(f"transform(_min, (m, i) -> array({both}))"))
        .drop("_blocks", "_min")
    )


def template_table(spark: SparkSession, templates: Mapping[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """license, template (number), _h (distinct shingles), _sig (keys of each window)."""
    if sum(len(t) for v in templates.values() for t in v) > MAX_TEMPLATE_BYTES:
        raise ValueError("the templates are larger than a plan should hold")
    flat = [(name, text) for name, texts in sorted(templates.items()) for text in texts if re.search(r"\w", text)]
    rows = spark.createDataFrame([(n, i, t) for i, (n, t) in enumerate(flat)], "license string, template int, _text string")
    rows = _with_windows(_with_shingles(rows, "_text")).withColumn("_h", F.array_distinct("_h")).drop("_text")
    return rows


def scan_licenses(
    docs: DataFrame,
    templates: Mapping[str, tuple[str, ...]] = TEMPLATES,
    containment: float = CONTAINMENT,
    text: str = "text",
    keys: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """Per row of docs and license: keys, license, containment (best of its templates), first_word (of the region found).

    Null and empty texts hold no license. Rows that repeat all keys give one row for each license that any of them holds,
    with the best containment and the first place among them. Very long texts are scanned whole: one array of hashes
    each. An empty table gives no rows. Other columns of docs are not read; a key may not be named as an output column.
    """
    if {"license", "containment", "first_word"} & set(keys):
        raise ValueError("keys may not be named license, containment or first_word")
    spark = docs.sparkSession
    docs = docs.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col(text).alias("_text"))
    names, keys = keys, tuple(f"_key{i}" for i in range(len(keys)))
    known = template_table(spark, templates).collect()  # the templates are parameters, of bounded size
    if not known:
        none = docs.limit(0).select(*[F.col(k).alias(n) for k, n in zip(keys, names)])
        return none.selectExpr("*", "'' AS license", "0D AS containment", "0L AS first_word")
    longest = max(len(r["_h"]) for r in known)
    keyed = {(k, r["template"]) for r in known if len(r["_h"]) > FEW for window in r["_sig"] for k in window}
    few = {(r["_h"][0], r["template"]) for r in known if 0 < len(r["_h"]) <= FEW}
    wanted = sorted({k for k, _ in keyed})
    by_key = spark.createDataFrame(sorted(keyed), "_key long, template int")
    by_shingle = spark.createDataFrame(sorted(few), "_key long, template int")
    literal = lambda keys: ", ".join(f"{k}L" if k > -(2**63) else f"({k + 1}L - 1L)" for k in keys)
    listed = literal(wanted)
    worded = _with_shingles(docs.filter("_text IS NOT NULL"), "_text").drop("_text")
    # Equal min-hashes of a band are those of one shingle, so a text without any shingle of a template has no spot.
    shingles = literal(sorted({h for r in known for h in r["_h"]})) or "NULL"
    rows = _with_windows(worded.withColumn("_h", F.expr(f"if(exists(_h, h -> h IN ({shingles})), _h, slice(_h, 1, 0))")))
    by_windows = f"""transform(filter(transform(_sig, (s, i) -> struct(i, filter(s, k -> k IN ({listed or 'NULL'})) AS k)), x -> size(x.k) > 0),
        x -> struct(false AS single, x.k AS found, greatest(x.i * {BLOCK} - {longest}, 0) AS first,
            slice(_h, greatest(x.i * {BLOCK} - {longest}, 0) + 1, {2 * longest + 2 * BLOCK}) AS region))"""
    by_shingles = f"""transform(filter(transform(_h, (h, i) -> struct(h, i)), x -> x.h IN ({literal(sorted({k for k, _ in few})) or 'NULL'})),
        x -> struct(true AS single, array(x.h) AS found, x.i AS first, slice(_h, x.i + 1, {FEW}) AS region))"""
    spots = rows.withColumn("_spot", F.explode(F.expr(f"concat({by_windows}, {by_shingles})"))).select(*keys, "_spot.*")
    known_keys = by_key.withColumn("single", F.lit(False)).unionByName(by_shingle.withColumn("single", F.lit(True)))
    found = spots.withColumn("_key", F.explode("found")).join(F.broadcast(known_keys), ["single", "_key"])
    own = spark.createDataFrame([(r["template"], r["license"], r["_h"]) for r in known], "template int, license string, _h array<long>")
    share = F.size(F.array_intersect("region", "_h")) / F.size("_h")
    first = F.expr("array_min(transform(filter(transform(region, (x, i) -> struct(x, i)), y -> array_contains(_h, y.x)), y -> y.i))")
    return (
        found.withColumn("_region", F.xxhash64("region"))  # rows of one key with other texts are verified for themselves
        .dropDuplicates([*keys, "first", "template", "_region"])
        .join(F.broadcast(own), "template")
        .withColumn("share", share)
        .filter(F.col("share") >= containment)
        .withColumn("at", F.col("first") + first)
        .groupBy(*keys, "license")
        .agg(F.max("share").alias("containment"), F.min("at").cast("long").alias("first_word"))
        .select(*[F.col(k).alias(n) for k, n in zip(keys, names)], "license", "containment", "first_word")
    )
