"""License scans with DataFrame functions alone.

Templates and texts are cut into words (runs of letters and digits, lower-cased)
and shingles of K words, or of all its words for a template of fewer.  For a
template of n words, texts are read in windows of 2 n words that overlap by half,
so an occurrence lies whole in some window.  A window is a candidate if it holds
one of the template's picks: its min-hashes under BANDS seeded hash functions, one
row a band, and as many more shingles as make the picks meet any window that
contains enough of the template.  A band alone meets a window that contains a share
c of the template with probability c; the further picks make that certain.  Every
candidate is verified by exact shingle containment, so none is missed.

Everything happens within rows, and a hit takes only the words around it along;
only matches are shuffled, to keep the best one of each template and row.
Templates are a fixed, small list.

Defined results: null texts and templates without a word match nothing;
repeated rows and ids are reported each for itself (by a row number); other
columns are not read; no template gives no row.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

K, BANDS, CONTAINMENT = 5, 32, 0.8

#: License statements and notices to look for: (name, text).
TEMPLATES: list[tuple[str, str]] = [
    ("MIT (statement)", "Released under the MIT License."),
    ("Apache-2.0 (statement)", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0 (statement)", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0 (statement)", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0 (statement)", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0 (statement)", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0 (notice)", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD (statement)", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MIT (grant)", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."),
    ("Apache-2.0 (notice)", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL (notice)", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."),
    ("BSD (conditions)", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("Rights reserved (notice)", "All rights reserved."),
]


def _words(text):
    return F.array_remove(F.split(F.lower(text), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), "")


def _shingle_hashes(words, k: int):
    """One hash for each run of k words; none for fewer words."""
    return F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(1), F.size(words) - (k - 1)), lambda i: F.xxhash64(*(F.element_at(words, i + j) for j in range(k))))).otherwise(F.array().cast("array<bigint>"))


def min_hash(hashes, band: int):
    """The hash that is least under the band's hash function."""
    return F.array_min(F.transform(hashes, lambda x: F.struct(F.xxhash64(F.lit(band), x).alias("order"), x.alias("x"))))["x"]


def _found(hashes: str, values: list[int]):
    """(x, i): the hashes that are among the values, and where."""
    return F.filter(F.transform(hashes, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: s["x"].isin(values))


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, containment: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, containment (share of the template's shingles in the window) and window_start (its first word, from 0): the best window of each template in each row."""
    spark = docs.sparkSession
    named = [(i, name, text) for i, (name, text) in enumerate(TEMPLATES if templates is None else templates)]
    table = spark.createDataFrame(named, "template int, license string, text string").withColumn("w", _words("text")).where(F.size("w") > 0)
    table = table.withColumn("k", F.least(F.size("w"), F.lit(K)))
    hashes = F.coalesce(*(F.when(F.col("k") == k, _shingle_hashes(F.col("w"), k)) for k in range(1, K + 1)))
    table = table.select("template", "license", "k", F.size("w").alias("n"), F.array_distinct(hashes).alias("t"), F.array_distinct(_shingle_words(F.col("w"), F.col("k"))).alias("t_words"))
    table = table.withColumn("least", F.array(*(min_hash("t", band) for band in range(BANDS))))
    # Fixed and small: a row for each template, at most BANDS hashes of each and those that may be missing.
    picks, values, longest = [], {}, 0
    for r in table.collect():
        missing = len(r["t"]) - max(1, math.ceil(containment * len(r["t"]) - 1e-9))
        longest = max(longest, r["n"])
        for pick in set(r["least"]) | set(sorted(r["t"])[: missing + 1]):
            picks.append((r["template"], r["license"], r["k"], r["n"], r["t_words"], pick))
            values.setdefault(r["k"], set()).add(pick)
    out = "doc_id", "license", "containment", "window_start"
    rows = texts(docs, id_col, text_col)
    if not values:
        return rows.where("false").select("doc_id", F.lit("").alias("license"), F.lit(0.0).alias("containment"), F.lit(0).alias("window_start"))
    picks = spark.createDataFrame(picks, "template int, license string, k int, n int, t_words array<string>, pick bigint")
    rows = rows.withColumn("w", _words("text")).select("doc_id", F.monotonically_increasing_id().alias("row"), "w", *(_shingle_hashes(F.col("w"), k).alias(f"h{k}") for k in sorted(values)))
    found = F.concat(*(_found(f"h{k}", sorted(values[k])) for k in sorted(values)))
    # A hit at word i lies in windows that begin at i - 2 n + 1 or later and end at i + 2 n or before.
    around = F.transform(found, lambda s: F.struct(s["x"].alias("x"), s["i"].alias("i"), F.greatest(s["i"] - 2 * longest, F.lit(0)).alias("from")))
    around = F.transform(around, lambda s: F.struct(s["x"].alias("x"), s["i"].alias("i"), s["from"].alias("from"), F.slice("w", s["from"] + 1, F.lit(4 * longest)).alias("w")))
    # explode_outer: a filter on the array, which explode brings along, would be pushed down and hash each text for each word.
    hits = rows.select("doc_id", "row", around.alias("hits")).select("doc_id", "row", F.explode_outer("hits").alias("hit")).where("hit is not null")
    near = hits.join(F.broadcast(picks), F.col("hit.x") == F.col("pick"))
    # Windows of 2 n words begin at multiples of n; a hit lies in two of them.
    at = (F.col("hit.i") / F.col("n")).cast("int")
    near = near.select("doc_id", "row", "hit", "template", "license", "k", "n", "t_words", F.explode(F.array(at, at - 1)).alias("window")).where("window >= 0")
    near = near.withColumn("first", F.col("window") * F.col("n"))
    text = _shingle_words(F.slice("hit.w", F.col("first") - F.col("hit.from") + 1, 2 * F.col("n")), F.col("k"))
    near = near.withColumn("containment", F.size(F.array_intersect(F.col("t_words"), text)) / F.size("t_words")).where(F.col("containment") >= containment)
    best = near.groupBy("row", "template").agg(F.max(F.struct("containment", -F.col("first"))).alias("b"), F.first("doc_id").alias("doc_id"), F.first("license").alias("license"))
    return best.select("doc_id", "license", F.col("b.containment").alias("containment"), (-F.col("b.col2")).cast("int").alias("window_start")).select(*out)


def _shingle_words(words, k):
    return F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(1), F.size(words) - (k - 1)), lambda i: F.array_join(F.slice(words, i, k), " "))).otherwise(F.array().cast("array<string>"))
